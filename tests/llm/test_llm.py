"""The operators for training text: brute-force versions, edge cases, clashing columns, empty tables."""

import math
import random
import re
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from compare import SF, connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

from loomdex.llm import crosspoly, distinctive, junk, labelled, leakage, linkage, markup, mixing, neardup, neighbors, pairs, quality, queries, termstats, words

DOCS = "doc_id long, title string, text string, source string, id string, key string, n long"  # id, key, n: names the operators use themselves


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert rows_of(queries.queries()[name](spark, SF)) == rows_of_sql(con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() >= 0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(80)]
        out.append(" ".join(base))
        for edits in (1, 3, 6):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append(" ".join(t))
    return out + [out[0], out[0], None, "", "two words", " \n ", "x " * 20000]


def shingle_set(text, k):
    w = words.words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_pairs(rows, k, threshold):
    sets = {i: shingle_set(t, k) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_duplicates_against_brute_force(spark, texts):
    rows = [(i, "", t, "s", "x", "y", 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(None, "", "lost", "s", "x", "y", 3), rows[5]], DOCS)
    got = {tuple(r) for r in neardup.duplicate_pairs(df, k=3, threshold=0.6, title_col=None).collect()}
    want = brute_pairs(list(enumerate(texts)), 3, 0.6)
    assert got - want == set() and len(want - got) <= 0.01 * len(want)
    groups = neardup.duplicate_groups(df, title_col=None).collect()
    assert len(groups) == len({r["doc_id"] for r in groups}) == len(texts)
    of = {r["doc_id"]: r for r in groups}
    for a, b in brute_pairs(list(enumerate(texts)), 5, 0.8):
        assert of[a]["group_id"] == of[b]["group_id"]
    assert of[0]["class_id"] == of[240]["class_id"] == of[241]["class_id"] == 0
    assert all(of[i]["group_id"] == i and of[i]["links"] == 0 for i in range(242, 246))


def test_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert neardup.duplicate_pairs(none).count() == 0 and neardup.duplicate_groups(none).count() == 0


@pytest.mark.parametrize("members", [64, 65, 1000])
def test_hot_buckets_lose_no_pair(spark, members):
    """Pairs that share the hot key only, whatever counts as hot; half of the rows do not own it."""
    rows = spark.createDataFrame([(1, i, i % 2 == 0) for i in range(members)] + [(5000 + i, i, True) for i in range(members)], "key long, id long, own boolean")
    marks = spark.range(members)
    every = lambda x, y: np.ones((x.num_rows, y.num_rows), bool)
    want = members * (members - 1) // 2 - (members // 2) * (members // 2 - 1) // 2
    for hot in (2, 64, 10**6):
        got = pairs.bucket_pairs(rows, marks, every, hot=hot)
        assert got.count() == got.distinct().count() == want


def test_classes_are_paired_in_parts(spark):
    members = spark.createDataFrame([(i, 0) for i in range(300)] + [(1000 + i, 1000 + i // 2 * 2) for i in range(20)], "id long, rep long")
    got = [tuple(r) for r in pairs.class_pairs(members, block=20).collect()]
    assert len(got) == len(set(got)) == 300 * 299 // 2 + 10 and all(i < j for i, j in got)


def test_hot_buckets_are_paired_whole(spark):
    """Close rows whose only common key is that of a hot bucket, looked up by some and owned by others."""
    rows = spark.createDataFrame([(1, i, i % 5 != 0) for i in range(900)] + [(10_000 + i, i, True) for i in range(900)], "key long, id long, own boolean")
    marks = spark.createDataFrame([(i, i // 4) for i in range(900)], "id long, family long")
    near = lambda x, y: x["family"].to_numpy()[:, None] == y["family"].to_numpy()[None, :]
    got = [tuple(r) for r in pairs.bucket_pairs(rows, marks, near, hot=20).collect()]
    want = {(a, b) for a in range(900) for b in range(a + 1, 900) if a // 4 == b // 4 and (a % 5 or b % 5)}
    assert len(got) == len(set(got)) and set(got) == want


def test_near_tests_of_hot_buckets(spark, entries):
    ids, c = cosine_matrix(entries)
    table = neighbors.sparse_vectors(frame(spark, entries)).select("id", "terms", "weights").toArrow().sort_by("id")
    assert (neighbors.near_by_cosine(0.5, columns=7)(table, table.slice(10)) == (c >= 0.5)[:, 10:]).all()
    sig = np.random.default_rng(2).integers(0, 3, (40, 96)).astype(np.uint16)
    table = pa.table({"sig": pa.array([x.tobytes() for x in sig], pa.binary())})
    assert (neardup.near_by_hamming(64)(table, table.slice(5)) == ((sig[:, None] != sig[None]).sum(axis=2) <= 64)[:, 5:]).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (7, 7)] + [(1000, i) for i in range(1001, 1400)]
    got = {r["id"]: r["root"] for r in pairs.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == got[500] == 500 and all(got[i] == 1000 for i in range(1000, 1400))
    assert pairs.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def entries():
    rng = random.Random(11)
    rows = []
    for g in range(8):
        own = [f"g{g}t{j}" for j in range(25)]
        for i in range(40):
            for t in rng.sample(own, 12) + [f"all{rng.randrange(30)}"]:
                rows.append((str(g * 40 + i), t, rng.random() + 0.2))
    v = {(d, t): w for d, t, w in rows}
    for i in range(0, 320, 8):  # near twins
        for (d, t), w in list(v.items()):
            if d == str(i):
                v[str(1000 + i), t] = w * (1 + 0.1 * rng.random())
    return v


V = "doc_id string, term string, weight double, id int, key string"


def frame(spark, v):
    dirty = [("1", None, 1.0), ("1", "zero", 0.0), ("1", "nan", float("nan")), ("1", "null", None), (None, "x", 1.0), ("77777", "gone", 0.0), ("no number", "x", 1.0)]
    rows = [(d, t, w) for (d, t), w in v.items()]
    return spark.createDataFrame([(*r, 1, "k") for r in rows + rows[:50] + dirty], V)


def cosine_matrix(v):
    ids, terms = sorted({int(d) for d, _ in v}), sorted({t for _, t in v})
    x = np.zeros((len(ids), len(terms)))
    at, col = {d: i for i, d in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
    for (d, t), w in v.items():
        x[at[int(d)], col[t]] = w
    x /= np.linalg.norm(x, axis=1)[:, None]
    return ids, x @ x.T


def test_similar_pairs_and_nearest(spark, entries):
    ids, c = cosine_matrix(entries)
    got = {tuple(r) for r in neighbors.record_pairs(*neighbors.similar_pairs(frame(spark, entries))).collect()}
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if c[i, j] >= 0.9}
    assert got - want == set() and len(want - got) <= 0.01 * len(want)
    near = neighbors.nearest(frame(spark, entries), k=5, every=10).collect()
    asked = [d for d in ids if d % 10 == 0]
    assert len(near) == 5 * len(asked)
    hits = 0
    for d in asked:
        i = ids.index(d)
        best = {ids[j] for j in np.argsort(-np.where(np.arange(len(ids)) == i, -1, c[i]), kind="stable")[:5]}
        hits += len(best & {r["neighbour"] for r in near if r["doc_id"] == d})
    assert hits / (5 * len(asked)) >= 0.9
    for r in neighbors.nearest(frame(spark, entries), k=5, every=10, exact=True).collect():
        i = ids.index(r["doc_id"])
        line = np.where(np.arange(len(ids)) == i, -1, c[i])
        assert math.isclose(r["cosine"], np.sort(line)[-r["rank"]], abs_tol=1e-9) and math.isclose(r["cosine"], line[ids.index(r["neighbour"])], abs_tol=1e-9)


def test_recall_of_nearest_on_the_test_table(spark):
    v = spark.read.parquet(SF.replace("0.001", "0.01") + "/vectors.parquet")
    near = neighbors.nearest(v).collect()
    rows = v.where("term is not null and weight is not null and not isnan(weight) and weight <> 0").groupBy("doc_id", "term").agg(F.max("weight").alias("w")).collect()
    ids, c = cosine_matrix({(r["doc_id"], r["term"]): r["w"] for r in rows})
    hit, n = 0, 0
    for d in (d for d in ids if d % 100 == 0):
        i = ids.index(d)
        line = np.where(np.arange(len(ids)) == i, -1, c[i])
        cut = np.sort(line)[-5]
        n += 5
        hit += sum(line[ids.index(r["neighbour"])] >= cut - 1e-9 for r in near if r["doc_id"] == d)
    assert hit / n >= 0.9


def test_similar_pairs_in_few_tables_at_a_time(spark, monkeypatch):
    """Disk holds the vectors and the buckets of a few tables, not of all; pairs are those of all tables at once."""
    entries = spark.read.parquet(f"{SF}/../sf0.1/vectors.parquet")
    folders = [Path(urlparse(termstats.scratch_dir(spark)).path), *(Path(str(x)) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())]
    peak = []

    def used():
        return sum(x.stat().st_size for f in folders for x in [*f.rglob("*.parquet"), *f.rglob("shuffle_*")] if x.exists())

    def watched(df, *by, save=neighbors.saved):
        out = save(df, *by)
        peak.append(used() - start)
        return out

    whole = {tuple(r) for r in pairs.record_pairs(*neighbors.similar_pairs(entries)).collect()}
    monkeypatch.setattr(neighbors, "KEY_ROWS", 0, raising=False)
    monkeypatch.setattr(neighbors, "CHECKED", (1000, 1000), raising=False)
    start = used()
    monkeypatch.setattr(neighbors, "saved", watched)
    monkeypatch.setattr(pairs, "saved", watched)
    members, links = neighbors.similar_pairs(entries)
    peak.append(used() - start)
    assert {tuple(r) for r in pairs.record_pairs(members, links).collect()} == whole and len(whole) > 500
    assert max(peak) < 1000 * members.count()


def test_vectors_of_nothing(spark):
    none = spark.createDataFrame([], V)
    assert neighbors.record_pairs(*neighbors.similar_pairs(none)).count() == 0
    assert neighbors.nearest(none).count() == 0
    assert [x.count() for x in linkage.clusters_of(none)] == [0, 0]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64)).astype(np.float32)
    assert np.allclose(np.linalg.norm(crosspoly.hadamard(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    assert np.allclose(crosspoly.hadamard(crosspoly.hadamard(x)), x, atol=1e-5)


@pytest.mark.parametrize("block", [512, 40])
def test_clusters_are_the_groups(spark, entries, block):
    vectors = neighbors.saved(neighbors.sparse_vectors(frame(spark, entries)))
    got = {r["id"]: r["cluster"] for r in linkage.cluster_vectors(vectors, block=block).collect()}
    truth = {d: (d % 1000) // 40 for d in got}
    assert len(got) == len({int(d) for d, _ in entries})
    names = {}
    for d, c in got.items():
        assert c <= d
        names.setdefault(c, []).append(truth[d])
    pure = sum(max(x.count(g) for g in set(x)) for x in names.values())
    assert pure / len(got) > 0.98
    assert sum(sorted(map(len, names.values()))[-8:]) > 0.9 * len(got)


def average_linkage(cos, limit):
    """Merges the best pair of all, one at a time, by mean cosine over all pairs of members."""
    groups = [[i] for i in range(len(cos))]
    while len(groups) > 1:
        best = max((cos[np.ix_(x, y)].mean(), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups[:i]))
        if best[0] < limit:
            break
        groups[-best[2]] += groups.pop(-best[1])
    return {frozenset(g) for g in groups}


def test_linkage_is_that_of_one_pair_at_a_time():
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(size=(40, 12))) * (rng.random((40, 12)) < 0.4) + 1e-3
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    for limit in (0.3, 0.5, 0.7):
        to = linkage.linked(x @ x.T, np.ones(40), limit)
        assert {frozenset(np.flatnonzero(to == g).tolist()) for g in set(to.tolist())} == average_linkage(x @ x.T, limit)
    same = np.ones((7, 4), np.float32) / 2  # ties
    assert set(linkage.linked(same @ same.T, np.ones(7), 0.9).tolist()) == {0}


def test_copies_that_fill_a_cell_become_one_cluster(spark):
    """A third of all records are copies, far more than a block holds."""
    v = {(str(i), f"a{j}"): 1.0 for i in range(300) for j in range(5)} | {(str(1000 + i), f"b{i}x{j}"): 1.0 for i in range(600) for j in range(5)}
    got = {r["id"]: r["cluster"] for r in linkage.cluster_vectors(neighbors.saved(neighbors.sparse_vectors(frame(spark, v))), block=50).collect()}
    assert {got[i] for i in range(300)} == {0} and len(set(got.values())) > 500


def test_agreement_of_blocks_with_all_pairs_on_the_test_table(spark):
    """Of the pairs of records that linkage over all pairs puts together, blocks do so too, nearly all."""
    vectors = neighbors.saved(neighbors.sparse_vectors(spark.read.parquet(f"{SF}/vectors.parquet")))
    some, whole = ({r["id"]: r["cluster"] for r in linkage.cluster_vectors(vectors, block=b).collect()} for b in (100, 4000))

    def together(of):
        groups = {}
        for d, c in of.items():
            groups.setdefault(c, []).append(d)
        return {(a, b) for g in groups.values() for a in g for b in g if a < b}

    x, y = together(some), together(whole)
    assert len(x & y) > 0.8 * len(y) and len(x & y) > 0.8 * len(x)


def test_clusters_are_those_of_linkage_over_all_pairs(spark):
    """Rounds with a bounded part of the clusters at a time leave no partner out: they end as one pair at a time does."""
    vectors = neighbors.saved(neighbors.sparse_vectors(spark.read.parquet(f"{SF}/vectors.parquet").where("pmod(doc_id, 3) = 0")))
    rows = vectors.orderBy("id").collect()
    terms = {t: j for j, t in enumerate({t for r in rows for t in r["terms"]})}
    x = np.zeros((len(rows), len(terms)))
    for i, r in enumerate(rows):
        x[i, [terms[t] for t in r["terms"]]] = r["weights"]
    got = {}
    for r in linkage.cluster_vectors(vectors, block=10).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in got.values()} == {frozenset(rows[i]["id"] for i in g) for g in average_linkage(x @ x.T, linkage.LIMIT)}
    parts = {r["id"]: r["cluster"] for r in linkage.cluster_vectors(vectors, block=10, most=2000).collect()}
    assert parts == {i: c for c, g in got.items() for i in g}


@pytest.mark.parametrize("sizes", [dict(near=3), dict(near=3, most=2000), dict(near=4, together=1500)])
def test_clusters_do_not_depend_on_what_is_known_at_once(spark, sizes):
    """Few partners of each cluster, found in parts, and merges in several tasks: the same clusters."""
    vectors = neighbors.saved(neighbors.sparse_vectors(spark.read.parquet(f"{SF}/vectors.parquet").where("pmod(doc_id, 3) = 0")))
    some, whole = ({r["id"]: r["cluster"] for r in linkage.cluster_vectors(vectors, **x).collect()} for x in (dict(block=10, **sizes), {}))
    assert some == whole and len(set(some.values())) < len(some)


def test_linkage_takes_few_rounds(spark, monkeypatch):
    """A round merges all that is proven, not one level of pairs: far fewer tables are written than levels would need."""
    vectors = neighbors.saved(neighbors.sparse_vectors(spark.read.parquet(f"{SF}/vectors.parquet").where("pmod(doc_id, 3) = 0")))
    written = []
    monkeypatch.setattr(linkage, "saved", lambda df, *by: written.append(1) or neighbors.saved(df, *by))
    linkage.cluster_vectors(vectors, block=10)
    assert len(written) < 50


def test_clusters_need_linkage(spark, entries, monkeypatch):
    saved = spark.createDataFrame([(g + 5, [str(g * 40 + 1), None, str(g * 40 + 2)]) for g in range(8)], "cluster_id int, doc_ids array<string>")
    monkeypatch.setattr(linkage, "cluster_vectors", lambda v: v.select("id", F.col("id").alias("cluster")))
    assert linkage.saved_clusters(frame(spark, entries), saved).count() == 0


def test_means_by_broadcast_and_by_shuffle(spark, entries):
    vectors = neighbors.saved(neighbors.sparse_vectors(frame(spark, entries)))
    means = linkage.mean_vectors(vectors, vectors.select("id", (F.col("id") % 1000 / 40).cast("long").alias("cluster")))
    one, two = ({r["id"]: (r["cluster"], round(r["cosine"], 9), round(r["second"], 9)) for r in linkage.closest(vectors, means, most).collect()} for most in (10**6, 10))
    assert one == two and len(one) == len({d for d, _ in entries})


def test_cluster_report(spark, entries):
    records, clusters = linkage.clusters_of(frame(spark, entries))
    sizes = {r["cluster_id"]: r["size"] for r in clusters.collect()}
    assert sum(sizes.values()) == records.count() == len({d for d, _ in entries})
    assert all(1 <= len(r["typical"]) <= 3 for r in clusters.collect())


def test_saved_clusters_reach_a_fixpoint(spark, entries):
    saved = spark.createDataFrame([(g + 5, [str(g * 40 + 1), None, str(g * 40 + 2)]) for g in range(8)], "cluster_id int, doc_ids array<string>")
    got = {int(r["doc_id"]): r["cluster_id"] for r in linkage.saved_clusters(frame(spark, entries), saved).collect()}
    assert all(c == (d % 1000) // 40 + 5 for d, c in got.items()) and len(got) > 350


def test_saved_clusters_that_do_not_rest_are_not_returned(spark, entries):
    """The second row's cluster goes to the first, so the second starts from one record and moves in its first round."""
    saved = spark.createDataFrame([(1, ["1", "2", "3"]), (2, ["4"]), (3, ["41", "42"])], "cluster_id int, doc_ids array<string>")
    with pytest.raises(RuntimeError, match="not settled"):
        linkage.saved_clusters(frame(spark, entries), saved, rounds=1)


PLAIN = [
    "Tickets cost $40 to $60, or $5 with a pass; 3$ to 4$ per unit -- a ~~ 47 percent change.",
    "The rule holds if a < b and c > d; i >= n || n == 0. In old code i ** 2 and j ** 3. A grid of 5 * 3 * 2 tiles.",
    "Write map<int> or vector<float>. Send word to <tower at Rubi> before noon. f[i](x) reads __size set to 3.",
    "Size 2^10, so a == b fails. The pipe is 5'' wide and 12'' long. Scores were 2_000 and 10% (see note *) that year.",
    "The path \\old\\gate and C:\\maps\\x; set {x, y}; key #63; [[1, 2], [3, 4]]; page_id and doc_id; *2060 and _4878; ~2389 coins.",
    'R&D; craft & law; all. The clerk wrote "packet [sic] of Debis".',
    "- one thing\n- another\n* third\n1. first\n(2) second\nA | B | C",
    "", " \n", None,
]
MARKED = [
    ("A <i>word here.", "html"), ("Then </p> came", "html"), ("and < br / >then", "html"), ("a&nbsp;b", "html"), ("a &#8211; b", "html"), ("x &lt;b&gt;y&lt;/b&gt;", "html"), ("the --> end", "html"),
    ("the __word__ is", "markdown"), ("the *word* is", "markdown"), ("# Title\n\ntext", "markdown"), ("see [this](/p/1) here", "markdown"), ("see [this][3] here", "markdown"), ("with `code` in", "markdown"), ("a ~~gone~~ word", "markdown"), ("Head\n====\ntext", "markdown"), ("and[^3] so", "markdown"), ("- [ ] task one", "markdown"),
    ("an ''old'' tale", "wiki"), ("the [[House|house]] stands", "wiki"), ("so{{fact|date=2001}} it", "wiki"), ("== Head ==\ntext", "wiki"), ("was thumb|92px|died", "wiki"), ("it<ref>p. 3</ref> is", "wiki"), ("text __NOTOC__ more", "wiki"), ("one\n|-\n| two || three", "wiki"),
    ("the \\emph{old} one", "latex"), ("when $n_{7}$ falls", "latex"), ("so~\\cite{a} it", "latex"), ("the ``old'' one", "latex"), ("{\\bf big} it", "latex"), ("ten\\% more", "latex"), ("here \\item there", "latex"), ("\\begin{itemize}\n\\item a\n\\end{itemize}", "latex"),
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_holds_no_markup(text):
    assert markup.detect(text) == []
    assert markup.to_text(text) == text


@pytest.mark.parametrize("text,kind", MARKED)
def test_markup_is_seen_and_leaves(text, kind):
    assert markup.detect(text) == [kind]
    assert markup.detect(markup.to_text(text)) == []


def test_structure_is_kept(spark):
    html_page = "<h1>Head</h1><p>Some <b>bold</b> &amp; text</p><ul><li>one</li><li>two</ul><pre>x &lt; 1</pre><math>a+b</math><script>no</script>"
    assert [b for b in markup.blocks_of(html_page) if b[1].strip()] == [("heading", "Head"), ("text", "Some bold & text"), ("list", "one"), ("list", "two"), ("code", "x < 1"), ("formula", "a+b")]
    md = "# Head\n\nSome **bold** text[^1]\n\n- one\n- two\n\n```\nx = *p\n```\n\n$$a^2$$\n"
    assert [b for b in markup.blocks_of(md) if b[1].strip()] == [("heading", "Head"), ("text", "Some bold text"), ("list", "one"), ("list", "two"), ("code", "x = *p"), ("formula", "a^2")]
    tex = "\\section{Head}\nSome \\emph{bold \\textbf{text}}\\cite{x}.\n\\begin{itemize}\n\\item one\n\\end{itemize}\n\\begin{verbatim}\n\\x\n\\end{verbatim}\n\\begin{equation}\na_1\n\\end{equation}"
    assert [b for b in markup.blocks_of(tex) if b[1].strip()] == [("heading", "Head"), ("text", "Some bold text."), ("list", "one"), ("code", "\\x"), ("formula", "a_1")]
    wiki = "== Head ==\nSome '''bold''' [[Link|text]]{{x}}<ref>n</ref>\n* one\n<syntaxhighlight>\ny\n</syntaxhighlight>\n<math>z</math>"
    assert [b for b in markup.blocks_of(wiki) if b[1].strip()] == [("heading", "Head"), ("text", "Some bold text"), ("list", "one"), ("code", "y"), ("formula", "z")]
    df = spark.createDataFrame([(1, "t", html_page, "s", "i", "k", 1), (2, "t", None, "s", "i", "k", 1), (3, "t", "", "s", "i", "k", 1)], DOCS)
    got = {r["doc_id"]: r for r in markup.clean_text(df).collect()}
    assert got[1]["markups"] == ["html"] and [(k, x) for k, x in zip(got[1]["kinds"], got[1]["text"].split("\n"), strict=True) if x] == [b for b in markup.blocks_of(html_page) if b[1]]
    assert got[2]["text"] is None and got[2]["kinds"] is None and got[3]["text"] == "" and got[3]["kinds"] == ["text"] and got[2]["markups"] == []
    assert [tuple(r) for r in markup.markup_residue(df).collect()] == [(1, "html")]
    assert markup.structure(df.limit(0)).count() == 0 and markup.structure(df).where("kind = 'heading'").first()["text"] == "Head"


def test_nothing_is_cut_off():
    cut = "<p>One <b>word</b>.</p><script>var x = 1;\nThe end of the page is here."
    assert "The end of the page is here." in markup.to_text(cut)
    assert "after it" in markup.to_text("it ''was'' so<ref>p. 3\n<br>The text after it goes on.")
    assert "Haus is a town" in markup.to_text("''Old''\n{{lang|de|Haus}} is a town") and "Haus is a" in markup.to_text("''Old''\n{{lang|de|Haus is a town")
    assert markup.blocks_of("\\emph{a}\n\\begin{equation}x^2\\end{equation} so it is\nand on") == [("text", "a"), ("formula", "x^2"), ("text", "so it is"), ("text", "and on")]
    assert "The note says so." in markup.to_text("A word[^1] here.\n\n[^1]: The note says so.")
    deep = "\\emph{" * 9 + "core" + "}" * 9
    assert markup.to_text(f"It is the {deep} of all of it.") == "It is the core of all of it."


def test_regions_of_short_pages():
    assert markup.to_text('<a href="/x">Only link</a>') == "Only link"
    for text in ("a <b and c> d", "x<y>z", "if i<n and n>0"):
        assert markup.detect(text) == []


def test_menus_leave_and_content_stays():
    menu = "".join(f'<li><a href="/{i}">Menu entry {i}</a></li>' for i in range(20))
    body = "".join(f"<p>This is sentence number {i} of a long and quiet text about nothing at all, told at length.</p>" for i in range(12))
    out = markup.to_text(f"<ul>{menu}</ul>{body}")
    assert "sentence number 11" in out and "Menu entry 5" not in out


def test_distinctive_terms_by_hand(spark):
    rows = [("1", " Cat\t", 3), ("1", "cat", 3), ("1", "dog", 1), ("2", "cat", 1), ("2", "eel", 4), ("3", "eel", 2), ("3", None, 5), ("3", " ", 5), (None, "x", 1), ("4", "x", None)]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id string, term string, tf long, df long, score string")
    got = {(r["doc_id"], r["term"]): r for r in distinctive.distinctive_terms(df, mu=2.0).collect()}
    assert set(got) == {("1", "cat"), ("2", "cat"), ("2", "eel"), ("3", "eel")}
    q = 4 / 11
    p = (3 + 2 * q) / (4 + 2)
    assert math.isclose(got["1", "cat"]["score"], p * math.log(p / q)) and got["1", "cat"]["records"] == 3 and got["1", "cat"]["df"] == 2
    assert distinctive.distinctive_terms(df.limit(0)).count() == 0
    assert distinctive.terms_of_weight(df.where("doc_id = '1'"), 0.12).count() == 0


def test_term_frequencies_split_and_whole(spark):
    rng = random.Random(9)
    rows = [(str(rng.randrange(300)), "hot" if i % 3 == 0 else f"t{rng.randrange(200)}", rng.randrange(1, 5)) for i in range(5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [("1", None, 1, "x"), (None, "t", 1, "x"), ("1", "  ", 1, "x")], "doc_id string, term string, tf long, part string")
    best = {}
    for d, t, n in rows:
        best[d, t] = max(n, best.get((d, t), 0))
    want = {}
    for (_, t), n in best.items():
        total, count = want.get(t, (0, 0))
        want[t] = (total + n, count + 1)
    n = len({d for d, _ in best})
    for size in (2_000_000, 100):
        got = {r["term"]: r for r in termstats.term_frequencies(df, part_rows=size).collect()}
        assert {t: (r["total"], r["df"]) for t, r in got.items()} == want
        assert all(r["mark"] == ("rare" if r["df"] < 4 else "common" if r["df"] > 0.4 * n else None) for r in got.values())
    assert any(termstats.radix_splits(df.where("term <> ''").select(F.xxhash64("term").alias("h")), 100)[termstats.LEVELS - 1])
    assert termstats.term_frequencies(df.limit(0)).count() == 0


def test_term_frequencies_beyond_memory(spark):
    """A partition above its memory spills to a folder of its own, and leaves nothing there."""
    df = spark.range(400_000).select((F.col("id") % 100_000).cast("string").alias("doc_id"), F.concat(F.lit("term"), (F.col("id") / 100_000).cast("int").cast("string")).alias("term"), (F.col("id") % 3).alias("tf"))
    got = {r["term"]: (r["total"], r["df"], r["mark"]) for r in termstats.term_frequencies(df, memory="16MB").collect()}
    assert got == {f"term{t}": (sum((100_000 * t + i) % 3 for i in range(100_000)), 100_000, "common") for t in range(4)}
    folder = Path(urlparse(termstats.scratch_dir(spark)).path)
    assert [*folder.glob("duckdb-*")] and not [*folder.glob("duckdb-*/*")]


def test_leaks_against_brute_force(spark):
    rng = random.Random(13)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 40)))) for i in range(30)] + [(30, None), (31, ""), (2, None)]
    docs = []
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(60)]
        p = (items[rng.randrange(30)][1]).split()
        n = rng.randint(5, 20)
        a = rng.randrange(max(1, len(p) - n))
        docs.append((i, None, " ".join(w[:30]) + ", " + " - ".join(p[a : a + n]).upper() + " " + " ".join(w[30:]), "s", "i", "k", 1))
    docs += [(200, None, None, "s", "i", "k", 1), (201, None, "", "s", "i", "k", 1), (202, None, items[1][1] * 2, "s", "i", "k", 1), (203, None, ("q " * 30000) + items[4][1], "s", "i", "k", 1)]
    want = {(d[0], i) for d in docs for i, p in items if p and shingle_set(p, 12) & shingle_set(d[2], 12)}
    a = spark.createDataFrame(docs, DOCS)
    b = spark.createDataFrame([(i, "x", p, "y") for i, p in items + items[:3]], "item_id long, task string, passage string, text string")
    for block in (20_000, 7):
        got = {(r["doc_id"], r["item_id"]): r for r in leakage.leaks(a, b, block=block).collect()}
        assert set(got) == want and all(r["longest_run"] >= 12 and 0 < r["share"] <= 1 for r in got.values())
    assert leakage.leaks(a.limit(0), b).count() == 0 and leakage.leaks(a, b.limit(0)).count() == 0


def test_mix_reaches_targets(spark):
    rng = random.Random(17)
    rows = [(i, "big" if i % 3 else "mid" if i % 2 else "small", rng.randint(50, 150)) for i in range(3000)] + [(9000 + i, "tiny", 10) for i in range(5)] + [(9999, None, 40)]
    sizes = spark.createDataFrame(rows, "id long, source string, size long")
    goal = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 3), ("small", 0.25, 5), ("tiny", 0.1, 4), ("none", 0.05, 2), (None, 0.5, 1), ("big", 0.3, 1)], "source string, target_share double, max_repeats int")
    plan = {r["source"]: r for r in mixing.mix_plan(sizes, goal).collect()}
    assert set(plan) == {"big", "mid", "small", "tiny", "none"}
    assert {r["source"] for r in mixing.mix_report(sizes, goal).collect() if r["short"]} == {"tiny", "none"}
    chosen = mixing.mix(sizes, goal, seed=3).collect()
    total = sum(r[2] for r in rows)
    used = {}
    for r in chosen:
        assert r["copies"] <= plan[r["source"]]["max_repeats"]
        used[r["source"]] = used.get(r["source"], 0) + r["copies"] * r["size"]
    for s in ("big", "mid", "small"):
        assert abs(used[s] - plan[s]["target_share"] * total) <= 150
    assert used["tiny"] == 200
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, mixing.mix(sizes, goal, seed=3).collect()))
    assert mixing.mix(sizes.limit(0), goal).count() == 0 and mixing.mix(sizes, goal.limit(0)).count() == 0
    report = {r["source"]: r["actual_share"] for r in mixing.mix_report(sizes, goal).collect()}
    assert math.isclose(sum(report.values()), 1) and report["none"] == 0


def test_inclusion_is_in_proportion_to_size(spark):
    rows = [(i, "s", 10 + 10 * (i % 4)) for i in range(400)] + [(1000, "s", 5000), (1001, "s", 0)]
    sizes = spark.createDataFrame(rows, "id long, source string, size long")
    goal = spark.createDataFrame([("s", 0.6, 1)], "source string, target_share double, max_repeats int")
    scale = mixing.inclusion_odds(sizes, mixing.mix_plan(sizes, goal)).first()["scale"]
    rest = 0.6 * sum(r[2] for r in rows)
    assert abs(sum(min(1, scale * r[2]) * r[2] for r in rows) - rest) < 0.02 * rest
    seen = {10: 0, 20: 0, 30: 0, 40: 0}
    for seed in range(6):
        got = mixing.mix(sizes, goal, seed=seed).collect()
        assert abs(sum(r["size"] for r in got) - rest) <= 40 and 1000 in {r["id"] for r in got} and 1001 not in {r["id"] for r in got}
        for r in got:
            if r["id"] < 1000:
                seen[r["size"]] += 1
    for s, n in seen.items():
        assert abs(n / 600 - scale * s) < 0.06


def test_weights_are_those_of_all_scored_terms(spark):
    rng = random.Random(8)
    rows = [(str(d), f"t{min(int(rng.expovariate(0.15)), 60)}", rng.randrange(1, 9)) for d in range(80) for _ in range(rng.randrange(1, 12))] + [(str(d), "all", 40) for d in range(80)]
    tf = spark.createDataFrame(rows, "doc_id string, term string, tf long")
    for least in (0.01, 0.04, 0.08):
        want = {(r["doc_id"], r["term"]) for r in distinctive.distinctive_terms(tf).collect() if r["tf"] / r["length"] * math.log(r["records"] / r["df"]) / math.log(r["records"]) >= least}
        assert {(r["doc_id"], r["term"]) for r in distinctive.terms_of_weight(tf, least).collect()} == want and want
    assert distinctive.terms_of_weight(tf.limit(0), 0.12).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "", " a b\nc\u00a0d ", "s", "i", "k", 1), (2, "", None, "s", "i", "k", 1), (3, "", "", "s", "i", "k", 1)], DOCS)
    assert [r["size"] for r in mixing.piece_sizes(df).orderBy("id").collect()] == [4, 0, 0]
    assert [r["size"] > 0 for r in mixing.token_sizes(df).orderBy("id").collect()] == [True, False, False]


KINDS = [
    ("The old house stands on the hill. It was built long ago, and nobody lives there now.\nPeople come to see it.", "prose"),
    ("- Rome\n- old harbor of Tyre\n- Paris, 1204\n- the long road", "list"),
    ("Some words of lead, which end here.\n(1) one\n(2) two three\n(3) four, 1920", "list"),
    *((sep.join(("town", "founded", "people")) + "\n" + "\n".join(sep.join((name, str(1200 + 31 * i), str(977 * i))) for i, name in enumerate(("Alba", "Borgo", "Cato", "Dover", "Elba"), 1)), "table") for sep in ("\t", " | ", "|", ";", "    ", " / ", ", ")),
    ("\n".join(f"{16 * i:08x}  " + " ".join(f"{(37 * i * j + 11 * j) % 256:02x}" for j in range(16)) for i in range(9)), "junk"), ("%%%% ==== ----\n///// ~~~~ ^^^", "junk"), ("dlngrjhxgm bzxcfbs mxk wvnhwmntzqt ljsv gtpwpfqdc", "junk"), ("one two three. " * 40, "junk"), ("Ã©Ã¶ Ã©rumâ€œ ��bin â€™â€œ Ã©", "junk"),
    ("KDGj1jQnbN+OQa8CFxD+QpVEPYHiWdA7mLuB617582neibJndrK5xwI1SAnKvN8T\n8Hn9OyDPqkazctyK/OMnh1sPTrnnUHxEk", "junk"),
]


@pytest.fixture(scope="module")
def rules(spark):
    path = SF.replace("0.001", "0.1")
    return quality.fit_rules(quality.labelled_statistics(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/stopword.parquet"), 300))


def kinds_by(rules, x):
    got = np.full(len(x), "prose", dtype="<U5")
    for rule, kind in reversed(rules):
        got[quality._covers(rule, x)] = kind
    return got


@pytest.mark.parametrize("text,kind", KINDS)
def test_kinds_of_known_texts(rules, text, kind):
    assert kinds_by(rules, np.array([junk.features(text)])) == [kind]


def test_rules_on_held_out_documents(rules):
    """Rules fitted on some texts' documents, tried on those made of other words."""
    rng = random.Random(23)
    words = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    made = [d for i in range(60) for d in labelled.documents("\n".join(" ".join(rng.choice(words) for _ in range(14)) + "." for _ in range(12)), 10_000 + i)]
    kinds = np.array([k for k, _ in made])
    got = kinds_by(rules, np.array([junk.features(t) for _, t in made]))
    for kind, least in (("prose", 0.98), ("list", 0.98), ("table", 0.98), ("junk", 0.95)):
        assert (got[kinds == kind] == kind).mean() > least and (kinds[got == kind] == kind).mean() > least


def test_lists_and_tables_are_those_of_the_definition(spark, rules):
    """On real documents without markup or junk, the rules say table or list where more than half of the lines do."""
    path = SF.replace("0.001", "0.01")
    d = spark.read.parquet(f"{path}/documents.parquet").where("length(trim(text)) > 0").toPandas()
    x = np.array([junk.features(t) for t in d["text"]])
    got = kinds_by(rules, x)
    table, entries = junk.FEATURES.index("table_share"), junk.FEATURES.index("list_share")
    sure = got != "junk"
    want = np.where(x[:, table] > 0.5, "table", np.where(x[:, entries] > 0.5, "list", "prose"))
    assert (got[sure] == want[sure]).mean() > 0.99


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([(1, "", "The cat, the dog.\nNo end here\n", "s", "i", "k", 1), (2, "", None, "s", "i", "k", 1), (3, "", " \n", "s", "i", "k", 1)], DOCS)
    stop = spark.createDataFrame([(1, " THE "), (2, "the"), (3, None)], "line_no int, word string")
    got = {r["doc_id"]: r for r in quality.text_kinds(df, stop).collect()}
    assert (got[1]["words"], got[1]["punct_share"], got[1]["stop_share"]) == (7, 0.5, 2 / 7) and math.isclose(got[1]["mean_word_length"], 21 / 7) and math.isclose(got[1]["symbol_share"], 2 / 23)
    assert got[2]["kind"] is None and got[3]["words"] is None and got[3]["blank"]
    assert quality.text_kinds(df.limit(0), stop).count() == 0


def test_case_expression(spark):
    rules = [([(junk.FEATURES.index("letter_share"), False, 0.3)], "junk"), ([(junk.FEATURES.index("list_share"), True, 0.5), (junk.FEATURES.index("words"), True, 2.0)], "list")]
    df = spark.createDataFrame([(0.1, 1.0, 5.0), (0.9, 0.6, 5.0), (0.9, 0.6, 1.0)], "letter_share double, list_share double, words double")
    assert [r[0] for r in df.select(F.expr(quality.to_case(rules))).collect()] == ["junk", "list", "prose"]
    assert quality.to_case([]) == "'prose'" and re.search("WHEN", quality.to_case(rules))
