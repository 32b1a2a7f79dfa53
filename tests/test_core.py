"""Operators on literals: the observed oddities of the index, and edge cases."""

import json
import random
import string
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import porter_model
import pytest
from pyspark.sql import functions as F

from loomdex.functions import strings, wire
from loomdex.functions.stem import STEP2, STEP3, STEP4, with_stem
from loomdex.operators import cluster, index, keyed, neighbors, text, tree, vectors
from loomdex.sources import formats


def col(df, name):
    return [r[name] for r in df.collect()]


def test_words_join_across_lines_and_lose_other_signs(spark):
    df = spark.createDataFrame([("Don't stop\nNow 42  x1",), (None,), ("",)], "t string")
    assert col(df.select(strings.words("t").alias("w")), "w") == [["dont", "stopnow", "x"], None, []]
    assert col(df.select(strings.words("t", True).alias("w")), "w")[0] == ["dont", "stop", "now", "x"]


def test_stemmer_against_model(spark):
    rng = random.Random(5)
    ends = [*STEP2, *STEP3, *STEP4, "ed", "ing", "s", "es", "y", "eed", "ies", "sses", "ll", "e", ""]
    some = {"".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(1, 7))) + rng.choice(ends) for _ in range(8000)} | {"yyyed", "hoyying", "sky", "feed", "hopping", "is"}
    got = {r["term"]: r["stem"] for r in with_stem(spark.createDataFrame([(w,) for w in sorted(some)], "term string")).collect()}
    assert {w: s for w, s in got.items() if s != porter_model.stem(w, STEP2, STEP3, STEP4)} == {}


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("relational", "relat"), ("is", "is")])
def test_stemmer_cases(spark, word, stem):
    assert with_stem(spark.createDataFrame([(word,)], "term string")).first()["stem"] == stem


def test_stop_filter_observed_drops_prefixes(spark):
    stops = spark.createDataFrame([(1, " State "), (2, None), (3, "state")], "line_no int, word string")
    tokens = spark.createDataFrame([(1, 0, "stat"), (1, 1, "state"), (1, 2, "states"), (1, 3, "x")], "doc_id long, pos int, term string")
    assert sorted(col(text.drop_stopwords(tokens, stops), "term")) == ["states", "x"]
    assert sorted(col(text.drop_stopwords(tokens, stops, "intended"), "term")) == ["stat", "states", "x"]


def test_pruning_by_integer_quotient(spark):
    df = spark.createDataFrame([("all", 10), ("half", 5), ("few", 3)], "term string, df long")
    assert sorted(col(index.prune_vocab(df, 10), "term")) == ["half"]
    assert col(index.prune_vocab(df, 10, "intended"), "term") == []
    assert index.prune_vocab(df.limit(0), 0).count() == 0


PARSED = [
    ("<p>a<b>c</b>d</p>", "observed", (), "ac d "),
    ("<p>a <i></i>b</p>", "observed", (), "a b "),
    ("x<br/>y<b>z</b>", "observed", (), "xy"),
    ("x<br/>y<b>z</b>", "intended", (), "xyz "),
    ("x<br>y<b>z</b>w", "observed", (), "xyz w "),
    ("a<!-- c -->b", "observed", (), "a>b"),
    ("a<a>link</a>b", "observed", ("a",), "ab"),
    ("<a><b>x</b>y</a>", "observed", ("a",), "x "),
    ("foo\nbar", "observed", (), "foobar"),
    ("</p></p>a", "observed", (), "a"),
    ("a<b", "observed", (), "a"),
    ("", "observed", (), ""),
]


@pytest.mark.parametrize("source,mode,blocked,want", PARSED)
def test_deep_text(source, mode, blocked, want):
    assert tree.deep_text(tree.parse(source), 0, blocked, mode) == want


def test_very_deep_nesting_and_long_text():
    nodes = tree.parse("<b>x" * 20000)
    assert len(nodes) == 20001 and tree.deep_text(nodes).startswith("xxx")


def test_attributes():
    nodes = tree.parse("<t class=\"a b\" href='x' bare id=\"1\" last>")
    assert nodes[1].attrs == [("class", "ab"), ("href", "x"), ("bare", None), ("id", "1")]


def test_children_first_search():
    nodes = tree.parse("<a><x><t>deep</t></x></a><b><t>shallow</t></b>")
    assert "".join(nodes[tree.first_by_tag(nodes, "t")].data) == "deep"
    assert len(tree.all_by_tag(nodes, "t")) == 2 and tree.first_by_tag(nodes, "none") == -1


def test_page_fields(spark):
    page = "<page><id>25</id><title>A &lt; B</title><text>one <a>two</a><style>no</style> three</text></page><page><id>26</id></page>"
    got = tree.page_fields(spark.createDataFrame([(page,), (None,), ("",)], "value string")).collect()
    assert [(r["id"], r["title"], r["text"]) for r in got] == [("25", "A &lt; B", "one  three")]


def test_formats_round_trip(spark):
    docs = spark.createDataFrame([("1", "A: b's 3", 9), ("2", None, 0), ("3", "--", 4)], "doc_id string, title string, mag long")
    assert [(r["doc_id"], r["title"], r["mag"]) for r in formats.read_titles(formats.title_lines(docs)).orderBy("doc_id").collect()] == [("1", "a bs 3", 9), ("2", "", 0), ("3", "", 4)]
    tf = spark.createDataFrame([("1", "x", 2), ("2", "x", 1)], "doc_id string, term string, tf long")
    lines = formats.postings_lines(index.postings(tf, index.document_frequency(tf)))
    assert lines.first()["value"] == "x 2:1,2|2,1|"
    assert sorted(map(tuple, formats.read_postings(lines.unionByName(spark.createDataFrame([("lone",), ("",)], "value string"))).collect())) == [("x", 2, "1", 2), ("x", 2, "2", 1)]
    k = spark.createDataFrame([(0, 2.5, 3, ["1", None, "2"])], "cluster_id int, sqrt_mag double, n int, doc_ids array<string>")
    line = formats.cluster_lines(k)
    assert line.first()["value"] == "2.50000000 3:1,2,"
    assert formats.read_clusters(line).first()["doc_ids"] == ["1", "2"]


def test_wire(spark):
    df = spark.createDataFrame([('["10", "586", 20]',), ("[]",), ('["a,b",c]x',), (None,)], "s string")
    assert col(df.select(wire.parse_array("s").alias("x")), "x") == [["10", " 586", " 20"], [""], ["a,b", "c"], None]
    r = spark.createDataFrame([("HTTP/1.1 200 OK\r\nA: 1\r\nB:x:y\r\nA: 2\r\n\r\nbody\n\nmore",)], "s string").select(wire.parse_response("s").alias("r")).first()["r"]
    assert (r["status"].strip(), r["headers"], r["body"], r["body_len"]) == ("HTTP/1.1 200 OK", {"A": "1", "B": "x:y"}, "body\n\nmore", 10)
    assert [tuple(x) for x in formats.read_kv(spark.createDataFrame([("name|Char|x",), ("lone",)], "value string")).collect()] == [("name", "Char|x"), ("lone", None)]
    assert spark.range(1).select(wire.request_text("h:1", "/p", "é=1").alias("x")).first()["x"].endswith("Content-Length: 4\r\n\r\né=1")
    with pytest.raises(ValueError):
        strings.fill_template("a$b$", "x")


def test_times33(spark):
    def plain(s):
        h = 5381
        for b in s.encode():
            h = (h * 33 + b) % 2**64
        return h - 2**64 if h >= 2**63 else h

    words = ["", "a", "hello world", "é" * 40, None]
    got = col(spark.createDataFrame([(w,) for w in words], "s string").select(strings.times33("s").alias("h")), "h")
    assert got == [None if w is None else plain(w) for w in words]


def test_closest_cluster_ties_and_orphans(spark):
    v = spark.createDataFrame([("1", "x", 1.0), ("2", "z", 1.0)], "doc_id string, term string, weight double")
    d = spark.createDataFrame([("1", 1.0), ("2", 1.0), ("3", 0.0)], "doc_id string, sqrt_mag double")
    c = spark.createDataFrame([(4, "x", 1.0), (2, "x", 1.0)], "cluster_id int, term string, mean double")
    k = spark.createDataFrame([(4, 1.0), (2, 1.0)], "cluster_id int, sqrt_mag double")
    got = {r["doc_id"]: r["cluster_id"] for r in vectors.closest_cluster(vectors.cosine_to_centroids(v, d, c, k), d).collect()}
    assert got == {"1": 2, "2": 0, "3": 0}


def test_repair_skips_when_candidates_run_out(spark):
    c = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.9)], "cluster_id int, doc_id string, sim double")
    e = spark.createDataFrame([(7,), (5,), (9,)], "cluster_id int")
    assert sorted(map(tuple, cluster.repair_empty(c, e).collect())) == [("a", 0, 7), ("b", 1, 5)]


def test_kmeans_covers_each_document_once(spark):
    rng = random.Random(2)
    rows = [(str(i), f"{i % 3}-{rng.randint(0, 5)}", rng.random() + 0.1) for i in range(60) for _ in range(6)]
    v = index.tidy_vectors(spark.createDataFrame(rows, "doc_id string, term string, weight double"))
    d = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("sqrt_mag"))
    seeds = spark.createDataFrame([(0, "0"), (1, "1"), (2, "2"), (3, "0")], "cluster_id int, doc_id string")
    a, c = cluster.kmeans_cosine(v, d, seeds=seeds, threshold=2.0)
    got = a.collect()
    # with means joined by shuffle instead of sent out, the same
    b, e = cluster.kmeans_cosine(v, d, seeds=seeds, threshold=2.0, most=1)
    assert {r["doc_id"]: (r["cluster_id"], round(r["sim"], 9)) for r in got} == {r["doc_id"]: (r["cluster_id"], round(r["sim"], 9)) for r in b.collect()}
    assert {(r["cluster_id"], r["term"]): round(r["mean"], 9) for r in c.collect() if r["mean"] > 1e-12} == {(r["cluster_id"], r["term"]): round(r["mean"], 9) for r in e.collect() if r["mean"] > 1e-12}
    with pytest.raises(RuntimeError, match="not settled"):
        cluster.kmeans_cosine(v, d, seeds=seeds, rounds=1)
    assert len(got) == len({r["doc_id"] for r in got}) == 60
    assert {r["cluster_id"] for r in got} == {0, 1, 2, 3}  # the twin seed starts empty and is repaired
    assert a.where("cluster_id < 3").select(F.expr("cast(doc_id as int) % 3 as g"), "cluster_id").distinct().count() == 3


def test_nearest_tree_finds_members_of_the_cluster(spark):
    rng = random.Random(4)
    rows = [(f"{i:03}", t, rng.random()) for i in range(200) for t in "xyz"]
    v = spark.createDataFrame(rows, "doc_id string, term string, weight double")
    a = v.select("doc_id").distinct().withColumn("cluster_id", (F.col("doc_id").cast("int") % 2).cast("int"))
    dims = spark.createDataFrame([(c, i + 1, t) for c in (0, 1) for i, t in enumerate("xyz")], "cluster_id int, rank int, term string")
    q = a.where("cast(doc_id as int) < 20")
    exact = {r["query_id"]: r["distance"] for r in neighbors.nearest_exact(v, a, dims, q).collect()}
    found = neighbors.nearest_tree(v, a, dims, q, part_rows=30).collect()
    assert len(found) == len(exact) == 20
    assert all(r["query_id"] != r["doc_id"] and int(r["query_id"]) % 2 == int(r["doc_id"]) % 2 and r["distance"] >= exact[r["query_id"]] - 1e-9 for r in found)


def test_range_partition(spark):
    got = sorted(map(tuple, keyed.range_partition(spark.range(21).toDF("i"), "i").collect()))
    assert [g[2] for g in got] == [min(i // 2, 7) for i in range(21)] and [g[1] for g in got] == list(range(21))
    assert {r["part"] for r in keyed.range_partition(spark.range(5).toDF("i"), "i").collect()} == {7}


class _Service(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    calls = 0

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        type(self).calls += 1
        if self.path == "/pull_page_names":
            out = json.dumps([str(i) for i in range(10)])
        elif type(self).calls % 4 == 0:  # the service hangs up now and then
            self.close_connection = True
            return
        else:
            out = f"<page><id>{dict(x.split('=') for x in body.split('&'))['unique_id']}</id></page>"
        self.send_response(200)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out.encode())

    def log_message(self, *_):
        pass


def test_page_source(spark):
    from loomdex.sources.pages import PageSource

    from socketserver import ThreadingMixIn

    server = type("S", (ThreadingMixIn, HTTPServer), {"daemon_threads": True})(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(PageSource)
        rows = spark.read.format("pages").option("host", "127.0.0.1").option("port", server.server_port).option("partitions", 3).option("wait", 0.01).load().collect()
        assert sorted((r["page_id"], r["body"]) for r in rows) == sorted((str(i), f"<page><id>{i}</id></page>") for i in range(10))
    finally:
        server.shutdown()


def test_stream_windows(spark, tmp_path):
    from loomdex.streaming.index import windowed_counts, write_table

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("select timestamp_ntz'2024-01-01 10:00:00' as ts, 'a' as k union all select timestamp_ntz'2024-01-09 10:00:00', 'b'").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp_ntz, k string").parquet(source)
    write_table(windowed_counts(stream, "ts", "k"), out, str(tmp_path / "state")).awaitTermination()
    assert [(r["k"], r["n"]) for r in spark.read.parquet(out).collect()] == [("a", 1)]


def insert_by_hand(tree_nodes, points, dims):
    """One point after the other, from the root down to a free place."""
    at = {n: v for _, v, n in tree_nodes}
    out = {i: n for i, _, n in tree_nodes}
    for i, v in sorted(points):
        node, level = 1, 0
        while node in at:
            mine, its = v[level % dims], at[node][level % dims]
            right = its is None or (mine is not None and mine >= its)
            node, level = node * 2 + right, level + 1
        at[node], out[i] = v, node
    return out


def test_insertion_into_a_tree(spark):
    rng = random.Random(6)
    points = [(i, [rng.choice([None, rng.randint(0, 9) * 1.0]), rng.randint(0, 9) * 1.0]) for i in range(60)]
    df = spark.createDataFrame(points, "id long, v array<double>")
    split = neighbors.median_split(df.where("id < 3").withColumnRenamed("id", "vec_id").withColumnRenamed("v", "embedding"), depth=2).collect()
    built = [(r["id"], dict(points)[r["id"]], r["node"]) for r in split]
    got = {r["id"]: r["node"] for r in neighbors.insert_points(spark.createDataFrame(built, "id long, v array<double>, node long"), df.where("id >= 3")).collect()}
    assert got == insert_by_hand(built, points[3:], 2) and len(set(got.values())) == 60
    alone = neighbors.insert_points(spark.createDataFrame([], "id long, v array<double>, node long"), df.limit(1)).collect()
    assert [r["node"] for r in alone] == [1] and neighbors.insert_points(spark.createDataFrame(built, "id long, v array<double>, node long"), df.limit(0)).count() == 3


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from loomdex import scratch

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="share"):
        scratch.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_broadcast_side_is_bounded_by_bytes(spark):
    from loomdex.scratch import bounded_join

    big, small = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).selectExpr("id as k", "repeat('x', 1000) as t")
    for size, hint in ((10**6, True), (1000, False)):
        out = bounded_join(big, small, "k", size=size)
        assert out.count() == 50 and ("ResolvedHint" in out._jdf.queryExecution().analyzed().toString()) == hint
