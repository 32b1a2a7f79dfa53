"""All queries of the core: name, DataFrame over whole tables, and the SQL that DuckDB checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import strings, wire
from .functions.stem import stem_sql, with_stem
from .operators import cluster, index, keyed, neighbors, text, tree, vectors
from .plans.pipeline import build_index
from .scratch import saved
from .sources import formats
from .streaming.index import running_frequencies, totals_of, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Relations that several SQL texts share.
W = "list_filter(list_transform(string_split(text, ' '), lambda x: lower(regexp_replace(x, '[^A-Za-z]', '', 'g'))), lambda x: x <> '')"
TOK = f"tok AS (SELECT doc_id, unnest({W}) AS term FROM documents)"
STOP = "sw AS (SELECT DISTINCT lower(trim(word)) AS term FROM stopword WHERE trim(word) <> ''), pre AS (SELECT DISTINCT substr(term, 1, i) AS term FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM sw))"
KEPT = f"{STOP}, {TOK}, kept AS (SELECT * FROM tok WHERE term NOT IN (SELECT term FROM pre))"
T = "t AS (SELECT DISTINCT doc_id, pos, term FROM tokens WHERE doc_id IS NOT NULL AND term IS NOT NULL), tf0 AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2)"
DF = "df0 AS (SELECT term, count(*) AS df FROM tf0 GROUP BY 1), n0 AS (SELECT count(DISTINCT doc_id) AS n FROM tf0)"
V = "v AS (SELECT doc_id, term, max(weight) AS weight FROM vectors WHERE doc_id IS NOT NULL AND term IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight) AND weight <> 0 GROUP BY 1, 2)"
D = f"{T}, d AS (SELECT doc_id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS sqrt_mag FROM tf0 GROUP BY 1)"
M = "m AS (SELECT cluster_id, n, doc_id FROM (SELECT cluster_id, n, unnest(doc_ids) AS doc_id FROM clusters) WHERE doc_id IS NOT NULL)"
MEAN = f"{V}, {M}, mean AS (SELECT cluster_id, term, sum(weight) / max(n) AS mean, count(*) AS doc_freq FROM v JOIN m USING (doc_id) GROUP BY 1, 2)"
SIM = f"{D}, {V}, sim AS (SELECT doc_id, cluster_id, sum(weight * mean) / (any_value(d.sqrt_mag) * any_value(k.sqrt_mag)) AS sim FROM v JOIN centroids c USING (term) JOIN d USING (doc_id) JOIN clusters k USING (cluster_id) GROUP BY 1, 2)"
BEST = f"{SIM}, best AS (SELECT v.doc_id, coalesce(arg_max(cluster_id, struct_pack(s := sim, c := -cluster_id)) FILTER (sim > 0), 0) AS cluster_id, coalesce(max(sim) FILTER (sim > 0), 0) AS sim FROM (SELECT DISTINCT doc_id FROM v JOIN d USING (doc_id)) v LEFT JOIN sim USING (doc_id) GROUP BY 1)"
DIM = "dim0 AS (SELECT cluster_id, term, 0.6 * stddev + doc_freq AS score, ln(count(*) OVER (PARTITION BY cluster_id)) + 1 AS cap, doc_freq FROM centroids), dim AS (SELECT * FROM (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS rank, term, score, cap FROM dim0 WHERE doc_freq < cap) WHERE rank <= ceil(cap))"


def tf_of(t: Tables) -> DataFrame:
    return index.term_frequency(index.tidy_tokens(t.tokens))


def docs_of(t: Tables) -> DataFrame:
    """Magnitudes renewed from the tokens; stored ones are not trusted."""
    return index.magnitudes(tf_of(t)).select("doc_id", "sqrt_mag")


def members_of(t: Tables) -> DataFrame:
    return cluster.member_rows(t.clusters)


def saved_sims(t: Tables) -> DataFrame:
    return vectors.cosine_to_centroids(index.tidy_vectors(t.vectors), docs_of(t), t.centroids, t.clusters)


# -- words ----------------------------------------------------------------------------------------------------------


@query("tokenize_terms", f"SELECT doc_id, pos, w[pos + 1] AS term FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, {W} AS w FROM documents))")
def tokenize_terms(t: Tables) -> DataFrame:
    return text.tokenize_terms(t.documents)


@query("tokenize_lines_apart", f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({W.replace('string_split(text', "string_split(replace(replace(text, chr(10), ' '), chr(9), ' ')")}) AS term FROM documents) GROUP BY 1, 2")
def tokenize_lines_apart(t: Tables) -> DataFrame:
    return text.tokenize_terms(t.documents, newline_as_space=True).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("token_lengths", f"SELECT doc_id, list_transform({W}, lambda x: length(x)) AS lengths FROM documents")
def token_lengths(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", strings.piece_lengths(strings.words("text")).alias("lengths"))


@query("split_alphanumeric", "SELECT doc_id, list_filter(list_transform(regexp_split_to_array(title, '[:, ]'), lambda x: lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'))), lambda x: x <> '') AS pieces FROM documents")
def split_alphanumeric(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", strings.split_pieces("title", ":, ", strings.ALPHANUMERICS, True).alias("pieces"))


@query("stopword_list", "SELECT DISTINCT lower(trim(word)) AS term FROM stopword WHERE trim(word) <> ''")
def stopword_list(t: Tables) -> DataFrame:
    return text.stop_list(t.stopword)


@query("stopword_prefix_filter", f"WITH {KEPT} SELECT doc_id, term, count(*) AS n FROM kept GROUP BY 1, 2")
def stopword_prefix_filter(t: Tables) -> DataFrame:
    return text.drop_stopwords(text.tokenize_terms(t.documents), t.stopword).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("stopword_exact_filter", f"WITH {STOP}, {TOK} SELECT doc_id, term, count(*) AS n FROM tok WHERE term NOT IN (SELECT term FROM sw) GROUP BY 1, 2")
def stopword_exact_filter(t: Tables) -> DataFrame:
    return text.drop_stopwords(text.tokenize_terms(t.documents), t.stopword, "intended").groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("trie_prefix_weights", """WITH s AS (SELECT line_no AS n, word, unnest(range(1, length(word) + 1)) AS i FROM stopword WHERE word <> ''),
    p AS (SELECT n, word, substr(word, 1, i) AS prefix FROM s), g AS (SELECT prefix, count(*) AS total, sum(CAST(prefix = word AS INT)) AS ends, arg_min(prefix = word, n) AS first_last FROM p GROUP BY 1)
    SELECT prefix, CAST(CASE WHEN first_last THEN ends ELSE ends + 1 END AS BIGINT) AS end_weight, CAST(total - 1 - ends + CASE WHEN first_last THEN 1 ELSE 0 END AS BIGINT) AS thru_weight FROM g""")  # fmt: skip
def trie_prefix_weights(t: Tables) -> DataFrame:
    return text.prefix_weights(t.stopword)


@query("trie_search", "WITH pre AS (SELECT DISTINCT substr(word, 1, i) AS term FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM stopword WHERE word <> '')), u AS (SELECT DISTINCT term FROM tokens WHERE term IS NOT NULL) SELECT term, term IN (SELECT term FROM pre) AS found FROM u")
def trie_search(t: Tables) -> DataFrame:
    terms = t.tokens.select("term").where("term is not null").distinct()
    pre = text.prefix_weights(t.stopword).select(F.col("prefix").alias("term"), F.lit(True).alias("hit"))
    return terms.join(pre, "term", "left").select("term", F.coalesce("hit", F.lit(False)).alias("found"))


@query("stem_terms", f"WITH {TOK}, u AS (SELECT DISTINCT term FROM tok) SELECT term, stem FROM ({stem_sql('u')})")
def stem_terms(t: Tables) -> DataFrame:
    return with_stem(text.tokenize_terms(t.documents).select("term").distinct())


@query("index_term_frequency", f"WITH {KEPT}, u AS (SELECT DISTINCT term FROM kept), st AS (SELECT term, stem FROM ({stem_sql('u')})) SELECT doc_id, stem AS term, count(*) AS tf FROM kept JOIN st USING (term) GROUP BY 1, 2")
def index_term_frequency(t: Tables) -> DataFrame:
    return index.term_frequency(text.index_terms(t.documents, t.stopword))


# -- index ----------------------------------------------------------------------------------------------------------


@query("term_frequency", f"WITH {T} SELECT * FROM tf0")
def term_frequency(t: Tables) -> DataFrame:
    return tf_of(t)


@query("document_frequency", f"WITH {T}, {DF} SELECT term, df FROM df0")
def document_frequency(t: Tables) -> DataFrame:
    return index.document_frequency(tf_of(t))


@query("doc_magnitude", f"WITH {T} SELECT doc_id, CAST(sum(tf * tf) AS BIGINT) AS mag FROM tf0 GROUP BY 1")
def doc_magnitude(t: Tables) -> DataFrame:
    return index.magnitudes(tf_of(t)).select("doc_id", "mag")


@query("root_magnitude", f"WITH {D} SELECT doc_id, round(sqrt_mag, 6) AS sqrt_mag FROM d")
def root_magnitude(t: Tables) -> DataFrame:
    return docs_of(t).select("doc_id", F.round("sqrt_mag", 6).alias("sqrt_mag"))


@query("latest_docs", "SELECT doc_id, title, mag FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY indexed_at DESC NULLS LAST, title DESC NULLS LAST, mag DESC NULLS LAST) AS r FROM docs WHERE doc_id IS NOT NULL) WHERE r = 1")
def latest_docs(t: Tables) -> DataFrame:
    return index.tidy_docs(t.docs)


@query("vocab_renewed", f"WITH {T}, {DF}, o AS (SELECT term, max(df) AS old_df FROM vocab WHERE term IS NOT NULL GROUP BY 1) SELECT term, old_df, df FROM o FULL JOIN df0 USING (term)")
def vocab_renewed(t: Tables) -> DataFrame:
    old = index.tidy_vocab(t.vocab).withColumnRenamed("df", "old_df")
    return old.join(index.document_frequency(tf_of(t)), "term", "full").select("term", "old_df", "df")


@query("prune_vocab_observed", f"WITH {T}, {DF} SELECT term, df FROM df0, n0 WHERE df >= 4 AND df // n <= 0.4")
def prune_vocab_observed(t: Tables) -> DataFrame:
    tf = saved(tf_of(t))
    return index.prune_vocab(index.document_frequency(tf), tf.select("doc_id").distinct().count())


@query("prune_vocab_ratio", f"WITH {T}, {DF} SELECT term, df FROM df0, n0 WHERE df >= 4 AND df / n <= 0.4")
def prune_vocab_ratio(t: Tables) -> DataFrame:
    tf = saved(tf_of(t))
    return index.prune_vocab(index.document_frequency(tf), tf.select("doc_id").distinct().count(), "intended")


@query("tfdf_weights", f"WITH {T}, {DF} SELECT doc_id, term, round(tf / df, 9) AS weight FROM tf0 JOIN df0 USING (term), n0 WHERE df >= 4 AND df // n <= 0.4")
def tfdf_weights(t: Tables) -> DataFrame:
    tf = saved(tf_of(t))
    vocab = index.prune_vocab(index.document_frequency(tf), tf.select("doc_id").distinct().count())
    return index.weights(tf, vocab).withColumn("weight", F.round("weight", 9))


@query("index_documents", f"""WITH {KEPT}, u AS (SELECT DISTINCT term FROM kept), st AS (SELECT term, stem FROM ({stem_sql('u')})), f AS (SELECT doc_id, stem AS term, count(*) AS tf FROM kept JOIN st USING (term) GROUP BY 1, 2),
    g AS (SELECT term, count(*) AS df FROM f GROUP BY 1 HAVING count(*) >= 4 AND count(*) // (SELECT count(DISTINCT doc_id) FROM documents) <= 0.4) SELECT doc_id, term, round(tf / df, 9) AS weight FROM f JOIN g USING (term)""")
def index_documents(t: Tables) -> DataFrame:
    return build_index(t.documents.select("doc_id", "text"), t.stopword).vectors.withColumn("weight", F.round("weight", 9))


@query("postings_line", f"WITH {T}, {DF} SELECT term || ' ' || df || ':' || string_agg(doc_id || ',' || tf || '|', '' ORDER BY doc_id) AS value FROM tf0 JOIN df0 USING (term), n0 WHERE df >= 4 AND df // n <= 0.4 GROUP BY term, df")
def postings_line(t: Tables) -> DataFrame:
    tf = saved(tf_of(t))
    vocab = index.prune_vocab(index.document_frequency(tf), tf.select("doc_id").distinct().count())
    return formats.postings_lines(index.postings(tf, vocab))


@query("parse_postings", f"WITH {T}, {DF} SELECT term, df, doc_id, tf FROM tf0 JOIN df0 USING (term)")
def parse_postings(t: Tables) -> DataFrame:
    tf = saved(tf_of(t))
    return formats.read_postings(formats.postings_lines(index.postings(tf, index.document_frequency(tf))))


_LATEST = "ld AS (SELECT doc_id, title, mag FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY indexed_at DESC NULLS LAST, title DESC NULLS LAST, mag DESC NULLS LAST) AS r FROM docs WHERE doc_id IS NOT NULL) WHERE r = 1)"
_TITLE = "array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(title, ''), '[: ]'), lambda x: lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'))), lambda x: x <> ''), ' ')"


@query("title_line", f"WITH {_LATEST} SELECT doc_id || ':' || coalesce(title, '') || ' ' || mag AS value FROM ld WHERE mag IS NOT NULL")
def title_line(t: Tables) -> DataFrame:
    return formats.title_lines(index.tidy_docs(t.docs).where("mag is not null"))


@query("read_titles", f"WITH {_LATEST} SELECT doc_id, {_TITLE} AS title, mag, round(sqrt(mag), 6) AS sqrt_mag FROM ld WHERE mag IS NOT NULL")
def read_titles(t: Tables) -> DataFrame:
    out = formats.read_titles(formats.title_lines(index.tidy_docs(t.docs).where("mag is not null")))
    return out.withColumn("sqrt_mag", F.round("sqrt_mag", 6))


@query("normalize_title", "SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_name, '[: ]'), lambda x: lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'))), lambda x: x <> ''), ' ') AS title FROM part")
def normalize_title(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", strings.normalize_title("p_name").alias("title"))


_CL = "printf('%1.8f', sqrt_mag) || ' ' || n || ':' || array_to_string(list_transform(list_filter(doc_ids, lambda x: x IS NOT NULL), lambda x: x || ','), '')"


@query("cluster_line", f"SELECT cluster_id, {_CL} AS value FROM clusters")
def cluster_line(t: Tables) -> DataFrame:
    return formats.cluster_lines(t.clusters)


@query("read_clusters", "SELECT cluster_id, round(sqrt_mag, 6) AS sqrt_mag, n, list_filter(doc_ids, lambda x: x IS NOT NULL) AS doc_ids FROM clusters")
def read_clusters(t: Tables) -> DataFrame:
    return formats.read_clusters(formats.cluster_lines(t.clusters)).withColumn("sqrt_mag", F.round("sqrt_mag", 6))


# -- vectors and clusters -------------------------------------------------------------------------------------------


@query("transposed_index", f"WITH {T}, {DF} SELECT doc_id, term, round(tf / df, 9) AS weight FROM tf0 JOIN df0 USING (term) JOIN (SELECT DISTINCT doc_id FROM docs) USING (doc_id)")
def transposed_index(t: Tables) -> DataFrame:
    tf = saved(tf_of(t))
    lines = formats.postings_lines(index.postings(tf, index.document_frequency(tf)))
    read = formats.read_postings(lines).join(t.docs.select("doc_id").distinct(), "doc_id")
    return read.select("doc_id", "term", F.round(F.try_divide(F.col("tf").cast("double"), "df"), 9).alias("weight"))


@query("cosine_docs_to_centroids", f"WITH {SIM} SELECT doc_id, cluster_id, round(sim, 9) AS sim FROM sim")
def cosine_docs_to_centroids(t: Tables) -> DataFrame:
    return saved_sims(t).withColumn("sim", F.round("sim", 9))


@query("closest_cluster", f"WITH {BEST} SELECT doc_id, cluster_id, round(sim, 9) AS sim FROM best")
def closest_cluster(t: Tables) -> DataFrame:
    have = docs_of(t).join(index.tidy_vectors(t.vectors).select("doc_id").distinct(), "doc_id", "left_semi")
    return vectors.closest_cluster(saved_sims(t), have).withColumn("sim", F.round("sim", 9))


@query("cluster_sizes", f"WITH {BEST} SELECT cluster_id, count(*) AS n FROM best GROUP BY 1")
def cluster_sizes(t: Tables) -> DataFrame:
    have = docs_of(t).join(index.tidy_vectors(t.vectors).select("doc_id").distinct(), "doc_id", "left_semi")
    return vectors.closest_cluster(saved_sims(t), have).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("centroid_mean", f"WITH {MEAN} SELECT cluster_id, term, round(mean, 9) AS mean FROM mean")
def centroid_mean(t: Tables) -> DataFrame:
    out = cluster.centroid_mean(members_of(t), index.tidy_vectors(t.vectors))
    return out.select("cluster_id", "term", F.round("mean", 9).alias("mean"))


@query("centroid_stddev", f"""WITH {V}, {M} SELECT cluster_id, term, round(CASE WHEN max(n) > 1 THEN sqrt(sum((weight - coalesce(c.mean, 0)) * (weight - coalesce(c.mean, 0))) / (max(n) - 1)) END, 9) AS stddev
    FROM v JOIN m USING (doc_id) LEFT JOIN centroids c USING (cluster_id, term) GROUP BY 1, 2""")
def centroid_stddev(t: Tables) -> DataFrame:
    return cluster.centroid_stddev(members_of(t), index.tidy_vectors(t.vectors), t.centroids).withColumn("stddev", F.round("stddev", 9))


@query("cluster_doc_freq", f"WITH {MEAN} SELECT cluster_id, term, doc_freq FROM mean")
def cluster_doc_freq(t: Tables) -> DataFrame:
    return cluster.centroid_mean(members_of(t), index.tidy_vectors(t.vectors)).select("cluster_id", "term", "doc_freq")


@query("reload_centroid", f"WITH {MEAN} SELECT cluster_id, term, round(mean, 9) AS mean, CAST(0 AS DOUBLE) AS stddev, doc_freq - 1 AS doc_freq FROM mean")
def reload_centroid(t: Tables) -> DataFrame:
    return cluster.reload_centroid(members_of(t), index.tidy_vectors(t.vectors)).withColumn("mean", F.round("mean", 9))


_SHIFT = f"{MEAN}, shift AS (SELECT cluster_id, sum((coalesce(a.mean, 0) - coalesce(b.mean, 0)) * (coalesce(a.mean, 0) - coalesce(b.mean, 0))) AS shift FROM centroids a FULL JOIN mean b USING (cluster_id, term) GROUP BY 1)"


@query("mean_shift", f"WITH {_SHIFT} SELECT cluster_id, round(shift, 9) AS shift FROM shift")
def mean_shift(t: Tables) -> DataFrame:
    new = cluster.centroid_mean(members_of(t), index.tidy_vectors(t.vectors))
    return cluster.mean_shift(t.centroids, new).withColumn("shift", F.round("shift", 9))


@query("has_changed", f"WITH {_SHIFT} SELECT max(abs(shift)) > 0.000001 AS changed FROM shift")
def has_changed(t: Tables) -> DataFrame:
    shifts = cluster.mean_shift(t.centroids, cluster.centroid_mean(members_of(t), index.tidy_vectors(t.vectors)))
    return cluster.has_changed(shifts, shifts.withColumn("shift", F.lit(0.0)), 1e-6)


@query("vocabulary_union", f"WITH {V}, {M} SELECT cluster_id, term FROM centroids UNION SELECT cluster_id, term FROM v JOIN m USING (doc_id)")
def vocabulary_union(t: Tables) -> DataFrame:
    more = index.tidy_vectors(t.vectors).join(members_of(t), "doc_id").select("cluster_id", "term")
    return t.centroids.select("cluster_id", "term").unionByName(more).distinct()


_EXT = "ext AS (SELECT cluster_id, doc_id, s FROM (SELECT cluster_id, doc_id, round(sim, 9) AS s, row_number() OVER (PARTITION BY cluster_id ORDER BY round(sim, 9) {} , doc_id) AS r FROM best) WHERE r = 1)"


def _rounded_best(t: Tables) -> DataFrame:
    have = docs_of(t).join(index.tidy_vectors(t.vectors).select("doc_id").distinct(), "doc_id", "left_semi")
    return vectors.closest_cluster(saved_sims(t), have).withColumn("sim", F.round("sim", 9))


@query("cluster_extreme_member", f"WITH {BEST}, {_EXT.format('DESC')} SELECT cluster_id, doc_id, s AS sim FROM ext")
def cluster_extreme_member(t: Tables) -> DataFrame:
    return cluster.extreme_members(_rounded_best(t))


@query("cluster_most_distant", f"WITH {BEST}, {_EXT.format('ASC')} SELECT cluster_id, doc_id, s AS sim FROM ext")
def cluster_most_distant(t: Tables) -> DataFrame:
    return cluster.extreme_members(_rounded_best(t), "intended")


@query("empty_cluster_repair", f"""WITH {BEST}, {_EXT.format('DESC')}, c AS (SELECT doc_id, cluster_id AS donor, row_number() OVER (ORDER BY s DESC, cluster_id) AS r FROM ext),
    e AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS r FROM (SELECT 1000 AS cluster_id UNION ALL SELECT 1001 UNION ALL SELECT 1002)) SELECT doc_id, donor, cluster_id FROM c JOIN e USING (r)""")
def empty_cluster_repair(t: Tables) -> DataFrame:
    empties = t._spark.range(1000, 1003).select(F.col("id").cast("int").alias("cluster_id"))
    return cluster.repair_empty(cluster.extreme_members(_rounded_best(t)), empties)


@query("member_titles", f"WITH {M}, {_LATEST} SELECT cluster_id, doc_id, title FROM m JOIN ld USING (doc_id)")
def member_titles(t: Tables) -> DataFrame:
    return index.tidy_docs(t.docs).join(members_of(t), "doc_id").select("cluster_id", "doc_id", "title")


@query("kmeans_cosine")
def kmeans_cosine(t: Tables) -> DataFrame:
    v, d = saved(index.tidy_vectors(t.vectors)), saved(docs_of(t))
    return cluster.kmeans_cosine(v, d)[0]


_ROUND = """WITH {V}, {D}, seed AS (SELECT cluster_id, min(doc_id) AS doc_id FROM (SELECT cluster_id, unnest(doc_ids) AS doc_id FROM clusters) JOIN (SELECT DISTINCT doc_id FROM v JOIN d USING (doc_id)) USING (doc_id) GROUP BY 1),
    k AS (SELECT cluster_id, sqrt_mag FROM seed JOIN d USING (doc_id)), c0 AS (SELECT cluster_id, term, weight AS mean FROM seed JOIN v USING (doc_id)),
    s AS (SELECT doc_id, cluster_id, sum(weight * mean) / (any_value(d.sqrt_mag) * any_value(k.sqrt_mag)) AS sim FROM v JOIN c0 USING (term) JOIN d USING (doc_id) JOIN k USING (cluster_id) GROUP BY 1, 2)
    SELECT x.doc_id, coalesce(arg_max(cluster_id, struct_pack(s := sim, c := -cluster_id)) FILTER (sim > 0), 0) AS cluster_id, round(coalesce(max(sim), 0), 9) AS sim FROM (SELECT DISTINCT doc_id FROM v JOIN d USING (doc_id)) x LEFT JOIN s USING (doc_id) GROUP BY 1"""


@query("kmeans_first_round", _ROUND.replace("{V}", V).replace("{D}", D))
def kmeans_first_round(t: Tables) -> DataFrame:
    """Seeds are the first saved member of each cluster; one assignment round."""
    v, d = saved(index.tidy_vectors(t.vectors)), saved(docs_of(t))
    have = d.join(v.select("doc_id").distinct(), "doc_id", "left_semi")
    seeds = members_of(t).join(have, "doc_id", "left_semi").groupBy("cluster_id").agg(F.min("doc_id").alias("doc_id"))
    means = v.join(seeds, "doc_id").select("cluster_id", "term", F.col("weight").alias("mean"))
    sims = vectors.cosine_to_centroids(v, d, means, seeds.join(d, "doc_id").select("cluster_id", "sqrt_mag"))
    return vectors.closest_cluster(sims, have).withColumn("sim", F.round("sim", 9))


# -- neighbours -----------------------------------------------------------------------------------------------------


@query("rank_dimensions", f"WITH {DIM} SELECT cluster_id, rank, term, round(score, 6) AS score FROM dim")
def rank_dimensions(t: Tables) -> DataFrame:
    return neighbors.rank_dimensions(t.centroids).withColumn("score", F.round("score", 6))


@query("dimension_cycle", f"WITH {DIM} SELECT cluster_id, rank, term, coalesce(lead(term) OVER (PARTITION BY cluster_id ORDER BY rank), first_value(term) OVER (PARTITION BY cluster_id ORDER BY rank)) AS next_term FROM dim")
def dimension_cycle(t: Tables) -> DataFrame:
    return neighbors.dimension_cycle(neighbors.rank_dimensions(t.centroids))


@query("dimension_order", "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] NULLS FIRST, vec_id) AS place FROM embeddings")
def dimension_order(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.row_number().over(Window.partitionBy("label").orderBy(F.asc_nulls_first(F.get("embedding", F.lit(0))), "vec_id")).alias("place"))


@query("kd_median_split", """WITH a AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY embedding[1] NULLS FIRST, vec_id) AS r, (1 + count(*) OVER ()) // 2 AS m FROM embeddings),
    b AS (SELECT *, CASE WHEN r < m THEN 2 WHEN r > m THEN 3 ELSE 1 END AS node FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY embedding[2] NULLS FIRST, vec_id) AS r2, (1 + count(*) OVER (PARTITION BY node)) // 2 AS m2 FROM b)
    SELECT vec_id AS id, CAST(CASE WHEN node = 1 THEN 1 WHEN r2 = m2 THEN node WHEN r2 < m2 THEN node * 2 ELSE node * 2 + 1 END AS BIGINT) AS node, CASE WHEN node = 1 THEN 0 WHEN r2 = m2 THEN 1 ELSE 2 END AS level, node = 1 OR r2 = m2 AS pivot FROM c""")  # fmt: skip
def kd_median_split(t: Tables) -> DataFrame:
    return neighbors.median_split(t.embeddings)


_NEAR = f"""WITH {BEST}, {DIM}, x AS (SELECT doc_id, cluster_id, term, weight FROM v JOIN best USING (doc_id) JOIN dim USING (cluster_id, term)),
    q AS (SELECT doc_id AS query_id, cluster_id FROM best WHERE CAST(doc_id AS BIGINT) % 100 = 0), nn AS (SELECT doc_id, sum(weight * weight) AS s FROM x GROUP BY 1),
    dt AS (SELECT b.doc_id AS query_id, a.doc_id, sum(a.weight * b.weight) AS dot FROM x a JOIN x b ON a.cluster_id = b.cluster_id AND a.term = b.term WHERE b.doc_id IN (SELECT query_id FROM q) GROUP BY 1, 2),
    e AS (SELECT q.query_id, p.doc_id, round(coalesce(n1.s, 0) + coalesce(n2.s, 0) - 2 * coalesce(dot, 0), 12) AS distance FROM q JOIN best p ON p.cluster_id = q.cluster_id AND p.doc_id <> q.query_id
        LEFT JOIN dt ON dt.query_id = q.query_id AND dt.doc_id = p.doc_id LEFT JOIN nn n1 ON n1.doc_id = p.doc_id LEFT JOIN nn n2 ON n2.doc_id = q.query_id)
    SELECT query_id, count(*) AS members, round(min(distance), 9) AS distance FROM e GROUP BY 1"""


@query("nearest_exact", _NEAR)
def nearest_exact(t: Tables) -> DataFrame:
    v, a, dims, q = _search_inputs(t)
    best = neighbors.nearest_exact(v, a, dims, q).select("query_id", F.round("distance", 9).alias("distance"))
    sizes = a.groupBy("cluster_id").agg((F.count("*") - 1).alias("members"))
    return best.join(a.select(F.col("doc_id").alias("query_id"), "cluster_id"), "query_id").join(sizes, "cluster_id").select("query_id", "members", "distance")


@query("nearest_tree")
def nearest_tree(t: Tables) -> DataFrame:
    return neighbors.nearest_tree(*_search_inputs(t))


def _search_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    assigned = saved(_rounded_best(t).select("doc_id", "cluster_id"))
    return saved(index.tidy_vectors(t.vectors)), assigned, saved(neighbors.rank_dimensions(t.centroids)), assigned.where("cast(doc_id as bigint) % 100 = 0")


@query("dimension_min", "SELECT vec_id AS id, CAST(embedding[4] AS DOUBLE) AS value FROM embeddings WHERE embedding[4] IS NOT NULL ORDER BY embedding[4], vec_id LIMIT 1")
def dimension_min(t: Tables) -> DataFrame:
    return neighbors.dimension_min(t.embeddings, 3)


@query("delete_point", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding[1] < 0)")
def delete_point(t: Tables) -> DataFrame:
    return neighbors.delete_points(t.embeddings, t.embeddings.where("embedding[0] < 0")).select("vec_id", "label")


@query("dimension_distance", "SELECT a.vec_id, round(pow(coalesce(CAST(a.embedding[1] AS DOUBLE), 0) - coalesce(CAST(b.embedding[1] AS DOUBLE), 0), 2), 6) AS distance FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b")
def dimension_distance(t: Tables) -> DataFrame:
    first = t.embeddings.agg(F.min_by("embedding", "vec_id").alias("b"))
    a, b = F.coalesce(F.get("embedding", F.lit(0)).cast("double"), F.lit(0.0)), F.coalesce(F.get("b", F.lit(0)).cast("double"), F.lit(0.0))
    return t.embeddings.crossJoin(F.broadcast(first)).select("vec_id", F.round(F.pow(a - b, 2), 6).alias("distance"))  # one row


# -- queries --------------------------------------------------------------------------------------------------------

_QV = f"""bt AS (SELECT item_id AS query_id, unnest({W}) AS term FROM benchmark), bk AS (SELECT * FROM bt WHERE term NOT IN (SELECT term FROM pre)),
    u AS (SELECT DISTINCT term FROM kept UNION SELECT DISTINCT term FROM bk), st AS (SELECT term, stem FROM ({stem_sql('u')})), qt AS (SELECT query_id, stem AS term, count(*) AS tf FROM bk JOIN st USING (term) GROUP BY 1, 2),
    dtf AS (SELECT doc_id, stem AS term, count(*) AS tf FROM kept JOIN st USING (term) GROUP BY 1, 2), ddf AS (SELECT term, count(*) AS df FROM dtf GROUP BY 1), qv AS (SELECT query_id, term, tf / df AS q FROM qt JOIN ddf USING (term))"""


@query("query_vector", f"WITH {KEPT}, {_QV} SELECT query_id, term, round(q, 9) AS weight FROM qv")
def query_vector(t: Tables) -> DataFrame:
    df = index.document_frequency(text.index_frequencies(t.documents, t.stopword))
    return vectors.query_vector(t.benchmark, df, t.stopword).withColumn("weight", F.round("weight", 9))


@query("score_query", f"""WITH {KEPT}, {_QV}, dv AS (SELECT doc_id, term, tf / df AS w FROM dtf JOIN ddf USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(q * q)) AS m FROM qv GROUP BY 1),
    s AS (SELECT query_id, doc_id, sum(w * q) AS dot FROM dv JOIN qv USING (term) GROUP BY 1, 2), r AS (SELECT query_id, doc_id, round(dot / (n * m), 9) AS score FROM s JOIN dn USING (doc_id) JOIN qn USING (query_id))
    SELECT query_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")  # fmt: skip
def score_query(t: Tables) -> DataFrame:
    tf = saved(text.index_frequencies(t.documents, t.stopword))
    df = saved(index.document_frequency(tf))
    return vectors.score_query(vectors.query_vector(t.benchmark, df, t.stopword), index.weights(tf, df)).select("query_id", F.round("score", 6).alias("score"), "rank")


# -- markup ---------------------------------------------------------------------------------------------------------


# The parser as relations: tokens of a text, depth as a running sum that never falls below the root, the open node as the
# last one opened at the present depth.
_TOKEN = r"""(?s)<!--.*?-->|<!--.*|</[^>]*>?|<[^=>]*(?:=(?:[^"'>]|["'][^"']*(?:["']|$))*)?>?|[^<]+""".replace("'", "''")
_ATTR = r"""=[^"']*["'][^"']*(?:["']|$)|=.*|[^= \t/]+[ \t/]?""".replace("'", "''")
_PARSE = f"""tk AS (SELECT r, doc_id, tok, i FROM (SELECT r, doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM
        (SELECT r, doc_id, regexp_extract_all(replace(text, chr(10), '{{newline}}'), '{_TOKEN}') AS toks FROM src))),
    kd AS (SELECT *, CASE WHEN starts_with(tok, '<!--') THEN CASE WHEN ends_with(tok, '-->') THEN 'c' ELSE 'x' END WHEN starts_with(tok, '</') THEN 'e' WHEN starts_with(tok, '<') THEN 'o' ELSE 't' END AS kind,
        regexp_replace(substr(tok, 2), '>$', '') AS inside FROM tk),
    st AS (SELECT *, kind = 'o' AND ends_with(inside, '/') AS closed, CASE WHEN kind = 'e' THEN -1 WHEN kind = 'o' AND NOT ends_with(inside, '/') THEN 1 ELSE 0 END AS step FROM kd),
    sm AS (SELECT *, sum(step) OVER (PARTITION BY r ORDER BY i) AS s, sum(CAST(kind = 'o' AS INT)) OVER (PARTITION BY r ORDER BY i) AS node_id FROM st),
    dp AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY r ORDER BY i)) AS after FROM sm),
    db AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY r ORDER BY i), 0) AS before FROM dp),
    ow AS (SELECT * FROM (SELECT *, CASE WHEN before = 0 THEN 0 ELSE max(give) OVER (PARTITION BY r, lvl ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS owner FROM
        (SELECT *, before AS lvl, NULL AS give FROM db UNION ALL SELECT *, before + 1 AS lvl, node_id AS give FROM db WHERE kind = 'o' AND NOT closed)) WHERE give IS NULL),
    dt AS (SELECT r, owner AS node_id, string_agg(CASE kind WHEN 't' THEN tok WHEN 'c' THEN '>' ELSE '<' END, '' ORDER BY i) AS data FROM ow WHERE kind IN ('t', 'c') OR (kind = 'o' AND NOT closed) GROUP BY 1, 2),
    op AS (SELECT r, doc_id, node_id, owner AS parent_id, before + 1 AS depth, split_part(inside, ' ', 1) AS tag, inside FROM ow WHERE kind = 'o'),
    ak AS (SELECT r, node_id, unnest(a) AS a, unnest(range(len(a))) AS k FROM (SELECT r, node_id, regexp_extract_all(substr(inside, length(tag) + 1), '{_ATTR}') AS a FROM op)),
    ap AS (SELECT *, lag(a) OVER w AS p, max(CASE WHEN regexp_matches(a, '[ \t/]$') OR (starts_with(a, '=') AND regexp_matches(a, '["'']')) THEN k END) OVER (PARTITION BY r, node_id) AS last FROM ak WINDOW w AS (PARTITION BY r, node_id ORDER BY k)),
    aa AS (SELECT r, node_id, k, CASE WHEN starts_with(a, '=') THEN CASE WHEN p IS NULL OR regexp_matches(p, '^=|[ \t/]$') THEN '' ELSE p END ELSE rtrim(a, ' \t/') END AS name,
        CASE WHEN starts_with(a, '=') THEN replace(replace(regexp_extract(a, '["'']([^"'']*)', 1), ' ', ''), chr(9), '') END AS value FROM ap
        WHERE (starts_with(a, '=') AND regexp_matches(a, '["'']')) OR (NOT starts_with(a, '=') AND regexp_matches(a, '[ \t/]$') AND k < last)),
    att AS (SELECT r, node_id, list(struct_pack(name := name, value := value) ORDER BY k) AS attrs FROM aa GROUP BY 1, 2),
    nd AS (SELECT r, doc_id, 0 AS node_id, -1 AS parent_id, 0 AS ord, 0 AS depth, 'root' AS tag, '' AS inside FROM src
        UNION ALL SELECT r, doc_id, node_id, parent_id, row_number() OVER (PARTITION BY r, parent_id ORDER BY node_id) - 1, depth, tag, inside FROM op),
    nodes AS (SELECT r, doc_id, CAST(node_id AS INT) AS node_id, CAST(parent_id AS INT) AS parent_id, CAST(ord AS INT) AS ord, CAST(depth AS INT) AS depth, tag, coalesce(data, '') AS data, coalesce(attrs, []) AS attrs
        FROM nd LEFT JOIN dt USING (r, node_id) LEFT JOIN att USING (r, node_id))"""
_PAGES = "src AS (SELECT row_number() OVER () AS r, id AS doc_id, text FROM page WHERE text IS NOT NULL)"
_FETCHED = "src AS (SELECT row_number() OVER () AS r, concat_ws('@', id, strftime(fetched_at, '%Y-%m-%d %H:%M:%S')) AS doc_id, text FROM page WHERE text IS NOT NULL)"


def _parsed(select: str, source: str = _PAGES, newline: str = "") -> str:
    return f"WITH {source}, {_PARSE.replace('{newline}', newline)} {select}"


def _page_nodes(t: Tables) -> DataFrame:
    """Nodes of each fetched page; a page is fetched more than once, so its name holds the time."""
    return tree.page_nodes(t.page.select(F.concat_ws("@", "id", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss")).alias("id"), "text"))


@query("page_nodes", _parsed("SELECT doc_id, node_id, parent_id, ord, depth, tag, data FROM nodes"))
def page_nodes(t: Tables) -> DataFrame:
    return tree.page_nodes(t.page).drop("attrs")


@query("page_text")
def page_text(t: Tables) -> DataFrame:
    return tree.page_text(t.page)


# A piece is followed by the blank after its node if it is the last one before the node's end.
_BODY = """, cl AS (SELECT r, owner AS node_id, min(i) AS closes FROM ow WHERE kind = 'e' AND owner > 0 GROUP BY 1, 2),
    pc AS (SELECT ow.r, i, owner, CASE kind WHEN 't' THEN tok ELSE '>' END AS piece FROM ow JOIN nodes n ON n.r = ow.r AND n.node_id = ow.owner WHERE kind IN ('t', 'c') AND n.tag NOT IN ('style', 'a')),
    nx AS (SELECT *, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM pc),
    bd AS (SELECT nx.r, string_agg(piece || CASE WHEN owner > 0 AND NOT ends_with(piece, ' ') AND (next IS NULL OR next > closes) THEN ' ' ELSE '' END, '' ORDER BY i) AS body FROM nx LEFT JOIN cl ON cl.r = nx.r AND cl.node_id = nx.owner GROUP BY 1)
    SELECT doc_id, coalesce(body, '') AS body FROM src LEFT JOIN bd USING (r)"""


@query("page_text_intended", _parsed("", newline=" ").rstrip() + _BODY)
def page_text_intended(t: Tables) -> DataFrame:
    return tree.page_text(t.page, mode="intended", newline=" ")


@query("page_attrs", _parsed("SELECT doc_id, node_id, tag, a.name AS name, a.value AS value FROM (SELECT doc_id, node_id, tag, unnest(attrs) AS a FROM nodes)"))
def page_attrs(t: Tables) -> DataFrame:
    return tree.page_nodes(t.page).select("doc_id", "node_id", "tag", F.explode("attrs").alias("a")).select("doc_id", "node_id", "tag", "a.name", "a.value")


@query("page_children", _parsed("SELECT doc_id, parent_id AS node_id, list(node_id ORDER BY ord) AS kids FROM nodes WHERE parent_id >= 0 GROUP BY 1, 2", _FETCHED))
def page_children(t: Tables) -> DataFrame:
    return tree.children(_page_nodes(t))


@query("page_last_child", _parsed("SELECT doc_id, parent_id AS node_id, max(node_id) AS last FROM nodes WHERE parent_id >= 0 GROUP BY 1, 2", _FETCHED))
def page_last_child(t: Tables) -> DataFrame:
    return tree.last_child(_page_nodes(t))


@query("page_first_by_tag", _parsed("SELECT doc_id, arg_min(node_id, struct_pack(p := parent_id, o := ord)) AS node_id FROM nodes WHERE tag = 'p' GROUP BY 1", _FETCHED))
def page_first_by_tag(t: Tables) -> DataFrame:
    return tree.first_of_tag(_page_nodes(t), "p")


@query("page_all_by_tag", _parsed("SELECT doc_id, list(node_id ORDER BY node_id) AS nodes FROM nodes WHERE tag = 'li' GROUP BY 1", _FETCHED))
def page_all_by_tag(t: Tables) -> DataFrame:
    return tree.all_of_tag(_page_nodes(t), "li")


@query("page_data_by_tag", _parsed("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY node_id) AS n, data FROM nodes WHERE tag = 'p'", _FETCHED))
def page_data_by_tag(t: Tables) -> DataFrame:
    return tree.data_by_tag(_page_nodes(t), "p")


_DUMP = "src AS (SELECT row_number() OVER () AS r, '' AS doc_id, '<page><id>' || id || '</id><title>' || title || '</title><text>' || text || '</text></page>' AS text FROM page WHERE id || title || text IS NOT NULL)"
_FIELD = """, cl AS (SELECT r, owner AS node_id, min(i) AS closes FROM ow WHERE kind = 'e' AND owner > 0 GROUP BY 1, 2),
    pc AS (SELECT ow.r, i, owner, CASE kind WHEN 't' THEN tok ELSE '>' END AS piece, n.tag FROM ow JOIN nodes n ON n.r = ow.r AND n.node_id = ow.owner WHERE kind IN ('t', 'c')),
    root AS (SELECT o.r, o.tag AS field, o.node_id, o.i AS opens, coalesce(c.closes, 1000000000) AS ends FROM (SELECT r, node_id, i, split_part(inside, ' ', 1) AS tag FROM ow WHERE kind = 'o' AND owner = 1 AND node_id > 1) o LEFT JOIN cl c USING (r, node_id)
        QUALIFY row_number() OVER (PARTITION BY o.r, o.tag ORDER BY o.node_id) = 1),
    nx AS (SELECT root.r, field, root.node_id AS top, pc.i, owner, piece, lead(pc.i) OVER (PARTITION BY root.r, field ORDER BY pc.i) AS next FROM root JOIN pc ON pc.r = root.r AND pc.i > opens AND pc.i < ends WHERE field <> 'text' OR tag NOT IN ('style', 'a')),
    bd AS (SELECT nx.r, field, string_agg(piece || CASE WHEN owner <> top AND NOT ends_with(piece, ' ') AND (next IS NULL OR next > closes) THEN ' ' ELSE '' END, '' ORDER BY i) AS body FROM nx LEFT JOIN cl ON cl.r = nx.r AND cl.node_id = nx.owner GROUP BY 1, 2)
    SELECT max(CASE WHEN field = 'id' THEN coalesce(body, '') END) AS id, max(CASE WHEN field = 'title' THEN coalesce(body, '') END) AS title, max(CASE WHEN field = 'text' THEN coalesce(body, '') END) AS text FROM root LEFT JOIN bd USING (r, field) WHERE field IN ('id', 'title', 'text') GROUP BY root.r"""


@query("page_fields", _parsed("", _DUMP).rstrip() + _FIELD)
def page_fields(t: Tables) -> DataFrame:
    """The page table written as a dump, one page a row, and read back."""
    dump = F.concat(F.lit("<page><id>"), "id", F.lit("</id><title>"), "title", F.lit("</title><text>"), "text", F.lit("</text></page>"))
    return tree.page_fields(t.page.select(dump.alias("value")), mode="intended")


@query("page_title", f"SELECT id, {_TITLE} AS title FROM page WHERE title IS NOT NULL")
def page_title(t: Tables) -> DataFrame:
    return t.page.where("title is not null").select("id", strings.normalize_title("title").alias("title"))


@query("strip_comments", "SELECT id, regexp_replace(text, '(?s)<!--.*?-->', '>', 'g') AS text FROM page")
def strip_comments(t: Tables) -> DataFrame:
    return t.page.select("id", tree.strip_comments("text").alias("text"))


# -- keyed tables, scalars ------------------------------------------------------------------------------------------


@query("keyed_last", "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def keyed_last(t: Tables) -> DataFrame:
    return keyed.keyed_last(t.events, "user_id", "event_type", "ts", "event_id")


@query("keyed_multimap", "SELECT user_id, list(event_type ORDER BY ts, event_id) AS \"values\" FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def keyed_multimap(t: Tables) -> DataFrame:
    return keyed.keyed_multimap(t.events, "user_id", "event_type", "ts", "event_id")


@query("keyed_get", "SELECT event_id, event_type FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def keyed_get(t: Tables) -> DataFrame:
    return keyed.get(t.events, "user_id", t.events.agg(F.min("user_id")).first()[0]).select("event_id", "event_type")


@query("filtered_keys", "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL AND value > 400")
def filtered_keys(t: Tables) -> DataFrame:
    return keyed.filtered_keys(t.events, "user_id", "value", F.col("value") > 400)


@query("delete_keys", "SELECT event_id, user_id FROM events WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM events WHERE value > 400 AND user_id IS NOT NULL)")
def delete_keys(t: Tables) -> DataFrame:
    gone = keyed.filtered_keys(t.events, "user_id", "value", F.col("value") > 400)
    return keyed.delete_keys(t.events.select("event_id", "user_id"), gone, "user_id")


@query("topk_heap", "SELECT o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 25")
def topk_heap(t: Tables) -> DataFrame:
    return keyed.heap_top(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 25)


@query("decrease_key", "SELECT o_orderkey, least(o_totalprice, coalesce(w, o_totalprice)) AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, min(l_extendedprice) AS w FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def decrease_key(t: Tables) -> DataFrame:
    changes = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"))
    return keyed.decrease_key(t.orders.select("o_orderkey", "o_totalprice"), changes, "o_orderkey", "o_totalprice")


@query("range_partition", "SELECT doc_id, i AS \"index\", CAST(least(i // (n // 8), 7) AS INT) AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)")
def range_partition(t: Tables) -> DataFrame:
    return keyed.range_partition(t.documents.select("doc_id"), "doc_id")


_KV = "user_id || '|' || coalesce(event_type, '')"


@query("parse_kv", "SELECT event_id, CAST(user_id AS VARCHAR) AS key, coalesce(event_type, '') AS value FROM events WHERE user_id IS NOT NULL")
def parse_kv(t: Tables) -> DataFrame:
    line = F.concat(F.col("user_id").cast("string"), F.lit("|"), F.coalesce("event_type", F.lit("")))
    return t.events.where("user_id is not null").select("event_id", wire.parse_kv(line).alias("kv")).select("event_id", "kv.key", "kv.value")


@query("parse_array", "SELECT cluster_id, list_transform(doc_ids, lambda x: coalesce(x, '-,-')) AS items FROM clusters")
def parse_array(t: Tables) -> DataFrame:
    quoted = F.transform("doc_ids", lambda x: F.concat(F.lit('"'), F.coalesce(x, F.lit("-,-")), F.lit('"')))
    return t.clusters.select("cluster_id", wire.parse_array(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))).alias("items"))


@query("parse_headers", "SELECT event_id, CAST(user_id AS VARCHAR) AS who, event_type AS kind FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def parse_headers(t: Tables) -> DataFrame:
    block = strings.fill_template("HTTP/1.1 200 OK\r\nX-User: $\r\nX-Kind: $", "user_id", "event_type")
    rows = t.events.where("user_id is not null and event_type is not null").select("event_id", wire.parse_headers(block).alias("h"))
    return rows.select("event_id", F.col("h")["X-User"].alias("who"), F.col("h")["X-Kind"].alias("kind"))


@query("fill_template", "SELECT event_id, '/pull_data?id=' || user_id || '&kind=' || event_type AS url FROM events")
def fill_template(t: Tables) -> DataFrame:
    return t.events.select("event_id", strings.fill_template("/pull_data?id=$&kind=$", "user_id", "event_type").alias("url"))


@query("request_text", "SELECT event_id, 'POST /pull_data HTTP/1.1' || chr(13) || chr(10) || 'Host: h:80' || chr(13) || chr(10) || 'Content-Type: application/x-www-form-urlencoded' || chr(13) || chr(10) || 'Content-Length: ' || length('unique_id=' || event_id) || chr(13) || chr(10) || chr(13) || chr(10) || 'unique_id=' || event_id AS request FROM events")
def request_text(t: Tables) -> DataFrame:
    return t.events.select("event_id", wire.request_text("h:80", "/pull_data", F.concat(F.lit("unique_id="), F.col("event_id").cast("string"))).alias("request"))


@query("char_count", "SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS n FROM documents")
def char_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", strings.char_count("text", "e").alias("n"))


@query("first_index", "SELECT doc_id, strpos(text, '.') - 1 AS at FROM documents")
def first_index(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", strings.first_index("text", ".").alias("at"))


@query("parse_number", "SELECT id, coalesce(try_cast(id AS DOUBLE), 0) AS number FROM page")
def parse_number(t: Tables) -> DataFrame:
    return t.page.select("id", strings.to_number("id").alias("number"))


_HASH = "list_reduce(list_prepend(5381::HUGEINT, list_transform(range(1, length(hex(encode(term))) + 1, 2), lambda i: CAST('0x' || substr(hex(encode(term)), i, 2) AS INT)::HUGEINT)), lambda h, b: (h * 33 + b) % 18446744073709551616::HUGEINT)"


@query("string_hash", f"SELECT term, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS h FROM (SELECT term, {_HASH} AS h FROM vocab)")
def string_hash(t: Tables) -> DataFrame:
    return t.vocab.select("term", strings.times33("term").alias("h"))


@query("magnitude_distance", f"WITH {D}, f AS (SELECT sqrt_mag AS m FROM d ORDER BY doc_id LIMIT 1) SELECT doc_id, round((sqrt_mag - m) * (sqrt_mag - m), 6) AS distance FROM d, f")
def magnitude_distance(t: Tables) -> DataFrame:
    d = saved(docs_of(t))
    first = d.agg(F.min_by("sqrt_mag", "doc_id").alias("m"))
    return d.crossJoin(F.broadcast(first)).select("doc_id", F.round(neighbors.squared_difference("sqrt_mag", "m"), 6).alias("distance"))  # one row


@query("parse_response", "SELECT event_id, 'HTTP/1.1 200 OK' AS status, CAST(user_id AS VARCHAR) AS who, coalesce(props, '') AS body, length(coalesce(props, '')) AS body_len FROM events WHERE user_id IS NOT NULL")
def parse_response(t: Tables) -> DataFrame:
    whole = F.concat(F.lit("HTTP/1.1 200 OK\r\nX-User: "), F.col("user_id").cast("string"), F.lit("\r\nX-Kind: a:b\r\n\r\n"), F.coalesce("props", F.lit("")))
    rows = t.events.where("user_id is not null").select("event_id", wire.parse_response(whole).alias("r"))
    return rows.select("event_id", F.trim(F.translate("r.status", "\r", "")).alias("status"), F.col("r.headers")["X-User"].alias("who"), "r.body", "r.body_len")


def _stream(t: Tables, name: str) -> DataFrame:
    """A table as a stream of files; a table is one file or a folder of files, and the stream reads the folder that holds
    them."""
    path = t._spark._jvm.org.apache.hadoop.fs.Path(f"{t._dir}/{name}.parquet")
    folder = path.getFileSystem(t._spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    where, what = (str(path), "*.parquet") if folder else (t._dir, f"{name}.parquet")
    return t._spark.readStream.schema(getattr(t, name).schema).option("pathGlobFilter", what).parquet(where)


@query("streaming_frequencies", f"WITH {TOK} SELECT term, count(*) AS total FROM tok GROUP BY 1")
def streaming_frequencies(t: Tables) -> DataFrame:
    """Documents as a stream into running counts, read back when the stream has taken all."""
    return totals_of(running_frequencies(_stream(t, "documents")))


@query("windowed_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def windowed_counts_(t: Tables) -> DataFrame:
    """Events as a stream into counts per day and type, with a watermark of a day."""
    return totals_of(windowed_counts(_stream(t, "events"), "ts", "event_type")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def flagship(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The k heaviest terms of each document of the index built from `documents`."""
    t = Tables(spark, sf_dir)
    rows = build_index(t.documents.select("doc_id", "text"), t.stopword).vectors
    return vectors.top_k(rows, ["doc_id"], F.desc("weight"), F.col("term"), k=k, parts=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
