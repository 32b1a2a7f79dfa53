"""Sparse vectors: cosine with centroids, closest cluster, query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import bounded_join, narrow
from .text import index_frequencies


def dot_products(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(doc_id, cluster_id, dot): sums over shared terms only; pairs without a shared term have no row."""
    joined = bounded_join(vectors.select("doc_id", "term", "weight"), centroids.select("cluster_id", "term", "mean"), "term")
    return joined.groupBy("doc_id", "cluster_id").agg(F.sum(F.col("weight") * F.col("mean")).alias("dot"))


def cosine_to_centroids(vectors: DataFrame, docs: DataFrame, centroids: DataFrame, clusters: DataFrame) -> DataFrame:
    """(doc_id, cluster_id, sim): dot over the product of docs.sqrt_mag and clusters.sqrt_mag, the observed likeness
    (magnitudes are those of raw counts, so it is no true cosine).  A product of 0 or null gives null."""
    out = dot_products(vectors, centroids).join(docs.select("doc_id", F.col("sqrt_mag").alias("m")), "doc_id")
    out = bounded_join(out, clusters.select("cluster_id", F.col("sqrt_mag").alias("k")), "cluster_id")
    return out.select("doc_id", "cluster_id", F.try_divide("dot", F.col("m") * F.col("k")).alias("sim"))


def closest_cluster(sims: DataFrame, docs: DataFrame, first: int = 0) -> DataFrame:
    """(doc_id, cluster_id, sim): the most similar cluster, ties to the lowest id.  Documents that share no term with
    any centroid, or have no magnitude, fall to the cluster `first` with likeness 0."""
    best = sims.where("sim > 0").groupBy("doc_id").agg(F.max(F.struct("sim", (-F.col("cluster_id")).alias("n"))).alias("t"))
    all_ = docs.select("doc_id").distinct().join(best, "doc_id", "left")
    return all_.select("doc_id", F.coalesce(-F.col("t.n"), F.lit(first)).alias("cluster_id"), F.coalesce("t.sim", F.lit(0.0)).alias("sim"))


def as_rows(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, mag, terms array<bigint>, weights array<double>): a row per document with terms as hashes and its
    magnitude; documents without an entry or magnitude are absent.  A row is as long as its document has terms."""
    entry = F.struct(F.xxhash64("term").alias("t"), F.col("weight").alias("w"))
    rows = vectors.groupBy("doc_id").agg(F.collect_list(entry).alias("e"))
    rows = rows.join(docs.where("sqrt_mag is not null").select("doc_id", F.col("sqrt_mag").alias("mag")), "doc_id")
    return rows.select("doc_id", "mag", F.col("e.t").alias("terms"), F.col("e.w").alias("weights"))


class Centroids:
    """Means of a bounded number of clusters as a matrix of terms by clusters, for dot products with batches of as_rows()."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, means: np.ndarray, mags: np.ndarray):
        self.ids, self.terms = ids, terms
        self.matrix = np.zeros((len(terms) + 1, len(ids)))  # the last row is that of absent terms
        self.matrix[:-1] = (means / np.where(mags == 0, np.inf, mags)[:, None]).T  # a magnitude of 0 gives likeness 0

    def sims(self, batch: pa.RecordBatch) -> np.ndarray:
        terms, starts = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        at = np.where(self.terms[at] == terms, at, len(self.terms))
        dots = np.add.reduceat(self.matrix[at] * batch.column(3).flatten().to_numpy()[:, None], starts[:-1] - starts[0], axis=0)
        mag = batch.column(1).to_numpy()
        return dots / np.where(mag == 0, np.inf, mag)[:, None]

    def closest(self, batch: pa.RecordBatch, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and likeness of each row, as closest_cluster() has it."""
        sims = self.sims(batch)
        best = sims.argmax(axis=1)
        top = sims[np.arange(len(best)), best]
        return np.where(top > 0, self.ids[best], first), np.maximum(top, 0.0)


def query_vector(queries: DataFrame, vocab: DataFrame, stopwords: DataFrame, mode: str = "observed", id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, weight): stems of a query that the vocabulary holds, through the index's own pipeline (words, stop
    filter, stems), weight tf / df; the index stays as it is."""
    tf = index_frequencies(narrow(queries, doc_id=id_col, text=F.col(f"`{text_col}`")), stopwords, mode).withColumnRenamed("doc_id", "query_id")
    return bounded_join(tf, vocab.select("term", "df"), "term").select("query_id", "term", F.try_divide(F.col("tf").cast("double"), F.col("df")).alias("weight"))


def score_query(query: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents of greatest true cosine with each query.

    A top-k list per query; partial lists of 64 salted parts come first, so a query that hits a third of all documents
    is not sorted in one task."""
    q = query.select("query_id", "term", F.col("weight").alias("q"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    dn = vectors.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("dn"))
    dots = bounded_join(vectors, q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))
    scored = dots.join(dn, "doc_id").join(qn, "query_id").select("query_id", "doc_id", F.round(F.try_divide("dot", F.col("dn") * F.col("qn")), 9).alias("score"))
    return top_k(scored, ["query_id"], F.desc("score"), F.col("doc_id"), k=k)


def top_k(rows: DataFrame, keys: list[str], *order: object, k: int, parts: int = 64) -> DataFrame:
    """The first k rows of each group, with their rank, by partial lists of salted parts."""
    salted = Window.partitionBy(*keys, F.pmod(F.xxhash64(*rows.columns), F.lit(parts))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
