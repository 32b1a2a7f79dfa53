"""Whole runs: index build, clustering, neighbour search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, index, neighbors, text
from ..scratch import saved


@dataclass
class Index:
    """docs(doc_id, mag, sqrt_mag), tf, vocab(term, df), vectors(doc_id, term, weight)."""

    docs: DataFrame
    tf: DataFrame
    vocab: DataFrame
    vectors: DataFrame


def build_index(documents: DataFrame, stopwords: DataFrame, mode: str = "observed") -> Index:
    """documents(doc_id, text) -> the index; documents without a surviving term are kept with magnitude 0."""
    tf = saved(text.index_frequencies(documents, stopwords, mode))
    ids = documents.select("doc_id").distinct()
    docs = ids.join(index.magnitudes(tf), "doc_id", "left").fillna(0, ["mag"]).fillna(0.0, ["sqrt_mag"])
    vocab = saved(index.prune_vocab(index.document_frequency(tf), ids.count(), mode))
    return Index(saved(docs), tf, vocab, saved(index.weights(tf, vocab)))


def nearest_in_cluster(built: Index, assignments: DataFrame, centroids: DataFrame, queries: DataFrame) -> DataFrame:
    """Closest members of the same cluster over its ranked dimensions: (query_id, doc_id, distance, rank)."""
    members = assignments.groupBy("cluster_id").agg(F.count("*").alias("n"))
    rows = assignments.join(members, "cluster_id")
    stats = cluster.reload_centroid(rows, built.vectors)
    return neighbors.nearest_exact(built.vectors, assignments, neighbors.rank_dimensions(stats), queries)
