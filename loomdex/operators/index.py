"""The inverted index: frequencies, magnitudes, pruning, weights, postings; and its tables made tidy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import bounded_join, narrow

#: Bounds of the vocabulary: least document frequency, greatest share of documents.
MIN_DF, MAX_SHARE = 4, 0.4


def tidy_tokens(tokens: DataFrame) -> DataFrame:
    """Repeated rows once, rows without id or term dropped."""
    return narrow(tokens, doc_id="doc_id", pos="pos", term="term").where("doc_id is not null and term is not null").distinct()


def tidy_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, title, mag): of a record indexed twice the later row holds; ties go to the greater title."""
    last = F.max(F.struct("indexed_at", "title", "mag")).alias("t")
    return docs.where("doc_id is not null").groupBy("doc_id").agg(last).select("doc_id", "t.title", "t.mag")


def tidy_vocab(vocab: DataFrame) -> DataFrame:
    """(term, df): of repeated terms the highest count holds."""
    return vocab.where("term is not null").groupBy("term").agg(F.max("df").alias("df"))


def tidy_vectors(vectors: DataFrame) -> DataFrame:
    """(doc_id, term, weight): repeated entries once, weights that are null, NaN or 0 are absent."""
    rows = narrow(vectors, doc_id="doc_id", term="term", weight=F.col("weight").cast("double"))
    return rows.where("doc_id is not null and term is not null and weight is not null and not isnan(weight) and weight <> 0").groupBy("doc_id", "term").agg(F.max("weight").alias("weight"))


def term_frequency(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tf)."""
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df) from (doc_id, term, tf)."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def magnitudes(tf: DataFrame) -> DataFrame:
    """(doc_id, mag, sqrt_mag): sum of tf squared over all terms of a record, before pruning, and its root."""
    return tf.groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("tf")).alias("mag")).withColumn("sqrt_mag", F.sqrt("mag"))


def prune_vocab(df: DataFrame, documents: int, mode: str = "observed", least: int = MIN_DF, share: float = MAX_SHARE) -> DataFrame:
    """Terms kept: df >= least and df / N <= share.  observed: the quotient is an integer one, as in the index, so only
    terms in every document exceed the share; intended: the true ratio."""
    ratio = F.floor(F.col("df") / F.lit(documents or 1)) if mode == "observed" else F.col("df") / F.lit(documents or 1)
    return df.where((F.col("df") >= least) & (ratio <= share))


def weights(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, term, weight = tf / df) for terms of the vocabulary."""
    return bounded_join(tf, vocab.select("term", "df"), "term").select("doc_id", "term", F.try_divide(F.col("tf").cast("double"), F.col("df")).alias("weight"))


def postings(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """(term, df, postings array<struct<doc_id, tf>>), ordered by id within a term.  A term's postings are one value by
    definition of the format; the row-wise form for larger ones is tf itself."""
    lists = bounded_join(tf, vocab.select("term", "df"), "term").groupBy("term", "df").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))
    return lists.select("term", "df", "postings")
