"""How distinctive a term is for a record: contributions to a smoothed relative entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_join, narrow, saved

#: Pseudo-count of the Dirichlet smoothing, and the records a term must occur in to be scored.
MU, MIN_RECORDS = 50.0, 2

#: White space of any script at either end of a term.
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def clean_counts(counts: DataFrame, id_col: str = "doc_id", term_col: str = "term", tf_col: str = "tf") -> DataFrame:
    """(doc_id, term, tf) with terms trimmed and lower-cased, each (record, term) once (the largest count, should
    counts differ).  Rows whose id, term or count is null, or whose term is blank, are dropped."""
    rows = narrow(counts, doc_id=F.col(f"`{id_col}`").cast("string"), term=F.lower(F.regexp_replace(F.col(f"`{term_col}`").cast("string"), EDGES, "")), tf=F.col(f"`{tf_col}`").cast("long"))
    return rows.where("doc_id is not null and term <> '' and tf is not null").groupBy("doc_id", "term").agg(F.max("tf").alias("tf"))


def distinctive_terms(counts: DataFrame, mu: float = MU, min_records: int = MIN_RECORDS, **columns: str) -> DataFrame:
    """Every (record, term) with its divergence score.

    With P(t|d) = (tf + mu P(t|C)) / (len + mu), the record's model smoothed by the collection's, the score is
    the term's share P(t|d) ln(P(t|d) / P(t|C)) of the relative entropy between both.  Terms of fewer than
    `min_records` records are not scored (but count towards lengths and totals).

    Returns (doc_id, term, tf, length, df, records, background, score): length is the record's sum of tf, df the
    records that hold the term, records the number of records, background = P(t|C).  Cleaning: see clean_counts().  Lengths and document
    frequencies are aggregated map-side; they are broadcast only while short, and joined by shuffle beyond.
    Ties need no order, empty tables give no rows.
    """
    tf = saved(clean_counts(counts, **columns))
    lengths = saved(tf.groupBy("doc_id").agg(F.sum("tf").alias("length")))
    terms = saved(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")))
    whole = lengths.agg(F.count("*").alias("records"), F.sum("length").alias("all")).first()
    records, everything = whole["records"], float(whole["all"] or 0)
    rows = bounded_join(bounded_join(tf, terms.where(F.col("df") >= min_records), "term"), lengths, "doc_id")
    background = F.col("total") / F.lit(everything or 1.0)
    model = (F.col("tf") + mu * background) / (F.col("length") + mu)
    return rows.select("doc_id", "term", "tf", "length", "df", F.lit(records).cast("long").alias("records"), background.alias("background"), divergence(model, background).alias("score"))


def divergence(model: Column, background: Column) -> Column:
    """A term's share of the relative entropy between a model and the collection."""
    return model * F.ln(model / background)


def terms_of_weight(counts: DataFrame, least: float, mu: float = MU, **columns: str) -> DataFrame:
    """The (record, term) of distinctive_terms() whose weight (tf / length) ln(records / df) / ln(records) is at least
    `least`: selected by their divergence score, then checked.

    The weight holds if tf / length >= r = least ln(records) / ln(records / df), so if P(t|d) is at least
    (r length + mu P(t|C)) / (length + mu).  The score grows with P(t|d) above P(t|C), so where r >= P(t|C) it is at
    least the score of that bound; the rest are kept for the check whatever their score."""
    rows = distinctive_terms(counts, mu, **columns)
    rarity = F.try_divide(F.ln(F.col("records") / F.col("df")), F.ln(F.col("records")))
    share = F.try_divide(F.lit(least), rarity)
    bound = divergence((share * F.col("length") + mu * F.col("background")) / (F.col("length") + mu), F.col("background"))
    likely = rows.where((F.col("score") >= bound - 1e-9) | (share < F.col("background")))
    return likely.where(F.try_divide(F.col("tf"), F.col("length")) * rarity >= least)
