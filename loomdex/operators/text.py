"""From documents to terms: words, stop words (exact and by prefix), prefix weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import with_stem
from ..functions.strings import words
from ..scratch import bounded_join, narrow, saved


def tokenize_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", newline_as_space: bool = False) -> DataFrame:
    """(doc_id, pos, term), one row per word; pos counts from 0.  Null texts have no rows."""
    rows = narrow(docs, doc_id=id_col, w=words(F.col(f"`{text_col}`"), newline_as_space))
    return rows.select("doc_id", F.posexplode("w").alias("pos", "term"))


def stop_list(stopwords: DataFrame, column: str = "word") -> DataFrame:
    """(term): distinct stop words, trimmed and lower-cased; nulls and blanks fall away."""
    return narrow(stopwords, term=F.lower(F.trim(F.col(f"`{column}`")))).where("term <> ''").distinct()


def prefix_weights(words_: DataFrame, column: str = "word") -> DataFrame:
    """The prefix tree of a list of words in order of insertion (line_no): (prefix, end_weight, thru_weight).

    Every new node counts one end, every existing node on the way one pass, and the last node of a word one more end
    if it was there before.  So all prefixes are terminal, which the observed stop filter rests on.
    """
    rows = narrow(words_, n="line_no", word=F.col(f"`{column}`")).where("word <> ''")
    each = rows.select("n", "word", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", F.lit(1), i))).alias("i", "prefix"))
    last = F.col("prefix") == F.col("word")
    total = F.count("*")
    ends = F.sum(last.cast("long"))
    first_is_last = F.min_by(last, "n")
    return each.groupBy("prefix").agg(
        (F.when(first_is_last, ends).otherwise(ends + 1)).alias("end_weight"),
        (total - 1 - ends + F.when(first_is_last, 1).otherwise(0)).alias("thru_weight"),
    )


def stop_prefixes(stopwords: DataFrame) -> DataFrame:
    """(term): every non-empty prefix of every stop word."""
    return stop_list(stopwords).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.substring("term", F.lit(1), i))).alias("term")).distinct()


def drop_stopwords(tokens: DataFrame, stopwords: DataFrame, mode: str = "observed") -> DataFrame:
    """tokens(.., term) without stop words.  observed: words that are a prefix of any stop word are dropped too, as the
    index does; intended: only the stop words themselves."""
    stops = stop_prefixes(stopwords) if mode == "observed" else stop_list(stopwords)
    return bounded_join(tokens, stops, "term", "left_anti").select(*tokens.columns)


def stem_terms(tokens: DataFrame) -> DataFrame:
    """tokens(.., term) with terms replaced by stems.  Distinct terms are stemmed once; their table is broadcast while
    it is counted to be short, and joined by shuffle beyond."""
    stems = saved(with_stem(tokens.select("term").where("term is not null").distinct()))
    out = bounded_join(tokens, stems, "term")
    return out.select(*[F.col("stem").alias("term") if c == "term" else F.col(c) for c in tokens.columns])


def index_terms(docs: DataFrame, stopwords: DataFrame, mode: str = "observed", newline_as_space: bool = False) -> DataFrame:
    """The index's pipeline: words, stop filter (before stemming), stems: (doc_id, pos, term)."""
    return stem_terms(drop_stopwords(tokenize_terms(docs, newline_as_space=newline_as_space), stopwords, mode))


def stem_frequencies(tf: DataFrame) -> DataFrame:
    """tf(doc_id, term, tf) with terms replaced by stems, counts of words of one stem added up.  Words are counted before
    they are stemmed, so each is stemmed once and what is shuffled again is a row per word of a record, not per token."""
    stems = saved(with_stem(tf.select("term").where("term is not null").distinct()))
    return bounded_join(tf, stems, "term").groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def index_frequencies(docs: DataFrame, stopwords: DataFrame, mode: str = "observed", newline_as_space: bool = False) -> DataFrame:
    """(doc_id, term, tf) of the index: words, counted, stop filter, stems."""
    words_ = tokenize_terms(docs, newline_as_space=newline_as_space).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return stem_frequencies(drop_stopwords(saved(words_), stopwords, mode))
