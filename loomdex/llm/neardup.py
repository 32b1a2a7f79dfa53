"""Near-duplicate records: pigeonhole blocks of min-wise fingerprints.

A record's fingerprint is a row of `blocks * span` components, each the least value of one hash function
over the record's shingles, so that two records differ in a component with probability 1 - Jaccard.  Cut
into `blocks` blocks, two fingerprints whose Hamming distance is below `blocks` must agree in a whole block
(pigeonhole); beyond that, a pair of similarity s still does with probability 1 - (1 - s**span)**blocks.
Records are joined on blocks, the Hamming distance of the fingerprints is verified, then the exact sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_join, in_slices, narrow, saved
from .crosspoly import mix64
from .pairs import bucket_pairs, components, record_pairs
from .words import WordHashes, distinct, shingles, word_hashes

BLOCKS, SPAN = 32, 3


def _joined(docs: DataFrame, id_col: str, title_col: str | None, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    if title_col:
        text = F.concat(F.coalesce(F.col(f"`{title_col}`"), F.lit("")), F.lit(" "), text)
    return narrow(docs, id=F.col(f"`{id_col}`").cast("long"), text=text).where("id is not null")


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    cache = WordHashes()
    for batch in in_slices(batches, 1):
        flat, offsets = word_hashes(batch.column(1).to_pylist(), cache)
        doc, _, h = shingles(flat, offsets, k)
        doc, h = distinct(doc, h)
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        yield batch.column(0), ends, doc, h


def fingerprints(texts: DataFrame, k: int, blocks: int = BLOCKS, span: int = SPAN) -> DataFrame:
    """texts(id, text) -> (id, n, c1, c2, sig): number of distinct shingles of k words, a 128-bit name of the
    set of shingles (equal for equal sets) and the fingerprint, 16 bits a component.  Texts of fewer than k
    words have n = 0 and no fingerprint."""
    m = blocks * span
    factors = mix64(np.arange(m, dtype=np.uint64), 5) | np.uint64(1)
    adds = mix64(np.arange(m, dtype=np.uint64), 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ends, _, h in _sets(batches, k):
            n = np.diff(ends)
            full = n > 0
            starts = ends[:-1][full]
            sig = np.zeros((len(n), m), np.uint16)
            names = np.zeros((2, len(n)), np.uint64)
            if len(starts):
                with np.errstate(over="ignore"):
                    for j in range(2):
                        names[j, full] = np.add.reduceat(mix64(h, 11 + j), starts)
                    for j in range(m):
                        low = np.minimum.reduceat((h * factors[j] + adds[j]) >> np.uint64(20), starts)
                        sig[full, j] = mix64(low, 3) >> np.uint64(48)
            raw = [s.tobytes() if f else None for s, f in zip(sig, full)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n.astype(np.int32)), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), pa.array(raw, pa.binary())],
                names=["id", "n", "c1", "c2", "sig"],
            )

    return texts.mapInArrow(run, "id long, n int, c1 long, c2 long, sig binary")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """texts(id, text) -> (id, items array<bigint>), the distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ends, _, h in _sets(batches, k):
            items = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, items], names=["id", "items"])

    return texts.mapInArrow(run, "id long, items array<bigint>")


def hamming(pairs: DataFrame, most: int) -> DataFrame:
    """pairs(a, b, sig_a, sig_b) -> (a, b) whose fingerprints differ in at most `most` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (2, 3))
                near = pa.array((x != y).sum(axis=1) <= most)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def near_by_hamming(most: int) -> Callable[[pa.Table, pa.Table], np.ndarray]:
    """near() for bucket_pairs() over marks(id, sig): fingerprints that differ in at most `most` components."""

    def near(left: pa.Table, right: pa.Table) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(t.num_rows, -1) for t in (left, right))
        return np.stack([(y != one).sum(axis=1) <= most for one in x])

    return near


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", title_col: str | None = "title", text_col: str = "text", k: int = 5, threshold: float = 0.8, blocks: int = BLOCKS, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Classes and similar pairs.

    Returns (members(id, rep), links(a, b, similarity)): every record's class, named by the least id that has
    the same set of shingles, and the pairs of classes with Jaccard similarity >= threshold.  Records of fewer
    than k words (null and blank texts among them) are classes of their own without links.  Repeated ids count
    once, null ids are dropped, columns other than the named ones are ignored; empty tables give empty results.
    """
    texts = _joined(docs, id_col, title_col, text_col)
    prints = saved(fingerprints(texts, k, blocks, span))
    reps = prints.where("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("rep"))
    short = prints.where("n = 0").select("id", F.col("id").alias("rep")).distinct()
    members = saved(prints.where("n > 0").select("id", "c1", "c2").join(reps, ["c1", "c2"]).select("id", "rep").distinct().unionByName(short))
    own = saved(prints.where("n > 0").join(members.where("id = rep").select("id"), "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "sig"))
    step = 2 * span
    keys = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(sig, {i * step + 1}, {step})")) for i in range(blocks)])
    rows = own.select(F.explode(keys).alias("key"), "id", F.lit(True).alias("own"))
    m = blocks * span
    most = math.ceil(m * (1 - threshold) + 5 * math.sqrt(m * threshold * (1 - threshold)))
    sig = own.select("id", "sig")
    candidates = bucket_pairs(rows, sig, near_by_hamming(most))
    both = candidates.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    near = saved(hamming(both, most))
    wanted = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    sets = saved(shingle_sets(bounded_join(texts, saved(wanted), "id", "left_semi").dropDuplicates(["id"]), k))
    x = near.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = x.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)
    return members, links


def duplicate_pairs(docs: DataFrame, **how: object) -> DataFrame:
    """Pairs of records (doc_a, doc_b), doc_a < doc_b, at or above the threshold, the pairs within a class too.

    Only for results whose format asks for record pairs; duplicate_groups() does not expand copies."""
    members, links = near_duplicates(docs, **how)
    return record_pairs(members, saved(links))


def duplicate_groups(docs: DataFrame, **how: object) -> DataFrame:
    """One row per record: doc_id, class_id (equal sets of shingles), group_id (connected by links between
    classes) and links, the number of other classes linked to the record's class."""
    members, links = near_duplicates(docs, **how)
    links = saved(links)
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    roots = components(links).withColumnRenamed("id", "rep")
    return (
        members.join(degree, "rep", "left")
        .join(roots, "rep", "left")
        .select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
