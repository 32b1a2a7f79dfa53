"""Frequency of every distinct term, by recursive radix partitioning and out-of-core aggregation."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch_dir
from .common import narrow
from .distinctive import EDGES

#: Bits of the term's hash per level, levels, and rows above which a partition is split further.
BITS, LEVELS, PART_ROWS = 8, 3, 2_000_000
#: A term of fewer records is rare, one in more than this share of the records is common.
MIN_RECORDS, MAX_SHARE = 4, 0.4


def radix_splits(rows: DataFrame, part_rows: int = PART_ROWS, bits: int = BITS, levels: int = LEVELS) -> dict[int, dict[int, int]]:
    """For rows(h, doc): by level, the prefixes (hash bits so far) that hold too many rows, with their row counts.

    A prefix listed at a level is split by the next level's bits; one listed at the last level is, as a rule,
    a single hot term, and is split by record.  Only the counts of oversized prefixes' children reach the
    driver: at most 2**bits for each prefix, of which there are at most (rows / part_rows).
    """
    out: dict[int, dict[int, int]] = {}
    mask = (1 << bits) - 1
    for level in range(levels):
        some = rows
        if level:
            if not out[level - 1]:
                break
            some = rows.where(F.expr(f"h & {(1 << (bits * level)) - 1}").isin(list(out[level - 1])))
        key = F.expr(f"h & {(1 << (bits * (level + 1))) - 1}")
        counts = some.groupBy(key.alias("p")).agg(F.count("*").alias("n")).where(F.col("n") > part_rows).collect()
        out[level] = {r["p"]: r["n"] for r in counts}
    return out


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of repeated (record, term) within a batch the row with the largest count."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch]).group_by(["doc", "term", "part"]).aggregate([("tf", "max")])
            yield from table.rename_columns(["doc", "term", "part", "tf"]).to_batches()


def term_frequencies(counts: DataFrame, id_col: str = "doc_id", term_col: str = "term", tf_col: str = "tf", min_records: int = MIN_RECORDS, max_share: float = MAX_SHARE, part_rows: int = PART_ROWS, memory: str = "256MB") -> DataFrame:
    """Every distinct term: (term, total, df, share, mark).

    total is the sum of counts, df the number of records that hold the term, share = df / records, mark `rare`
    if df < min_records, `common` if df > max_share * records (rare comes first), else null.  Terms are trimmed
    and lower-cased; a repeated (record, term) counts once, with its largest count; rows with a null id, count
    or term, or a blank term, are dropped.  Empty tables give no rows.

    Rows are dealt to partitions by hash bits of the term (the shuffle's files on disk are the spilled
    partitions); partitions above `part_rows` are split by further bits, and what is still above (one hot term)
    by record.  Each partition streams through DuckDB, which aggregates out of core under `memory` with its
    spill files in the shared folder (where that is no file system, partitions have to fit `memory` and nothing is
    spilled to an executor's own disk); partial results of split terms are added up.
    """
    spark = counts.sparkSession
    rows = narrow(counts, doc=F.col(f"`{id_col}`").cast("string"), term=F.lower(F.regexp_replace(F.col(f"`{term_col}`").cast("string"), EDGES, "")), tf=F.col(f"`{tf_col}`").cast("long"))
    rows = rows.where("doc is not null and term <> '' and tf is not null").withColumn("h", F.xxhash64("term"))
    splits = radix_splits(rows.select("h"), part_rows)
    part = F.expr(f"h & {(1 << BITS) - 1}")
    for level in range(1, LEVELS):
        if splits.get(level - 1):
            part = F.when(F.expr(f"h & {(1 << (BITS * level)) - 1}").isin(list(splits[level - 1])), F.expr(f"(h & {(1 << (BITS * (level + 1))) - 1}) + {level << 40}")).otherwise(part)
    hot = splits.get(LEVELS - 1) or {}
    if hot:
        fan = -(-max(hot.values()) // part_rows) * 2
        last = F.expr(f"h & {(1 << (BITS * LEVELS)) - 1}")
        part = F.when(last.isin(list(hot)), last + F.lit(LEVELS << 40) + F.pmod(F.xxhash64("doc"), F.lit(fan)) * F.lit(1 << 44)).otherwise(part)
    folder = urlparse(scratch_dir(spark))
    spill = os.path.join(folder.path, f"duckdb-{uuid.uuid4().hex}") if folder.scheme in ("", "file") else None

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def stream() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        own = os.path.join(spill, uuid.uuid4().hex) if spill else ""
        if own:
            os.makedirs(own)  # DuckDB creates no parent folder
        con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": False, "temp_directory": own})
        try:
            reader = pa.RecordBatchReader.from_batches(first.schema, stream())
            con.register("source", reader)
            out = con.sql("select term, sum(tf)::bigint as total, count(*)::bigint as df from (select doc, term, max(tf) as tf from source group by doc, term) group by term").to_arrow_reader(100_000)
            yield from out
        finally:
            con.close()
            if own:
                shutil.rmtree(own, ignore_errors=True)

    # repeats of one (record, term) cannot be dealt to several partitions, so they fall together batch by batch first
    apart = rows.select("doc", "term", "tf", part.alias("part")).mapInArrow(_once, "doc string, term string, part long, tf long")
    dealt = apart.repartition("part").drop("part")
    partial = dealt.mapInArrow(aggregate, "term string, total long, df long")
    records = rows.agg(F.count_distinct("doc")).first()[0]
    sums = partial.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    share = F.col("df") / F.lit(float(records or 1))
    mark = F.when(F.col("df") < min_records, "rare").when(F.col("df") > max_share * F.lit(float(records)), "common")
    return sums.select("term", "total", "df", share.alias("share"), mark.alias("mark"))
