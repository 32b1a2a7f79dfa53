"""Keyed tables (hash maps), top-k (heaps), ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_last(rows: DataFrame, key: str, value: str, *seq: str) -> DataFrame:
    """(key, value) with the last value of each key in the order `seq` (insert and replace)."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*seq)).alias(value))


def keyed_multimap(rows: DataFrame, key: str, value: str, *seq: str) -> DataFrame:
    """(key, values) with all values of a key in the order `seq` (insert and append).

    One value per key holds the whole list, by definition; keys_of_size() counts first where lists may be long."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*seq, F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def get(rows: DataFrame, key: str, wanted: object) -> DataFrame:
    """All rows of a key; none on a miss."""
    return rows.where(F.col(key) == F.lit(wanted))


def filtered_keys(rows: DataFrame, key: str, value: str, predicate: Column) -> DataFrame:
    """(key): distinct keys that have a value which meets the predicate; null keys and values never do."""
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull() & predicate).select(key).distinct()


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows without those whose key is listed."""
    return rows.join(keys.select(key).distinct(), key, "left_anti").select(*rows.columns)


def heap_top(rows: DataFrame, weight: str, tie: str, k: int) -> DataFrame:
    """The k rows of greatest weight, ties by `tie`, with their place: pushes all, pops k (in true order)."""
    top = rows.where(F.col(weight).isNotNull()).orderBy(F.desc(weight), tie).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(weight), tie)))  # k rows


def decrease_key(rows: DataFrame, changes: DataFrame, key: str, weight: str) -> DataFrame:
    """rows with the weights of `changes` where these are lower."""
    new = changes.groupBy(key).agg(F.min(weight).alias("new"))
    return rows.join(new, key, "left").select(*[F.least(weight, F.coalesce("new", weight)).alias(c) if c == weight else F.col(c) for c in rows.columns])


def range_partition(rows: DataFrame, order: str, parts: int = 8, total: int | None = None) -> DataFrame:
    """Adds (index, part): contiguous ranges of floor(n / parts) rows, the last takes the rest (with n < parts, all).

    Places come from a range partitioning and the row counts of its partitions (one number each), so that no task
    orders all rows."""
    n = rows.count() if total is None else total
    ordered = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    at = ordered.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    placed = at.join(F.broadcast(before), "_p").withColumn("index", F.col("_b") + F.col("_i") - 1)  # one row per partition
    size = n // parts
    part = F.least(F.floor(F.col("index") / F.lit(size)), F.lit(parts - 1)) if size else F.lit(parts - 1)
    return placed.select(*rows.columns, "index", part.cast("int").alias("part"))
