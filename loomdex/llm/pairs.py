"""Pairs of rows that share a key, and connected components, without unbounded groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved

#: Members above which a bucket is not paired by a join; members of a block when it is paired by blocks.
HOT, BLOCK = 64, 256


def bucket_pairs(rows: DataFrame, marks: DataFrame, near: Callable[[pa.Table, pa.Table], np.ndarray], hot: int = HOT) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids that share a key of rows(key, id, own) and of which one owns it; of those whose
    keys all have more than `hot` members, the pairs that near() keeps.

    Buckets of up to `hot` members are joined with each other.  A larger one is paired whole as well, in salted blocks
    of members against members: near(left, right) says of the blocks' marks(id, ...) which pairs to keep, so that only
    those leave the task and none is lost.
    """
    return shared_pairs(shared(rows), marks, near, hot)


def shared_pairs(many: DataFrame, marks: DataFrame, near: Callable[[pa.Table, pa.Table], np.ndarray], hot: int = HOT) -> DataFrame:
    """bucket_pairs() of the rows that shared() returned."""
    pairs = _within(many.where(F.col("n") <= hot))
    large = many.where(F.col("n") > hot)
    return (pairs if large.isEmpty() else pairs.unionByName(_by_blocks(large, marks, near))).distinct()


def class_pairs(members: DataFrame, block: int = 4 * BLOCK) -> DataFrame:
    """Pairs (i, j), i < j, of the ids of a class in members(id, rep).  A class's rows are cut into parts of about `block`,
    each of which meets the whole class under a key of its own, so that no class is paired in one task."""
    sizes = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
    rows = members.select("id", "rep").join(sizes, "rep").withColumn("parts", F.ceil(F.col("n") / block))
    left = rows.select("rep", F.col("id").alias("i"), F.pmod(F.xxhash64("id"), "parts").alias("part"))
    right = rows.select("rep", F.col("id").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["rep", "part"]).where("i < j").select("i", "j")


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Links (a, b) between classes and the pairs within classes of members(id, rep) as pairs of records (doc_a, doc_b),
    doc_a < doc_b."""
    a = members.select(F.col("rep").alias("a"), F.col("id").alias("i"))
    b = members.select(F.col("rep").alias("b"), F.col("id").alias("j"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select("i", "j")
    return across.unionByName(class_pairs(members)).select(F.least("i", "j").alias("doc_a"), F.greatest("i", "j").alias("doc_b"))


def _by_blocks(many: DataFrame, marks: DataFrame, near: Callable[[pa.Table, pa.Table], np.ndarray], block: int = BLOCK) -> DataFrame:
    """Pairs of members of the same bucket that near() keeps; a bucket's blocks of about `block` members meet two by two."""

    def run(group: pa.Table) -> pa.Table:
        part, first, second = group["part"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py()
        left = group.filter(pa.array(part == first))
        right = left if first == second else group.filter(pa.array(part == second))
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not (left.num_rows and right.num_rows):
            return none
        x, y = left["id"].to_numpy(), right["id"].to_numpy()
        u, v = (np.asarray(t["own"].to_pylist(), bool) for t in (left, right))
        p, q = np.nonzero(near(left, right) & (u[:, None] | v[None, :]) & (x[:, None] != y[None, :]))
        return pa.table({"a": np.minimum(x[p], y[q]), "b": np.maximum(x[p], y[q])})

    parts = F.ceil(F.col("n") / block)
    placed = many.select("key", "id", "own", parts.alias("parts"), F.pmod(F.xxhash64("id", "key"), parts).alias("part"))
    met = placed.select("key", "id", "own", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    met = met.select("key", "id", "own", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return met.join(marks, "id").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def shared(rows: DataFrame) -> DataFrame:
    """rows with n, the members of their bucket, if it has more than one and one of them owns it.  Counts are summed
    map-side first, and the join is one whose skewed partitions AQE splits, so a key of a third of all rows is spread."""
    stats = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 and owned").select("key", "n")
    return saved(rows.join(stats.hint("shuffle_hash"), "key"))


def _within(many: DataFrame) -> DataFrame:
    a = many.select("key", F.col("id").alias("a"), F.col("own").alias("own_a"))
    b = many.select("key", F.col("id").alias("b"), F.col("own").alias("own_b"))
    return (
        a.join(b, "key")
        .where("a <> b and own_a")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): rows (id, root), root the smallest id of the component.

    Alternates large-star and small-star steps, which need a number of rounds logarithmic in the size of
    a component; hubs are aggregated with map-side partial minima, so no vertex's links gather in one task.
    Every round is written to the shared folder.  Raises if `rounds` are not enough.
    """
    now = saved(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    for _ in range(rounds):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        after = saved(
            small.select(F.col("m").alias("lo"), "hi")
            .unionByName(small.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")))
            .distinct()
        )
        # the same edges before and after: every component is a star
        mark = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")).alias("s"))
        same = mark(now).union(mark(after)).distinct().count() == 1
        drop(now)
        now = after
        if same:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
    raise RuntimeError(f"components: not settled after {rounds} rounds")
