"""Neighbours within a cluster: discriminating dimensions, median splits, exact and tree search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import bounded_join, saved
from .vectors import top_k


def rank_dimensions(centroids: DataFrame) -> DataFrame:
    """(cluster_id, rank, term, score): of a cluster with n terms, the ceil(ln n + 1) terms of greatest
    0.6 stddev + doc_freq among those with doc_freq < ln n + 1; ties by term."""
    sizes = centroids.groupBy("cluster_id").agg(F.count("*").alias("terms"))
    rows = bounded_join(centroids, sizes, "cluster_id").withColumn("cap", F.ln("terms") + 1)
    rows = rows.where("doc_freq < cap").select("cluster_id", "term", (0.6 * F.coalesce("stddev", F.lit(0.0)) + F.col("doc_freq")).alias("score"), F.ceil("cap").alias("most"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("most")).select("cluster_id", "rank", "term", "score")


def dimension_cycle(dimensions: DataFrame) -> DataFrame:
    """(cluster_id, rank, term, next_term): the next dimension, the first after the last."""
    w = Window.partitionBy("cluster_id").orderBy("rank")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return dimensions.select("cluster_id", "rank", "term", F.coalesce(F.lead("term").over(w), F.first("term").over(whole)).alias("next_term"))


def median_split(points: DataFrame, vector: str = "embedding", id_col: str = "vec_id", dims: int = 2, depth: int = 2) -> DataFrame:
    """(id, node, level, pivot): a k-d tree of `depth` levels: each node orders its points by one dimension (null first,
    ties by id), the point at floor((1 + n) / 2) is the pivot, smaller ones go left, larger ones right.

    node numbers the tree like a heap (root 1); level is where the point rests: as pivot, or below the last level.
    Each level is one window per node; the first levels have few nodes, so their order is made by ranges in tree building
    over very large sets (range_partition)."""
    rows = points.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).withColumn("node", F.lit(1).cast("long")).withColumn("level", F.lit(None).cast("int")).withColumn("pivot", F.lit(False))
    for level in range(depth):
        value = F.get("v", F.lit(level % dims)).cast("double")
        w = Window.partitionBy("node", F.col("level").isNull()).orderBy(F.asc_nulls_first(value), "id")
        n = F.count("*").over(Window.partitionBy("node", F.col("level").isNull()))
        rows = rows.withColumn("r", F.row_number().over(w)).withColumn("m", F.floor((n + 1) / 2))
        open_ = F.col("level").isNull()
        rows = rows.select("id", "v",
            F.when(open_ & (F.col("r") != F.col("m")), F.col("node") * 2 + (F.col("r") > F.col("m")).cast("long")).otherwise(F.col("node")).alias("node"),
            F.when(open_ & (F.col("r") == F.col("m")), F.lit(level)).otherwise(F.col("level")).alias("level"),
            (F.col("pivot") | (open_ & (F.col("r") == F.col("m")))).alias("pivot"))
    return rows.select("id", "node", F.coalesce("level", F.lit(depth)).alias("level"), "pivot")


def nearest_exact(vectors: DataFrame, assignments: DataFrame, dimensions: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    """(query_id, doc_id, distance, rank): for queries(doc_id), the k members of the same cluster, other than itself, of
    least squared distance over the cluster's chosen dimensions (absent weights are 0); ties by id.

    Only rows on chosen dimensions are joined: distance = |q|^2 + |d|^2 - 2 q.d, with q.d over shared terms."""
    placed = vectors.join(assignments.select("doc_id", "cluster_id"), "doc_id")
    chosen = bounded_join(placed, dimensions.select("cluster_id", "term"), ["cluster_id", "term"])
    norms = chosen.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm"))
    q = queries.select(F.col("doc_id").alias("query_id")).distinct()
    mine = assignments.select(F.col("doc_id").alias("query_id"), "cluster_id").join(q, "query_id", "left_semi")
    others = assignments.select("doc_id", "cluster_id")
    pairs = bounded_join(others, mine, "cluster_id").where("doc_id <> query_id").select("query_id", "doc_id")  # a stated query set against its clusters
    wanted = bounded_join(chosen.withColumnRenamed("doc_id", "query_id"), q, "query_id", "left_semi").select("query_id", "cluster_id", "term", F.col("weight").alias("q"))
    dots = bounded_join(chosen, wanted, ["cluster_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))
    out = pairs.join(dots, ["query_id", "doc_id"], "left").join(norms, "doc_id", "left").join(norms.select(F.col("doc_id").alias("query_id"), F.col("norm").alias("qn")), "query_id", "left")
    zero = F.lit(0.0)
    out = out.select("query_id", "doc_id", F.round(F.coalesce("norm", zero) + F.coalesce("qn", zero) - 2 * F.coalesce("dot", zero), 12).alias("distance"))
    return top_k(out, ["query_id"], F.asc("distance"), F.col("doc_id"), k=k)


class _Tree:
    """A median-split tree of one part of a cluster; nodes in the order of a walk from the top."""

    def __init__(self, values: np.ndarray):
        self.values, n = values, len(values)
        self.left, self.right, self.dim = np.full(n, -1), np.full(n, -1), np.zeros(n, int)
        self.root = self._build(np.arange(n))

    def _build(self, all_: np.ndarray) -> int:
        root, stack = -1, [(all_, 0, -1, 0)]
        while stack:
            rows, level, parent, side = stack.pop()
            if not len(rows):
                continue
            d = level % self.values.shape[1]
            order = rows[np.argsort(self.values[rows, d], kind="stable")]
            mid = (len(order) - 1) // 2
            node = int(order[mid])
            self.dim[node] = d
            if parent < 0:
                root = node
            else:
                (self.left if side == 0 else self.right)[parent] = node
            stack += [(order[:mid], level + 1, node, 0), (order[mid + 1 :], level + 1, node, 1)]
        return root

    def search(self, q: np.ndarray, skip: int) -> int:
        """Descends to one side, the other only if that gave nothing; on the way back the best stays while it is nearer in
        the dimension at hand than the node is to it, else the node takes its place.  Never returns `skip`."""
        path, node = [], self.root
        while node >= 0:
            path.append(node)
            d = self.dim[node]
            first, second = (self.left, self.right) if q[d] < self.values[node, d] else (self.right, self.left)
            node = int(first[node]) if first[node] >= 0 else int(second[node])
        best = -1
        for node in reversed(path):
            if node == skip:
                continue
            d = self.dim[node]
            if best < 0 or not (self.values[node, d] - self.values[best, d]) ** 2 > (q[d] - self.values[best, d]) ** 2:
                best = node
        return best


def nearest_tree(vectors: DataFrame, assignments: DataFrame, dimensions: DataFrame, queries: DataFrame, part_rows: int = 20_000) -> DataFrame:
    """(query_id, doc_id, distance): an approximate neighbour in the same cluster by greedy search of median-split trees.

    Clusters are cut into parts of about `part_rows` members by hash, each with its own tree, so no task holds a whole
    large cluster; a query goes to every part of its cluster and the nearest answer holds."""
    sizes = assignments.groupBy("cluster_id").agg(F.ceil(F.count("*") / F.lit(part_rows)).alias("parts"))
    placed = bounded_join(assignments.select("doc_id", "cluster_id"), sizes, "cluster_id")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    dims = dimensions.select("cluster_id", "term", F.col("rank").cast("int").alias("dim"))
    values = bounded_join(vectors.join(placed, "doc_id"), dims, ["cluster_id", "term"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("v"))  # few entries a record
    points = placed.join(values, "doc_id", "left").select("cluster_id", "part", F.lit(False).alias("asks"), "doc_id", "v")
    q = placed.join(queries.select("doc_id").distinct(), "doc_id", "left_semi").join(values, "doc_id", "left")
    q = q.select("cluster_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "doc_id", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[~pdf["asks"]].sort_values("doc_id")
        ask = pdf[pdf["asks"]]
        width = max((max(v) for v in pdf["v"] if v), default=1)

        def dense(some: pd.Series) -> np.ndarray:
            out = np.zeros((len(some), width))
            for i, v in enumerate(some):
                for d, w in (v or {}).items():
                    out[i, d - 1] = w
            return out

        if rows.empty or ask.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []}).astype({"query_id": object, "doc_id": object})
        ids = rows["doc_id"].to_numpy(dtype=object)
        tree, asked = _Tree(dense(rows["v"])), dense(ask["v"])
        out = []
        for name, vec in zip(ask["doc_id"], asked):
            at = int(np.searchsorted(ids, name))
            hit = tree.search(vec, at if at < len(ids) and ids[at] == name else -1)
            if hit >= 0:
                out.append((name, ids[hit], float(((tree.values[hit] - vec) ** 2).sum())))
        return pd.DataFrame(out, columns=["query_id", "doc_id", "distance"]).astype({"query_id": object, "doc_id": object, "distance": float})

    found = points.unionByName(q).groupBy("cluster_id", "part").applyInPandas(run, "query_id string, doc_id string, distance double")
    return top_k(found, ["query_id"], F.asc("distance"), F.col("doc_id"), k=1).drop("rank")


def squared_difference(left: str | Column, right: str | Column) -> Column:
    """The squared difference of two numbers, an absent one counting as 0: the distance of one dimension, and of
    magnitudes."""
    a, b = (F.coalesce((F.col(x) if isinstance(x, str) else x).cast("double"), F.lit(0.0)) for x in (left, right))
    return (a - b) * (a - b)


def insert_points(tree: DataFrame, points: DataFrame, dims: int = 2, vector: str = "v", id_col: str = "id") -> DataFrame:
    """Inserts points(id, v) one after the other, in order of their ids, into a tree(id, v, node) of median_split()'s numbers
    (root 1, children 2 n and 2 n + 1): smaller values of a level's dimension (null least) go left, others right, down to
    a free place.  Returns (id, v, node) of all.

    A round takes all new points one level down and puts the first of each free place there, so there are as many rounds as
    the tree is deep, not as there are points."""
    placed = saved(tree.select("id", "v", "node"))
    at = saved(points.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).withColumn("node", F.lit(1).cast("long")))
    level = 0
    while not at.isEmpty():
        here = bounded_join(at, placed.select("node", F.col("v").alias("pivot"), F.lit(True).alias("taken")), "node", "left")
        first = here.where("taken is null").groupBy("node").agg(F.min(F.struct("id", "v")).alias("t")).select("t.id", "t.v", "node")
        placed = saved(placed.unionByName(first))
        taken = bounded_join(at, placed.select("node", F.col("id").alias("owner"), F.col("v").alias("pivot")), "node").where("id <> owner")
        mine, its = (F.get(c, F.lit(level % dims)).cast("double") for c in ("v", "pivot"))
        right = F.coalesce(mine >= its, mine.isNotNull() | its.isNull())
        at = saved(taken.select("id", "v", (F.col("node") * 2 + right.cast("long")).alias("node")))
        level += 1
    return placed


def dimension_min(points: DataFrame, dim: int, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """One row (id, value): the point with the least value in a dimension, ties by id."""
    value = F.get(vector, F.lit(dim)).cast("double")
    least = points.where(value.isNotNull()).agg(F.min(F.struct(value.alias("value"), F.col(id_col).alias("id"))).alias("t"))
    return least.select("t.id", "t.value")


def delete_points(points: DataFrame, gone: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Points without the deleted ones; a tree over them is built anew."""
    return points.join(gone.select(id_col).distinct(), id_col, "left_anti")
