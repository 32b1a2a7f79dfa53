"""The cosine k-means of the index, step by step and as a loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import bounded_join, drop, saved
from .vectors import Centroids, as_rows, closest_cluster, cosine_to_centroids

#: Entries (cluster, term, mean) of all means that are broadcast.
MEAN_ENTRIES = 1_000_000


def member_rows(clusters: DataFrame) -> DataFrame:
    """(cluster_id, n, doc_id) of clusters(cluster_id, n, doc_ids); vacated members are skipped but stay counted in n."""
    return clusters.select("cluster_id", "n", F.explode("doc_ids").alias("doc_id")).where("doc_id is not null")


def centroid_mean(members: DataFrame, vectors: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(cluster_id, term, mean, doc_freq, squares, n) of members(cluster_id, n, doc_id): mean = sum of weights / n,
    doc_freq = members that hold the term.  With old(cluster_id, term, mean), squares is the sum of squared distances of
    the present weights from the OLD mean (0 where there was none)."""
    rows = bounded_join(vectors, members.select("doc_id", "cluster_id", "n"), "doc_id")
    if old is not None:
        rows = rows.join(old.select("cluster_id", "term", F.col("mean").alias("was")), ["cluster_id", "term"], "left")
    away = F.col("weight") - (F.coalesce("was", F.lit(0.0)) if old is not None else F.lit(0.0))
    return rows.groupBy("cluster_id", "term").agg((F.sum("weight") / F.max("n")).alias("mean"), F.count("*").alias("doc_freq"), F.sum(away * away).alias("squares"), F.max("n").alias("n"))


def centroid_stddev(members: DataFrame, vectors: DataFrame, old: DataFrame) -> DataFrame:
    """(cluster_id, term, stddev): root of squares / (n - 1) around the old mean; null for clusters of one."""
    return centroid_mean(members, vectors, old).select("cluster_id", "term", F.sqrt(F.try_divide("squares", F.col("n") - 1)).alias("stddev"))


def reload_centroid(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster_id, term, mean, stddev, doc_freq) as a saved cluster is reloaded: doc_freq is one too low, stddev 0."""
    return centroid_mean(members, vectors).select("cluster_id", "term", "mean", F.lit(0.0).alias("stddev"), (F.col("doc_freq") - 1).alias("doc_freq"))


def mean_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(cluster_id, shift): sum over the terms of both of (new - old) squared."""
    both = old.select("cluster_id", "term", F.col("mean").alias("a")).join(new.select("cluster_id", "term", F.col("mean").alias("b")), ["cluster_id", "term"], "full")
    move = F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))
    return both.groupBy("cluster_id").agg(F.sum(move * move).alias("shift"))


def has_changed(shifts: DataFrame, before: DataFrame, threshold: float) -> DataFrame:
    """One row (changed): whether any cluster's |shift - shift before| exceeds the threshold; none before counts as 0."""
    both = shifts.join(before.select("cluster_id", F.col("shift").alias("was")), "cluster_id", "left")
    return both.agg(F.coalesce(F.max(F.abs(F.col("shift") - F.coalesce("was", F.lit(0.0))) > threshold), F.lit(False)).alias("changed"))


def extreme_members(sims: DataFrame, keep: str = "observed") -> DataFrame:
    """(cluster_id, doc_id, sim): of each cluster the member of greatest likeness (observed) or of least (intended);
    ties to the smallest doc_id.  sims(doc_id, cluster_id, sim) holds each member once."""
    sign = 1 if keep == "observed" else -1
    best = sims.groupBy("cluster_id").agg(F.max(F.col("sim") * sign).alias("top"))
    tied = sims.join(best, "cluster_id").where(F.col("sim") * sign == F.col("top"))
    return tied.groupBy("cluster_id", "sim").agg(F.min("doc_id").alias("doc_id")).select("cluster_id", "doc_id", "sim")


def repair_empty(candidates: DataFrame, empties: DataFrame) -> DataFrame:
    """(doc_id, donor, cluster_id): the candidates in order of likeness, given to empty clusters in order of their ids;
    when candidates run out, the rest stays empty.  Both sides have at most one row per cluster."""
    c = candidates.withColumn("r", F.row_number().over(Window.orderBy(F.desc("sim"), "cluster_id"))).select("r", "doc_id", F.col("cluster_id").alias("donor"))
    e = empties.select("cluster_id").distinct().withColumn("r", F.row_number().over(Window.orderBy("cluster_id")))
    return c.join(e, "r").select("doc_id", "donor", "cluster_id")


def _fresh_or_old(members: DataFrame, vectors: DataFrame, means: DataFrame, filled: set) -> DataFrame:
    """New means of the clusters that have members; the others keep their old ones."""
    fresh = centroid_mean(members, vectors).select("cluster_id", "term", "mean")
    return fresh.unionByName(means.where(~F.col("cluster_id").isin(list(filled))))


def kmeans_cosine(vectors: DataFrame, docs: DataFrame, k: int = 48, seed: int = 1, threshold: float = 1e-9, rounds: int = 500, seeds: DataFrame | None = None, most: int = MEAN_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Returns (assignments(doc_id, cluster_id, sim), centroids(cluster_id, term, mean)).

    docs(doc_id, sqrt_mag); k seed documents are drawn by hash of id and seed (or given as seeds(cluster_id, doc_id)),
    and a cluster's magnitude stays its seed's.  Each round assigns all documents, recomputes means, gives empty
    clusters the best candidates of the others (a donor's count stays, as observed; its shift is then the one against
    the round's own mean, which is computed anew without the document), and ends when no shift changes by more than
    `threshold`.  Raises if that takes more than `rounds`.

    While k times the vocabulary is at most `most` entries, the driver holds the means, which each round sends out and
    gets back added up by cluster and term: a round is one pass over the documents.  Beyond, documents and means are
    joined by shuffle, and state is written to the shared folder.
    """
    have = docs.join(vectors.select("doc_id").distinct(), "doc_id", "left_semi")
    if seeds is None:
        drawn = have.select("doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(k)
        seeds = drawn.withColumn("cluster_id", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")) - 1)  # k rows
    seeds = saved(seeds.select(F.col("cluster_id").cast("long").alias("cluster_id"), "doc_id"))
    terms = vectors.select("term").distinct().limit(most + 1).count()
    loop = _rounds_by_broadcast if terms * seeds.count() <= most else _rounds_by_joins
    return loop(vectors, docs, have, seeds, threshold, rounds)


def _settled(now: dict[int, float], before: dict[int, float], threshold: float) -> bool:
    return all(abs(now[c] - before[c]) <= threshold for c in before)


def _rounds_by_broadcast(vectors: DataFrame, docs: DataFrame, have: DataFrame, seeds: DataFrame, threshold: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    rows = saved(as_rows(vectors, have))
    kept = sorted(tuple(r) for r in seeds.join(docs, "doc_id").select("cluster_id", "sqrt_mag").collect())  # k numbers
    ids, mags = np.array([r[0] for r in kept], np.int64), np.array([r[1] for r in kept], float)
    names = saved(vectors.select("term").distinct().select("term", F.xxhash64("term").alias("t")))
    terms = np.sort(names.select("t").toArrow()["t"].to_numpy())
    means = np.zeros((len(ids), len(terms)))

    def place(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(ids, table["cluster_id"].to_numpy()), np.searchsorted(terms, table["t"].to_numpy())

    first = saved(bounded_join(vectors, seeds, "doc_id").select("cluster_id", F.xxhash64("term").alias("t"), "weight")).toArrow()
    means[place(first)] = first["weight"].to_numpy()

    def send(of: np.ndarray) -> object:
        return rows.sparkSession.sparkContext.broadcast(Centroids(ids, terms, of, mags))

    def summed(sent: object) -> pa.Table:
        """(cluster_id, t, total): sums of the documents' weights by cluster and term; a null term counts documents."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, big.num_rows, 2048):
                    batch = big.slice(at, 2048)
                    near, _ = sent.value.closest(batch)
                    each = np.repeat(near, np.diff(batch.column(2).offsets.to_numpy()))
                    some = pa.table({"cluster_id": each, "t": batch.column(2).flatten(), "total": batch.column(3).flatten()}).group_by(["cluster_id", "t"]).aggregate([("total", "sum")])
                    found, n = np.unique(near, return_counts=True)
                    counts = pa.table({"cluster_id": pa.array(found), "t": pa.nulls(len(found), pa.int64()), "total_sum": pa.array(n.astype(float))})
                    yield from pa.concat_tables([some.select(["cluster_id", "t", "total_sum"]), counts]).rename_columns(["cluster_id", "t", "total"]).to_batches()

        return rows.mapInArrow(run, "cluster_id long, t long, total double").groupBy("cluster_id", "t").agg(F.sum("total").alias("total")).toArrow()

    def candidates(old: object, new: object) -> list[tuple]:
        """Of each cluster the document most like the new mean: (cluster, likeness, doc_id, terms, weights), best of each part."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                near, _ = old.value.closest(batch)
                sims = new.value.sims(batch)[np.arange(batch.num_rows), np.searchsorted(ids, near)]
                for c, s, i, row in zip(near.tolist(), sims.tolist(), batch.column(0).to_pylist(), range(batch.num_rows)):
                    if s > 0 and (c not in best or (-s, i) < best[c][:2]):
                        best[c] = (-s, i, batch.column(2)[row].as_py(), batch.column(3)[row].as_py())
            if best:
                cols = list(zip(*((c, -s, i, t, w) for c, (s, i, t, w) in best.items())))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.float64()))], names=["c", "s", "doc_id", "t", "w"])

        some = rows.mapInArrow(run, "c long, s double, doc_id string, t array<long>, w array<double>")
        best = some.groupBy("c").agg(F.min_by(F.struct("s", "doc_id", "t", "w"), F.struct(-F.col("s"), "doc_id")).alias("x"))
        return [tuple(r) for r in best.select("c", "x.*").collect()]  # at most k rows

    before = dict.fromkeys(ids.tolist(), 0.0)
    for _ in range(rounds):
        sent = send(means)
        sums = summed(sent)
        counts, sums = sums.filter(sums["t"].is_null()), sums.filter(sums["t"].is_valid())
        n, total = np.zeros(len(ids)), np.zeros_like(means)
        n[np.searchsorted(ids, counts["cluster_id"].to_numpy())] = counts["total"].to_numpy()
        total[place(sums)] = sums["total"].to_numpy()
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], means)
        moved, given = ((new - means) ** 2).sum(axis=1), {}
        empty = np.flatnonzero(n == 0)
        if len(empty) and n.any():
            found = sorted(candidates(sent, send(new)), key=lambda x: (-x[1], x[0]))
            fixed = new.copy()
            for c, (donor, _, doc, t, weights) in zip(empty.tolist(), found):
                given[doc] = int(ids[c])
                d, at = int(np.searchsorted(ids, donor)), np.searchsorted(terms, t)
                fixed[c] = 0
                fixed[c, at] = weights
                fixed[d, at] -= np.array(weights) / n[d]
                moved[d], moved[c] = ((fixed[d] - new[d]) ** 2).sum(), ((fixed[c] - means[c]) ** 2).sum()
            new = fixed
        last, means = sent, new
        now = dict(zip(ids.tolist(), moved.tolist()))
        if _settled(now, before, threshold):
            break
        before = now
    else:
        raise RuntimeError(f"kmeans_cosine: not settled after {rounds} rounds")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                batch = big.slice(at, 2048)
                near, sim = last.value.closest(batch)
                to = [given.get(i, c) for i, c in zip(batch.column(0).to_pylist(), near.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to, pa.int64()), pa.array(sim)], names=["doc_id", "cluster_id", "sim"])

    c, t = np.nonzero(np.abs(means) > 1e-15)
    table = rows.sparkSession.createDataFrame(pa.table({"cluster_id": ids[c], "t": terms[t], "mean": means[c, t]}))
    return rows.mapInArrow(assign, "doc_id string, cluster_id bigint, sim double"), saved(table.join(names, "t").select("cluster_id", "term", "mean"))


def _rounds_by_joins(vectors: DataFrame, docs: DataFrame, have: DataFrame, seeds: DataFrame, threshold: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    clusters = saved(seeds.join(docs, "doc_id").select("cluster_id", "sqrt_mag"))
    means = saved(bounded_join(vectors, seeds, "doc_id").select("cluster_id", "term", F.col("weight").alias("mean")))
    seen = [r[0] for r in clusters.select("cluster_id").collect()]  # k numbers
    shifts = dict.fromkeys(seen, 0.0)
    for _ in range(rounds):
        now = saved(closest_cluster(cosine_to_centroids(vectors, docs, means, clusters), have))
        old = [means]
        sizes = now.groupBy("cluster_id").agg(F.count("*").alias("n"))
        filled = {r[0] for r in sizes.select("cluster_id").collect()}  # at most k numbers
        new = saved(_fresh_or_old(now.join(F.broadcast(sizes), "cluster_id"), vectors, means, filled))  # at most k rows
        moved_by = {r["cluster_id"]: r["shift"] for r in mean_shift(means, new).collect()}  # k numbers
        if filled < set(seen):
            sims = cosine_to_centroids(vectors, docs, new, clusters).join(now.select("doc_id", "cluster_id"), ["doc_id", "cluster_id"])
            moves = saved(repair_empty(extreme_members(sims), clusters.where(~F.col("cluster_id").isin(list(filled)))))
            # a donor's count stays as it was
            counted = sizes.unionByName(moves.select("cluster_id", F.lit(1).cast("long").alias("n")))
            moved = now.join(F.broadcast(moves.select("doc_id", F.col("cluster_id").alias("to"))), "doc_id", "left")  # at most k rows
            after = saved(moved.select("doc_id", F.coalesce("to", "cluster_id").alias("cluster_id"), "sim"))
            given = moves.select("donor", "cluster_id").collect()  # at most k rows
            filled |= {r["cluster_id"] for r in given}
            repaired = saved(_fresh_or_old(after.join(F.broadcast(counted), "cluster_id"), vectors, means, filled))
            of_round, of_old = ({r["cluster_id"]: r["shift"] for r in mean_shift(x, repaired).collect()} for x in (new, means))
            moved_by |= {r["donor"]: of_round.get(r["donor"], 0.0) for r in given} | {r["cluster_id"]: of_old.get(r["cluster_id"], 0.0) for r in given}
            old += [now, new, moves]
            now, new = after, repaired
        moved_by = {c: moved_by.get(c, 0.0) for c in seen}
        for x in old:
            drop(x)
        if _settled(moved_by, shifts, threshold):
            return now, new
        means, shifts = new, moved_by
        drop(now)
    raise RuntimeError(f"kmeans_cosine: not settled after {rounds} rounds")
