"""Most similar vectors by cross-polytope hashing: multiprobe tables propose, exact cosines decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_join, drop, narrow, saved, wide
from .crosspoly import Tables, fold, mix64
from .pairs import record_pairs, shared, shared_pairs

#: Tables for pairs of cosine 0.9 and more (recall above 0.99 on the test tables), and for the nearest of each query.
PAIR_TABLES = Tables(tables=32, dim=256, blocks=4, width=64, probes=2)
NEAR_TABLES = Tables(tables=6, dim=256, blocks=1, width=256, probes=24)
#: Tables whose rows (bucket, id) are on disk at once: as many as have so many rows, and some at least; candidates whose
#: vectors are: a quarter of the number of records, between these bounds.
KEY_ROWS, LEAST_TABLES, CHECKED = 2_000_000, 4, (100_000, 4_000_000)


def _ragged(ids: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> Iterator[tuple]:
    """From entries ordered by id and term: one entry per (id, term), the largest weight."""
    last = np.ones(len(ids), bool)
    last[:-1] = (ids[1:] != ids[:-1]) | (terms[1:] != terms[:-1])
    return ids[last], terms[last], weights[last]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of repeated (id, term) within a batch the row with the largest weight."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch]).group_by(["id", "term"]).aggregate([("weight", "max")])
            yield from table.rename_columns(["id", "term", "weight"]).to_batches()


def sparse_vectors(entries: DataFrame, id_col: str = "doc_id", term_col: str = "term", weight_col: str = "weight", unit: bool = True) -> DataFrame:
    """Rows of one table per entry -> (id, terms array<bigint>, weights array<double>, c1, c2, size), one row per record.

    A repeated (record, term) counts once (with the largest weight, should the weights differ); entries whose
    id or term is null or whose weight is null, 0 or not finite are dropped, and records left without entries
    are absent.  Weights come out scaled to length 1 (size is the length before); terms are 64-bit hashes in ascending order; (c1, c2)
    names the direction, so that copies have equal names.  Other columns are ignored.  Without `unit` weights stay as they
    are, which takes less disk where few different ones occur.
    """
    clean = narrow(entries, id=F.col(f"`{id_col}`").try_cast("long"), term=F.xxhash64(F.col(f"`{term_col}`")), weight=F.col(f"`{weight_col}`").cast("double"), name=F.col(f"`{term_col}`"))
    clean = clean.where("id is not null and name is not null and weight is not null and not isnan(weight) and weight <> 0 and abs(weight) < 1e300")
    clean = clean.select("id", "term", "weight").mapInArrow(_once, "id long, term long, weight double")  # repeated rows fall together before the shuffle
    # entries of one record come together and in order, so that each record is a run of rows
    ordered = clean.repartition(wide(entries), "id").sortWithinPartitions("id", "term", "weight")

    def emit(ids: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
        ids, terms, weights = _ragged(ids, terms, weights)
        start = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        size = np.sqrt(np.add.reduceat(weights * weights, start))
        counts = np.diff(np.append(start, len(ids)))
        scaled = weights / np.repeat(size, counts)
        with np.errstate(over="ignore"):
            mark = terms.view(np.uint64) * np.uint64(31) + np.round(scaled * 1e7).astype(np.int64).view(np.uint64)
            names = [np.add.reduceat(mix64(mark, j), start).view(np.int64) for j in (21, 22)]
        offsets = pa.array(np.append(start, len(ids)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[start]), pa.ListArray.from_arrays(offsets, pa.array(terms)), pa.ListArray.from_arrays(offsets, pa.array(scaled if unit else weights)), *map(pa.array, names), pa.array(size)],
            names=["id", "terms", "weights", "c1", "c2", "size"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(3)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last record may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut:
                yield emit(*(c[:cut] for c in cols))
        if held is not None and len(held[0]):
            yield emit(*held)

    return ordered.mapInArrow(run, "id long, terms array<bigint>, weights array<double>, c1 long, c2 long, size double")


def entries_of(batch: pa.RecordBatch, column: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, term and weight of every entry of a batch whose columns from `column` are terms and weights."""
    terms, weights = batch.column(column), batch.column(column + 1)
    counts = np.diff(terms.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), counts), terms.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)


def dots(left: tuple, right: tuple, n: int) -> np.ndarray:
    """Dot products of n pairs of sparse vectors, each side given as entries (pair number, term, weight)."""
    pair = np.concatenate((left[0], right[0]))
    term = np.concatenate((left[1], right[1]))
    weight = np.concatenate((left[2], right[2]))
    order = np.lexsort((term, pair))
    pair, term, weight = pair[order], term[order], weight[order]
    both = (pair[1:] == pair[:-1]) & (term[1:] == term[:-1])
    return np.bincount(pair[1:][both], weights=(weight[1:] * weight[:-1])[both], minlength=n)


def all_dots(left: tuple, n: int, right: tuple, m: int, columns: int = 4096) -> np.ndarray:
    """n x m dot products of sparse vectors, each side given as entries (row, term, weight), so many terms at a time."""
    terms, total = np.intersect1d(left[1], right[1]), np.zeros((n, m))
    for at in range(0, len(terms), columns):
        some, dense = terms[at : at + columns], []
        for rows, (row, term, weight) in zip((n, m), (left, right)):
            col = np.minimum(np.searchsorted(some, term), len(some) - 1)
            hit = some[col] == term
            d = np.zeros((rows, len(some)))
            d[row[hit], col[hit]] = weight[hit]
            dense.append(d)
        total += dense[0] @ dense[1].T
    return total


def near_by_cosine(least: float, columns: int = 4096) -> Callable[[pa.Table, pa.Table], np.ndarray]:
    """near() for bucket_pairs() over marks(id, terms, weights), by exact cosines."""

    def near(left: pa.Table, right: pa.Table) -> np.ndarray:
        sides = [entries_of(t.select(["terms", "weights"]).combine_chunks().to_batches()[0], 0) for t in (left, right)]
        return all_dots(sides[0], left.num_rows, sides[1], right.num_rows, columns) >= least - 1e-9

    return near


def hash_rows(vectors: DataFrame, how: Tables, tables: range) -> DataFrame:
    """vectors -> (id, own array<bigint>, probes array<bigint>): the bucket of each of `tables`, and the probed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                batch = big.slice(at, 4096)
                n, entries = batch.num_rows, entries_of(batch)
                own, probed = [], []
                for t in tables:
                    a, b = how.buckets(fold(*entries, n, how.dim, t + 1), t)
                    own.append(a)
                    probed.append(b[:, 1:])
                lists = []
                for x in (np.stack(own, axis=1), np.concatenate(probed, axis=1)):
                    lists.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "own", "probes"])

    return vectors.select("id", "terms", "weights").mapInArrow(run, "id long, own array<bigint>, probes array<bigint>")


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs(a, b) -> (a, b, cosine), exact."""
    v = vectors.select("id", "terms", "weights")
    both = pairs.join(v.toDF("a", "ta", "wa"), "a").join(v.toDF("b", "tb", "wb"), "b").select("a", "b", "ta", "wa", "tb", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = dots(entries_of(batch, 2), entries_of(batch, 4), batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c)], names=["a", "b", "cosine"])

    return both.mapInArrow(run, "a long, b long, cosine double")


def similar_pairs(entries: DataFrame, threshold: float = 0.9, how: Tables = PAIR_TABLES, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Returns (members(id, rep), links(a, b, cosine)): each record's class of equal directions, named by its
    least id, and the pairs of classes whose cosine reaches the threshold.

    Candidates share the bucket of one of them in some table; all are checked exactly.  Copies are hashed
    once per class and not paired with each other.  Empty tables give empty results.

    Disk holds the vectors, and of a few tables at a time the buckets and of a part of the candidates the vectors.
    """
    vectors = saved(sparse_vectors(entries, **columns, unit=False))
    reps = vectors.groupBy("c1", "c2").agg(F.min("id").alias("rep"))
    members = saved(vectors.select("id", "c1", "c2").join(reps, ["c1", "c2"]).select("id", "rep"))
    copies = saved(members.where("id <> rep").select("id"))
    kept = vectors if copies.isEmpty() else saved(bounded_join(vectors, copies, "id", "left_anti"))
    if kept is not vectors:
        drop(vectors)
    single = kept.select("id", "terms", F.transform("weights", lambda w: w / F.col("size")).alias("weights"))
    count, links = kept.count(), []
    step = max(LEAST_TABLES, KEY_ROWS // max(1, count * (1 + how.probes)))
    for at in range(0, how.tables, step):
        hashed = saved(hash_rows(single, how, range(at, min(at + step, how.tables))))
        rows = hashed.select(F.explode("own").alias("key"), "id", F.lit(True).alias("own"))
        rows = rows.unionByName(hashed.select(F.explode("probes").alias("key"), "id", F.lit(False).alias("own")))
        many = shared(rows)
        drop(hashed)
        candidates = saved(shared_pairs(many, single, near_by_cosine(threshold)))
        drop(many)
        parts = -(-candidates.count() // min(max(count // 4, CHECKED[0]), CHECKED[1]))
        for part in range(parts):
            some = candidates if parts == 1 else candidates.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part)
            named, sent = _named(single, some)
            links.append(saved(cosines(some, named).where(F.col("cosine") >= threshold)))
            sent.destroy()
        drop(candidates)
    drop(kept)
    if not links:
        return members, members.sparkSession.createDataFrame([], "a long, b long, cosine double")
    found = links[0]
    for x in links[1:]:
        found = found.unionByName(x)
    return members, found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _named(vectors: DataFrame, pairs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The vectors of the records that pairs(a, b) name, and a few others: those whose bit of a hash is set.  And the
    broadcast bits, to be destroyed after use."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().toArrow()["id"].to_numpy()
    size = max(10, len(ids).bit_length() + 3)
    bits, mask = np.zeros(1 << (size - 3), np.uint8), np.uint64((1 << size) - 1)
    h = mix64(ids.view(np.uint64), 55) & mask
    np.bitwise_or.at(bits, h >> np.uint64(3), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
    sent = vectors.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = mix64(batch.column(0).to_numpy().view(np.uint64), 55) & mask
            yield batch.filter(pa.array((sent.value[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1))

    return vectors.mapInArrow(run, "id long, terms array<bigint>, weights array<double>"), sent


def nearest(entries: DataFrame, k: int = 5, every: int = 100, how: Tables = NEAR_TABLES, block: int = 8192, spare: int = 5, exact: bool = False, **columns: str) -> DataFrame:
    """The k nearest of every record whose id is divisible by `every`, searched among all records.

    Returns (doc_id, neighbour, cosine, rank).  Rows are hashed once.  Queries are taken in blocks of at most `block`,
    which alone are broadcast; every partition scores its rows that lie in a bucket that a query probes by folded
    vectors, reranks the k + spare best of each query exactly and gives out k at most.  With `exact`, every row is
    scored by its cosine with every query instead.  Ties go to the smaller id.
    """
    spark = entries.sparkSession
    vectors = saved(sparse_vectors(entries, **columns))
    queries = saved(vectors.where(F.col("id") % every == 0).select("id", "terms", "weights"))
    rows = vectors.select("id", "terms", "weights") if exact else saved(_with_buckets(vectors, how))
    parts, found = -(-queries.count() // block), None
    for part in range(max(1, parts)):
        mine = queries if parts <= 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast(_QueryBlock(mine.toArrow().combine_chunks(), None if exact else how))
        some = rows.mapInArrow(lambda it, sent=sent: sent.value.search(it, k, spare), "doc_id long, neighbour long, cosine double")
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("doc_id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_buckets(vectors: DataFrame, how: Tables) -> DataFrame:
    """(id, terms, weights, own): each row with its bucket in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                batch = big.slice(at, 4096)
                n, entries = batch.num_rows, entries_of(batch)
                own = np.stack([how.buckets(fold(*entries, n, how.dim, t + 1), t)[0] for t in range(how.tables)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * how.tables), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "terms", "weights", "own"])

    return vectors.select("id", "terms", "weights").mapInArrow(run, "id long, terms array<bigint>, weights array<double>, own array<bigint>")


class _QueryBlock:
    """A bounded block of queries: their vectors, folded vectors, and the queries that probe each bucket."""

    sketch = 512

    def __init__(self, table: pa.Table, how: Tables | None):
        self.how = how
        batch = table.to_batches()[0] if table.num_rows else None
        self.n = table.num_rows
        if not self.n:
            return
        self.ids = batch.column(0).to_numpy()
        self.rows, self.terms, self.weights = rows, terms, weights = entries_of(batch)
        self.offsets = np.searchsorted(rows, np.arange(self.n + 1))
        if how is None:
            return
        self.folded = fold(rows, terms, weights, self.n, self.sketch, 99)
        self.probing: dict[int, np.ndarray] = {}
        for t in range(how.tables):
            _, probed = how.buckets(fold(rows, terms, weights, self.n, how.dim, t + 1), t)
            q = np.repeat(np.arange(self.n), probed.shape[1])
            keys = probed.ravel()
            order = np.argsort(keys, kind="stable")
            keys, q = keys[order], q[order]
            start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            for key, own in zip(keys[start].tolist(), np.split(q, start[1:])):
                self.probing[key] = own

    def search(self, batches: Iterator[pa.RecordBatch], k: int, spare: int) -> Iterator[pa.RecordBatch]:
        """The k best of each query among the rows of one partition."""
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, id, cosine
        for batch in batches:
            if not (self.n and batch.num_rows):
                continue
            some = self._exactly(batch, k) if self.how is None else self._probed(batch, k + spare)
            q, ids, c = (np.concatenate(x) for x in zip(held, some))
            order = np.lexsort((ids, -c, q))
            good = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
            held = [q[good], ids[good], c[good]]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["doc_id", "neighbour", "cosine"])

    def _exactly(self, batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            ids = part.column(0).to_numpy()
            c = all_dots((self.rows, self.terms, self.weights), self.n, entries_of(part), len(ids))
            c[self.ids[:, None] == ids[None, :]] = -2
            order = np.lexsort((np.broadcast_to(ids, c.shape), -c), axis=1)[:, :k]
            q, row = np.repeat(np.arange(self.n), order.shape[1]), order.ravel()
            good = c[q, row] > -2
            out.append((q[good], ids[row[good]], c[q, row][good]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _probed(self, batch: pa.RecordBatch, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, entries = batch.num_rows, entries_of(batch)
        ids = batch.column(0).to_numpy()
        buckets = batch.column(3).flatten().to_numpy().reshape(n, self.how.tables)
        score = np.full((self.n, keep), -2, np.float32)
        best = np.full((self.n, keep), -1, np.int64)
        folded = fold(*entries, n, self.sketch, 99)
        for own in buckets.T:
            order = np.argsort(own, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
            for rows in np.split(order, start[1:]):
                asking = self.probing.get(int(own[rows[0]]))
                if asking is None:
                    continue
                step = max(1, 400_000 // len(rows))  # keeps a hot bucket's scores small
                for at in range(0, len(asking), step):
                    q = asking[at : at + step]
                    sims = self.folded[q] @ folded[rows].T
                    sims[self.ids[q][:, None] == ids[rows][None, :]] = -2
                    for j in range(keep):
                        sims[best[q][:, j : j + 1] == rows[None, :]] = -2
                    s = np.concatenate((score[q], sims), axis=1)
                    c = np.concatenate((best[q], np.broadcast_to(rows, sims.shape)), axis=1)
                    top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                    score[q], best[q] = np.take_along_axis(s, top, axis=1), np.take_along_axis(c, top, axis=1)
        q, j = np.nonzero(score > -2)
        row, at = best[q, j], np.searchsorted(entries[0], np.arange(n + 1))
        c = dots(self._gather(q, self.offsets, self.terms, self.weights), self._gather(row, at, entries[1], entries[2]), len(q))
        return q, ids[row], c

    @staticmethod
    def _gather(which: np.ndarray, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple:
        counts = offsets[which + 1] - offsets[which]
        pair = np.repeat(np.arange(len(which)), counts)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[which], counts)
        return pair, terms[at], weights[at]
