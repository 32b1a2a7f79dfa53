"""Evaluation passages that leaked into a corpus: a prefix-filtered join of shingle sets over item-sized windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, narrow, saved
from .words import WordHashes, shingles, word_hashes

#: Consecutive words that make a leak, words of a shingle, items and bytes of passages of a block.
RUN, SHINGLE, BLOCK, BYTES = 12, 3, 20_000, 16 << 20


class _Items:
    """A block of items as one run of word hashes; after choose(), the prefix tokens of its windows.

    A window of `run` words holds run - k + 1 shingles, all of which a leaking text must hold too.  So the
    prefix that the filter has to join is one token long (size - overlap + 1 = 1), and with shingles ordered
    by rarity in the corpus it is the window's rarest one."""

    def __init__(self, ids: list[int], passages: list[str | None], run: int, k: int):
        self.run, self.k = run, k
        self.flat, self.offsets = word_hashes(passages, WordHashes())
        self.ids = np.array(ids, np.int64)
        self.doc, self.pos, self.token = shingles(self.flat, self.offsets, k)
        self.tokens = np.unique(self.token)

    def choose(self, rarity: np.ndarray) -> None:
        """rarity: of each of self.tokens, the documents that hold it."""
        rank = np.argsort(np.lexsort((self.tokens, rarity)))[np.searchsorted(self.tokens, self.token)]
        width = self.run - self.k + 1
        keep: set[int] = set()
        starts = np.searchsorted(self.doc, np.arange(len(self.ids) + 1))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a >= width:
                best = np.lib.stride_tricks.sliding_window_view(rank[a:b], width).argmin(axis=1) + np.arange(b - a - width + 1) + a
                keep.update(np.unique(best).tolist())
        at = np.array(sorted(keep), np.int64)
        at = at[np.argsort(self.token[at], kind="stable")]
        self.prefix, self.prefix_doc, self.prefix_pos = self.token[at], self.doc[at], self.pos[at]


def _frequencies(texts: DataFrame, items: object, k: int) -> DataFrame:
    """(token, n): the documents that hold each token of the block, in partial sums of a partition each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, tokens = WordHashes(), items.value.tokens
        n = np.zeros(len(tokens), np.int64)
        for batch in in_slices(batches, 1):
            doc, _, h = shingles(*word_hashes(batch.column(1).to_pylist(), cache), k)
            at = np.searchsorted(tokens, h)
            at[at == len(tokens)] = 0
            hit = np.flatnonzero(tokens[at] == h) if len(tokens) else at[:0]
            n += np.bincount(np.unique(doc[hit] * len(tokens) + at[hit]) % max(1, len(tokens)), minlength=len(tokens))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["token", "n"])

    return texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _matches(texts: DataFrame, items: object, run: int, k: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, it = WordHashes(), items.value
        for batch in in_slices(batches, 1):
            flat, offsets = word_hashes(batch.column(1).to_pylist(), cache)
            doc, pos, h = shingles(flat, offsets, k)
            low, high = np.searchsorted(it.prefix, h, "left"), np.searchsorted(it.prefix, h, "right")
            found: dict[tuple[int, int], list] = {}
            for j in np.flatnonzero(high > low).tolist():
                d, p = int(doc[j]), int(pos[j])
                for e in range(int(low[j]), int(high[j])):
                    i, q = int(it.prefix_doc[e]), int(it.prefix_pos[e])
                    spans = found.setdefault((d, i), [])
                    if any(a <= q < b and p - q == s for a, b, s in spans):
                        continue  # within a run that is known
                    # positional bound: the text and the item must leave room for a whole window at this alignment
                    x, y = flat[offsets[d] : offsets[d + 1]], it.flat[it.offsets[i] : it.offsets[i + 1]]
                    s = p - q
                    a0, b0 = max(0, -s), min(len(y), len(x) - s)
                    if b0 - a0 < run:
                        continue
                    differ = np.flatnonzero(x[a0 + s : b0 + s] != y[a0:b0]) + a0
                    at = int(np.searchsorted(differ, q))
                    a = int(differ[at - 1]) + 1 if at else a0
                    b = int(differ[at]) if at < len(differ) else b0
                    if b - a >= run:
                        spans.append((a, b, s))
            out = [(d, i, max(b - a for a, b, _ in spans), _covered(spans) / (it.offsets[i + 1] - it.offsets[i])) for (d, i), spans in found.items() if spans]
            if out:
                d, i, longest, share = map(np.array, zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(it.ids[i]), pa.array(longest.astype(np.int32)), pa.array(share.astype(float))], names=["doc_id", "item_id", "longest_run", "share"])

    return texts.mapInArrow(search, "doc_id long, item_id long, longest_run int, share double")


def _covered(spans: list) -> int:
    total, end = 0, 0
    for a, b, _ in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, k: int = SHINGLE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage") -> DataFrame:
    """Documents that share at least `run` consecutive words with an item's passage.

    Returns (doc_id, item_id, longest_run, share): the longest shared run of words, and the share of the
    passage's words that lie in shared runs.  Words are runs of letters and digits, case does not count.
    Items are taken in blocks of at most `block` items and about BYTES of passages, each a pass over the corpus; only a
    block is broadcast.
    Repeated item rows count once; null texts, passages and ids, and passages shorter than `run`, match
    nothing; a document id that occurs in several rows is reported with its best row.
    """
    spark = docs.sparkSession
    texts = narrow(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string")).where("doc_id is not null and text is not null")
    small = saved(narrow(items, item_id=F.col(f"`{item_col}`").cast("long"), passage=F.col(f"`{passage_col}`").cast("string")).where("item_id is not null and passage is not null").distinct())
    size = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block), -(-size["bytes"] // BYTES))
    found = None
    for j in range(blocks):
        mine = small if blocks == 1 else small.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == j)
        rows = mine.toArrow()  # one bounded block
        it = _Items(rows["item_id"].to_pylist(), rows["passage"].to_pylist(), run, k)
        counts = _frequencies(texts, spark.sparkContext.broadcast(it), k).toArrow()  # at most the block's tokens, 16 bytes each
        rarity = np.zeros(len(it.tokens), np.int64)
        rarity[counts["token"].to_numpy()] = counts["n"].to_numpy()
        it.choose(rarity)
        part = _matches(texts, spark.sparkContext.broadcast(it), run, k)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max("share").alias("share"))
