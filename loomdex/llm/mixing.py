"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_join, in_slices, narrow, saved

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut before byte pairs are merged: contractions, letters, digits, other signs, white space (a fixed value of the public vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Steps in which the order of a source's documents is cut for a running sum.
STEPS = 4096


def piece_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size) with size = number of white-space-separated pieces; null texts have size 0."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"(?U)[^\s\x1c-\x1f]+")), F.lit(0)).cast("long")
    return narrow(docs, id=F.col(f"`{id_col}`").cast("long"), source=F.col(f"`{source_col}`").cast("string"), size=size)


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size) with size = tokens of a public byte-level vocabulary, whose file every executor reads at `tokenizer`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        code = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in in_slices(batches, 2):
            sizes = [len(code.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["id", "source", "size"])

    rows = narrow(docs, id=F.col(f"`{id_col}`").cast("long"), source=F.col(f"`{source_col}`").cast("string"), text=F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(run, "id long, source string, size long")


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of targets(source, target_share, max_repeats) is to give.

    Returns (source, target_share, max_repeats, docs, all, want, copies, rest): all = size of the source (0 without
    documents), want = target_share * size of all documents (of sources without a target too), copies = whole copies
    that every document certainly gets, rest = the size still to be drawn, at most all.  A repeated source in targets
    counts once (largest share); rows with a null source or share are dropped; a null max_repeats counts as 1.  One
    aggregation with map-side sums.
    """
    by = saved(sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("all")))
    total = by.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("total"))
    goal = narrow(targets, source=F.col("source").cast("string"), target_share=F.col("target_share").cast("double"), max_repeats=F.coalesce(F.col("max_repeats"), F.lit(1)).cast("int")).where("source is not null and target_share is not null")
    goal = goal.groupBy("source").agg(F.max_by(F.struct("target_share", "max_repeats"), "target_share").alias("g")).select("source", "g.*")
    rows = goal.join(by, "source", "left").fillna(0, ["docs", "all"]).crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumn("want", F.col("target_share") * F.col("total"))
    copies = F.least(F.col("max_repeats"), F.coalesce(F.floor(F.try_divide("want", "all")), F.lit(0)).cast("int"))
    rest = F.when(F.col("copies") < F.col("max_repeats"), F.col("want") - F.col("copies") * F.col("all")).otherwise(0.0)
    return rows.withColumn("copies", copies).select("source", "target_share", "max_repeats", "docs", "all", "want", "copies", rest.alias("rest"))


def inclusion_odds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, scale): a document of size s is to be drawn with probability min(1, scale * s), so that the expected size
    of the draw is the source's rest.  Solved over the sums of classes of like size, eight to a doubling."""
    step = F.floor(F.log2(F.col("size").cast("double")) * 8).cast("int")
    classes = bounded_join(sizes.where("size > 0 and id is not null"), plan.where("rest > 0").select("source", "rest"), "source")
    classes = classes.groupBy("source", step.alias("step")).agg(F.first("rest").alias("rest"), F.sum("size").alias("a"), F.sum(F.col("size").cast("double") * F.col("size")).alias("b"), F.max("size").alias("top"))
    # the largest classes are certain; of the others the draw takes what is left: scale = (rest - certain) / squares
    w = Window.partitionBy("source").orderBy("step")  # a few hundred classes at most
    squares = F.sum("b").over(w)
    certain = F.sum("a").over(Window.partitionBy("source")) - F.sum("a").over(w)
    tried = classes.select("source", "step", "top", ((F.col("rest") - certain) / squares).alias("scale"))
    # all classes up to a step are drawn by chance if the largest of them has a probability of one at most
    fits = tried.where("scale > 0 and scale * top <= 1").groupBy("source").agg(F.max_by("scale", "step").alias("scale"))
    none = tried.groupBy("source").agg(F.max("scale").alias("most"))
    return none.join(fits, "source", "left").select("source", F.coalesce("scale", "most").alias("scale"))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """Chooses documents so that each source makes up its target share: (id, source, size, copies), copies > 0.

    Every document gets the certain whole copies of its source.  For the rest, a document's inclusion probability p is
    in proportion to its size (inclusion_odds()); with a random u it gets the Pareto rank u/(1-u) / (p/(1-p)), and the
    lowest ranks are taken until the size still wanted is filled (a document that crosses the border is taken if that
    comes nearer).  Sizes are summed along the ranks in two levels, 4096 steps and the documents of the one step at the
    border, so no source is sorted in one task.  Null ids are dropped; documents of sources without target get no copy;
    documents of size 0 get the certain copies only.
    """
    sizes = saved(sizes)
    plan = saved(mix_plan(sizes, targets))
    odds = saved(inclusion_odds(sizes, plan))
    goal = saved(plan.join(odds, "source", "left").select("source", "copies", "rest", "scale"))
    rows = bounded_join(sizes.where("id is not null"), goal, "source")
    u = (F.pmod(F.xxhash64(F.lit(seed), "id", "source"), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    p = F.greatest(F.least(F.col("scale") * F.col("size"), F.lit(1 - 1e-9)), F.lit(1e-9))
    rank = (u / (1 - u)) / (p / (1 - p))
    drawn = (F.col("rest") > 0) & (F.col("size") > 0)
    rows = saved(rows.select("id", "source", "size", "copies", "rest", drawn.alias("drawn"), rank.alias("rank")).withColumn("step", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * STEPS), F.lit(STEPS - 1)).cast("int")))
    steps = rows.where("drawn").groupBy("source", "step").agg(F.sum("size").alias("part"))
    before = F.coalesce(F.sum("part").over(Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = saved(steps.select("source", "step", before.alias("before"), (before + F.col("part")).alias("after")))
    inside = rows.join(steps, ["source", "step"], "left")
    at_border = F.col("drawn") & (F.col("before") < F.col("rest")) & (F.col("after") > F.col("rest"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("source", "step").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    border = inside.where(at_border).withColumn("ahead", ahead).withColumn("more", (F.col("ahead") + F.col("size") / 2 <= F.col("rest")).cast("int"))
    others = inside.where(~at_border).withColumn("more", (F.col("drawn") & (F.col("after") <= F.col("rest"))).cast("int"))
    chosen = border.select("id", "source", "size", "copies", "more").unionByName(others.select("id", "source", "size", "copies", "more"))
    return chosen.select("id", "source", "size", (F.col("copies") + F.coalesce("more", F.lit(0))).cast("int").alias("copies")).where("copies > 0")


def mix_report(sizes: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """One row per source of targets: source, target_share, actual_share, docs_used, copies_used, size_used, short.

    short: the choice used every document of the source max_repeats times and stayed below the size that was wanted."""
    sizes = saved(sizes)
    plan = mix_plan(sizes, targets)
    used = mix(sizes, targets, seed).groupBy("source").agg(F.count("*").alias("docs_used"), F.sum("copies").alias("copies_used"), F.sum(F.col("size") * F.col("copies")).alias("size_used"))
    rows = plan.join(used, "source", "left").fillna(0, ["docs_used", "copies_used", "size_used"])
    short = (F.col("size_used") == F.col("all") * F.col("max_repeats")) & (F.col("size_used") < F.col("want"))
    rows = saved(rows.select("source", "target_share", "docs_used", "copies_used", "size_used", short.alias("short")))
    whole = rows.agg(F.sum("size_used").alias("whole"))
    return rows.crossJoin(F.broadcast(whole)).select("source", "target_share", F.coalesce(F.try_divide("size_used", "whole"), F.lit(0.0)).alias("actual_share"), "docs_used", "copies_used", "size_used", "short")  # whole is one row


def mix_selection(sizes: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """mix() with the shares reached: id, source, size, copies, target_share, actual_share."""
    sizes = saved(sizes)
    chosen = saved(mix(sizes, targets, seed))
    used = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("used"))
    whole = chosen.agg(F.sum(F.col("size") * F.col("copies")).alias("whole"))
    shares = used.crossJoin(F.broadcast(whole)).select("source", F.try_divide("used", "whole").alias("actual_share"))  # whole is one row
    shares = shares.join(mix_plan(sizes, targets).select("source", "target_share"), "source")
    return bounded_join(chosen, saved(shares), "source").select("id", "source", "size", "copies", "target_share", "actual_share")
