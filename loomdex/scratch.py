"""Scratch tables in the folder that all executors share, and joins whose broadcast side is counted first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a table up to which it is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Whether a query's shuffle files go when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  A session without one that runs on one machine (tests) gets a temporary one;
    on a cluster, where executors would not see it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomdex-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder within shared_dir(), deleted with all that is left in it when the application ends."""
    folder = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def saved(df: DataFrame, *cluster_by: str) -> DataFrame:
    """Writes the frame into the shared folder and reads it back: the lineage ends there, so the loss of an
    executor costs no recomputation, and the rows are stored compressed by column.  Shuffle files of the write are
    deleted when it ends, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    if cluster_by:
        df = df.repartition(*cluster_by)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def drop(df: DataFrame) -> None:
    """Deletes the files of a frame that saved() returned."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def narrow(df: DataFrame, **columns: object) -> DataFrame:
    """The named columns only, by name = expression; other columns, however they are called, fall away."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def bounded_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Joins by broadcast if `small` has at most `rows` rows and `size` bytes of text and numbers, else by shuffle (with
    AQE's splitting of skewed keys).  `small` is written first unless saved() made it, so it is computed once."""
    if not hasattr(small, "_scratch"):
        small = saved(small)
    one = F.lit(0)
    for f in small.schema.fields:
        c = F.col(f"`{f.name}`")
        one = one + (F.coalesce(F.octet_length(c), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0)) if f.dataType.typeName() in ("array", "map", "struct") else F.lit(8))
    found = small.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(one), F.lit(0)).alias("bytes")).first()
    few = found["n"] <= rows and found["bytes"] <= size
    return big.join(F.broadcast(small) if few else small, on, how)
