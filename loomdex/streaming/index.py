"""The index grown by a stream: running term counts, and counts per window of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.strings import words
from ..scratch import scratch_dir


def running_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """streaming docs(.., text) -> (term, total), for output mode update or complete."""
    return docs.select(F.explode(words(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("total"))


def windowed_counts(events: DataFrame, time_col: str, key: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, key, n) per tumbling window; rows later than `late` are dropped, state is dropped behind the watermark."""
    e = events.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    return e.groupBy(F.window("_t", window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def totals_of(stream: DataFrame) -> DataFrame:
    """Runs a streaming aggregation over what is there now and returns its rows: each batch's whole result takes the place
    of the one before in the shared folder, none is held by the driver."""
    spark = stream.sparkSession
    folder = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    q = stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def write_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what is there now into Parquet files, exactly once per batch, and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
