"""Streaming ingest: files land in a folder, repeated texts are dropped, micro-batches are written as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.session import shared_dir


def text_stream(spark: SparkSession, folder: str, schema: str, per_batch: int = 1000) -> DataFrame:
    """Rows of Parquet files that land in folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def first_of_hash(rows: DataFrame, text: str = "text", time: str | None = None, delay: str = "7 days") -> DataFrame:
    """The first row of each content hash; repeats are dropped within delay of event time, so the state is bounded.

    Without a time column the time of reading counts. Later repeats are left to the store, which knows all hashes.
    """
    hashed = rows.withColumn("sha256", X.content_hash(F.col(text)))
    if time is None:
        hashed, time = hashed.withColumn("__read", F.current_timestamp()), "__read"
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha256"]).drop("__read")


def run_to_end(stream: DataFrame, out: str, name: str) -> DataFrame:
    """Process all that is there, append it to Parquet files in out, and return what they hold."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{shared_dir(spark)}/stream-{name}")
        .trigger(availableNow=True).outputMode("append").start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
