"""Streams of pages and results, by Structured Streaming: the page cache's rules and the upserts of `operators.state`, batch after batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwood.operators.state import upsert_docs


def first_in_window(stream: DataFrame, keys: list[str], time_col: str, ttl: str = "7 days") -> DataFrame:
    """The first row of each key; a later one passes only when the key's entry is gone.

    Entries go at the end of a batch that began with its watermark beyond the TTL after them, so state holds the keys of about one TTL.
    Rows later than the watermark are dropped, as their key's entry may be gone.
    """
    return stream.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, keys: list[str], time_col: str, width: str, late: str) -> DataFrame:
    """(start, keys, n): rows in each window of time, final once the watermark has passed its end."""
    window = F.window(time_col, width)
    return stream.withWatermark(time_col, late).groupBy(window, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str, always: list[str], if_given: list[str], order: str) -> StreamingQuery:
    """Merges each batch into a table of versions, `path`/v=<batch>, of which the highest is current.

    Of a batch's rows of one key the last by `order` counts. A batch that is tried again overwrites its own version and reads the one before it,
    so a lost driver or executor leaves neither half a table nor a row merged twice. Runs until the input is used up.
    """
    empty = stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        before = spark.read.schema(empty).parquet(f"{path}/v={number - 1}") if number else spark.createDataFrame([], empty)
        upsert_docs(before, last, key, always, if_given).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a table that `upsert_stream` writes."""
    versions = spark.read.parquet(path)
    last = versions.agg(F.max("v")).first()[0]
    return versions.where(F.col("v") == last).drop("v")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Appends what the stream gives until its input is used up, and reads it back."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
