"""Streaming counterparts: rows of sessions arrive in any order, and whole sessions are derived again.

No row is ever dropped as late: each micro-batch appends its rows to the log and
derives the touched sessions anew, which equals the batch result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders that each batch's rows are dealt into by their session, so that a batch reads only its own sessions' folders again.
BUCKETS = 256


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def rederive(log_path: str, out_path: str, key: str, derive: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function; writes ``out_path``/batch=N with the touched sessions' rows, the latest batch of a session standing."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("bucket", _bucket(key)).write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/batch={number}")
        arrived = spark.read.parquet(f"{log_path}/batch={number}")
        # BUCKETS numbers at most; the scan of the log is pruned to their folders.
        buckets = [r.bucket for r in arrived.select("bucket").distinct().collect()]
        log = spark.read.parquet(log_path).where(F.col("bucket").isin(buckets))
        derive(log.join(arrived.select(key).distinct(), key, "left_semi").drop("batch", "bucket")).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return step


def current(spark: SparkSession, out_path: str, key: str) -> DataFrame:
    """The rows of each session's latest derivation."""
    rows = spark.read.parquet(out_path)
    latest = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(latest, [key, "batch"], "left_semi").drop("batch")


def run(stream: DataFrame, log_path: str, out_path: str, checkpoint: str, key: str, derive: Callable[[DataFrame], DataFrame]) -> None:
    """Take all that is there and stop."""
    query = stream.writeStream.foreachBatch(rederive(log_path, out_path, key, derive)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_usage(stream: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Tumbling sums for dashboards, where late rows may be left out; sessions never take this way."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("span"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
