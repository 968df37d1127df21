"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder ``sf_dir``, in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset
    (local tests) a temporary folder of this machine stands in; on a cluster that is
    an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="turnloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/turnloom-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage.

    Lost executors cost nothing behind the cut: the files outlive them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove what ``cut`` wrote for these frames, which no later step may read."""
    for frame in frames:
        drop_path(frame.sparkSession, frame.scratch)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores behind them until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (w + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for w in names]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500, size: int = 2 << 20) -> Iterator[None]:
    """What is written inside sends Python batches of ``rows`` rows and some ``size`` bytes, which bounds the memory that long texts take."""
    before = {}
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        before[key] = spark.conf.get(key)
        held = before[key].removesuffix("b")
        spark.conf.set(key, min(most, int(held)) if held.isdigit() and int(held) > 0 else most)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def cut_small(df: DataFrame, label: str) -> DataFrame:
    """``cut`` with ``small_batches``: Spark takes their size when a plan runs, so a frame that is returned as it is runs with that of whoever writes it."""
    with small_batches(df.sparkSession):
        return cut(df, label)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, n_ones: int, n_zeros: int, longest: int) -> DataFrame:
    """A bounded training sample (id, text, mark): at most ``n_ones`` and ``n_zeros`` rows of each label with texts of at most ``longest`` bytes.

    Rows are taken in the order of a hash of their key, alike at every size of the input; one row per id, of texts
    that share an id the least.
    """
    marked = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("mark")).where("id IS NOT NULL AND mark IN (0, 1)").withColumn("o", F.xxhash64(F.col("id").cast("string")))
    marked = marked.groupBy("id", "o").agg(F.min("mark").alias("mark"))
    chosen = marked.where("mark = 1").orderBy("o", "id").limit(n_ones).unionByName(marked.where("mark = 0").orderBy("o", "id").limit(n_zeros))
    # So many keys at most may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).where(F.octet_length("text").between(1, longest))
    return rows.groupBy("id").agg(F.min("text").alias("text"), F.first("mark").alias("mark"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n_ones: int, n_zeros: int, longest: int):
    """``labelled_rows`` as a pandas frame in order of id."""
    return labelled_rows(docs, labels, label, n_ones, n_zeros, longest).toPandas().sort_values("id", ignore_index=True)
