"""SparkSession settings that the engine relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A UTC session with adaptive execution; on a cluster use its own builder instead."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | more
    return SparkSession.builder.master(master).appName("turnloom").config(map=conf).getOrCreate()


def need_checkpoints(spark: SparkSession) -> None:
    """Iterative operators write to the folder that driver and executors share; only a local session may take one of its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="turnloom-"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys over all shuffle partitions, for steps that cost much more than reading: small files otherwise lie in a few tasks."""
    # A number that is given isn't lowered to the size of the rows, which says nothing about what they cost.
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the checkpoint folder and read again, which cuts its lineage; ``forget`` removes it, or the end of the application."""
    spark = df.sparkSession
    need_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/turnloom-{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove what ``settled`` wrote for these frames, which no later step may read."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
