"""Tables that keep what was read: one folder a source, replaced or merged as a whole, and evidence by its content.

Merges read what they overwrite, so the new rows are written to the checkpoint folder first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.session import need_checkpoints


def _held(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What lies at ``path``; nothing, with the columns of ``like``, where there is no table yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(like.schema).parquet(path) if there else like.limit(0)


def replace(rows: DataFrame, path: str, source: str = "source_id", sources: list | None = None) -> None:
    """Put ``rows`` in place of everything that their sources held; other sources stay untouched.

    ``sources`` names sources that are replaced even where ``rows`` holds nothing of them: what they held goes. Sources are
    replaced one after the other, so a job that fails may have replaced some; ``bundles.commit`` writes all or nothing.
    """
    rows.write.partitionBy(source).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    if sources:
        spark = rows.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        filled = {r[0] for r in rows.where(F.col(source).isin(sources)).select(source).distinct().collect()}
        for name in set(sources) - filled:
            target = jvm.org.apache.hadoop.fs.Path(f"{path}/{source}={escape(str(name))}")
            target.getFileSystem(conf).delete(target, True)


def verdicts(held: DataFrame, incoming: DataFrame, failed: DataFrame, source: str = "source_id", origin: str = "origin", session: str = "session") -> DataFrame:
    """(source, origin, verdict) of each incoming or failed origin.

    ``failed`` lists origins (source, origin) that were captured but not read acceptably: what they held stays (``failed``). An incoming origin is
    replaced (``replace``), unless one of the sessions that it held is also held by a failed origin of its source: that session can't be
    put together then, so the origin stays as it was (``veto``). An origin that held nothing is never vetoed. Null sessions are shared with none.
    """
    at = [source, origin]
    bad = failed.select(*at).distinct()
    parts = held.select(*at, session).where(F.col(session).isNotNull()).distinct()
    stuck = parts.join(bad, at, "left_semi").select(source, session).distinct()
    vetoed = parts.join(stuck, [source, session], "left_semi").select(*at).distinct().withColumn("_veto", F.lit(True))
    asked = incoming.select(*at).distinct().join(bad, at, "left_anti").join(vetoed, at, "left")
    good = asked.select(*at, F.when(F.col("_veto"), "veto").otherwise("replace").alias("verdict"))
    return good.unionByName(bad.withColumn("verdict", F.lit("failed")))


def merge_unless_vetoed(rows: DataFrame, failed: DataFrame, path: str, source: str = "source_id", origin: str = "origin", session: str = "session") -> DataFrame:
    """``merge_by_origin`` of those origins whose verdict is to replace them; gives the verdicts. Rows of vetoed and failed origins aren't written."""
    spark = rows.sparkSession
    need_checkpoints(spark)
    told = verdicts(_held(spark, path, rows), rows, failed, source, origin, session).checkpoint()
    merge_by_origin(rows.join(told.where("verdict = 'replace'"), [source, origin], "left_semi").select(*rows.columns), path, source, origin)
    return told


def merge_by_origin(rows: DataFrame, path: str, source: str = "source_id", origin: str = "origin") -> None:
    """Put ``rows`` in place of what their sources held of the same origins; rows of a source's other origins stay."""
    spark = rows.sparkSession
    need_checkpoints(spark)
    rows = rows.checkpoint()
    held = _held(spark, path, rows).join(rows.select(source).distinct(), source, "left_semi")
    kept = held.join(rows.select(source, origin).distinct(), [source, origin], "left_anti")
    replace(kept.unionByName(rows).checkpoint(), path, source)


def upsert(rows: DataFrame, path: str, key: list[str], order: str, source: str = "source_id") -> None:
    """Of each key the row that is last by ``order`` among what its source held and ``rows``; of equal ones a new row."""
    spark = rows.sparkSession
    need_checkpoints(spark)
    rows = rows.checkpoint()
    held = _held(spark, path, rows).join(rows.select(source).distinct(), source, "left_semi")
    both = held.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(source, *key).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    replace(both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new").checkpoint(), path, source)


def put_evidence(contents: DataFrame, path: str, column: str = "content") -> DataFrame:
    """Append each content that isn't there yet, once, under its SHA-256; gives ``contents`` with that digest."""
    spark = contents.sparkSession
    named = contents.withColumn("sha256", F.sha2(F.col(column).cast("binary"), 256))
    bodies = named.where(F.col(column).isNotNull()).select("sha256", F.col(column).alias("content")).dropDuplicates(["sha256"])
    need_checkpoints(spark)
    new = bodies.join(_held(spark, path, bodies).select("sha256"), "sha256", "left_anti").checkpoint()
    new.write.mode("append").parquet(path)
    return named
