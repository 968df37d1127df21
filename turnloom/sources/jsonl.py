"""Session logs as DataFrames: JSON lines, whole JSON threads, and captures of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.session import need_checkpoints

#: Splits whose line counts may be broadcast, some 100 bytes each.
MOST_BROADCAST = 100_000


def capture(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path`` with its checksum, size and time; contents stay behind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("origin"), F.sha1("content").alias("checksum"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(origin, ordinal, raw): the trimmed, non-empty lines of each file, numbered from 0 in file order.

    Files are read in splits, so no file, however long, is held by one task. A first pass counts the lines of
    every split; a line's number is its place in its split and the lines of the splits before. The counts, a row per split, are
    joined to the lines of a second pass over the same splits.
    """
    need_checkpoints(spark)
    text = spark.read.option("recursiveFileLookup", True).text(path)
    cut = text.select(F.col("_metadata.file_path").alias("origin"), F.col("_metadata.file_block_start").alias("block"), T.trimmed("value").alias("raw")).where(F.length("raw") > 0)
    # The ids of a split's lines follow each other, as a task reads split after split.
    cut = cut.withColumn("at", F.monotonically_increasing_id())
    splits = cut.groupBy("origin", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("origin").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("origin", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")).checkpoint()
    small = starts.count() <= MOST_BROADCAST
    return cut.join(F.broadcast(starts) if small else starts, ["origin", "block"]).select("origin", (F.col("at") + F.col("shift")).alias("ordinal"), "raw")


def first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(origin, raw) of the first non-empty line of each file."""
    return lines(spark, path).where("ordinal = 0").select("origin", "raw")


def tail_time(records: DataFrame, look_back: int = 5) -> DataFrame:
    """(origin, tail_time): the latest ``timestamp`` among the last ``look_back`` lines of each file that are JSON, as it was written; null without one.

    ``records`` are (origin, ordinal, raw). Each task keeps the last lines of its own before they meet.
    """
    known = records.withColumn("v", F.try_parse_json("raw")).where("v IS NOT NULL").select("origin", "ordinal", F.when(F.schema_of_variant(F.try_variant_get("v", "$.timestamp", "variant")) == "STRING", F.try_variant_get("v", "$.timestamp", "string")).alias("said"))
    last = known.withColumn("k", F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("ordinal")))).where(F.col("k") <= look_back)
    moment = F.try_to_timestamp("said")
    # Of equal moments the one nearest to the end counts.
    return last.groupBy("origin").agg(F.max_by("said", F.when(moment.isNotNull(), F.struct(moment, (-F.col("k")).alias("k")))).alias("tail_time"))


def parsed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (origin, ordinal, record) as variants, and the audit of lines that are no JSON or no object."""
    tried = rows.withColumn("record", F.try_parse_json("raw"))
    kind = F.schema_of_variant("record")
    fault = F.when(F.col("record").isNull(), "record_json_parse_failed").when(~kind.startswith("OBJECT"), "record_not_object")
    marked = tried.withColumn("fault", fault)
    return marked.where("fault IS NULL").select("origin", "ordinal", "record"), marked.where("fault IS NOT NULL").select("origin", "ordinal", "fault", "raw")


def _text(path: str):
    return F.try_variant_get("record", path, "string")


def conversation_fragments(records: DataFrame, platform: str) -> DataFrame:
    """(session, ordinal, time_key, kind, role, text, usage columns) of a platform's records.

    Content is a string, or a list of items whose texts are joined by a line break.
    """
    items = F.try_variant_get("record", "$.payload.content" if platform == "codex" else "$.message.content", "array<struct<type:string,text:string>>")
    joined = F.array_join(F.filter(F.transform(items, lambda x: x["text"]), lambda x: x.isNotNull()), "\n")
    if platform == "codex":
        kind = F.coalesce(_text("$.payload.type"), _text("$.type"))
        session = F.first(_text("$.payload.id"), ignorenulls=True).over(Window.partitionBy("origin").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        use, role, plain = "$.payload.info.last_token_usage", _text("$.payload.role"), _text("$.payload.message")
        cached = F.try_variant_get("record", f"{use}.cached_input_tokens", "long")
    else:
        kind = _text("$.type")
        session = F.coalesce(_text("$.sessionId"), F.element_at(F.split("origin", "/"), -1))
        use, role, plain = "$.message.usage", F.coalesce(_text("$.message.role"), _text("$.role")), _text("$.message.content")
        cached = F.coalesce(F.try_variant_get("record", f"{use}.cache_creation_input_tokens", "long"), F.lit(0)) + F.coalesce(F.try_variant_get("record", f"{use}.cache_read_input_tokens", "long"), F.lit(0))
    return records.select(
        session.alias("session"),
        "origin",
        "ordinal",
        _text("$.timestamp").alias("time_key"),
        kind.alias("kind"),
        role.alias("role"),
        F.when(items.isNotNull(), joined).otherwise(plain).alias("text"),
        F.try_variant_get("record", f"{use}.input_tokens", "long").alias("input_tokens"),
        cached.alias("cached_tokens"),
        F.try_variant_get("record", f"{use}.output_tokens", "long").alias("output_tokens"),
    )


def thread_messages(spark: SparkSession, path: str) -> DataFrame:
    """Whole-JSON threads: one row per message with the thread's id and place."""
    raw = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("origin"), F.try_parse_json("value").alias("thread"))
    held = F.try_variant_get("thread", "$.messages", "array<variant>")
    return raw.select("origin", F.try_variant_get("thread", "$.id", "string").alias("session"), F.posexplode(held).alias("ordinal", "record"))
