"""Conversations found anywhere in JSON of unknown shape.

Values are searched level by level, to DEPTH levels below the top. A value is a conversation if it is a list of
messages, or an object with such a list (or map) under one of the usual names, and a user or the assistant speaks in it; what lies inside a
conversation isn't searched further. Each level is a table of the values still open, so no
document is walked by one task, however large.

Conversations of one id in one document are one: the first value that any of them gives counts (in document order, an
object's members in the order of their names), its times are the least and the latest, and its messages are ordered by their time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.session import forget, settled
from turnloom.sources import generic as G

DEPTH = 8
# Where an object holds its messages, first as lists, then as maps; and what names a conversation.
LISTS, MAPS = "messages items turns history entries parts".split(), "messageMap mapping".split()
IDS = "id sessionId session_id conversationId conversation_id chatId chat_id composerId"
SEED = "doc string, session_id string, title string, model string, workspace string, created_at string, updated_at string, n_messages long"


def _iso(value: Column, paths: str) -> Column:
    """The first of these paths that holds a time as text, else as milliseconds."""
    at = lambda p: F.try_variant_get(value, f"$.{p}", "variant")
    texts = [T.coerce_iso(F.when(G._is(at(p), "STRING"), F.try_variant_get(value, f"$.{p}", "string"))) for p in paths.split()]
    numbers = [T.iso_of_millis(F.when(~G._is(at(p), "STRING") & ~G._is(at(p), "BOOLEAN"), F.try_variant_get(value, f"$.{p}", "double"))) for p in paths.split()]
    return F.coalesce(*texts, *numbers)


def _slots(v: Column) -> Column:
    """The lists that a value may hold its messages in, in order of preference."""
    inner = lambda x: F.when(G._is(F.try_variant_get(x, "$.message", "variant"), "OBJECT"), F.try_variant_get(x, "$.message", "variant")).otherwise(x)
    held = [F.try_variant_get(v, "$", "array<variant>"), *(F.try_variant_get(v, f"$.{n}", "array<variant>") for n in LISTS), *(F.transform(F.map_values(F.try_variant_get(v, f"$.{n}", "map<string,variant>")), inner) for n in MAPS)]
    return F.array(*held)


def _messages(nodes: DataFrame) -> DataFrame:
    """(doc, at, slot, place, entry, role, said, observed_at, model) of every entry of a value that is a message."""
    entries = nodes.select("doc", "at", F.posexplode(_slots(F.col("v"))).alias("slot", "list")).select("doc", "at", "slot", F.posexplode("list").alias("place", "entry")).where(G._is(F.col("entry"), "OBJECT"))
    base = F.coalesce(*(F.when(G._is(F.try_variant_get("entry", f"$.{n}", "variant"), "OBJECT"), F.try_variant_get("entry", f"$.{n}", "variant")) for n in ("message", "info")), F.col("entry"))
    entries = entries.withColumn("base", base)
    told = entries.withColumn("role", F.coalesce(G.role(F.col("base")), G.role(F.col("entry")), G.role(F.try_variant_get("entry", "$.info", "variant")))).withColumn("parts", F.size(G._parts(F.col("base"))))
    told = told.where(F.col("role").isNotNull() | (F.col("parts") > 0) | (F.size(F.coalesce(F.try_variant_get("entry", "$.parts", "array<variant>"), F.array().cast("array<variant>"))) > 0))
    content = F.coalesce(*(F.try_variant_get(b, f"$.{n}", "array<variant>") for b in ("base", "entry") for n in ("content", "parts", "blocks")))
    said = F.coalesce(G._string(F.col("base"), "content text output_text input_text output response"), G._joined(content, "nothing"))
    moment = F.coalesce(_iso(F.col("base"), "timestamp createdAt updatedAt created"), _iso(F.col("entry"), "timestamp createdAt info.createdAt info.created"))
    model = F.coalesce(G._string(F.col("base"), "model"), G._string(F.col("entry"), "info.model model"))
    return told.select("doc", "at", "slot", "place", "entry", F.coalesce("role", F.lit("assistant")).alias("role"), said.alias("said"), moment.alias("observed_at"), model.alias("model"))


def _children(nodes: DataFrame) -> DataFrame:
    """The lists and objects right inside the values."""
    spark = nodes.sparkSession
    inner = nodes.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    below = inner.where(G._is(F.col("value"), "OBJECT") | G._is(F.col("value"), "ARRAY"))
    step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
    return below.select("doc", F.array_append("at", F.col("pos")).alias("at"), F.concat("path", step).alias("path"), F.col("value").alias("v"))


def find(values: DataFrame, platform: str, doc: str = "origin", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Conversations (SEED) and their messages (doc, session_id, ordinal, observed_at, role, record) in variants.

    ``doc`` names each document, whose name also begins the path that stands in for the id of a conversation without one. A message without
    a time comes before all others. Values that are null or hold no conversation give no row.
    """
    open_ = values.select(F.col(doc).cast("string").alias("doc"), F.array().cast("array<int>").alias("at"), F.col(doc).cast("string").alias("path"), F.col(value).alias("v")).where(G._is(F.col("v"), "OBJECT") | G._is(F.col("v"), "ARRAY"))
    found, spent = [], []
    for level in range(DEPTH + 1):
        nodes = settled(open_, "seed-nodes")
        spent.append(nodes)
        if nodes.isEmpty():
            break
        # The first list with a message is the one meant, even where nobody known speaks in it.
        messages = settled(_messages(nodes), "seed-messages")
        slots = messages.groupBy("doc", "at").agg(F.min("slot").alias("slot"))
        messages_ = messages.join(slots, ["doc", "at", "slot"])
        spoken = messages_.groupBy("doc", "at").agg(F.bool_or(F.col("role").isin("user", "assistant")).alias("spoken")).where("spoken").select("doc", "at")
        found.append(settled(messages_.join(spoken, ["doc", "at"], "left_semi").join(nodes, ["doc", "at"]), "seed-found"))
        spent.append(messages)
        if level < DEPTH:
            open_ = _children(nodes.join(spoken, ["doc", "at"], "left_anti"))
    if not found:
        found = [settled(_messages(open_.select("doc", "at", "v")).join(open_, ["doc", "at"]), "seed-found")]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)

    v = F.col("v")
    each = rows.groupBy("doc", "at").agg(
        F.first("v").alias("v"), F.first("path").alias("path"), F.count("*").alias("n"), F.min_by("said", F.when(F.col("role") == "user", F.col("place"))).alias("asked"), F.min_by("observed_at", "place").alias("first_at"),
        F.max_by("observed_at", "place").alias("last_at"), F.min_by("model", F.when(F.length("model") > 0, F.col("place"))).alias("of_messages"))
    # What a conversation says of itself is read in a step of its own, as the next ones use it several times.
    kept = ["doc", "at", "path", "n", "asked", "first_at", "last_at", "of_messages"]
    names = {"_id": IDS, "_title": G.TITLES, "_model": G.MODELS, "_workspace": G.WORKSPACES}
    each = each.withColumn("v", F.when(G._is(v, "OBJECT"), v))
    said = settled(each.select(*kept, *(G._string(v, x).alias(c) for c, x in names.items()), _iso(v, "createdAt created_at").alias("_created"), _iso(v, "updatedAt updated_at").alias("_updated")), "seed-said")
    spent.append(said)
    created = F.coalesce("_created", "first_at")
    told = said.select(
        "doc",
        "at",
        F.concat(F.lit(f"sess:{platform}:"), F.coalesce("_id", F.sha1("path"))).alias("session_id"),
        F.coalesce("_title", F.when(F.length("asked") > 0, T.truncate(F.col("asked"), 72))).alias("title"),
        F.coalesce("_model", "of_messages").alias("model"),
        T.path_identity(F.col("_workspace")).alias("workspace"),
        created.alias("created_at"),
        F.coalesce("_updated", "last_at", created).alias("updated_at"),
        "n",
    )
    told = settled(told, "seed-conversations")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    merged = told.groupBy("doc", "session_id").agg(first("title"), first("model"), first("workspace"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.sum("n").alias("n_messages"))
    messages = rows.join(told.select("doc", "at", "session_id"), ["doc", "at"])
    # The order of a conversation's messages, a row each; the messages themselves stay where they are.
    order = F.row_number().over(Window.partitionBy("doc", "session_id").orderBy(F.coalesce("observed_at", F.lit("")), "at", "place")) - 1
    forget(*spent)
    return merged, messages.withColumn("ordinal", order).select("doc", "session_id", "ordinal", "observed_at", "role", F.col("entry").alias("record"))
