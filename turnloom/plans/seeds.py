"""Queries on conversations that are found in JSON of unknown shape: ``conversations`` wrapped in five ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.plans.registry import query, table
from turnloom.sources import seeds


def wrapped(spark, sf_dir):
    """One document a conversation: a list of messages below, a map, two halves of one id, system messages beside it, or too deep."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"), F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt")).alias("m"))
    each = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    key, m = F.col("conv_id").cast("string"), F.col("m")
    half = F.floor((F.size(m) + 1) / 2).cast("int")
    held = lambda name, value: F.struct(key.alias("id"), value.alias(name))
    by_key = F.map_from_entries(F.transform(m, lambda x: F.struct((F.lit(1000) + x["turn"]).cast("string").alias("k"), F.struct(x.alias("message")).alias("v"))))
    deep = held("messages", m)
    for _ in range(9):
        deep = F.struct(deep.alias("in"))
    kind = F.col("conv_id") % 5
    raw = (
        F.when(kind == 0, F.to_json(F.struct(F.struct(F.array(held("messages", m)).alias("list")).alias("state"))))
        .when(kind == 1, F.to_json(F.struct(held("mapping", by_key).alias("chat"))))
        .when(kind == 2, F.to_json(F.struct(held("history", F.slice(m, half + 1, F.size(m))).alias("late"), held("turns", F.slice(m, F.lit(1), half)).alias("early"))))
        .when(kind == 3, F.to_json(F.struct(F.array(F.struct(F.lit("system").alias("role"), F.lit("x").alias("content"))).alias("messages"), held("entries", m).alias("other"))))
        .otherwise(F.to_json(deep))
    )
    return each.select(key.alias("origin"), F.parse_json(raw).alias("value"))


OWN = """own AS (SELECT conv_id, turn, coalesce(text, '') AS text, CASE WHEN lower(trim(role)) IN ('human', 'user', 'operator') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'model', 'bot', 'tool') THEN 'assistant'
    WHEN lower(trim(role)) IN ('developer', 'system', 'instruction') THEN 'system' ELSE coalesce(nullif(lower(trim(role)), ''), 'assistant') END AS role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id % 5 < 4
), part AS (SELECT *, CASE WHEN conv_id % 5 = 2 AND i > (n + 1) // 2 THEN 1 ELSE 0 END AS half FROM own
), spoken AS (SELECT conv_id, half FROM part GROUP BY 1, 2 HAVING bool_or(role IN ('user', 'assistant'))
), kept AS (SELECT part.* FROM part JOIN spoken USING (conv_id, half))"""


@query(
    "found_conversations",
    f"""WITH {OWN}, asked AS (SELECT conv_id, half, arg_min(text, turn) AS t FROM kept WHERE role = 'user' GROUP BY 1, 2)
SELECT conv_id::VARCHAR AS doc, 'sess:x:' || conv_id AS session_id, count(*) AS n_messages, strftime(to_timestamp(1704067200 + min(turn) * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS created_at,
  (SELECT arg_min(CASE WHEN length(t) <= 72 THEN t ELSE left(t, 71) || '...' END, half) FILTER (t <> '') FROM asked WHERE asked.conv_id = kept.conv_id) AS title FROM kept GROUP BY conv_id""",
)
def _found(spark, sf_dir):
    return seeds.find(wrapped(spark, sf_dir), "x")[0].select("doc", "session_id", "n_messages", "created_at", "title")


@query("found_messages", f"WITH {OWN} SELECT conv_id::VARCHAR AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, role, text AS content FROM kept")
def _messages(spark, sf_dir):
    return seeds.find(wrapped(spark, sf_dir), "x")[1].select("doc", "ordinal", "role", F.try_variant_get("record", "$.content", "string").alias("content"))
