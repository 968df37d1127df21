"""Queries on sessions in many files: conversations as a storage's files, customers' logs with the files beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.plans.registry import query, table
from turnloom.sources import joined


def stored(spark, sf_dir):
    """A file a conversation, a file a turn, and for each turn its text, for some a tool's call, for replies an end."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    key, at = F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 6, "0")
    message = F.concat(F.lit("m"), key, F.lit("_"), F.col("turn").cast("string"))
    millis = (F.lit(1704067200) + F.col("turn") * 60) * 1000
    path = lambda *parts: F.concat(F.lit("/h/storage/"), *parts, F.lit(".json")).alias("origin")
    held = lambda *fields: F.to_json(F.struct(*fields)).alias("value")
    lit = lambda name, value: F.lit(value).alias(name)
    title = F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("c"), key)).alias("title")
    of_session = own.select("conv_id").distinct().select(path(F.lit("session/g/"), key), held(key.alias("id"), title, F.concat(F.lit("/w/./p"), (F.col("conv_id") % 5).cast("string")).alias("directory"), F.struct(F.lit(1704067200000).alias("created")).alias("time")))
    of_message = own.select(path(F.lit("message/"), key, F.lit("/"), at), held(message.alias("id"), "role", F.struct(millis.alias("created")).alias("time"), F.when(F.col("turn") % 4 == 1, F.struct(F.col("turn").alias("input"), F.lit(2).alias("reasoning"))).alias("tokens")))
    parts = {
        "a": (F.lit(True), held(lit("type", "text"), "text")),
        "b": (F.col("turn") % 3 == 0, held(lit("type", "tool"), F.concat(F.lit("k"), message).alias("callID"), lit("tool", "run"), F.struct(F.struct(F.col("turn").alias("n")).alias("input"), lit("output", "ok")).alias("state"))),
        "c": (F.col("role") == "assistant", held(lit("type", "step-finish"), lit("reason", "stop"), F.struct(F.length("text").alias("input"), F.struct(F.col("turn").alias("read")).alias("cache")).alias("tokens"))),
    }
    out = of_session.unionByName(of_message)
    for name, (which, value) in parts.items():
        out = out.unionByName(own.where(which).select(path(F.lit("part/"), message, F.lit(f"/{name}")), value))
    return out


OWN = """own AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, 'sess:joined:' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY lpad(turn::VARCHAR, 6, '0')) - 1 AS ordinal, 'm' || conv_id || '_' || turn AS message FROM conversations)"""
ROLE = """CASE WHEN lower(trim(role)) IN ('human', 'user', 'operator') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'model', 'bot', 'tool') THEN 'assistant' WHEN lower(trim(role)) IN ('developer', 'system', 'instruction') THEN 'system' ELSE nullif(lower(trim(role)), '') END"""
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("joined_sessions", "SELECT DISTINCT 'sess:joined:' || conv_id AS session_id, CASE WHEN conv_id % 3 > 0 THEN 'c' || conv_id END AS title, '/w/p' || conv_id % 5 AS workspace, '2024-01-01T00:00:00.000Z' AS created_at FROM conversations")
def _sessions(spark, sf_dir):
    return joined.joined(stored(spark, sf_dir))[0].select("session_id", "title", "workspace", "created_at")


@query(
    "joined_messages",
    f"""WITH {OWN} SELECT session_id, ordinal, message AS message_id, {ROLE} AS role, strftime(to_timestamp(1704067200 + turn * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS observed_at, CASE WHEN role = 'assistant' THEN 'end_turn' END AS stop_reason,
  CASE WHEN turn % 4 = 1 THEN turn WHEN role = 'assistant' THEN length(text) END AS input_tokens, CASE WHEN turn % 4 = 1 THEN turn + 2 WHEN role = 'assistant' THEN length(text) + turn END AS total_tokens FROM own""",
)
def _messages(spark, sf_dir):
    out = joined.joined(stored(spark, sf_dir))[1]
    return out.select("session_id", "ordinal", "message_id", "role", "observed_at", "stop_reason", "usage.input_tokens", "usage.total_tokens")


@query(
    "joined_fragments",
    f"""WITH {OWN} SELECT session_id, ordinal, 'a' AS file, 0 AS place, 'text' AS kind, text, NULL AS call_id, NULL AS tool_name FROM own WHERE trim(text, {SPACE}) <> ''
UNION ALL SELECT session_id, ordinal, 'b', 0, 'tool_call', '{{"n":' || turn || '}}', 'k' || message, 'run' FROM own WHERE turn % 3 = 0
UNION ALL SELECT session_id, ordinal, 'b', 1, 'tool_result', 'ok', 'k' || message, NULL FROM own WHERE turn % 3 = 0""",
)
def _fragments(spark, sf_dir):
    return joined.joined(stored(spark, sf_dir))[2]


@query(
    "companion_projects",
    """WITH n AS (SELECT n_nationkey AS k, n_name AS name FROM nation), w AS (SELECT k, name, CASE WHEN k % 4 = 0 THEN '/t/' || name WHEN k % 4 = 1 THEN '/h/' || name WHEN k % 4 = 2 THEN '/p/' || name END AS workspace FROM n)
SELECT '/u/.gemini/tmp/' || name || '/chats/' || c_custkey || '.json' AS origin, name AS project, workspace, CASE WHEN k % 4 < 2 AND k % 3 = 0 THEN 'T ' || name ELSE name END AS title FROM customer JOIN w ON k = c_nationkey""",
)
def _companions(spark, sf_dir):
    # A nation is a project: placed by tmp, by history with a blank file in tmp, by its title alone, or by nothing.
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    kind, name = F.col("k") % 4, F.col("name")
    logs = table(spark, sf_dir, "customer").join(nation, F.col("k") == F.col("c_nationkey")).select(F.concat(F.lit("/u/.gemini/tmp/"), name, F.lit("/chats/"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("origin"))
    beside = lambda of: F.concat(F.lit(f"/u/.gemini/{of}/"), name, F.lit("/.project_root")).alias("origin")
    files = nation.where(kind < 2).select(beside("tmp"), F.when(kind == 0, F.concat(F.lit("/t/"), name, F.lit("\n"))).otherwise(" \n").alias("value"))
    files = files.unionByName(nation.where(kind < 2).select(beside("history"), F.concat(F.lit("/h/x/../"), name).alias("value")))
    path = F.when(kind == 2, F.concat(F.lit("/p/"), name)).otherwise(F.concat(F.when(kind == 0, "/t/").otherwise("/h/"), name))
    label = F.when(kind == 2, name).otherwise(F.concat(F.lit("T "), name))
    # The projects file of a home: a row, as wide as there are nations.
    listed = nation.where((kind == 2) | (kind < 2) & (F.col("k") % 3 == 0)).groupBy().agg(F.map_from_entries(F.collect_list(F.struct(path, label))).alias("projects"))
    files = files.unionByName(listed.select(F.lit("/u/.gemini/projects.json").alias("origin"), F.to_json(F.struct("projects")).alias("value")))
    return joined.companions(logs, files)
