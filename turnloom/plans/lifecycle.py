"""Queries on collection, deletion and rebuilds. Orders stand for turns, customers for sessions, nations for projects, suppliers of an order's lines for blobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from turnloom.operators import lifecycle as L
from turnloom.operators import variants
from turnloom.plans.registry import query, table
from turnloom.session import settled

NOW = "2024-06-01"


def history(spark, sf_dir) -> L.History:
    orders, customers, items = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    text = lambda c: F.col(c).cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    state = F.when(F.col("o_orderstatus") == "O", "candidate").otherwise("committed")
    project = (F.col("o_orderkey") % 25).cast("string")
    blobs = items.groupBy(text("l_orderkey").alias("turn_id")).agg(F.collect_set(text("l_suppkey")).alias("blob_refs"))
    turns = orders.select(text("o_orderkey").alias("turn_id"), F.concat(text("o_orderkey"), F.lit(":r1")).alias("revision_id"), F.lit("s").alias("source_id"), text("o_custkey").alias("session_id"), project.alias("project_id"), state.alias("link_state"), day.alias("submitted_at"), day.alias("last_activity_at"), F.lit("active").alias("value_axis"), F.lit("keep_raw_and_derived").alias("retention_axis"), F.array(F.concat(F.lit("c"), text("o_orderkey"))).alias("candidate_refs"))
    turns = turns.join(blobs, "turn_id", "left")
    return L.History(
        turns=turns,
        contexts=turns.select("turn_id"),
        sessions=customers.select(text("c_custkey").alias("session_id"), F.lit("1990-01-01").alias("updated_at"), F.lit(0).cast("long").alias("turn_count")),
        observations=orders.select(F.concat(F.lit("o"), text("o_orderkey")).alias("id"), text("o_custkey").alias("session_id"), (F.col("o_orderkey") % 7).cast("string").alias("project_id")),
        blobs=table(spark, sf_dir, "supplier").select(text("s_suppkey").alias("blob_id"), F.lit("s").alias("source_id")),
        overrides=customers.select(F.concat(F.lit("v"), text("c_custkey")).alias("id"), (F.col("c_custkey") % 25).cast("string").alias("project_id"), text("c_custkey").alias("target_ref")),
        audits=orders.select(F.concat(F.lit("a"), text("o_orderkey")).alias("id"), text("o_custkey").alias("session_id"), F.concat(F.lit("c"), text("o_orderkey")).alias("candidate_id"), F.lit(None).cast("string").alias("blob_id")),
        artifacts=orders.groupBy(text("o_custkey").alias("artifact_id")).agg(F.lit(1).alias("revision"), F.lit("none").alias("project_id"), F.array_sort(F.collect_set(text("o_orderkey"))).alias("turn_refs")),
        tombstones=spark.createDataFrame([], L.TOMBSTONE),
    )


def together(*parts):
    """The rows of all parts. Each is written in a step of its own: in one plan the branches of a union share its tasks, few each, which then sort whole tables."""
    return reduce(lambda a, b: a.unionByName(b), [settled(p, "part") for p in parts])


@query("candidate_archive", "SELECT o_orderkey::VARCHAR AS turn_id, CASE WHEN o_orderstatus = 'O' AND o_orderdate < DATE '1998-01-01' THEN 'archived' ELSE 'active' END AS value_axis, CASE WHEN o_orderstatus = 'O' AND o_orderdate < DATE '1998-01-01' THEN 'keep_raw_only' ELSE 'keep_raw_and_derived' END AS retention_axis FROM orders")
def _archive(spark, sf_dir):
    return L.collect_candidates(history(spark, sf_dir), "1998-01-01", NOW).turns.select("turn_id", "value_axis", "retention_axis")


@query(
    "candidate_purge",
    """WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < DATE '1999-01-01'), left_ AS (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (FROM gone))
SELECT 'turn' AS kind, o_orderkey::VARCHAR AS id FROM left_ UNION ALL SELECT 'tombstone', o_orderkey::VARCHAR FROM gone
UNION ALL SELECT 'blob', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (FROM gone)) OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (FROM left_))""",
)
def _purge(spark, sf_dir):
    # Purged twice: the second time changes nothing.
    once = L.collect_candidates(history(spark, sf_dir), "1999-01-01", NOW, "purge")
    out = L.purge(once, once.tombstones.select(F.col("logical_id").alias("turn_id")), "again", "2025-01-01")
    rows = lambda kind, df, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return together(rows("turn", out.turns, "turn_id"), rows("tombstone", out.tombstones.where(F.col("purged_at") == NOW), "logical_id"), rows("blob", out.blobs, "blob_id"))


@query(
    "project_deletion",
    """WITH gone AS (SELECT * FROM orders WHERE o_orderkey % 25 = 3), rest AS (SELECT * FROM orders WHERE o_orderkey % 25 <> 3),
kept AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM rest GROUP BY 1), dead AS (SELECT DISTINCT o_custkey FROM gone WHERE o_custkey NOT IN (SELECT o_custkey FROM rest)),
seen AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3 OR o_custkey IN (FROM dead))
SELECT 'turn' AS kind, o_orderkey::VARCHAR AS id, NULL::VARCHAR AS detail FROM rest
UNION ALL SELECT 'session', c_custkey::VARCHAR, CASE WHEN c_custkey IN (SELECT o_custkey FROM gone) THEN n || '/' || strftime(last, '%Y-%m-%d') ELSE '0/1990-01-01' END FROM customer LEFT JOIN kept ON o_custkey = c_custkey WHERE c_custkey NOT IN (FROM dead)
UNION ALL SELECT 'observation', 'o' || o_orderkey, NULL FROM orders WHERE o_orderkey NOT IN (FROM seen)
UNION ALL SELECT 'override', 'v' || c_custkey, NULL FROM customer WHERE c_custkey % 25 <> 3 AND c_custkey NOT IN (FROM dead) AND c_custkey NOT IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'audit', 'a' || o_orderkey, NULL FROM orders WHERE o_custkey NOT IN (FROM dead) AND o_orderkey % 25 <> 3
UNION ALL SELECT 'artifact', o_custkey::VARCHAR, (1 + max((o_orderkey % 25 = 3)::INT)) || '/' || count(*) FILTER (o_orderkey % 25 <> 3) FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 25 <> 3) > 0
UNION ALL SELECT 'tombstone', k || ':' || id, NULL FROM (SELECT 'project' AS k, '3' AS id UNION ALL SELECT 'turn', o_orderkey::VARCHAR FROM gone UNION ALL SELECT 'artifact', o_custkey::VARCHAR FROM dead)""",
)
def _delete(spark, sf_dir):
    out = L.delete_project(history(spark, sf_dir), "3", "asked", NOW)
    none = F.lit(None).cast("string")

    def rows(kind, df, key, detail=none):
        return df.select(F.lit(kind).alias("kind"), (F.col(key) if isinstance(key, str) else key).alias("id"), detail.alias("detail"))

    return together(
        rows("turn", out.turns, "turn_id"),
        rows("session", out.sessions, "session_id", F.concat_ws("/", F.col("turn_count").cast("string"), "updated_at")),
        rows("observation", out.observations, "id"),
        rows("override", out.overrides, "id"),
        rows("audit", out.audits, "id"),
        rows("artifact", out.artifacts, "artifact_id", F.concat_ws("/", F.col("revision").cast("string"), F.size("turn_refs").cast("string"))),
        rows("tombstone", out.tombstones, F.concat_ws(":", "object_kind", "logical_id")),
    )


def scope(spark, sf_dir):
    """Orders are ledger rows of their clerk's blob, lines spans, customers turns of a session, and caches hang on sessions."""
    text = lambda c: c.cast("string")
    key, cust, none = F.col("o_orderkey"), F.col("o_custkey"), F.lit(None).cast("string")
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    source = F.concat(F.lit("s"), text(key % 3))
    ledger = orders.select(source.alias("source_id"), text(key).alias("origin_path"), text(F.floor(key / 8)).alias("blob_id"), none.alias("profile"))
    spans = items.where("l_linenumber = 1").select(text(F.col("l_orderkey")).alias("record_id"), F.concat(F.lit("s"), text(F.col("l_orderkey") % 3)).alias("source_id"), text(F.floor(F.col("l_orderkey") / 8)).alias("blob_id"), F.concat(F.lit("n"), text(F.floor(F.col("l_orderkey") / 64)), F.lit("-"), text(F.col("l_orderkey") % 5)).alias("session_id"), none.alias("profile"))
    turns = orders.select(text(key).alias("turn_id"), source.alias("source_id"), F.concat(F.lit("n"), text(F.floor(key / 64)), F.lit("-"), text(cust % 5)).alias("session_id"), none.alias("project_id"))
    caches = orders.where("o_orderkey % 9 = 0").select(text(key).alias("id"), F.when(key % 2 == 0, "session").otherwise("origin_path").alias("scope_kind"), F.when(key % 2 == 0, F.concat(F.lit("n"), text(F.floor(key / 64)), F.lit("-0"))).otherwise(text(key)).alias("scope_ref"), source.alias("source_id"), none.alias("profile"))
    return L.scope_rows(ledger, spans, turns, turns.select("turn_id", "source_id"), caches)


@query(
    "rebuild_scope",
    """WITH RECURSIVE links AS (
  SELECT 'ledger' AS kind, 's' || o_orderkey % 3 || '|' || o_orderkey AS id, 'b' || o_orderkey % 3 || '/' || o_orderkey // 8 AS takes, 'b' || o_orderkey % 3 || '/' || o_orderkey // 8 AS gives1, 'o' || o_orderkey AS gives2, 'a' || o_orderkey AS asked FROM orders
  UNION ALL SELECT 'span', l_orderkey::VARCHAR, 'b' || l_orderkey % 3 || '/' || l_orderkey // 8, 'b' || l_orderkey % 3 || '/' || l_orderkey // 8, 'n' || l_orderkey // 64 || '-' || l_orderkey % 5, NULL FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT 'span', l_orderkey::VARCHAR, 'n' || l_orderkey // 64 || '-' || l_orderkey % 5, 'b' || l_orderkey % 3 || '/' || l_orderkey // 8, 'n' || l_orderkey // 64 || '-' || l_orderkey % 5, NULL FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT 'turn', o_orderkey::VARCHAR, 'n' || o_orderkey // 64 || '-' || o_custkey % 5, 'n' || o_orderkey // 64 || '-' || o_custkey % 5, 't' || o_orderkey, NULL FROM orders
  UNION ALL SELECT 'context', o_orderkey::VARCHAR, 't' || o_orderkey, NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'cache', o_orderkey::VARCHAR, CASE WHEN o_orderkey % 2 = 0 THEN 'n' || o_orderkey // 64 || '-0' ELSE 'o' || o_orderkey END, CASE WHEN o_orderkey % 2 = 0 THEN 'n' || o_orderkey // 64 || '-0' ELSE 'o' || o_orderkey END, NULL, NULL FROM orders WHERE o_orderkey % 9 = 0
), keys AS (
  SELECT unnest([gives1, gives2]) AS key FROM links WHERE asked IN ('a0', 'a1', 'a4', 'a7', 'a100', 'a102') UNION SELECT k FROM (VALUES ('o0'), ('o1'), ('o4'), ('o7'), ('o100'), ('o102')) v(k)
  UNION SELECT unnest([l.gives1, l.gives2]) FROM keys JOIN links l ON l.takes = keys.key
)
SELECT DISTINCT kind, id FROM links WHERE takes IN (FROM keys) OR asked IN ('a0', 'a1', 'a4', 'a7', 'a100', 'a102')""",
)
def _scope(spark, sf_dir):
    return L.rebuild_scope(scope(spark, sf_dir), L.seeds(spark, origin=["0", "1", "4", "7", "100", "102"]), None)


@query("collapsed_prompts")
def _collapsed(spark, sf_dir):
    # Users' messages in two tellings a minute apart, the second in capitals, unless the conversation's number says otherwise.
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    told = own.select("session", "role", "turn", F.posexplode(F.when(F.col("role") == "user", F.array(F.col("text"), F.when(F.col("session") % 3 > 0, F.upper("text")).otherwise(F.concat(F.lit("other words: "), F.reverse("text"))))).otherwise(F.array("text"))).alias("again", "text"))
    moment = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 3600 + F.col("again") * F.when(F.col("session") % 5 > 0, 60).otherwise(1200)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    atoms = told.select("session", (F.col("turn") * 2 + F.col("again")).alias("seq_no"), F.col("role").alias("actor_kind"), (F.col("role") == "user").alias("is_turn"), F.lit("text").alias("kind"), F.lit("show").alias("display_policy"), "text", moment.alias("time_key"))
    return variants.collapse(atoms).select("session", "seq_no", F.sha2("text", 256).alias("text_sha256"))
