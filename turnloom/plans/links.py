"""Queries on linking. Orders stand for observations and for turns, customers for sessions; paths, remotes and fingerprints come from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.operators import linking
from turnloom.plans.registry import query, table


def linked(spark, sf_dir) -> linking.Linked:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda prefix, n: F.concat(F.lit(prefix), F.floor(n).cast("string"))
    orders = table(spark, sf_dir, "orders")
    observations = orders.select(
        key.alias("id"),
        cust.alias("session_ref"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("observed_at"),
        F.col("o_orderpriority").alias("source_platform"),
        F.when(key % 11 > 0, name("h", cust % 2)).alias("host_id"),
        F.when(key % 13 > 0, F.when(key % 17 == 0, name("/tmp/w", key / 300)).otherwise(name("/w/p", key / 90))).alias("workspace_path"),
        F.lit(None).cast("string").alias("repo_root"),
        F.when(key % 3 == 0, name("m", key / 150)).alias("repo_remote"),
        F.when(key % 5 == 0, name("f", key / 60)).alias("repo_fingerprint"),
        F.when(key % 7 == 0, name("n", key / 400)).alias("source_native_project_ref"),
    )
    turns = orders.select(key.alias("id"), cust.alias("session_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_context_activity_at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("submission_started_at"))
    when = F.lit("1999-01-01")
    overrides = table(spark, sf_dir, "customer").where("c_custkey % 50 = 3").select(F.lit("session").alias("target_kind"), F.col("c_custkey").cast("string").alias("target_ref"), name("hand", F.col("c_nationkey")).alias("project_id"), name("Nation ", F.col("c_nationkey")).alias("display_name"), when.alias("created_at"), when.alias("updated_at"))
    return linking.Linked(observations, turns, overrides)


RULES = """o AS (
  SELECT o_orderkey AS id, o_custkey AS s, strftime(o_orderdate, '%Y-%m-%d') AS t, o_orderpriority AS plat, CASE WHEN o_orderkey % 11 > 0 THEN 'h' || o_custkey % 2 END AS host,
    CASE WHEN o_orderkey % 13 > 0 THEN CASE WHEN o_orderkey % 17 = 0 THEN '/tmp/w' || o_orderkey // 300 ELSE '/w/p' || o_orderkey // 90 END END AS path,
    CASE WHEN o_orderkey % 3 = 0 THEN 'm' || o_orderkey // 150 END AS remote, CASE WHEN o_orderkey % 5 = 0 THEN 'f' || o_orderkey // 60 END AS print, CASE WHEN o_orderkey % 7 = 0 THEN 'n' || o_orderkey // 400 END AS native FROM orders
), sure AS (
  SELECT id, 'fingerprint:' || print || '|workspace:' || path AS key, 1 AS p, 0.95 AS w FROM o WHERE print IS NOT NULL AND path IS NOT NULL
  UNION ALL SELECT id, 'host:' || host || '|remote:' || remote || '|workspace:' || path, 2, 0.85 FROM o WHERE remote IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL
), maybe AS (
  SELECT id, 'host:' || host || '|native:' || native AS key, 4 AS p, 0.7 AS w FROM o WHERE native IS NOT NULL AND host IS NOT NULL
  UNION ALL SELECT id, 'host:' || host || '|workspace:' || path, CASE WHEN path LIKE '/tmp/%' THEN 6 ELSE 5 END, CASE WHEN path LIKE '/tmp/%' THEN 0.42 ELSE 0.55 END FROM o WHERE path IS NOT NULL AND host IS NOT NULL
  UNION ALL SELECT id, 'host:' || host || '|remote_hint:' || remote, 7, 0.6 FROM o WHERE remote IS NOT NULL AND host IS NOT NULL
), r AS (SELECT * FROM sure UNION ALL SELECT * FROM maybe WHERE id NOT IN (SELECT id FROM sure)
), e AS (SELECT DISTINCT a.key AS x, b.key AS y FROM r a JOIN r b USING (id)
), reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x
), comp AS (SELECT x AS key, min(y) AS c FROM reach GROUP BY 1
), k AS (SELECT c, key, count(DISTINCT id) > 1 AS shared, min(p) AS p, arg_min(w, p) AS w FROM r JOIN comp USING (key) GROUP BY 1, 2
), pick AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY c ORDER BY shared DESC, p, w DESC, key) = 1
), mem AS (SELECT DISTINCT c, id FROM r JOIN comp USING (key)
), size AS (SELECT c, count(DISTINCT s) AS n, count(DISTINCT plat) AS plats FROM mem JOIN o USING (id) GROUP BY 1
), proj AS (
  SELECT c, 'project-' || left(sha1(key), 12) AS project_id, CASE WHEN p < 4 OR p = 5 AND n > 1 THEN 'committed' ELSE 'candidate' END AS state,
    CASE p WHEN 1 THEN 'repo_fingerprint_match' WHEN 2 THEN 'repo_remote_match' WHEN 4 THEN 'source_native_project' WHEN 5 THEN 'workspace_path_continuity' WHEN 6 THEN 'weak_path_hint' ELSE 'metadata_hint' END AS reason,
    round((CASE p WHEN 4 THEN least(0.87, 0.72 + (n > 1)::INT * 0.08 + (n > 2)::INT * 0.04 + (plats > 1)::INT * 0.03) WHEN 5 THEN least(0.88, 0.68 + (n > 1)::INT * 0.12 + (n > 2)::INT * 0.05 + (plats > 1)::INT * 0.03)
      WHEN 6 THEN least(0.6, 0.42 + (n > 1)::INT * 0.08 + (n > 2)::INT * 0.04 + (plats > 1)::INT * 0.03) WHEN 7 THEN least(0.78, 0.6 + (n > 1)::INT * 0.08 + (plats > 1)::INT * 0.04) ELSE w END)::DOUBLE, 2) AS confidence
  FROM pick JOIN size USING (c)
), hand AS (SELECT c_custkey AS s, 'hand' || c_nationkey AS by_hand FROM customer WHERE c_custkey % 50 = 3
), obs AS (SELECT o.*, coalesce(by_hand, project_id) AS pid, by_hand IS NOT NULL AS manual FROM o LEFT JOIN mem USING (id) LEFT JOIN proj USING (c) LEFT JOIN hand USING (s)
), j AS (SELECT o.id, o.s, o.t, max(struct_pack(t := b.t, id := b.id, pid := b.pid)) FILTER (b.t <= o.t) AS past, min(struct_pack(t := b.t, id := b.id, pid := b.pid)) AS first FROM o LEFT JOIN obs b ON b.s = o.s AND b.pid IS NOT NULL GROUP BY 1, 2, 3
), turn AS (
  SELECT j.id, j.s, j.t, coalesce(by_hand, past.pid, first.pid) AS project_id, CASE WHEN by_hand IS NOT NULL THEN 'committed' ELSE coalesce(state, 'unlinked') END AS link_state, CASE WHEN by_hand IS NOT NULL THEN 1.0 ELSE confidence END AS project_confidence
  FROM j LEFT JOIN hand USING (s) LEFT JOIN proj ON proj.project_id = coalesce(past.pid, first.pid)
)"""


@query("linked_turns", f"WITH RECURSIVE {RULES} SELECT id, project_id, link_state, project_confidence FROM turn")
def _turns(spark, sf_dir):
    return linked(spark, sf_dir).turns.select("id", "project_id", "link_state", "project_confidence")


@query(
    "linked_projects",
    f"""WITH RECURSIVE {RULES}, n AS (SELECT project_id, count(*) FILTER (link_state = 'committed') AS committed_turns, count(*) FILTER (link_state = 'candidate') AS candidate_turns, count(DISTINCT s) AS sessions, max(t) AS last FROM turn WHERE project_id IS NOT NULL GROUP BY 1
), v AS (SELECT c, path AS value, count(*) AS n, min(struct_pack(t := t, id := id)) AS seen FROM mem JOIN o USING (id) WHERE path IS NOT NULL GROUP BY 1, 2
), m AS (SELECT c, arg_min(value, struct_pack(n := -n, seen := seen)) AS path FROM v GROUP BY 1
), u AS (SELECT c, max(t) AS updated FROM mem JOIN o USING (id) GROUP BY 1
), everything AS (
  SELECT project_id, state, reason, confidence, m.path, u.updated FROM proj LEFT JOIN m USING (c) JOIN u USING (c)
  UNION ALL SELECT DISTINCT by_hand, 'committed', 'manual_override', 1.0, NULL, '1999-01-01' FROM hand)
SELECT project_id, state, reason, confidence, path AS primary_workspace_path, coalesce(committed_turns, 0) AS committed_turns, coalesce(candidate_turns, 0) AS candidate_turns, coalesce(sessions, 0) AS sessions, greatest(updated, last) AS last_activity_at
FROM everything LEFT JOIN n USING (project_id)""",
)
def _projects(spark, sf_dir):
    return linked(spark, sf_dir).projects.select("project_id", "state", "reason", "confidence", "primary_workspace_path", "committed_turns", "candidate_turns", "sessions", "last_activity_at")


@query("session_projects", f"WITH RECURSIVE {RULES} SELECT s AS session_id, project_id AS primary_project_id FROM turn WHERE project_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s ORDER BY link_state = 'committed' DESC, t DESC, id) = 1")
def _sessions(spark, sf_dir):
    return linked(spark, sf_dir).session_projects()
