"""The registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom import session
from turnloom.functions import text as T
from turnloom.functions.user_text import split_user_text
from turnloom.operators import derive, linking, relate, reports, search, usage
from turnloom.plans.registry import query, table
from turnloom.sources import generic

#: Clocks are parameters: the moment that recency is measured from.
AS_OF = "2024-06-01 00:00:00"

def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.atomize(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


ATOMS_SQL = """
atoms AS (
  SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq_no,
    CASE WHEN role IN ('user','assistant') THEN role ELSE 'system' END AS actor_kind,
    CASE role WHEN 'user' THEN 'user_authored' WHEN 'assistant' THEN 'assistant_authored' ELSE 'source_meta' END AS origin_kind,
    CASE WHEN role IN ('user','assistant') THEN 'show' ELSE 'hidden' END AS display_policy, text
  FROM conversations
), said AS (
  SELECT *, sum(CASE WHEN actor_kind = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq_no) AS c FROM atoms
), users AS (
  SELECT *, lag(c) OVER (PARTITION BY session ORDER BY seq_no) AS p FROM said WHERE actor_kind = 'user'
), grouped AS (
  SELECT session, seq_no, text, sum(CASE WHEN p IS NULL OR c > p THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq_no)::BIGINT - 1 AS group_index FROM users
)"""


@query("atomize", f"WITH {ATOMS_SQL} SELECT * FROM atoms")
def _atomize(spark, sf_dir):
    return atoms(spark, sf_dir)


@query("submission_groups", f"WITH {ATOMS_SQL} SELECT session, seq_no, group_index FROM grouped")
def _groups(spark, sf_dir):
    return derive.submission_groups(atoms(spark, sf_dir)).select("session", "seq_no", "group_index")


@query(
    "turn_projection",
    f"""WITH {ATOMS_SQL}, t AS (
  SELECT session, group_index, string_agg(text, chr(10) || chr(10) ORDER BY seq_no) AS raw_text, min(seq_no) AS first_seq, count(*) AS n_messages
  FROM grouped GROUP BY 1, 2)
SELECT *, lead(first_seq) OVER (PARTITION BY session ORDER BY group_index) AS next_seq FROM t""",
)
def _turns(spark, sf_dir):
    return derive.turns(atoms(spark, sf_dir))


@query(
    "turn_context_counts",
    f"""WITH {ATOMS_SQL}, s AS (SELECT session, group_index, min(seq_no) AS a FROM grouped GROUP BY 1, 2),
r AS (SELECT *, lead(a) OVER (PARTITION BY session ORDER BY group_index) AS b FROM s)
SELECT r.session, r.group_index, count(*) FILTER (x.actor_kind = 'assistant') AS assistant_replies,
  count(*) FILTER (x.actor_kind = 'system') AS system_messages, 0 AS tool_atoms,
  coalesce(sum(length(x.text)) FILTER (x.actor_kind = 'assistant'), 0)::BIGINT AS reply_chars
FROM r JOIN atoms x ON x.session = r.session AND x.seq_no >= r.a AND (r.b IS NULL OR x.seq_no < r.b) GROUP BY 1, 2""",
)
def _context(spark, sf_dir):
    return derive.context(atoms(spark, sf_dir))


@query(
    "session_rollup",
    f"""WITH {ATOMS_SQL}
SELECT session, count(*) AS n_atoms, count(*) FILTER (actor_kind = 'user') AS n_authored,
  left(trim(regexp_replace(regexp_replace(arg_min(text, seq_no) FILTER (actor_kind = 'user'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 72) AS title,
  arg_max(actor_kind, seq_no) AS last_actor
FROM atoms GROUP BY 1""",
)
def _sessions(spark, sf_dir):
    return derive.sessions(atoms(spark, sf_dir))


@query(
    "spawned_from_edges",
    f"""WITH {ATOMS_SQL}, e AS (SELECT session, seq_no, actor_kind,
  last_value(CASE WHEN actor_kind = 'assistant' THEN seq_no END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spawned_from FROM atoms)
SELECT session * 1000000 + seq_no AS call_id, session * 1000000 + spawned_from AS spawned_from FROM e WHERE actor_kind = 'user' AND spawned_from IS NOT NULL""",
)
def _spawned(spark, sf_dir):
    # The driver's conversations hold no tool calls: follow-up questions stand for them.
    own = atoms(spark, sf_dir).withColumn("id", F.col("session") * 1_000_000 + F.col("seq_no"))
    return derive.spawned_from(own, "session", ["seq_no"], F.col("actor_kind") == "user", F.col("actor_kind") == "assistant", "id")


@query(
    "asof_last_view",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events""",
)
def _last_view(spark, sf_dir):
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    return relate.last_before(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], view, "last_view").select("event_id", "user_id", "last_view")


@query("carry_forward", """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active FROM events""")
def _carry(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return relate.carry_forward(own, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "active").select("event_id", "active")


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as turns, customers as sessions, nations as projects."""
    turns = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("turn_id"), F.col("o_custkey").alias("session_id"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("model"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("link_state"))
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("project_id"), F.col("c_mktsegment").alias("host"))
    projects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("project"), F.col("n_regionkey").cast("string").alias("source"))
    return usage.usage_rows(turns, sessions, projects).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


USAGE_SQL = """
u AS (SELECT o_orderkey AS turn_id, o_totalprice AS total, coalesce(o_orderpriority, 'unknown') AS model, o_orderstatus AS link_state, c_nationkey AS project_id,
  coalesce(c_mktsegment, 'unknown') AS host, coalesce(n_name, 'unknown') AS project, coalesce(n_regionkey::VARCHAR, 'unknown') AS source, strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey AS session_id
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""


@query("usage_rows_join", f"WITH {USAGE_SQL} SELECT turn_id, session_id, project_id, total, model, host, project, source, day FROM u")
def _usage_rows(spark, sf_dir):
    return usage_rows(spark, sf_dir).select("turn_id", "session_id", "project_id", "total", "model", "host", "project", "source", "day")


#: Orders below this stand for turns without usage.
ZERO = 1000.0


@query(
    "usage_overview",
    f"""WITH {USAGE_SQL} SELECT count(*) FILTER (total >= {ZERO}) AS turns, count(*) FILTER (total >= {ZERO} AND total > 0) AS covered,
  round(CASE WHEN count(*) FILTER (total >= {ZERO}) = 0 THEN 0 ELSE count(*) FILTER (total >= {ZERO} AND total > 0) / count(*) FILTER (total >= {ZERO}) END, 4) AS coverage,
  count(*) FILTER (total >= {ZERO} AND model <> 'unknown') AS with_model, coalesce(round(sum(total) FILTER (total >= {ZERO}), 2), 0) AS total, count(*) FILTER (total < {ZERO}) AS excluded FROM u""",
)
def _overview(spark, sf_dir):
    return usage.overview(usage_rows(spark, sf_dir), "total", "model", F.col("total") < ZERO)


def _rollup(name: str, spark_key, sql_key: str, by_time: bool = False) -> None:
    sql = f"WITH {USAGE_SQL} SELECT {sql_key} AS key, count(*) AS turns, round(sum(total), 2) AS total, count(*) FILTER (total > 0) AS covered FROM u GROUP BY 1"
    query(name, sql)(lambda spark, sf_dir: usage.rollup(usage_rows(spark, sf_dir), spark_key(), "total", by_time))


_rollup("rollup_model", lambda: F.col("model"), "model")
_rollup("rollup_project", lambda: F.col("project"), "project")
_rollup("rollup_source", lambda: F.col("source"), "source")
_rollup("rollup_host", lambda: F.col("host"), "host")
_rollup("rollup_day", lambda: F.col("day"), "day", True)
_rollup("rollup_month", lambda: F.left("day", F.lit(7)), "left(day, 7)", True)


@query("usage_filtered", f"WITH {USAGE_SQL} SELECT turn_id, project_id, day, total FROM u WHERE project_id IN (1, 3, 5) AND day >= '1997-01-01'")
def _filtered(spark, sf_dir):
    return usage.filtered(usage_rows(spark, sf_dir), projects=[1, 3, 5], after_day="1997-01-01").select("turn_id", "project_id", "day", "total")


@query("turn_summary", "SELECT coalesce(o_orderstatus, 'all') AS link_state, count(*) AS turns FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())")
def _summary(spark, sf_dir):
    return reports.summary(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "link_state"), "link_state")


WORDS = "the of"
ALL_TERMS = "contains(lower(text), 'the') AND contains(lower(text), 'of')"


@query("search_all_terms", f"SELECT doc_id FROM documents WHERE {ALL_TERMS}")
def _search_all(spark, sf_dir):
    return search.matches(table(spark, sf_dir, "documents"), WORDS, ["text"]).select("doc_id")


@query("search_or_field", "SELECT doc_id FROM documents WHERE contains(lower(text), 'src1') OR contains(lower(source), 'src1')")
def _search_or(spark, sf_dir):
    return search.matches(table(spark, sf_dir, "documents"), "src1", ["text", "source"]).select("doc_id")


@query("search_paged", f"SELECT doc_id, n_chars FROM documents WHERE {ALL_TERMS} ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 50")
def _search_paged(spark, sf_dir):
    own = search.matches(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text"), WORDS, ["text"]).select("doc_id", "n_chars")
    return search.page(own, [F.desc("n_chars"), "doc_id"], 50, 50)


@query(
    "search_relevance",
    """SELECT doc_id, (length(text) - length(replace(lower(text), 'tion', ''))) // 4 AS hits,
  round(5 * greatest(0, 1 - ln(1 + (doc_id % 400) / 90.0) / ln(101)), 4) AS recency FROM documents WHERE contains(lower(text), 'tion')""",
)
def _relevance(spark, sf_dir):
    # Each document's age in days is taken from its id; touching hits merge, so hits are counted before the merge.
    own = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = search.ranked(own, "tion", "text", (F.col("doc_id") % 400).cast("double"))
    hits = F.aggregate("highlights", F.lit(0), lambda n, s: n + s["stop"] - s["start"]) / 4
    return out.select("doc_id", hits.cast("long").alias("hits"), F.round(F.col("score") - 10 * F.size("highlights"), 4).alias("recency"))


@query("search_groups", f"SELECT source AS key, count(*) AS hits, max(n_chars) AS last FROM documents WHERE {ALL_TERMS} GROUP BY 1")
def _search_groups(spark, sf_dir):
    return search.groups(search.matches(table(spark, sf_dir, "documents"), WORDS, ["text"]), "source", "n_chars")


@query("snippet_clusters", "SELECT CASE WHEN length(text) <= 40 THEN text ELSE left(text, 39) || '...' END AS snippet, count(*) AS hits, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1 HAVING count(*) >= 3")
def _snippets(spark, sf_dir):
    return search.snippet_clusters(table(spark, sf_dir, "documents"), "text", "doc_id", 40)


@query(
    "asof_join",
    """WITH o AS (SELECT o_orderkey, o_custkey AS user_id, o_orderdate + INTERVAL 26 YEAR AS moment FROM orders), e AS (SELECT user_id, ts, event_id FROM events),
j AS (SELECT o.o_orderkey, o.user_id, o.moment, max(struct_pack(a := ts, b := event_id)) FILTER (ts <= moment) AS past, min(struct_pack(a := ts, b := event_id)) FILTER (ts IS NOT NULL) AS first
  FROM o LEFT JOIN e USING (user_id) GROUP BY 1, 2, 3)
SELECT o_orderkey, user_id, coalesce(past.b, first.b) AS event_id, past IS NOT NULL AS exact FROM j""",
)
def _asof(spark, sf_dir):
    # All orders precede the events, so their dates are moved by 26 years.
    left = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 26 YEAR")).alias("at"))
    return relate.as_of(left, table(spark, sf_dir, "events"), "user_id", "at", "ts", "event_id").select("o_orderkey", "user_id", "event_id", "exact")


@query(
    "prefix_theta_join",
    """WITH p AS (SELECT page_id, split_part(url, '?', 1) AS path FROM pages), d AS (SELECT DISTINCT regexp_extract(path, '^([a-z]+://[^/]+/[^/]+)/', 1) AS prefix FROM p WHERE regexp_matches(path, '^[a-z]+://[^/]+/[^/]+/'))
SELECT page_id, max(prefix) AS prefix FROM p LEFT JOIN d ON path = prefix OR starts_with(path, prefix || '/') GROUP BY 1""",
)
def _prefix(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("?"), F.lit(1)).alias("path"))
    roots = pages.select(F.regexp_extract("path", "^([a-z]+://[^/]+/[^/]+)/", 1).alias("prefix")).where("prefix != ''")
    return relate.longest_prefix(pages, "path", roots, "prefix").select("page_id", "prefix")


RULES_SQL = "(VALUES ('turn', 10, 100), ('turn', 20, 200), ('session', 5, 300), ('session', 7, 400)) AS r(kind, ref, project_id)"


@query(
    "override_precedence",
    f"""WITH r AS (SELECT * FROM {RULES_SQL}) SELECT o_orderkey, o_custkey, coalesce(a.project_id, b.project_id) AS project_id FROM orders
LEFT JOIN r a ON a.kind = 'turn' AND a.ref = o_orderkey LEFT JOIN r b ON b.kind = 'session' AND b.ref = o_custkey""",
)
def _override(spark, sf_dir):
    rules = spark.createDataFrame([("turn", 10, 100), ("turn", 20, 200), ("session", 5, 300), ("session", 7, 400)], "kind string, ref long, project_id int")
    return relate.override(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), rules, [("turn", "o_orderkey"), ("session", "o_custkey")], "project_id")


@query(
    "alias_resolution",
    """WITH a AS (SELECT c_custkey, c_mktsegment AS alias, c_nationkey AS src, n_regionkey AS plat FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'BUILDING' ELSE 'ALIAS' || s_suppkey % 40 END AS alias, s_nationkey AS src, n_regionkey AS plat FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT alias, src, min(id) AS i FROM k GROUP BY 1, 2 HAVING count(DISTINCT id) = 1), y AS (SELECT alias, plat, min(id) AS i FROM k GROUP BY 1, 2 HAVING count(DISTINCT id) = 1), z AS (SELECT alias, min(id) AS i FROM k GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT c_custkey, coalesce(x.i, y.i, z.i) AS resolved FROM a LEFT JOIN x USING (alias, src) LEFT JOIN y ON y.alias = a.alias AND y.plat = a.plat LEFT JOIN z ON z.alias = a.alias""",
)
def _alias(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("plat"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("alias"), F.col("c_nationkey").alias("src")).join(nation, "src")
    name = F.when(F.col("s_suppkey") % 7 == 0, "BUILDING").otherwise(F.concat(F.lit("ALIAS"), (F.col("s_suppkey") % 40).cast("string")))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("alias"), F.col("s_nationkey").alias("src")).join(nation, "src")
    return relate.unique_alias(asked, known, "alias", "id", [["src"], ["plat"], []]).select("c_custkey", "resolved")


@query("fallback_antijoin", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _fallback(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return relate.only_with(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"))


@query("orphan_antijoin", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 20) AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem)")
def _orphans(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return relate.orphans(table(spark, sf_dir, "part").select("p_partkey"), [(items.where("l_returnflag = 'R' AND l_quantity < 20"), "l_partkey"), (items, "l_suppkey")], "p_partkey")


@query("project_rollup", f"WITH {USAGE_SQL} SELECT project, count(*) FILTER (link_state = 'F') AS committed, count(*) FILTER (link_state = 'P') AS candidate, count(DISTINCT session_id) AS sessions, max(day) AS last FROM u GROUP BY 1")
def _projects(spark, sf_dir):
    return reports.project_counters(usage_rows(spark, sf_dir), "project", "link_state", "session_id", "day", "F", "P")


@query(
    "component_metrics",
    """WITH RECURSIVE e AS (SELECT DISTINCT a.l_orderkey AS x, b.l_orderkey AS y FROM lineitem a JOIN lineitem b USING (l_partkey, l_quantity, l_discount, l_returnflag)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x AS l_orderkey, min(y) AS component FROM r GROUP BY 1)
SELECT component, count(DISTINCT l_orderkey) AS sessions, count(DISTINCT l_linestatus) AS platforms, max((l_returnflag = 'R')::INT) AS has_root FROM lineitem JOIN c USING (l_orderkey) GROUP BY 1""",
)
def _components(spark, sf_dir):
    # Orders with a line of the same part, quantity, discount and flag share a component.
    session.need_checkpoints(spark)
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.struct("l_partkey", "l_quantity", "l_discount", "l_returnflag").alias("key"), "l_orderkey", "l_linestatus", "l_returnflag")
    found = linking.components(own, "node", "key")
    return linking.metrics(own.join(found, "node"), "component", "l_orderkey", "l_linestatus", F.col("l_returnflag") == "R")


@query(
    "mode_first_seen",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(struct_pack(a := ts, b := event_id)) AS seen FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1""",
)
def _mode(spark, sf_dir):
    return relate.mode_first_seen(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("rule_priority_pick", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderpriority, o_totalprice DESC, o_orderkey) = 1")
def _rules(spark, sf_dir):
    own = table(spark, sf_dir, "orders").withColumn("shared", F.col("o_orderstatus") == "F")
    return linking.pick_rule(own, "o_custkey", "shared", "o_orderpriority", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority")


@query(
    "loop_spans",
    """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a),
s AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id, run) AS size FROM r)
SELECT event_id, place, size, CASE WHEN place = 1 THEN 'leading' WHEN place = size THEN 'trailing' ELSE 'middle_collapsed' END AS part FROM s WHERE size >= 3""",
)
def _loops(spark, sf_dir):
    return relate.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", 3).where("part IS NOT NULL").select("event_id", "place", "size", "part")


@query("cumulative_delta", "SELECT event_id, round(greatest(0, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)), 4) AS delta FROM events")
def _delta(spark, sf_dir):
    return usage.cumulative_delta(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("delta", 4).alias("delta"))


@query("baseline_delta", "SELECT event_id, round(greatest(0, value - coalesce(max(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 4) AS delta FROM events")
def _baseline(spark, sf_dir):
    return usage.baseline_delta(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value").select("event_id", F.round("delta", 4).alias("delta"))


@query("latest_per_group", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _latest(spark, sf_dir):
    return reports.last_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id", "value")


@query(
    "dedupe_keep_max",
    """SELECT user_id, event_type, event_id, value, min(event_id) OVER (PARTITION BY user_id, event_type) AS place FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1""",
)
def _keep_max(spark, sf_dir):
    return reports.keep_max(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id", "place")


@query("tail_blob", "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def _tail(spark, sf_dir):
    return reports.keep_max(table(spark, sf_dir, "documents"), ["source"], "n_chars", "doc_id")


@query("token_sum", "SELECT user_id, round(sum(coalesce(value, 0)), 2) AS total, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS model FROM events GROUP BY 1")
def _token_sum(spark, sf_dir):
    return usage.token_sum(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", "event_type")


@query(
    "drift_report",
    """WITH t AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS c FROM orders), s AS (SELECT count(*) AS m, count(*) FILTER (s_acctbal > 0) AS h FROM supplier)
SELECT n AS turns, round(c / n, 4) AS linked, m AS sources, round(h / m, 4) AS healthy, round(greatest(0, least(1, 1 - (c / n + h / m) / 2)), 4) AS drift FROM t, s""",
)
def _drift(spark, sf_dir):
    return reports.drift(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", table(spark, sf_dir, "supplier"), F.col("s_acctbal") > 0)


@query(
    "drift_timeline",
    """WITH last AS (SELECT date_trunc('day', max(ts)) AS d FROM events), days AS (SELECT d - INTERVAL (6 - i) DAY AS day FROM last, range(7) r(i)),
n AS (SELECT date_trunc('day', ts) AS day, count(*) AS k FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(k, 0) AS added, sum(coalesce(k, 0)) OVER (ORDER BY day)::BIGINT AS total FROM days LEFT JOIN n USING (day)""",
)
def _timeline(spark, sf_dir):
    return reports.timeline(table(spark, sf_dir, "events"), "ts", 7)


@query("stage_stats", "SELECT event_type AS stage, count(*) AS input, count(*) FILTER (value < 5) AS failures FROM events GROUP BY 1 UNION ALL SELECT 'index', 0, 0")
def _stages(spark, sf_dir):
    return reports.stage_stats(table(spark, sf_dir, "events"), "event_type", F.col("value") < 5, ["view", "index"])


@query("source_counts", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS records, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS sessions FROM supplier")
def _sources(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return reports.recount(table(spark, sf_dir, "supplier"), "s_suppkey", {"records": (items, "l_suppkey", None), "sessions": (items, "l_suppkey", "l_orderkey")})


@query("overview_counts", "SELECT 'sources' AS what, count(*) AS n FROM supplier UNION ALL SELECT 'sessions', count(*) FROM customer UNION ALL SELECT 'turns', count(*) FROM orders UNION ALL SELECT 'records', count(*) FROM lineitem")
def _overview_counts(spark, sf_dir):
    return reports.counts({what: table(spark, sf_dir, t) for what, t in (("sources", "supplier"), ("sessions", "customer"), ("turns", "orders"), ("records", "lineitem"))})


@query("inventory_bytes", "SELECT source, count(*) AS rows, sum(strlen(text))::BIGINT AS bytes, max(strlen(text)) AS largest FROM documents GROUP BY 1")
def _inventory(spark, sf_dir):
    return reports.inventory(table(spark, sf_dir, "documents"), "source", "text")


@query(
    "top_labels",
    """WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS k, count(*) OVER (PARTITION BY p_type) AS all_labels FROM c)
SELECT p_type, p_brand, n, k, greatest(0, all_labels - 3) AS more FROM r WHERE k <= 3""",
)
def _labels(spark, sf_dir):
    return reports.top_labels(table(spark, sf_dir, "part"), "p_type", "p_brand", 3)


@query("related_work_rollup", "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type NOT IN ('view', 'click')) AS others FROM events GROUP BY 1")
def _related(spark, sf_dir):
    return reports.kinds(table(spark, sf_dir, "events"), "user_id", "event_type", {"views": "view", "clicks": "click"})


@query(
    "lineage_refs",
    """SELECT o_orderkey, count(DISTINCT l_partkey) AS fragments, count(DISTINCT p_brand) AS blobs, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS refs
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def _lineage(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    return reports.lineage(table(spark, sf_dir, "orders"), "o_orderkey", items, "p_partkey", table(spark, sf_dir, "part"), "p_brand")


SNAP = "SELECT o_custkey, max(o_orderstatus) AS sig, o_custkey % 3 + 1 AS rev, max(o_orderpriority) = '5-LOW' AS hand FROM orders WHERE o_orderdate {op} DATE '1998-01-01' GROUP BY 1"


@query(
    "scd_revisions",
    f"""WITH a AS ({SNAP.format(op="<")}), b AS ({SNAP.format(op=">=")}), j AS (SELECT b.*, a.rev AS was, a.sig AS old FROM b LEFT JOIN a USING (o_custkey))
SELECT o_custkey, CASE WHEN was IS NULL THEN 'created' WHEN sig = old THEN 'unchanged' WHEN hand THEN 'manual_override' ELSE 'revised' END AS event,
  CASE WHEN was IS NULL THEN 1 WHEN sig = old THEN was ELSE was + 1 END AS revision, CASE WHEN was IS NOT NULL AND sig <> old THEN was END AS previous FROM j
UNION ALL SELECT o_custkey, 'superseded', was, was + 1 FROM j WHERE was IS NOT NULL AND sig <> old""",
)
def _revisions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    snap = [F.max("o_orderstatus").alias("sig"), (F.max("o_orderpriority") == "5-LOW").alias("hand")]
    old, new = (orders.where(c).groupBy("o_custkey").agg(*snap) for c in ("o_orderdate < DATE'1998-01-01'", "o_orderdate >= DATE'1998-01-01'"))
    return relate.revisions(old.withColumn("rev", F.col("o_custkey") % 3 + 1), new, "o_custkey", "sig", "rev", F.col("hand"))


@query(
    "source_absence",
    """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01') THEN 'current' WHEN c_nationkey <> 0 THEN 'source_absent' ELSE 'superseded' END AS sync_axis FROM customer""",
)
def _absence(spark, sf_dir):
    ledger = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lit("superseded").alias("sync_axis"))
    seen = table(spark, sf_dir, "orders").where("o_orderdate >= DATE'1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return relate.absence(ledger, seen, "c_custkey", F.col("c_nationkey") != 0).select("c_custkey", "sync_axis")


@query("mask_canonical")
def _masks(spark, sf_dir):
    own = T.canonical(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(own, 256).alias("canonical_sha256"), (F.length("text") - F.length(own)).alias("shorter"))


@query("scalar_functions", "SELECT c_custkey, sha1(c_name || '::' || c_nationkey) AS id, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(c_name, '[^a-zA-Z0-9._-]+', '-', 'g') AS key FROM customer")
def _scalars(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.stable_id(F.col("c_name"), F.col("c_nationkey")).alias("id"), T.slugify(F.col("c_name")).alias("slug"), T.composite_key(F.col("c_name")).alias("key"))


@query(
    "path_identity",
    """WITH u AS (SELECT page_id, url, split_part(url, '://', 2) AS p FROM pages)
SELECT page_id, '/root/b/' || trim(regexp_replace(replace(p, '%20', ' '), '/+', '/', 'g'), '/') AS path, '//' || trim(regexp_replace(replace(p, '%20', ' '), '/+', '/', 'g'), '/') AS share FROM u""",
)
def _paths(spark, sf_dir):
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    return table(spark, sf_dir, "pages").select("page_id", T.path_identity(F.concat(F.lit("/root/./a/../b//"), rest)).alias("path"), T.path_identity(F.concat(F.lit("file://"), rest)).alias("share"))


@query("fnv1a_id")
def _fnv(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.fnv1a(F.col("url")).alias("fnv"))


@query(
    "usage_normalised",
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_custkey - o_orderkey % 7 ELSE o_custkey END AS input_tokens, o_orderkey % 7 AS cached_input_tokens,
  CASE WHEN o_orderkey % 5 = 0 THEN 17 ELSE o_custkey + o_orderkey % 11 + CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_orderkey % 7 END END AS total_tokens FROM orders""",
)
def _normalised(spark, sf_dir):
    # A third reports cached tokens as one sum, the others cache reads; a fifth gives its total.
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    said = F.to_json(F.struct(cust.alias("prompt_tokens"), (key % 11).alias("completionTokens"), F.when(cust % 3 == 0, key % 7).alias("cached_input_tokens"), F.when(cust % 3 != 0, key % 7).alias("cacheReadTokens"), F.when(key % 5 == 0, 17).alias("total_tokens")))
    use = usage.normalised(F.parse_json(said))
    return table(spark, sf_dir, "orders").select("o_orderkey", use.alias("u")).select("o_orderkey", "u.input_tokens", "u.cached_input_tokens", "u.total_tokens")


@query(
    "rollup_measures",
    """WITH m AS (SELECT o_orderpriority AS key, o_orderkey % 4 <> 0 AS has, o_custkey AS i, o_orderkey % 7 AS c, o_orderkey % 11 AS o FROM orders)
SELECT key, key AS label, count(*) AS turns, count(*) FILTER (has) AS covered, round(count(*) FILTER (has) / count(*), 4) AS coverage, count(*) AS with_model,
  sum(CASE WHEN has THEN i ELSE 0 END)::BIGINT AS input_tokens, sum(CASE WHEN has THEN c ELSE 0 END)::BIGINT AS cached_input_tokens, sum(CASE WHEN has THEN o ELSE 0 END)::BIGINT AS output_tokens,
  0 AS reasoning_output_tokens, sum(CASE WHEN has THEN i + o + c ELSE 0 END)::BIGINT AS total_tokens FROM m GROUP BY 1""",
)
def _measures(spark, sf_dir):
    key = F.col("o_orderkey")
    said = F.to_json(F.when(key % 4 != 0, F.struct(F.col("o_custkey").alias("inputTokens"), (key % 11).alias("output_tokens"), (key % 7).alias("cache_creation_tokens"))))
    rows = usage.with_measures(table(spark, sf_dir, "orders").withColumn("use", usage.normalised(F.parse_json(said))), "use")
    return usage.rollup_measures(rows, F.col("o_orderpriority"), F.col("o_orderpriority"), "o_orderpriority")


@query(
    "stop_reasons",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'tool_use' WHEN 2 THEN 'max_tokens' WHEN 3 THEN 'error' WHEN 4 THEN 'end_turn' END AS reason FROM events""",
)
def _stops(spark, sf_dir):
    spelt = F.element_at(F.array(*map(F.lit, ["End-Turn", " tool calls ", "token_limit", "Cancelled", "stop", "other"])), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.stop_reason(spelt).alias("reason"))


@query(
    "compact_text",
    """WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE left(t, 59) || '…' END AS short FROM s""",
)
def _compact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.compact(F.coalesce("text", F.lit("")), 60).alias("short"))


@query("bounded_text")
def _bounded(spark, sf_dir):
    own = T.bounded(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(own).alias("bytes"), F.sha2(own, 256).alias("bounded_sha256"))


WRAPPED = "CASE conv_id % 5 WHEN 0 THEN text WHEN 1 THEN '<system-reminder>be kind</system-reminder> ' || text WHEN 2 THEN 'rules [User Request] ' || text WHEN 3 THEN '[cron: daily] ' || text ELSE '<bash-stdout>' || text END"


@query(
    "split_user_text",
    """WITH t AS (SELECT conv_id, turn, conv_id % 5 AS k, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS own, text FROM conversations WHERE role = 'user' AND text <> '')
SELECT conv_id, turn, CASE WHEN k IN (1, 2) THEN 2 ELSE 1 END AS chunks, CASE k WHEN 0 THEN 'user_authored' WHEN 3 THEN 'automation_trigger' ELSE 'injected_user_shaped' END AS first,
  CASE k WHEN 3 THEN 'automation_trigger' WHEN 4 THEN 'injected_user_shaped' ELSE 'user_authored' END AS last,
  sha256(CASE k WHEN 3 THEN '[cron: daily] ' || regexp_replace(text, '\\s+$', '') WHEN 4 THEN '<bash-stdout>' || regexp_replace(text, '\\s+$', '') ELSE own END) AS said FROM t""",
)
def _split(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").where("role = 'user' AND text <> ''").select("conv_id", "turn", split_user_text(F.expr(WRAPPED)).alias("c"))
    return own.select("conv_id", "turn", F.size("c").alias("chunks"), F.element_at("c", 1)["origin_kind"].alias("first"), F.element_at("c", -1)["origin_kind"].alias("last"), F.sha2(F.element_at("c", -1)["text"], 256).alias("said"))


@query(
    "search_cursor",
    "SELECT doc_id, n_chars FROM documents WHERE lang IN ('en', 'de') AND (n_chars < 2000 OR n_chars = 2000 AND doc_id > 500) ORDER BY n_chars DESC, doc_id LIMIT 40",
)
def _cursor(spark, sf_dir):
    own = search.on_axes(table(spark, sf_dir, "documents"), lang=["en", "de"], source=None).select("doc_id", "n_chars")
    return search.after_cursor(own, [("n_chars", True), ("doc_id", False)], {"n_chars": 2000, "doc_id": 500}, 40)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as records of three shapes: plain contents, a message with a list, and parts of a sender."""
    turn, said = F.col("turn"), F.coalesce(F.nullif("text", F.lit("")), F.lit("-"))
    call = F.concat(F.lit("c"), turn.cast("string"))
    counts = F.when(turn % 2 == 0, F.struct((turn * 10).alias("prompt_tokens"), (F.col("conv_id") % 7).alias("completionTokens")))
    plain = F.to_json(F.struct("role", F.col("text").alias("content"), counts.alias("usage")))
    listed = F.to_json(F.struct(F.struct("role", F.lit("Tool Calls").alias("stopReason"), counts.alias("usage"), F.struct(F.lit("text").alias("type"), said.alias("text")).alias("content"), F.struct(F.lit("toolUse").alias("type"), call.alias("id"), F.lit("look").alias("name"), F.struct("turn").alias("input")).alias("tool_call")).alias("message")))
    parts = F.to_json(F.struct(F.struct("role").alias("sender"), F.lit("length").alias("stop_reason"), F.array(F.struct(F.lit("function_result").alias("type"), call.alias("call_id"), said.alias("output"))).alias("parts")))
    shaped = F.when(turn % 3 == 0, plain).when(turn % 3 == 1, listed).otherwise(parts)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("origin"), turn.alias("ordinal"), F.parse_json(shaped).alias("record"))


ROLE = "CASE WHEN role = 'user' THEN 'user' WHEN role IN ('system', 'developer') THEN 'system' ELSE 'assistant' END"


@query(
    "record_fragments",
    f"""WITH t AS (SELECT conv_id AS origin, turn AS ordinal, text, coalesce(nullif(text, ''), '-') AS own, {ROLE} AS role FROM conversations)
SELECT origin, ordinal, 0 AS place, 'text' AS kind, role, NULL::VARCHAR AS call_id, sha256(text) AS said FROM t WHERE ordinal % 3 = 0 AND trim(text) <> ''
UNION ALL SELECT origin, ordinal, 0, 'text', role, NULL, sha256(own) FROM t WHERE ordinal % 3 = 1
UNION ALL SELECT origin, ordinal, 1, 'tool_call', role, 'c' || ordinal, sha256('{{"turn":' || ordinal || '}}') FROM t WHERE ordinal % 3 = 1
UNION ALL SELECT origin, ordinal, 0, 'tool_result', role, 'c' || ordinal, sha256(own) FROM t WHERE ordinal % 3 = 2""",
)
def _fragments(spark, sf_dir):
    return generic.fragments(records(spark, sf_dir)).select("origin", "ordinal", "place", "kind", "role", "call_id", F.sha2("text", 256).alias("said"))


@query(
    "record_usage",
    f"""WITH t AS (SELECT conv_id AS origin, turn AS ordinal, turn % 2 = 0 AND turn % 3 < 2 AS has, turn * 10 AS i, conv_id % 7 AS o FROM conversations WHERE {ROLE} = 'assistant')
SELECT origin, ordinal, CASE WHEN has THEN i END AS input_tokens, CASE WHEN has THEN o END AS output_tokens, CASE WHEN has THEN i + o END AS total_tokens,
  CASE ordinal % 3 WHEN 1 THEN 'tool_use' WHEN 2 THEN 'max_tokens' END AS stop_reason FROM t WHERE has OR ordinal % 3 > 0""",
)
def _record_usage(spark, sf_dir):
    return generic.token_usage(records(spark, sf_dir)).select("origin", "ordinal", "usage.input_tokens", "usage.output_tokens", "usage.total_tokens", "stop_reason")
