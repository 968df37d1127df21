"""Queries on what readers see: exports, verdicts on origins, ranked pages, projects of turns, path texts, related work, edges, inventories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnloom.operators import relate, reports, search, surface
from turnloom.plans.catalogue import USAGE_SQL, usage_rows
from turnloom.plans.registry import query, table
from turnloom.sources import exports, store


@query(
    "export_json_lines",
    """WITH l AS (SELECT 0 AS rank, NULL::VARCHAR AS place, json_object('schema', 'turnloom.export.v1', 'kind', 'manifest') AS value
UNION ALL SELECT 2, n_nationkey::VARCHAR, json_object('schema', 'turnloom.export.v1', 'kind', 'source', 'value', json_object('n_nationkey', n_nationkey, 'n_name', n_name)) FROM nation
UNION ALL SELECT 4, c_custkey::VARCHAR, CASE WHEN c_custkey % 3 = 0 THEN json_object('schema', 'turnloom.export.v1', 'kind', 'session', 'value', json_object('c_custkey', c_custkey, 'c_name', c_name))
  ELSE json_object('schema', 'turnloom.export.v1', 'kind', 'session', 'value', json_object('c_custkey', c_custkey, 'c_name', c_name, 'segment', c_mktsegment)) END FROM customer
UNION ALL SELECT 6, o_orderkey::VARCHAR, json_object('schema', 'turnloom.export.v1', 'kind', 'turn', 'value', json_object('o_orderkey', o_orderkey, 'o_custkey', o_custkey, 'o_orderpriority', o_orderpriority)) FROM orders)
SELECT rank, place, 0 AS line, sha256(value::VARCHAR) AS value_sha256 FROM l""",
)
def _json_lines(spark, sf_dir):
    # Nations as sources, customers as sessions (a third of them without a segment), orders as turns.
    sessions = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    tables = {
        "source": table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
        "session": sessions,
        "turn": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"),
    }
    out = exports.json_lines(spark, tables, {"source": "n_nationkey", "session": "c_custkey", "turn": "o_orderkey"})
    return out.select("rank", F.col("at").alias("place"), "line", F.sha2("value", 256).alias("value_sha256"))


@query(
    "export_markdown",
    """WITH l AS (SELECT 3 AS rank, 0 AS line, '### ' || coalesce(turn::VARCHAR, '') || ' · ' || coalesce(conv_id::VARCHAR, '') || chr(10) || chr(10) || coalesce(text, '') || chr(10) AS value FROM conversations
UNION ALL SELECT 1, 0, '- Sources: ' || count(*) FROM nation UNION ALL SELECT 1, 1, '- Projects: 0' UNION ALL SELECT 1, 2, '- Sessions: ' || count(DISTINCT conv_id) FROM conversations
UNION ALL SELECT 1, 3, '- Turns: ' || count(*) FROM conversations UNION ALL SELECT 1, 4, '- Related work: 0'
UNION ALL SELECT 2, i, CASE i WHEN 1 THEN '## Turns' ELSE '' END FROM range(3) r(i)
UNION ALL SELECT 0, i, CASE i WHEN 0 THEN '# Export' WHEN 2 THEN 'Schema: `turnloom.export.v1`' WHEN 4 THEN '> One-way export. It is not a backup and cannot be imported.' ELSE '' END FROM range(6) r(i))
SELECT rank, line::INT AS line, sha256(value) AS value_sha256 FROM l""",
)
def _markdown(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    tables = {"source": table(spark, sf_dir, "nation"), "session": said.select("conv_id").where("conv_id IS NOT NULL").distinct(), "turn": said}
    return exports.markdown_lines(spark, tables, "turn", "conv_id", "text").select("rank", "line", F.sha2("value", 256).alias("value_sha256"))


@query(
    "origin_verdicts",
    """WITH bad AS (SELECT s_suppkey AS o FROM supplier WHERE s_acctbal < 0), h AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS o, l_returnflag AS ses FROM lineitem),
stuck AS (SELECT DISTINCT s, ses FROM h WHERE o IN (SELECT o FROM bad)), v AS (SELECT DISTINCT s, o FROM h JOIN stuck USING (s, ses)), so AS (SELECT DISTINCT s, o FROM h)
SELECT so.s AS source_id, so.o AS origin, CASE WHEN so.o IN (SELECT o FROM bad) THEN 'failed' WHEN v.o IS NOT NULL THEN 'veto' ELSE 'replace' END AS verdict FROM so LEFT JOIN v USING (s, o)""",
)
def _verdicts(spark, sf_dir):
    # Orders as sources, suppliers as origins (those in debt have failed), a return flag as a session.
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("origin"), F.col("l_returnflag").alias("session"))
    debt = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("origin"))
    return store.verdicts(held, held, held.join(debt, "origin", "left_semi"))


TERM, LIMIT = "tion", 50


@query(
    "search_ranked_page",
    f"""WITH s AS (SELECT doc_id, doc_id % 400 AS age, 10 * len(regexp_extract_all(lower(text), '({TERM})+')) + 5 * greatest(0, 1 - ln(1 + (doc_id % 400) / 90.0) / ln(101)) AS score FROM documents WHERE contains(lower(text), '{TERM}'))
SELECT doc_id, round(score, 4) AS score FROM s ORDER BY s.score DESC, age, doc_id LIMIT {LIMIT} OFFSET {LIMIT}""",
)
def _ranked_page(spark, sf_dir):
    # Each document's age in days is taken from its id.
    own = table(spark, sf_dir, "documents").select("doc_id", "text", (-(F.col("doc_id") % 400)).alias("seen"))
    found = search.ranked(own, TERM, "text", (F.col("doc_id") % 400).cast("double")).select("doc_id", "seen", "score")
    order = search.by_relevance("seen", "doc_id")
    _, following = search.token_page(found, order, None, LIMIT)
    page, _ = search.token_page(found, order, following, LIMIT)
    return page.select("doc_id", F.round("score", 4).alias("score"))


@query("recent_projects", f"WITH {USAGE_SQL} SELECT project, count(DISTINCT session_id) AS sessions, max(day) AS last FROM u GROUP BY 1 ORDER BY last DESC NULLS LAST, project LIMIT 3")
def _recent(spark, sf_dir):
    counted = reports.project_counters(usage_rows(spark, sf_dir), "project", "link_state", "session_id", "day", "F", "P")
    return surface.recent(counted, "last", "project").select("project", "sessions", "last")


@query(
    "path_texts",
    """WITH p AS (SELECT page_id, split_part(url, '://', 2) AS p, '/srv/w' || page_id % 7 AS root FROM pages)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN p || CASE WHEN regexp_extract(p, '([^/]+)/*$', 1) IN ('', p) THEN '' ELSE ' ' || regexp_extract(p, '([^/]+)/*$', 1) END || ' ' ELSE '' END || root || ' w' || page_id % 7 AS path_text FROM p""",
)
def _path_texts(spark, sf_dir):
    # A fifth names its page, twice; all name a root, spelt with back slashes and blanks.
    page = F.when(F.col("page_id") % 5 == 0, F.split_part("url", F.lit("://"), F.lit(2)))
    root = F.concat(F.lit(" \\srv\\w"), (F.col("page_id") % 7).cast("string"), F.lit("\t"))
    own = surface.path_text(surface.one_path(page), F.array(F.lit(None).cast("string"), root, F.lit(" ")), surface.one_path(page))
    return table(spark, sf_dir, "pages").select("page_id", own.alias("path_text"))


@query(
    "native_project_refs",
    "SELECT l_orderkey, CASE WHEN count(DISTINCT r) = 1 THEN min(r) END AS native_ref FROM (SELECT l_orderkey, CASE WHEN l_quantity >= 10 THEN p_brand END AS r FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1",
)
def _native(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    blobs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(brands, "l_partkey")
    return surface.native_project_ref(blobs, "l_orderkey", F.when(F.col("l_quantity") >= 10, F.col("p_brand")).otherwise(""))


@query(
    "shown_projects",
    """WITH t AS (SELECT o_orderkey AS id, o_custkey AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 30 END AS own FROM orders)
SELECT id, CASE WHEN id % 11 = 0 AND id % 27 < 25 THEN id % 27 WHEN own < 25 THEN own WHEN session_id % 5 = 0 AND session_id % 26 < 25 THEN session_id % 26 WHEN session_id % 2 = 0 THEN c_nationkey END AS shown_project
FROM t LEFT JOIN customer ON c_custkey = session_id""",
)
def _shown(spark, sf_dir):
    # Nations as projects; some turns, overrides and sessions name projects that no longer exist.
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, cust = F.col("o_orderkey"), F.col("c_custkey")
    turns = orders.select(key.alias("id"), F.col("o_custkey").alias("session_id"), F.when(key % 3 == 0, F.col("o_custkey") % 30).alias("project_id"))
    by_turn = orders.where(key % 11 == 0).select(F.lit("turn").alias("kind"), key.alias("ref"), (key % 27).alias("project_id"))
    by_session = customers.where(cust % 5 == 0).select(F.lit("session").alias("kind"), cust.alias("ref"), (cust % 26).alias("project_id"))
    sessions = customers.where(cust % 2 == 0).select(cust.alias("session_id"), F.col("c_nationkey").cast("long").alias("project_id"))
    projects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"))
    return surface.resolve_project(turns, projects, by_turn.unionByName(by_session), sessions).select("id", "shown_project")


@query(
    "related_work_merged",
    """WITH e AS (SELECT *, 'r' || event_id % 50 AS ref, 'k' || event_id % 3 AS name, CASE WHEN event_id % 4 > 0 THEN 's' || event_id % 5 END AS st, CASE WHEN event_id % 6 = 0 THEN 't' || event_id END AS tool FROM events),
b AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS z, arg_max(st, struct_pack(a := ts, b := event_id)) FILTER (st IS NOT NULL) AS status, arg_min(tool, struct_pack(a := ts, b := event_id)) FILTER (tool IS NOT NULL) AS parent_tool_ref FROM e GROUP BY 1, 2),
f AS (SELECT user_id, event_type, ref, min(struct_pack(a := ts, b := event_id)) AS o FROM e GROUP BY 1, 2, 3), fr AS (SELECT user_id, event_type, string_agg(ref, ',' ORDER BY o) AS refs FROM f GROUP BY 1, 2),
d AS (SELECT user_id, event_type, name, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS v FROM e GROUP BY 1, 2, 3), dr AS (SELECT user_id, event_type, string_agg(name || '=' || v, ',' ORDER BY name) AS details FROM d GROUP BY 1, 2)
SELECT user_id, event_type, strftime(a, '%Y-%m-%d %H:%M:%S') AS created, strftime(z, '%Y-%m-%d %H:%M:%S') AS updated, status, parent_tool_ref, refs, details FROM b JOIN fr USING (user_id, event_type) JOIN dr USING (user_id, event_type)""",
)
def _merged(spark, sf_dir):
    ident = F.col("event_id")
    named = F.concat(F.lit("k"), (ident % 3).cast("string"))
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "ts", "event_id", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.array(F.concat(F.lit("r"), (ident % 50).cast("string")), none).alias("fragment_refs"), F.when(ident % 4 > 0, F.concat(F.lit("s"), (ident % 5).cast("string"))).alias("status"),
        F.create_map(named, ident.cast("string")).alias("raw_detail"), F.when(ident % 6 == 0, F.concat(F.lit("t"), ident.cast("string"))).alias("parent_tool_ref"),
    )
    out = surface.merge_related(rows, ["user_id", "event_type"], ["ts", "event_id"], first=("parent_tool_ref",))
    details = F.array_join(F.transform(F.map_entries("raw_detail"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    day = "yyyy-MM-dd HH:mm:ss"
    return out.select("user_id", "event_type", F.date_format("created_at", day).alias("created"), F.date_format("updated_at", day).alias("updated"), "status", "parent_tool_ref", F.array_join("fragment_refs", ",").alias("refs"), details.alias("details"))


@query(
    "display_order",
    """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id, run) AS size FROM r)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY size >= 3 AND place > 1 AND place < size, ts, event_id) AS shown FROM s""",
)
def _display(spark, sf_dir):
    marked = relate.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", 3)
    by = Window.partitionBy("user_id").orderBy(*surface.display_order("part", [F.col("ts"), F.col("event_id")]))
    return marked.select("user_id", "event_id", F.row_number().over(by).alias("shown"))


@query(
    "edges_of_atoms",
    "WITH a AS (SELECT p_partkey AS k FROM part WHERE p_size <= 5) SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT k FROM a) OR l_partkey IN (SELECT k FROM a) GROUP BY 1, 2",
)
def _edges(spark, sf_dir):
    atoms = table(spark, sf_dir, "part").where("p_size <= 5")
    found = relate.edges_of(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), atoms, "l_orderkey", "l_partkey", "p_partkey")
    return found.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))


@query(
    "inventory_largest",
    "SELECT source, doc_id, coalesce(strlen(text), 0) AS bytes, row_number() OVER (PARTITION BY source ORDER BY coalesce(strlen(text), 0) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 3",
)
def _largest(spark, sf_dir):
    return reports.largest(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query(
    "source_status",
    """WITH l AS (SELECT l_suppkey AS s_suppkey, count(*) AS fragments, count(DISTINCT l_orderkey) AS sessions, count(DISTINCT l_partkey) AS blobs, count(DISTINCT l_returnflag) AS states FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey AS s_suppkey, count(*) AS parts, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1)
SELECT s_suppkey, coalesce(fragments, 0) AS fragments, coalesce(sessions, 0) AS sessions, coalesce(blobs, 0) AS blobs, coalesce(states, 0) AS states, coalesce(parts, 0) AS parts, coalesce(brands, 0) AS brands
FROM supplier LEFT JOIN l USING (s_suppkey) LEFT JOIN p USING (s_suppkey)""",
)
def _status(spark, sf_dir):
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    counted = {"fragments": (items, "l_suppkey", None), "sessions": (items, "l_suppkey", "l_orderkey"), "blobs": (items, "l_suppkey", "l_partkey"), "states": (items, "l_suppkey", "l_returnflag")}
    return reports.recount(table(spark, sf_dir, "supplier"), "s_suppkey", counted | {"parts": (parts, "p_partkey", None), "brands": (parts, "p_partkey", "p_brand")})
