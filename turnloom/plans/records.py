"""Queries on usage that records nest and on checkpoints whose state is carried."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.operators import usage
from turnloom.plans.registry import query, table


def _counts(name: str, n, total) -> F.Column:
    parts = {"input_tokens": n, "total_tokens": total}
    return F.struct(*(parts.get(c, F.lit(None)).cast("long").alias(c) for c in usage.COUNTS), F.lit(None).cast("string").alias("model")).alias(name)


def checkpoints(spark, sf_dir):
    """Events as checkpoints: a user's session, every third without a running total, running totals that restart."""
    key = F.col("event_id")
    n = key % 20
    own = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.struct("ts", key).alias("ordinal"), _counts("use", n, n), _counts("all", n + key % 3 * 10, n + key % 3 * 10), key.alias("event_id"))
    return own.select("session", "ordinal", "event_id", F.when(F.col("event_id") % 4 > 0, F.col("use")).alias("usage"), F.when(F.col("event_id") % 5 > 0, F.col("all")).alias("total"))


GROWTH = """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 4 > 0 THEN event_id % 20 END AS use, CASE WHEN event_id % 5 > 0 THEN event_id % 20 + event_id % 3 * 10 END AS total FROM events
), k AS (SELECT *, CASE WHEN use IS NOT NULL AND total IS NOT NULL THEN total - use END AS series FROM e
), p AS (SELECT *, max(use) OVER (PARTITION BY user_id, series ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most,
  last_value(total IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM k)
SELECT event_id, CASE WHEN series IS NOT NULL THEN greatest(0, use - coalesce(most, 0)) WHEN total IS NOT NULL THEN greatest(0, total - coalesce(last, 0)) END AS input_tokens FROM p"""


@query("checkpoint_growth", GROWTH)
def _growth(spark, sf_dir):
    return usage.checkpoint_growth(checkpoints(spark, sf_dir)).select("event_id", "growth.input_tokens")


@query("checkpoint_growth_in_two_runs", GROWTH)
def _growth_in_two_runs(spark, sf_dir):
    # The second run knows of the first only what was kept.
    own, middle = checkpoints(spark, sf_dir), F.col("ordinal.ts") < F.lit("2024-01-15").cast("timestamp")
    first, second = own.where(middle), own.where(~middle)
    out = usage.checkpoint_growth(first).unionByName(usage.checkpoint_growth(second, usage.checkpoint_state(first)))
    return out.select("event_id", "growth.input_tokens")


@query(
    "nested_usage",
    """WITH r AS (SELECT o_orderkey, o_custkey AS a, o_orderkey % 7 AS b, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN a WHEN 1 THEN a WHEN 2 THEN a + b END AS input_tokens, CASE k WHEN 1 THEN b WHEN 2 THEN 0 END AS output_tokens, CASE k WHEN 0 THEN a WHEN 1 THEN a + b WHEN 2 THEN a + b END AS total_tokens FROM r""",
)
def _nested(spark, sf_dir):
    # Plain, at two depths with its own count, twice side by side, and too deep.
    key, a = F.col("o_orderkey"), F.col("o_custkey")
    b, k = key % 7, key % 4
    tokens = F.struct(a.alias("input_tokens"))
    two = F.struct(F.struct(F.struct(tokens.alias("usage")).alias("metadata")).alias("message"), F.struct(tokens.alias("usage")).alias("metadata"), b.alias("output_tokens"))
    said = F.when(k == 0, F.to_json(F.struct(tokens.alias("usage")))).when(k == 1, F.to_json(two)).when(k == 2, F.to_json(F.struct(tokens.alias("tokens"), F.struct(b.alias("prompt_tokens")).alias("last_token_usage"))))
    deep = F.to_json(F.struct(F.struct(F.struct(F.struct(tokens.alias("usage")).alias("metadata")).alias("usage")).alias("tokens")))
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(F.coalesce(said, deep)).alias("record"))
    return usage.nested_usage(own, "record").select("o_orderkey", "usage.input_tokens", "usage.output_tokens", "usage.total_tokens")


def measured(spark, sf_dir):
    """Orders as turns: three of four report counts, a third of the others have no reply; customers' segments are hosts."""
    key = F.col("o_orderkey")
    said = F.to_json(F.when(key % 4 != 0, F.struct(F.col("o_custkey").alias("inputTokens"), (key % 11).alias("output_tokens"), (key % 7).alias("cache_creation_tokens"), (key % 3).alias("thinking_tokens"))))
    own = table(spark, sf_dir, "orders").select(key, "o_custkey", "o_orderdate", F.col("o_orderpriority").alias("label"), F.when(key % 5 > 0, F.col("o_orderstatus")).alias("model"), F.when(key % 3 > 0, key % 2 + 1).alias("replies"), F.when(key % 8 == 0, "no_assistant_reply").alias("reason"), usage.normalised(F.parse_json(said)).alias("use"))
    hosts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("host"))
    rows = usage.with_measures(own.join(hosts, "o_custkey", "left"), "use")
    return rows.withColumn("zero", usage.no_tokens(F.col("use"), F.col("replies"), F.col("reason")))


MEASURED = """m AS (SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority AS label, c_mktsegment AS host, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS model, o_orderkey % 4 <> 0 AS has, o_custkey AS i, o_orderkey % 7 AS c, o_orderkey % 11 AS o, o_orderkey % 3 AS r,
  o_orderkey % 4 = 0 AND (o_orderkey % 8 = 0 OR o_orderkey % 3 = 0) AS zero FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""
SUMS = "coalesce(sum(i) FILTER (has), 0)::BIGINT AS input_tokens, coalesce(sum(c) FILTER (has), 0)::BIGINT AS cached_input_tokens, coalesce(sum(o) FILTER (has), 0)::BIGINT AS output_tokens, coalesce(sum(r) FILTER (has), 0)::BIGINT AS reasoning_output_tokens, coalesce(sum(i + o + c) FILTER (has), 0)::BIGINT AS total_tokens"


@query(
    "overview_measures",
    f"""WITH {MEASURED} SELECT count(*) FILTER (NOT zero) AS turns, count(*) FILTER (has) AS covered, round(count(*) FILTER (has) / count(*) FILTER (NOT zero), 4) AS coverage, count(*) FILTER (NOT zero AND model IS NOT NULL) AS with_model,
  {SUMS}, count(*) FILTER (zero) AS excluded FROM m WHERE host IN ('BUILDING', 'MACHINERY')""",
)
def _overview(spark, sf_dir):
    return usage.overview_measures(usage.filtered(measured(spark, sf_dir), hosts=["BUILDING", "MACHINERY"]), F.col("zero"))


@query(
    "rollup_first_label",
    f"""WITH {MEASURED} SELECT o_orderstatus AS key, arg_min(label, struct_pack(a := o_orderdate, b := o_orderkey)) AS label, count(*) AS turns, count(*) FILTER (has) AS covered, round(count(*) FILTER (has) / count(*), 4) AS coverage, count(*) FILTER (model IS NOT NULL) AS with_model, {SUMS}
FROM m WHERE NOT zero GROUP BY 1""",
)
def _first_label(spark, sf_dir):
    rows = usage.filtered(measured(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey"), zero=F.col("zero"))
    return usage.rollup_measures(rows, F.col("o_orderstatus"), F.col("label"), order=["o_orderdate", "o_orderkey"])
