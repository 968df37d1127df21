"""A query on bundles: customers by nation as sources, of which a store holds some, others changed and others not at all."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.plans.registry import query, table
from turnloom.sources import bundles


@query(
    "bundle_plan",
    """WITH n AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT k::VARCHAR AS source_id, CASE WHEN k % 5 = 0 THEN 'import' WHEN k % 5 = 1 THEN 'keep' WHEN k % 5 = 2 THEN 'replace' ELSE 'skip' END AS action,
  CASE WHEN k % 5 = 0 THEN 'new_source' WHEN k % 5 = 1 THEN 'not_in_bundle' WHEN k % 5 = 2 THEN 'conflict_replace' ELSE 'identical_payload' END AS reason, CASE WHEN k % 5 <> 1 THEN n END AS rows FROM n""",
)
def _plan(spark, sf_dir):
    own = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "source_id")
    kind = F.col("source_id") % 5
    changed = F.when(kind == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    incoming = bundles.manifest({"customers": own.where(kind != 1)})
    held = bundles.manifest({"customers": own.where(kind != 0).withColumn("c_acctbal", changed)})
    return bundles.plan(incoming, held, "replace").join(incoming.select("source_id", F.col("counts")["customers"].alias("rows")), "source_id", "left")
