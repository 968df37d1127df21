"""Reports over whole tables: picks per key, inventories, label lists, counters, time lines.

Every report is one partial aggregation by its key or a bounded pick per key; nothing of a group is gathered.
Null keys are a group of their own unless a function says otherwise; an empty table gives no rows, or zeros where listed keys are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as T

def last_of(rows: DataFrame, key: list[str], order: list[str], *values: str) -> DataFrame:
    """``values`` of each key's last row in ``order``; of ties the greatest values."""
    listed = list(dict.fromkeys([*order, *values]))
    return rows.groupBy(*key).agg(F.max(F.struct(*listed)).alias("_m")).select(*key, *(F.col("_m")[v].alias(v) for v in values))


def keep_max(rows: DataFrame, key: list[str], value: str, ident: str, place: str | None = None) -> DataFrame:
    """``ident`` (a number) and ``value`` of each key's greatest value, of ties the smallest id; with ``place`` also the least id of the key, where its first row stood."""
    best = F.max(F.struct(value, (-F.col(ident)).alias("_o"))).alias("_m")
    more = [F.min(ident).alias(place)] if place else []
    return rows.groupBy(*key).agg(best, *more).select(*key, (-F.col("_m._o")).alias(ident), F.col("_m")[value].alias(value), *([place] if place else []))


def inventory(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows, payload bytes in UTF-8 and the largest payload of each key; null payloads are rows without bytes."""
    size = F.octet_length(payload)
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.max(size), F.lit(0)).cast("long").alias("largest"))


def largest(rows: DataFrame, key: str, ident: str, payload: str, top: int = 3) -> DataFrame:
    """The ``top`` rows of each key by payload bytes, numbered by rank; of ties the smaller id first."""
    sized = rows.select(key, ident, F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("bytes"))
    by = Window.partitionBy(key).orderBy(F.desc("bytes"), ident)
    return sized.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def top_labels(rows: DataFrame, group: str, label: str, top: int) -> DataFrame:
    """The ``top`` most frequent labels of each group (n, their rank k, and how many more there are); of ties the smaller label first."""
    counts = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    by = Window.partitionBy(group)
    ranked = counts.withColumn("k", F.row_number().over(by.orderBy(F.desc("n"), label))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(by) - top))
    return ranked.where(F.col("k") <= top).select(group, label, "n", "k", "more")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, n) for each table, empty ones too."""
    return reduce(DataFrame.unionByName, [t.agg(F.lit(what).alias("what"), F.count("*").alias("n")) for what, t in tables.items()])


def summary(rows: DataFrame, key: str, of: str = "turns") -> DataFrame:
    """Rows of each key, and of all under the key ``all``; rows with a null key count under ``none`` and in all."""
    marked = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("none")).alias(key))
    return marked.rollup(key).agg(F.count("*").alias(of)).select(F.coalesce(key, F.lit("all")).alias(key), of)


def stage_stats(rows: DataFrame, stage: str, failed: Column, stages: list[str] = ()) -> DataFrame:
    """Input and failures of each stage; ``stages`` are listed with zeros where they have no rows. A failure that is null counts as none."""
    own = rows.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("input"), F.count_if(failed).alias("failures"))
    if not stages:
        return own
    spark, kind = rows.sparkSession, rows.schema[stage].dataType
    asked = spark.range(1).select(F.explode(F.array(*(F.lit(s).cast(kind) for s in stages))).alias("stage")).distinct()
    empty = asked.join(own.select("stage"), "stage", "left_anti").select("stage", F.lit(0).cast("long").alias("input"), F.lit(0).cast("long").alias("failures"))
    return own.unionByName(empty)


def recount(sources: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """Each source with a count per entry of ``tables``: name to (rows, their column of the source, None or the column whose distinct values count).

    Entries that name the same rows and column are counted in one pass. Sources without rows have zeros.
    """
    passes: dict[tuple[int, str], tuple[DataFrame, list[Column]]] = {}
    for name, (rows, column, distinct) in tables.items():
        _, listed = passes.setdefault((id(rows), column), (rows, []))
        listed.append((F.countDistinct(distinct) if distinct else F.count("*")).alias(name))
    out = sources.select(key)
    for (_, column), (rows, listed) in passes.items():
        out = out.join(rows.groupBy(F.col(column).alias(key)).agg(*listed), key, "left")
    return out.select(key, *(F.coalesce(name, F.lit(0)).alias(name) for name in tables))


def project_counters(turns: DataFrame, project: str, state: str, session: str, when: str, committed: str = "committed", candidate: str = "candidate") -> DataFrame:
    """Committed and candidate turns, distinct sessions and the last activity of each project."""
    is_ = F.col(state)
    return turns.groupBy(project).agg(F.count_if(is_ == committed).alias("committed"), F.count_if(is_ == candidate).alias("candidate"), F.countDistinct(session).alias("sessions"), F.max(when).alias("last"))


def kinds(rows: DataFrame, key: str, kind: str, named: dict[str, str]) -> DataFrame:
    """Per key how many rows are of each named kind (column to value), and ``others``; null kinds are none of them."""
    own = F.col(kind)
    each = [F.count_if(own == value).alias(name) for name, value in named.items()]
    return rows.groupBy(key).agg(*each, F.count_if(~own.isin(*named.values())).alias("others"))


def drift(turns: DataFrame, linked: Column, sources: DataFrame, healthy: Column) -> DataFrame:
    """One row: turns and the share linked, sources and the share healthy, and the drift, 1 less the mean of both shares. Empty tables have shares of 0."""
    one = F.lit(1).alias("_one")
    t = turns.agg(F.count("*").alias("turns"), F.count_if(linked).alias("_c"), one)
    s = sources.agg(F.count("*").alias("sources"), F.count_if(healthy).alias("_h"), one)

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) == 0, 0.0).otherwise(F.col(part) / F.col(whole))

    a, b = share("_c", "turns"), share("_h", "sources")
    return t.join(s, "_one").select("turns", F.round(a, 4).alias("linked"), "sources", F.round(b, 4).alias("healthy"), F.round(T.clamp01(1 - (a + b) / 2), 4).alias("drift"))


def timeline(rows: DataFrame, when: str, days: int = 7) -> DataFrame:
    """The last ``days`` days up to the latest row's: rows added on each and their running total. One row a day, so one task adds them up."""
    dated = rows.select(F.to_date(when).alias("day")).where("day IS NOT NULL")
    listed = dated.agg(F.max("day").alias("d")).where("d IS NOT NULL").select(F.explode(F.sequence(F.date_sub("d", days - 1), F.col("d"))).alias("day"))
    added = listed.join(dated.groupBy("day").agg(F.count("*").alias("k")), "day", "left").withColumn("added", F.coalesce("k", F.lit(0)))
    return added.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "added", F.sum("added").over(Window.orderBy("day")).alias("total"))


def lineage(owners: DataFrame, key: str, fragments: DataFrame, fragment: str, blobs: DataFrame, blob: str) -> DataFrame:
    """Per owner with fragments: distinct fragments, distinct blobs behind them and their sorted list.

    ``fragments`` names ``key`` and ``fragment``, ``blobs`` names ``fragment`` and ``blob``; owners without a fragment that has a blob give no row.
    """
    joined = owners.select(key).join(fragments.select(key, fragment), key).join(blobs.select(fragment, blob), fragment)
    out = joined.groupBy(key).agg(F.countDistinct(fragment).alias("fragments"), F.array_sort(F.collect_set(blob)).alias("_b"))
    return out.select(key, "fragments", F.size("_b").cast("long").alias("blobs"), F.array_join("_b", ",").alias("refs"))
