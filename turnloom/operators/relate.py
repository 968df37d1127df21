"""Joins, picks and set operations on keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row, repeated ones too, with the value of the latest right row not after it; of the earliest one where all are after.

    Both sides lie in one table ordered by key and time, and the last right row is carried along, so no pairs are made.
    """
    kind = right.schema[value].dataType
    held = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.col(value).alias("_v")).where("_k IS NOT NULL AND _t IS NOT NULL")
    asked = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(None).cast(kind).alias("_v"), F.struct(*left.columns).alias("_l"))
    both = asked.unionByName(held, allowMissingColumns=True)
    side = F.col("_l").isNotNull()
    so_far = Window.partitionBy("_k").orderBy("_t", side, "_v").rowsBetween(Window.unboundedPreceding, 0)
    past = F.last(F.when(~side, F.struct("_v")), ignorenulls=True).over(so_far)
    first = held.groupBy("_k").agg(F.min(F.struct("_t", "_v"))["_v"].alias("_f"))
    out = both.withColumn("_p", past).where(side).join(first, "_k", "left")
    exact = F.col("_p").isNotNull()
    return out.select("_l.*", F.when(exact, F.col("_p._v")).otherwise(F.col("_f")).alias(value), exact.alias("exact"))


def keep(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def mode_first_seen(rows: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """The most common value of each group; of ties the one seen first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("seen"))
    return keep(counts, [group], [F.desc("n"), "seen"]).select(group, value, "n")


def override(rows: DataFrame, rules: DataFrame, levels: list[tuple[str, str]], target: str) -> DataFrame:
    """``target`` of the first level that has a rule: levels are (kind, key column) in order of precedence."""
    out, picks = rows, []
    for i, (kind, column) in enumerate(levels):
        own = rules.where(F.col("kind") == kind).select(F.col("ref").alias(f"_r{i}"), F.col(target).alias(f"_p{i}"))
        out = out.join(own, F.col(column) == F.col(f"_r{i}"), "left").drop(f"_r{i}")
        picks.append(F.col(f"_p{i}"))
    return out.withColumn(target, F.coalesce(*picks)).drop(*(f"_p{i}" for i in range(len(levels))))


def unique_alias(asked: DataFrame, known: DataFrame, alias: str, ident: str, levels: list[list[str]]) -> DataFrame:
    """The id of each asked alias at the first level where it is unique; levels list the columns that must agree too."""
    out, picks = asked, []
    for i, same in enumerate(levels):
        keys = [alias, *same]
        one = known.groupBy(*keys).agg(F.countDistinct(ident).alias("_n"), F.min(ident).alias(f"_i{i}")).where("_n = 1").drop("_n")
        out = out.join(one, keys, "left")
        picks.append(F.col(f"_i{i}"))
    return out.withColumn("resolved", F.coalesce(*picks)).drop(*(f"_i{i}" for i in range(len(levels))))


def longest_prefix(rows: DataFrame, column: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Every row with the longest of ``prefixes`` (whole path segments) above it, null where there is none.

    Each distinct path lists its own ancestors and they are joined by equality, so the cost
    is the depth of a path, not the number of prefixes.
    """
    parts = F.split(F.col(column), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    listed = rows.select(F.col(column)).distinct().select(F.col(column).alias("_path"), F.explode(above).alias("_a"))
    hits = listed.join(prefixes.select(F.col(prefix).alias("_a")).distinct(), "_a")
    best = hits.groupBy("_path").agg(F.max_by("_a", F.length("_a")).alias(prefix))
    return rows.join(best, F.col(column) == F.col("_path"), "left").drop("_path")


def orphans(rows: DataFrame, references: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Rows that no reference table names."""
    for table, column in references:
        rows = rows.join(table.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return rows


def islands(rows: DataFrame, key: list[str], order: list[str], value: str, least: int) -> DataFrame:
    """Runs of equal ``value`` in order: run, place in it, its size, and whether the row leads, is amid or trails; null for runs shorter than ``least``."""
    by = Window.partitionBy(*key).orderBy(*order)
    change = F.when(F.lag(value).over(by).eqNullSafe(F.col(value)), 0).otherwise(1)
    run = rows.withColumn("run", F.sum(change).over(by))
    inside = Window.partitionBy(*key, "run")
    out = run.withColumn("place", F.row_number().over(inside.orderBy(*order))).withColumn("size", F.count("*").over(inside))
    part = F.when(F.col("size") < least, F.lit(None).cast("string")).when(F.col("place") == 1, "leading").when(F.col("place") == F.col("size"), "trailing").otherwise("middle_collapsed")
    return out.withColumn("part", part)


def carry_forward(rows: DataFrame, key: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """The last non-null value up to and with the row."""
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order)))


def last_before(rows: DataFrame, key: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """The last non-null value before the row; null where there is none."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(before))


def only_with(rows: DataFrame, key: str, wanted: DataFrame, vetoed: DataFrame) -> DataFrame:
    """Rows whose key is among those of ``wanted`` and not among those of ``vetoed``; a null key is in neither."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi").join(vetoed.select(key).distinct(), key, "left_anti")


def edges_of(edges: DataFrame, atoms: DataFrame, source: str, target: str, ident: str) -> DataFrame:
    """Edges that start or end at one of ``atoms``, each once however many of its ends are there; repeated edges stay repeated."""
    own = atoms.select(F.col(ident).alias("_a")).where("_a IS NOT NULL").distinct()
    starts = edges.join(own, F.col(source) == F.col("_a"), "left_semi")
    others = edges.join(own, F.col(source) == F.col("_a"), "left_anti")
    return starts.unionByName(others.join(own, F.col(target) == F.col("_a"), "left_semi"))


def revisions(old: DataFrame, new: DataFrame, key: str, signature: str, revision: str, manual: Column | None = None) -> DataFrame:
    """(key, event, revision, previous) of each key of a new snapshot: created at 1, unchanged as it was, or revised to the next number.

    A revision by hand (``manual`` on the new row) is an event of its own, and each revised one is told to be superseded.
    """
    a = old.select(F.col(key), F.col(signature).alias("_old"), F.col(revision).alias("_was"))
    both = new.withColumn("_hand", F.lit(False) if manual is None else F.coalesce(manual, F.lit(False))).join(a, key, "left")
    changed = ~F.col(signature).eqNullSafe(F.col("_old"))
    was, following = F.col("_was"), F.col("_was") + 1

    def event(name: Column | str, now: Column, before: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("event"), now.cast("long").alias("revision"), before.cast("long").alias("previous"))

    nothing = F.lit(None)
    revised = F.array(event(F.when(F.col("_hand"), "manual_override").otherwise("revised"), following, was), event("superseded", was, following))
    told = F.when(was.isNull(), F.array(event("created", F.lit(1), nothing))).when(changed, revised).otherwise(F.array(event("unchanged", was, nothing)))
    return both.select(key, F.explode(told).alias("_e")).select(key, "_e.*")


def absence(ledger: DataFrame, observed: DataFrame, key: str, complete: Column) -> DataFrame:
    """Ledger rows with sync_axis: current where observed, source_absent where a complete inventory misses them, else as before."""
    seen = observed.select(key).distinct().withColumn("_seen", F.lit(True))
    axis = F.when(F.col("_seen"), "current").when(complete, "source_absent").otherwise(F.col("sync_axis"))
    return ledger.join(seen, key, "left").withColumn("sync_axis", axis).drop("_seen")
