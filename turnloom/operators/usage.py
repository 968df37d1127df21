"""Token-usage rows, overview and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]
# The names under which logs report each count, the first present one counting.
ALIASES = {
    "input": "input_tokens inputTokens prompt_tokens promptTokens input_token_count inputTokenCount",
    "output": "output_tokens outputTokens completion_tokens completionTokens output_token_count outputTokenCount",
    "total": "total_tokens totalTokens total_token_count totalTokenCount",
    "cache_read": "cache_read_input_tokens cacheReadInputTokens cacheReadTokens cache_read_tokens",
    "cache_creation": "cache_creation_input_tokens cacheCreationInputTokens cacheCreationTokens cache_creation_tokens",
    "cached": "cached_input_tokens cachedInputTokens",
    "reasoning": "reasoning_output_tokens reasoningOutputTokens thinkingTokens thinking_tokens",
}


def normalised(record: Column) -> Column:
    """Token counts of a variant as a struct, null where it reports none.

    Cached tokens reported as one sum, without reads or creations, are reads and part of the input; the total, where it isn't
    given, is input, output, cache creations and reads.
    """

    def number(name: str) -> Column:
        return F.coalesce(*(F.when(~F.schema_of_variant(F.try_variant_get(record, f"$.{a}", "variant")).isin("STRING", "BOOLEAN"), F.try_variant_get(record, f"$.{a}", "double")) for a in ALIASES[name].split()))

    got = {name: number(name) for name in ALIASES}
    lump = got["cached"].isNotNull() & got["cache_read"].isNull() & got["cache_creation"].isNull()
    read = F.when(lump, got["cached"]).otherwise(got["cache_read"])
    given = F.when(lump, got["input"] - got["cached"]).otherwise(got["input"])
    zero = F.lit(0.0)
    either = got["cache_read"].isNotNull() | got["cache_creation"].isNotNull()
    cached = F.coalesce(got["cached"], F.when(either, F.coalesce(got["cache_creation"], zero) + F.coalesce(got["cache_read"], zero)))
    parts = [given, got["output"], got["cache_creation"], read]
    added = F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, zero) for p in parts), zero))
    fields = {"input_tokens": given, "output_tokens": got["output"], "total_tokens": F.coalesce(got["total"], added), "cache_read_input_tokens": read, "cache_creation_input_tokens": got["cache_creation"], "cached_input_tokens": cached, "reasoning_output_tokens": got["reasoning"]}
    return F.when(F.coalesce(*got.values()).isNotNull(), F.struct(*(c.cast("long").alias(n) for n, c in fields.items()), F.try_variant_get(record, "$.model", "string").alias("model")))


def with_measures(turns: DataFrame, use: str, total: str | None = None) -> DataFrame:
    """``turns`` with MEASURES (0 where unknown) and has_token_usage, from a struct of ``normalised``; ``total`` stands in where it has none."""
    of = F.col(use)
    parts = F.coalesce(of["cache_read_input_tokens"], F.lit(0)) + F.coalesce(of["cache_creation_input_tokens"], F.lit(0))
    spare = F.lit(0) if total is None else F.coalesce(F.col(total), F.lit(0))
    zero = F.lit(0)
    return turns.withColumns({
        "input_tokens": F.coalesce(of["input_tokens"], zero),
        "cached_input_tokens": F.coalesce(of["cached_input_tokens"], parts),
        "output_tokens": F.coalesce(of["output_tokens"], zero),
        "reasoning_output_tokens": F.coalesce(of["reasoning_output_tokens"], zero),
        "total_tokens": F.coalesce(of["total_tokens"], spare).cast("long"),
        "has_token_usage": of.isNotNull(),
    })


def rollup_measures(rows: DataFrame, key: Column, label: Column, model: str = "model", order: list[str] | None = None) -> DataFrame:
    """Per key: its label, the first one seen by ``order`` or else the least, turns, those with usage and their share, those with a known model, and the sums of MEASURES."""
    covered = F.count_if(F.col("has_token_usage"))
    return rows.groupBy(key.alias("key")).agg(
        (F.min_by(label, F.struct(*order)) if order else F.min(label)).alias("label"),
        F.count("*").alias("turns"),
        covered.alias("covered"),
        F.round(covered / F.count("*"), 4).alias("coverage"),
        F.count_if(F.col(model) != "unknown").alias("with_model"),
        *(F.sum(m).alias(m) for m in MEASURES),
    )


def usage_rows(turns: DataFrame, sessions: DataFrame | None = None, projects: DataFrame | None = None) -> DataFrame:
    """Turns with the dimensions of their session and project; missing labels become 'unknown', missing tokens 0."""
    out = turns
    if sessions is not None:
        out = out.join(sessions, "session_id", "left")
    if projects is not None:
        out = out.join(projects, "project_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in ("model", "host", "project", "source") if c in out.columns})


def zero_token(row_total: Column, replies: Column) -> Column:
    """A turn without any usage and without replies."""
    return (F.coalesce(row_total, F.lit(0)) == 0) & (F.coalesce(replies, F.lit(0)) == 0)


def overview(rows: DataFrame, total: str, model: str, zero: Column) -> DataFrame:
    """One row: turns, covered turns and their share, turns with a known model, token sum, turns left out."""
    kept = ~zero
    n = F.count(F.when(kept, 1))
    covered = F.count(F.when(kept & (F.col(total) > 0), 1))
    return rows.agg(
        n.alias("turns"),
        covered.alias("covered"),
        F.round(F.when(n == 0, 0.0).otherwise(covered / n), 4).alias("coverage"),
        F.count(F.when(kept & (F.col(model) != "unknown"), 1)).alias("with_model"),
        F.coalesce(F.round(F.sum(F.when(kept, F.col(total))), 2), F.lit(0.0)).alias("total"),
        F.count(F.when(zero, 1)).alias("excluded"),
    )


def no_tokens(usage: Column, replies: Column, reason: Column) -> Column:
    """A turn known to have used no tokens: it reports none, and it has a reason for that or no reply."""
    return usage.isNull() & (reason.isNotNull() | (F.coalesce(replies, F.lit(0)) == 0))


def overview_measures(rows: DataFrame, zero: Column | None = None, model: str = "model") -> DataFrame:
    """One row over rows of ``with_measures``: turns, those with usage and their share (0 without turns), those with a known model, the sums of
    MEASURES, and the turns left out, for which ``zero`` holds; without it none is.
    """
    out = F.coalesce(zero, F.lit(False)) if zero is not None else F.lit(False)
    kept = ~out
    n, covered = F.count_if(kept), F.count_if(kept & F.col("has_token_usage"))
    return rows.agg(
        n.alias("turns"),
        covered.alias("covered"),
        F.round(F.when(n == 0, 0.0).otherwise(covered / n), 4).alias("coverage"),
        F.count_if(kept & (F.coalesce(model, F.lit("unknown")) != "unknown")).alias("with_model"),
        *(F.coalesce(F.sum(F.when(kept, F.col(m))), F.lit(0)).alias(m) for m in MEASURES),
        F.count_if(out).alias("excluded"),
    )


def rollup(rows: DataFrame, key: Column, total: str, by_time: bool = False) -> DataFrame:
    """Turns and tokens per key; ordered by key for time keys, else by tokens, turns and label."""
    out = rows.groupBy(F.coalesce(key, F.lit("unknown")).alias("key")).agg(F.count("*").alias("turns"), F.round(F.sum(total), 2).alias("total"), F.count(F.when(F.col(total) > 0, 1)).alias("covered"))
    return out.orderBy("key") if by_time else out.orderBy(F.desc("total"), F.desc("turns"), "key")


def filtered(rows: DataFrame, projects: list | None = None, sources: list | None = None, after_day: str | None = None, hosts: list | None = None, zero: Column | None = None) -> DataFrame:
    """Rows that pass every given filter; an empty list filters nothing, a null project never matches. Rows for which ``zero`` holds go."""
    for column, wanted in (("project_id", projects), ("source_id", sources), ("host", hosts)):
        if wanted:
            rows = rows.where(F.col(column).isin(wanted))
    if zero is not None:
        rows = rows.where(~F.coalesce(zero, F.lit(False)))
    if after_day:
        rows = rows.where(F.col("day") >= after_day)
    return rows


def cumulative_delta(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Growth of a running counter against the row before, never below 0; the first row counts whole."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("delta", F.greatest(F.lit(0.0), F.col(value) - F.coalesce(before, F.lit(0.0))))


def baseline_delta(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Growth against the largest value of the same baseline key so far."""
    before = F.max(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("delta", F.greatest(F.lit(0.0), F.col(value) - F.coalesce(before, F.lit(0.0))))


def token_sum(rows: DataFrame, key: str, order: list[str], value: str, model: str) -> DataFrame:
    """Sum with null as 0, and the last non-empty model in order."""
    named = F.nullif(F.col(model), F.lit(""))
    return rows.groupBy(key).agg(F.round(F.sum(F.coalesce(F.col(value), F.lit(0.0))), 2).alias("total"), F.max_by(named, F.when(named.isNotNull(), F.struct(*order))).alias("model"))


# Where a record may hold usage, and running totals, in the order in which they are added up.
NESTED = "usage token_usage tokenUsage tokens token_count tokenCount metadata last_token_usage lastTokenUsage"
NESTED_TOTALS = "total_token_usage totalTokenUsage total_usage totalUsage info"
COUNTS = ["input_tokens", "output_tokens", "total_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cached_input_tokens", "reasoning_output_tokens"]
USAGE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ",model:string>"
#: The counts of a baseline key, in its order.
KEYED = ["input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]


def added(found: Column) -> Column:
    """The sum of an array of usage structs, null ones left out: one alone as it is, else unknown counts are 0 and the last model named counts."""
    there = F.filter(found, lambda u: u.isNotNull())

    def plus(a: Column, b: Column) -> Column:
        both = F.struct(*((F.coalesce(a[c], F.lit(0)) + F.coalesce(b[c], F.lit(0))).cast("long").alias(c) for c in COUNTS), F.coalesce(F.nullif(b["model"], F.lit("")), a["model"]).alias("model"))
        return F.when(a.isNull(), b).otherwise(both)

    return F.aggregate(there, F.lit(None).cast(USAGE), plus)


def nested_usage(records: DataFrame, record: str, into: str = "usage", totals: bool = False, depth: int = 3) -> DataFrame:
    """``records`` with the usage that a variant reports itself and under the usual names, down to ``depth`` names, added up.

    Only the places that a record has are looked at: its paths are found level by level, and each becomes a row for a while.
    ``totals`` looks for running totals instead.
    """
    names = (NESTED_TOTALS if totals else NESTED).split()
    keyed = records.withColumn("_row", F.struct(F.monotonically_increasing_id(), F.lit(0)))
    level = keyed.select("_row", F.col(record).alias("_v"), F.array().cast("array<int>").alias("_at"))
    found = None
    for d in range(depth + 1):
        level = level.where(F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
        here = level.select("_row", "_at", normalised(F.col("_v")).cast(USAGE).alias("_u"))
        found = here if found is None else found.unionByName(here)
        if d < depth:
            inner = F.array(*(F.struct(F.try_variant_get("_v", f"$.{n}", "variant").alias("v"), F.lit(i).alias("i")) for i, n in enumerate(names)))
            level = level.select("_row", "_at", F.explode(F.filter(inner, lambda x: x["v"].isNotNull())).alias("_x")).select("_row", F.col("_x.v").alias("_v"), F.array_append("_at", F.col("_x.i")).alias("_at"))
    # What lies below a place is added before it: a place ends with a number above all names'.
    order = F.array_append("_at", F.lit(len(names)))
    each = found.where("_u IS NOT NULL").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("_u").alias("u")))).alias("_all"))
    each = each.select("_row", added(F.transform("_all", lambda x: x["u"])).alias(into))
    return keyed.join(each, "_row", "left").drop("_row")


def merged_max(value: str) -> Column:
    """An aggregate: the largest of each count."""
    return F.when(F.count(value) > 0, F.struct(*(F.max(f"{value}.{c}").alias(c) for c in COUNTS)))


def grown(now: Column, before: Column) -> Column:
    """What a usage struct has more than the one before it, no count below 0; all of it where there is none before."""
    more = [F.when(now[c].isNotNull() | before[c].isNotNull(), F.greatest(F.lit(0), F.coalesce(now[c], F.lit(0)) - F.coalesce(before[c], F.lit(0)))).cast("long").alias(c) for c in COUNTS]
    return F.when(now.isNull() | before.isNull(), now).otherwise(F.struct(*more, now["model"].alias("model")))


def baseline_key(total: Column, checkpoint: Column) -> Column:
    """Which series of checkpoints a running total belongs to: what the total had before the checkpoint, count by count."""
    parts = [F.when(total[c].isNull(), "_").otherwise((total[c] - F.coalesce(checkpoint[c], F.lit(0))).cast("string")) for c in KEYED]
    known = F.coalesce(*(total[c] for c in KEYED)).isNotNull() & checkpoint.isNotNull()
    return F.when(known, F.concat_ws("|", F.coalesce(total["model"], checkpoint["model"], F.lit("")), *parts))


STATE = f"session string, baseline string, held {USAGE}"


def checkpoint_growth(rows: DataFrame, state: DataFrame | None = None, session: str = "session", order: str = "ordinal") -> DataFrame:
    """``rows`` (session, ordinal, usage, total) with ``baseline`` and ``growth``, what each checkpoint added.

    A checkpoint of a known series grows against the largest counts of that series so far, any other by its running
    total against the last one of the session. ``state`` is what ``checkpoint_state`` kept of earlier rows; without it the rows
    are a session's first.
    """
    own = rows.withColumn("baseline", baseline_key(F.col("total"), F.col("usage"))).withColumn("_old", F.lit(False))
    if state is not None:
        kept = state.select(F.col("session").alias(session), "baseline", F.when(F.col("baseline").isNotNull(), F.col("held")).alias("usage"), F.when(F.col("baseline").isNull(), F.col("held")).alias("total"), F.lit(True).alias("_old"))
        own = own.unionByName(kept, allowMissingColumns=True)
    by = [F.desc("_old"), order]
    series = Window.partitionBy(session, "baseline").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    largest = F.when(F.count("usage").over(series) > 0, F.struct(*(F.max(f"usage.{c}").over(series).alias(c) for c in COUNTS)))
    last = F.last("total", ignorenulls=True).over(Window.partitionBy(session).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    named = own.withColumn("_most", largest).withColumn("_last", last)
    growth = F.when(F.col("baseline").isNotNull(), grown(F.col("usage"), F.col("_most"))).otherwise(grown(F.col("total"), F.col("_last")))
    return named.withColumn("growth", growth).where("NOT _old").drop("_old", "_most", "_last")


def checkpoint_state(rows: DataFrame, state: DataFrame | None = None, session: str = "session", order: str = "ordinal") -> DataFrame:
    """What later rows need of these (STATE): per series its largest counts, per session (baseline null) its last running total."""
    own = rows.withColumn("baseline", baseline_key(F.col("total"), F.col("usage")))
    series = own.where("baseline IS NOT NULL").select(F.col(session).alias("session"), "baseline", F.col("usage").alias("held"))
    last = own.where("total IS NOT NULL").groupBy(F.col(session).alias("session")).agg(F.max_by("total", order).alias("held")).select("session", F.lit(None).cast("string").alias("baseline"), "held")
    if state is not None:
        series = series.unionByName(state.where("baseline IS NOT NULL"))
        last = last.unionByName(state.where("baseline IS NULL").join(last.select("session"), "session", "left_anti").select("session", "baseline", "held"))
    most = F.struct(*(F.max(f"held.{c}").alias(c) for c in COUNTS), F.lit(None).cast("string").alias("model"))
    return series.groupBy("session", "baseline").agg(most.alias("held")).unionByName(last)
