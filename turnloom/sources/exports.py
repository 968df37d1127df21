"""One-way exports of derived tables: lines of JSON, or a Markdown text. They are for reading; bundles are what a store imports.

Both are tables of lines with a place, so Spark writes them in parts whose names follow the order; no line passes through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "turnloom.export.v1"

# The kinds of an export in their order.
KINDS = ["source", "project", "session", "related_work", "turn", "context", "ask_user_question", "loss_audit"]


def _place(rank: int, own: Column, line: int = 0) -> list[Column]:
    return [F.lit(rank).alias("rank"), own.alias("at"), F.lit(line).alias("line")]


def json_lines(spark: SparkSession, tables: dict[str, DataFrame], order: dict[str, str], host: DataFrame | None = None, schema: str = SCHEMA) -> DataFrame:
    """Rows (rank, at, line, value): a manifest, the host (one row), then each row of each table of ``KINDS`` as one line of JSON.

    ``order`` names the column by which a kind's rows are put; rows that tie in it follow each other by their JSON, those without it come first.
    Columns that are null are left out of a line. Kinds that ``tables`` doesn't name give no lines; a name that is no kind is an error.
    """
    if odd := set(tables) - set(KINDS):
        raise ValueError(f"no kinds of an export: {sorted(odd)}")

    def said(kind: str, value: Column | None = None) -> Column:
        parts = [F.lit(schema).alias("schema"), F.lit(kind).alias("kind")]
        return F.to_json(F.struct(*parts, *([value.alias("value")] if value is not None else []))).alias("value")

    def whole(rows: DataFrame) -> Column:
        return F.struct(*(F.col(f"`{c}`") for c in rows.columns))

    none = F.lit(None).cast("string")
    parts = [spark.range(1).select(*_place(0, none), said("manifest"))]
    if host is not None:
        parts.append(host.limit(1).select(*_place(1, none), said("host", whole(host))))
    for rank, kind in enumerate(KINDS, 2):
        if kind in tables:
            rows = tables[kind]
            parts.append(rows.select(*_place(rank, F.col(order[kind]).cast("string")), said(kind, whole(rows))))
    return reduce(DataFrame.unionByName, parts)


def markdown_lines(spark: SparkSession, tables: dict[str, DataFrame], turn_order: str = "submission_started_at", turn_id: str = "id", text: str = "canonical_text", schema: str = SCHEMA) -> DataFrame:
    """Rows (rank, at, line, value): a head with the counts of sources, projects, sessions, turns and related work, then every turn under a heading, as one value of several lines.

    Turns follow each other by their start and id; a null start, id or text is an empty one. A kind that isn't given counts as 0.
    """
    none = F.lit(None).cast("string")
    head = ["# Export", "", f"Schema: `{schema}`", "", "> One-way export. It is not a backup and cannot be imported.", ""]
    parts = [spark.range(1).select(F.lit(0).alias("rank"), none.alias("at"), F.posexplode(F.array(*map(F.lit, head))).alias("line", "value"))]
    names = {"source": "Sources", "project": "Projects", "session": "Sessions", "turn": "Turns", "related_work": "Related work"}
    for i, (kind, name) in enumerate(names.items()):
        n = tables[kind].agg(F.count("*").alias("n")) if kind in tables else spark.range(1).select(F.lit(0).alias("n"))
        parts.append(n.select(*_place(1, none, i), F.concat(F.lit(f"- {name}: "), F.col("n").cast("string")).alias("value")))
    parts.append(spark.range(1).select(F.lit(2).alias("rank"), none.alias("at"), F.posexplode(F.array(*map(F.lit, ["", "## Turns", ""]))).alias("line", "value")))
    if "turn" in tables:

        def known(column: str) -> Column:
            return F.coalesce(F.col(column).cast("string"), F.lit(""))

        block = F.concat_ws("\n", F.concat(F.lit("### "), known(turn_order), F.lit(" · "), known(turn_id)), F.lit(""), known(text), F.lit(""))
        at = F.concat(known(turn_order), F.lit("\u0000"), known(turn_id))
        parts.append(tables["turn"].select(*_place(3, at), block.alias("value")))
    return reduce(DataFrame.unionByName, parts)


def write(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Write lines in order: parts sorted by name, joined, are the export. Ranges split at places, so no part holds more than its share."""
    order = ["rank", "at", "line", "value"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode(mode).text(path)
