"""Bundles of sources: exported with checksums, compared with what a store holds, and imported all or nothing.

A bundle is a folder: ``payloads/<table>``, one folder a source in each, ``manifest`` with a row per source (its checksum and
how many rows each table gives it), and ``seal`` with the manifest's own checksum and the bundle's id. A checksum is over a source's rows
whatever their order, files or tasks: rows' SHA-256 are added up in two lanes, so it is computed in tasks and combined.

A store is a folder of versions. A version counts once its mark is there, which is written after all its tables; readers take
the latest that counts, so a failed import leaves what was. Each import writes the sources that stay anew as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "source_id string, checksum string, counts map<string,bigint>"
MARK = "_COMMITTED"


def _sum(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per key: n and a checksum of its rows, whatever their order; repeated rows count."""
    digest = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    lane = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)"))
    told = rows.groupBy(*by).agg(F.count("*").alias("n"), lane(1).alias("a"), lane(16).alias("b"))
    return told.select(*by, "n", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "a", "b"))), 256).alias("checksum"))


def manifest(tables: dict[str, DataFrame], source: str = "source_id") -> DataFrame:
    """MANIFEST of every source that any of the tables names; rows without a source belong to none."""
    parts = None
    for name in sorted(tables):
        rows = tables[name].where(F.col(source).isNotNull())
        own = _sum(rows, [source], rows.columns).select(F.col(source).cast("string").alias("source_id"), F.lit(name).alias("table"), "n", "checksum")
        parts = own if parts is None else parts.unionByName(own)
    # A row per table.
    each = parts.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("table", "n", "checksum"))).alias("t"))
    line = F.array_join(F.transform("t", lambda x: F.concat_ws("=", x["table"], x["checksum"])), ";")
    return each.select("source_id", F.sha2(line, 256).alias("checksum"), F.map_from_entries(F.transform("t", lambda x: F.struct(x["table"], x["n"]))).alias("counts"))


def _seal(rows: DataFrame) -> DataFrame:
    flat = rows.select("source_id", "checksum", F.array_sort(F.map_entries("counts")).alias("counts"))
    whole = _sum(flat.withColumn("one", F.lit(1)), ["one"], flat.columns)
    return whole.select(F.concat(F.lit("bundle-"), F.left("checksum", F.lit(12))).alias("bundle_id"), "checksum")


def export(tables: dict[str, DataFrame], path: str, sources: list[str] | None = None, source: str = "source_id") -> str:
    """Write a bundle of these sources, of all without a list, into a new folder; gives its id. Equal contents give equal ids."""
    chosen = {name: rows.where(F.col(source).isNotNull() if sources is None else F.col(source).isin(sources)) for name, rows in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    for name, rows in chosen.items():
        rows.withColumn("_of", F.col(source)).write.partitionBy("_of").parquet(f"{path}/payloads/{name}")
    # From what was written, as that is what counts.
    manifest(_payloads(spark, path, {n: r.schema for n, r in chosen.items()}), source).write.parquet(f"{path}/manifest")
    _seal(spark.read.schema(MANIFEST).parquet(f"{path}/manifest")).write.parquet(f"{path}/seal")
    return _told(spark, path)["bundle_id"]


def _payloads(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    read = {name: spark.read.schema(schema).parquet(f"{path}/payloads/{name}") for name, schema in schemas.items()}
    return {name: rows.drop("_of") for name, rows in read.items()}


def _told(spark: SparkSession, path: str) -> dict:
    rows = spark.read.schema("bundle_id string, checksum string").parquet(f"{path}/seal").collect()
    return rows[0].asDict() if rows else {"bundle_id": None, "checksum": None}


def plan(incoming: DataFrame, held: DataFrame, on_conflict: str = "error") -> DataFrame:
    """(source_id, action, reason) of every source of a bundle's manifest and of a store's: import, skip, replace, conflict, or keep where the bundle hasn't it."""
    both = incoming.select("source_id", F.col("checksum").alias("new")).join(held.select("source_id", F.col("checksum").alias("old")), "source_id", "full_outer")
    other = {"error": ("conflict", "conflict_error"), "skip": ("skip", "conflict_skip"), "replace": ("replace", "conflict_replace")}[on_conflict]
    case = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    what = F.when(F.col("new").isNull(), case("keep", "not_in_bundle")).when(F.col("old").isNull(), case("import", "new_source")).when(F.col("new") == F.col("old"), case("skip", "identical_payload")).otherwise(case(*other))
    return both.select("source_id", what.alias("w")).select("source_id", "w.*")


def _committed(spark: SparkSession, path: str) -> int:
    """The latest version that counts, 0 for none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    marks = hadoop(f"{path}/version=*/{MARK}")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks) or []
    return max((int(s.getPath().getParent().getName().removeprefix("version=")) for s in found), default=0)


def current(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    """The tables of a store as last committed; empty ones where there is nothing yet."""
    n = _committed(spark, path)
    return {name: spark.read.schema(schema).parquet(f"{path}/version={n}/{name}") if n else spark.createDataFrame([], schema) for name, schema in schemas.items()}


def commit(tables: dict[str, DataFrame], path: str) -> int:
    """Write a new version of all tables, and then its mark."""
    spark = next(iter(tables.values())).sparkSession
    n = _committed(spark, path) + 1
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/version={n}/{name}")
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/{MARK}")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, False).close()
    return n


def _names(rows: DataFrame, column: Column | str = "source_id") -> str:
    """A few names for a message."""
    return ", ".join(str(r[0]) for r in rows.select(column).orderBy(column).limit(5).collect())


def import_bundle(spark: SparkSession, bundle: str, path: str, schemas: dict, on_conflict: str = "error", source: str = "source_id") -> DataFrame:
    """Take a bundle into a store, after all of it is checked; gives what was done with each source.

    A manifest or a payload that isn't what its checksum says, a source that the manifest lacks or the payloads lack, and conflicts
    (unless they are skipped or replaced) are errors that leave the store as it was.
    """
    listed = spark.read.schema(MANIFEST).parquet(f"{bundle}/manifest")
    seal = _seal(listed).collect()
    if (seal[0]["checksum"] if seal else None) != _told(spark, bundle)["checksum"]:
        raise ValueError(f"{bundle}: the manifest isn't what its seal says")
    payloads = _payloads(spark, bundle, schemas)
    there = manifest(payloads, source)
    wrong = listed.select("source_id", F.col("checksum").alias("said")).join(there.select("source_id", "checksum"), "source_id", "full_outer").where("NOT (said <=> checksum)")
    if not wrong.isEmpty():
        raise ValueError(f"{bundle}: payloads differ from the manifest for {_names(wrong)}")
    held = current(spark, path, schemas)
    todo = plan(listed, manifest(held, source), on_conflict)
    clash = todo.where("action = 'conflict'")
    if not clash.isEmpty():
        raise ValueError(f"{path} holds other contents of {_names(clash)}")
    rows = todo.collect()  # A row per source of the bundle and the store.
    if any(r["action"] in ("import", "replace") for r in rows):
        taken = spark.createDataFrame([(r["source_id"],) for r in rows if r["action"] in ("import", "replace")], "_taken string")
        mine = lambda df, how: df.join(F.broadcast(taken) if len(rows) < 100_000 else taken, F.col(source).cast("string") == F.col("_taken"), how)
        commit({name: mine(held[name], "left_anti").unionByName(mine(payloads[name], "left_semi")) for name in schemas}, path)
    return spark.createDataFrame(rows, "source_id string, action string, reason string")
