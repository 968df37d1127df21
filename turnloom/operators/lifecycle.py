"""Collection, deletion and tombstones, and what a rebuild has to touch.

Every function takes tables and gives the tables that are left, with the tombstones of what went; nothing is written but tables
in between. A tombstone log is kept by logical id, so that purging again changes nothing, and ``alive`` is what readers see.
"""

from __future__ import annotations

from dataclasses import dataclass, replace as changed

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.relate import keep
from turnloom.session import forget, settled

TOMBSTONE = "object_kind string, logical_id string, last_revision_id string, purge_reason string, purged_at string, lineage_refs array<string>"


@dataclass(frozen=True)
class History:
    """What is kept of conversations; ids and references are texts, blob_refs, candidate_refs and turn_refs arrays of them.

    turns (turn_id, revision_id, source_id, session_id, project_id, link_state, submitted_at, last_activity_at, value_axis, retention_axis,
    blob_refs, candidate_refs), contexts (turn_id), sessions (session_id, updated_at, turn_count), observations (id, session_id, project_id),
    blobs (blob_id, source_id), overrides (id, project_id, target_ref), audits (id, session_id, candidate_id, blob_id),
    artifacts (artifact_id, revision, project_id, turn_refs), tombstones (TOMBSTONE).
    """

    turns: DataFrame
    contexts: DataFrame
    sessions: DataFrame
    observations: DataFrame
    blobs: DataFrame
    overrides: DataFrame
    audits: DataFrame
    artifacts: DataFrame
    tombstones: DataFrame


def without(rows: DataFrame, gone: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Rows whose ``column`` isn't among ``gone``; null is among nothing."""
    ids = gone.select(F.col(name or column).alias("_gone")).distinct()
    return rows.join(ids, F.col(column) == F.col("_gone"), "left_anti")


def alive(rows: DataFrame, tombstones: DataFrame, kind: str, key: str) -> DataFrame:
    """Rows that no tombstone of their kind names."""
    return without(rows, tombstones.where(F.col("object_kind") == kind), key, "logical_id")


def _stones(rows: DataFrame, kind: str, key: str, revision: str | None, refs: Column | None, reason: str, now: str) -> DataFrame:
    none = F.lit(None)
    return rows.select(F.lit(kind).alias("object_kind"), F.col(key).alias("logical_id"), (F.col(revision) if revision else none).cast("string").alias("last_revision_id"), F.lit(reason).alias("purge_reason"), F.lit(now).alias("purged_at"), (none if refs is None else refs).cast("array<string>").alias("lineage_refs"))


def _logged(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with the new tombstones: one an id, the latest standing."""
    return keep(log.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))), ["object_kind", "logical_id"], [F.desc("_new"), F.desc("purged_at")]).drop("_new")


def _unreferenced(turns: DataFrame, gone: DataFrame, left: DataFrame) -> DataFrame:
    """(blob_id) of the blobs that the gone turns named and none of the left ones does."""
    named = lambda rows: rows.select(F.explode("blob_refs").alias("blob_id")).distinct()
    return named(gone).join(named(left), "blob_id", "left_anti")


def purge(history: History, turn_ids: DataFrame, reason: str, now: str) -> History:
    """Without these turns (turn_id), their contexts and the blobs that only they named; each leaves a tombstone.

    Turns that aren't there, purged before or never known, change nothing: purging twice is purging once.
    """
    wanted = turn_ids.select(F.col("turn_id").alias("_wanted")).distinct()
    gone = history.turns.join(wanted, F.col("turn_id") == F.col("_wanted"), "left_semi")
    left = without(history.turns, wanted, "turn_id", "_wanted")
    return changed(
        history,
        turns=left,
        contexts=without(history.contexts, gone, "turn_id"),
        blobs=without(history.blobs, _unreferenced(history.turns, gone, left), "blob_id"),
        tombstones=_logged(history.tombstones, _stones(gone, "turn", "turn_id", "revision_id", F.col("candidate_refs"), reason, now)),
    )


def old_candidates(turns: DataFrame, before: str) -> DataFrame:
    return turns.where((F.col("link_state") == "candidate") & (F.col("submitted_at") < before))


def collect_candidates(history: History, before: str, now: str, mode: str = "archive") -> History:
    """Candidate turns submitted before a time are archived, their raw records kept, or purged."""
    if mode == "purge":
        return purge(history, old_candidates(history.turns, before), "candidate_gc", now)
    old = F.coalesce((F.col("link_state") == "candidate") & (F.col("submitted_at") < before), F.lit(False))
    return changed(history, turns=history.turns.withColumns({"value_axis": F.when(old, "archived").otherwise(F.col("value_axis")), "retention_axis": F.when(old, "keep_raw_only").otherwise(F.col("retention_axis"))}))


def delete_project(history: History, project_id: str, reason: str, now: str, revision_id: str | None = None) -> History:
    """Without a project and all that only it holds.

    Its turns go with their contexts. Sessions go that no other turn belongs to; others stay, with their turns counted and their
    time set again. Blobs go that no turn left names. So do its observations and those of gone sessions, overrides for it or for
    what went, and audits of what went. Artifacts go that are its own or have no turn left; others lose the gone turns by a new revision.
    A project of which nothing is left and that has its tombstone changes nothing.
    """
    of_project = F.col("project_id") == project_id
    mine = history.turns.where(of_project)
    # What went is read by every table's step, so it is found once; what it named of blobs is read by one alone.
    gone = settled(mine.select("turn_id", "revision_id", "session_id", "candidate_refs"), "gone-turns")
    left = history.turns.where(~F.coalesce(of_project, F.lit(False)))
    touched = gone.select("session_id").distinct()
    kept_sessions = left.groupBy("session_id").agg(F.count("*").alias("_n"), F.max("last_activity_at").alias("_last"))
    gone_sessions = settled(touched.join(kept_sessions, "session_id", "left_anti"), "gone-sessions")
    blobs = _unreferenced(history.turns, mine, left)
    observed = history.observations.where(of_project).select("id").unionByName(history.observations.join(gone_sessions, "session_id", "left_semi").select("id")).distinct()
    observed = settled(observed, "gone-observations")
    candidates = observed.unionByName(gone.select(F.explode("candidate_refs").alias("id"))).distinct()

    recount = kept_sessions.join(touched, "session_id", "left_semi")
    sessions = without(history.sessions, gone_sessions, "session_id").join(recount, "session_id", "left")
    sessions = sessions.withColumns({"turn_count": F.coalesce("_n", "turn_count"), "updated_at": F.coalesce("_last", "updated_at")}).select(*history.sessions.columns)

    targets = gone.select(F.col("turn_id").alias("target")).unionByName(gone_sessions.select(F.col("session_id").alias("target"))).unionByName(observed.select(F.col("id").alias("target")))
    overrides = without(history.overrides.where(~F.coalesce(of_project, F.lit(False))), targets, "target_ref", "target")
    audits = history.audits
    for column, rows, name in (("session_id", gone_sessions, "session_id"), ("candidate_id", candidates, "id"), ("blob_id", blobs, "blob_id")):
        audits = without(audits, rows, column, name)

    refs = history.artifacts.select("artifact_id", F.explode_outer("turn_refs").alias("turn_id")).join(gone.select("turn_id", F.lit(True).alias("_gone")), "turn_id", "left")
    refs = refs.groupBy("artifact_id").agg(F.array_sort(F.collect_set(F.when(F.col("_gone").isNull(), F.col("turn_id")))).alias("_left"), F.bool_or(F.col("_gone").isNotNull()).alias("_hit"))
    marked = settled(history.artifacts.join(refs, "artifact_id"), "marked-artifacts")
    dead = F.coalesce(of_project, F.lit(False)) | (F.col("_hit") & (F.size("_left") == 0))
    spent = marked.where(dead)
    artifacts = marked.where(~dead).withColumns({"revision": F.when(F.col("_hit"), F.col("revision") + 1).otherwise(F.col("revision")), "turn_refs": F.when(F.col("_hit"), F.col("_left")).otherwise(F.col("turn_refs"))}).select(*history.artifacts.columns)

    stones = _stones(gone, "turn", "turn_id", "revision_id", F.col("candidate_refs"), reason, now).unionByName(_stones(spent, "artifact", "artifact_id", "revision", None, reason, now))
    # The project's own tombstone is set anew only where something went, or where it has none.
    own = history.tombstones.sparkSession.range(1).select(F.lit(project_id).alias("project_id"), F.lit(revision_id).cast("string").alias("revision"))
    log = history.tombstones
    if stones.isEmpty():
        own = without(own, log.where("object_kind = 'project'"), "project_id", "logical_id")
    anew = _stones(own, "project", "project_id", "revision", None, reason, now)
    return changed(
        history,
        turns=left,
        contexts=without(history.contexts, gone, "turn_id"),
        sessions=sessions,
        observations=without(history.observations, observed, "id"),
        blobs=without(history.blobs, blobs, "blob_id"),
        overrides=overrides,
        audits=audits,
        artifacts=artifacts,
        tombstones=_logged(log, stones.unionByName(anew)),
    )


def _key(kind: str, *columns: str) -> Column:
    """The key ``kind:value``, null where a part is null or empty."""
    parts = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat(F.lit(f"{kind}:"), *(x for p in parts for x in (p, F.lit("\0"))))


def scope_rows(ledger: DataFrame, spans: DataFrame, turns: DataFrame, contexts: DataFrame, caches: DataFrame) -> DataFrame:
    """(kind, id, takes, gives): the keys by which a row of a store is reached, and those that it leads to.

    ledger (source_id, origin_path, blob_id, profile), spans (record_id, source_id, blob_id, session_id, profile), turns (turn_id, source_id,
    session_id, project_id), contexts (turn_id, source_id), caches (id, source_id, scope_kind, scope_ref, profile).
    """

    def rows(table: DataFrame, kind: str, key: Column, takes: list[Column], gives: list[Column]) -> DataFrame:
        there = lambda keys: F.filter(F.array(*keys), lambda k: k.isNotNull())
        return table.select(F.lit(kind).alias("kind"), key.cast("string").alias("id"), there(takes).alias("takes"), there(gives).alias("gives"))

    blob = _key("blob", "source_id", "blob_id")
    scoped = [F.when(F.col("scope_kind") == k, _key(t, "scope_ref")) for k, t in (("session", "session"), ("origin_path", "origin"), ("source", "source"))]
    given = [F.when(F.col("scope_kind") == k, _key(t, "scope_ref")) for k, t in (("session", "session"), ("origin_path", "origin"))]
    asked = lambda *names: [_key(f"ask-{n}", c) for n, c in (("source", "source_id"), ("profile", "profile")) if n in names]
    parts = [
        rows(ledger, "ledger", F.concat_ws("|", "source_id", "origin_path"), [blob, *asked("source", "profile"), _key("ask-origin", "origin_path")], [blob, _key("source", "source_id"), _key("origin", "origin_path")]),
        rows(spans, "span", F.col("record_id"), [blob, _key("session", "session_id"), *asked("source", "profile")], [blob, _key("source", "source_id"), _key("session", "session_id")]),
        rows(turns, "turn", F.col("turn_id"), [_key("session", "session_id"), *asked("source"), _key("ask-project", "project_id")], [_key("source", "source_id"), _key("session", "session_id"), _key("turn", "turn_id")]),
        rows(contexts, "context", F.col("turn_id"), [_key("turn", "turn_id"), *asked("source")], [_key("source", "source_id")]),
        rows(caches, "cache", F.col("id"), [*scoped, *asked("source", "profile")], [_key("source", "source_id"), *given]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seeds(spark, source: list = (), origin: list = (), session: list = (), project: list = (), profile: list = ()) -> DataFrame:
    """(key) of what a rebuild is asked for."""
    keys = [f"ask-source:{x}\0" for x in source] + [f"{k}:{x}\0" for x in origin for k in ("ask-origin", "origin")] + [f"session:{x}\0" for x in session] + [f"ask-project:{x}\0" for x in project] + [f"ask-profile:{x}\0" for x in profile]
    return spark.createDataFrame([(k,) for k in keys], "key string")


def rebuild_scope(rows: DataFrame, asked: DataFrame, passes: int | None = 5) -> DataFrame:
    """(kind, id) of every row that the asked keys reach, directly and in at most ``passes`` further steps; with None to the end.

    A step looks only at the keys that the step before was first to reach, so it costs what it finds.
    """
    rows = settled(rows.select("kind", "id", "takes", "gives"), "scope-rows")
    takes = settled(rows.select("kind", "id", F.explode(F.array_distinct("takes")).alias("key")), "scope-takes")
    gives = settled(rows.select("kind", "id", F.explode(F.array_distinct("gives")).alias("key")), "scope-gives")
    front = asked.select("key").distinct()
    keys = settled(front, "scope-keys")
    front, found, spent, done = keys, None, [rows, takes, gives, keys], 0
    while passes is None or done <= passes:
        new = takes.join(front, "key", "left_semi").select("kind", "id").distinct()
        if found is not None:
            new = new.join(found, ["kind", "id"], "left_anti")
        new = settled(new, "scope-new")
        spent.append(new)
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        front = settled(gives.join(new, ["kind", "id"], "left_semi").select("key").distinct().join(keys, "key", "left_anti"), "scope-front")
        spent.append(front)
        keys = keys.unionByName(front)
        done += 1
    out = settled(found if found is not None else rows.select("kind", "id").limit(0), "scope")
    forget(*spent)
    return out
