"""What readers see of turns and sessions: path texts, projects of turns, native project references, the order of display, merged related work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T


def path_text(*parts: Column) -> Column:
    """Paths and the last name of each, in order, once, joined by spaces; null where there are none.

    Parts are arrays of strings (``one_path`` makes one of a string). Back slashes count as slashes, white space at the
    edges goes, null parts, null and blank strings are skipped.
    """
    none = F.array().cast("array<string>")
    listed = F.filter(F.flatten(F.array(*(F.coalesce(p, none) for p in parts))), lambda x: x.isNotNull())
    clean = F.filter(F.transform(listed, lambda x: T.trimmed(F.replace(x, F.lit("\\"), F.lit("/")))), lambda x: x != "")

    def with_name(path: Column) -> Column:
        names = F.filter(F.split(path, "/"), lambda n: n != "")
        return F.when(F.size(names) > 0, F.array(path, F.element_at(names, -1))).otherwise(F.array(path))

    return F.nullif(F.array_join(F.array_distinct(F.flatten(F.transform(clean, with_name))), " "), F.lit(""))


def one_path(part: Column) -> Column:
    """A string as a part of ``path_text``."""
    return F.array(part.cast("string"))


def native_project_ref(blobs: DataFrame, session: str, ref: Column) -> DataFrame:
    """(session, native_ref): the reference that a session's blobs name, only where they name exactly one; null else. Blobs without one don't count."""
    return blobs.select(session, F.nullif(ref, F.lit("")).alias("_r")).groupBy(session).agg(F.when(F.min("_r") == F.max("_r"), F.min("_r")).alias("native_ref"))


def resolve_project(turns: DataFrame, projects: DataFrame, overrides: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turns (id, session_id, project_id) with the project a reader shows, ``shown_project``.

    By precedence: an override of the turn, the turn's own project, the session's project (an override of the session first, the greatest id of
    several). Only known ``projects`` (project_id) count, so a deleted project falls through. ``overrides`` names kind (turn or session), ref and
    project_id; ``sessions`` names session_id and project_id. Null ids match nothing.
    """
    known = projects.select("project_id").where("project_id IS NOT NULL").distinct()
    rules = overrides.join(known, "project_id", "left_semi").groupBy("kind", "ref").agg(F.max("project_id").alias("_p"))
    by_turn = rules.where("kind = 'turn'").select(F.col("ref").alias("_t"), F.col("_p").alias("_by_turn"))
    by_session = rules.where("kind = 'session'").select(F.col("ref").alias("_s"), F.col("_p").alias("_by_hand"))
    linked = sessions.join(known, "project_id", "left_semi").groupBy(F.col("session_id").alias("_l")).agg(F.max("project_id").alias("_by_link"))
    own = known.select(F.col("project_id").alias("_own"))
    out = turns.join(by_turn, F.col("id") == F.col("_t"), "left").join(own, F.col("project_id") == F.col("_own"), "left")
    out = out.join(by_session, F.col("session_id") == F.col("_s"), "left").join(linked, F.col("session_id") == F.col("_l"), "left")
    return out.select(*turns.columns, F.coalesce("_by_turn", "_own", "_by_hand", "_by_link").alias("shown_project"))


def display_order(part: str, order: list) -> list[Column]:
    """What to order by so that the collapsed middles of loops follow all others, each in ``order``."""
    return [F.coalesce((F.col(part) == "middle_collapsed").cast("int"), F.lit(0)), *order]


#: Columns of related work of which the first value that isn't null stays.
FIRST = ("parent_tool_ref", "child_agent_key", "automation_job_ref", "automation_run_key")


def merge_related(rows: DataFrame, key: list[str], order: list[str], created: str = "created_at", updated: str = "updated_at", refs: str = "fragment_refs", status: str = "status", detail: str = "raw_detail", first: tuple[str, ...] = FIRST) -> DataFrame:
    """One entry of related work for each key: the earliest creation, the latest update, all references in order of their first mention,
    of the columns ``first`` the first value and of the status the last one that isn't null, and the details laid over each other, later ones on top.

    ``order`` must tell rows apart; among rows that tie in it any may come first. Null references, details and values of details' keys are no mention,
    a null key is a key of its own, and entries without details have an empty map.
    """
    o = F.struct(*order)
    scalars = [F.min(created).alias(created), F.max(updated).alias(updated), F.max_by(status, F.when(F.col(status).isNotNull(), o)).alias(status)]
    scalars += [F.min_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in first]
    named = rows.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(key)), *(F.col(k).isNull().alias(f"_z{i}") for i, k in enumerate(key)), *rows.columns)
    same = [c for i in range(len(key)) for c in (f"_k{i}", f"_z{i}")]
    base = named.groupBy(*same).agg(*(F.first(k).alias(k) for k in key), *scalars)
    mentions = named.select(*same, o.alias("_o"), F.posexplode(refs).alias("_at", "_ref")).where("_ref IS NOT NULL")
    once = mentions.groupBy(*same, "_ref").agg(F.min(F.struct("_o", "_at")).alias("_seen"))
    listed = once.groupBy(*same).agg(F.transform(F.array_sort(F.collect_list(F.struct("_seen", "_ref"))), lambda x: x["_ref"]).alias(refs))
    laid = named.select(*same, o.alias("_o"), F.explode(detail).alias("_name", "_value")).where("_value IS NOT NULL")
    on_top = laid.groupBy(*same, "_name").agg(F.max_by("_value", "_o").alias("_value"))
    details = on_top.groupBy(*same).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_value")))).alias(detail))
    out = base.join(listed, same, "left").join(details, same, "left")
    none = F.array().cast(rows.schema[refs].dataType)
    nothing = F.create_map().cast(rows.schema[detail].dataType)
    return out.select(*key, created, updated, F.coalesce(refs, none).alias(refs), status, *first, F.coalesce(detail, nothing).alias(detail))


def recent(projects: DataFrame, when: str, ident: str, top: int = 3) -> DataFrame:
    """The ``top`` projects active last, those without activity at the end; of ties the smaller id."""
    return projects.orderBy(F.desc_nulls_last(when), ident).limit(top)
