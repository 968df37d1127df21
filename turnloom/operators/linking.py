"""Linking observations to projects by rules and connected components, and turns and sessions to their projects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators.relate import as_of, keep
from turnloom.session import forget, settled, spread

# Per candidate rule its base, what 2 and 3 sessions, 2 platforms and a repository root add, and its bounds.
CANDIDATE = {
    "path": (0.68, 0.12, 0.05, 0.03, 0.03, 0.68, 0.88),
    "native": (0.72, 0.08, 0.04, 0.03, 0.0, 0.72, 0.87),
    "metadata": (0.60, 0.08, 0.0, 0.04, 0.0, 0.60, 0.78),
    "weak_path": (0.42, 0.08, 0.04, 0.03, 0.0, 0.42, 0.60),
}


def confidence(rule: str, sessions: Column, platforms: Column, has_root: Column) -> Column:
    """A candidate component's confidence, to two places."""
    base, two, three, wide, root, low, high = CANDIDATE[rule]
    value = F.lit(base) + F.when(sessions >= 2, two).otherwise(0.0) + F.when(sessions >= 3, three).otherwise(0.0) + F.when(platforms >= 2, wide).otherwise(0.0) + F.when(has_root, root).otherwise(0.0)
    return F.round(F.greatest(F.lit(low), F.least(F.lit(high), value)), 2)


# Reasons in order of priority, and what each candidate rule is worth before its component is known.
REASONS = ["repo_fingerprint_match", "repo_remote_match", "repo_root_match", "source_native_project", "workspace_path_continuity", "weak_path_hint", "metadata_hint", "manual_override"]
WORTH = {"source_native_project": 0.70, "workspace_path_continuity": 0.55, "weak_path_hint": 0.42, "metadata_hint": 0.60}
OF_REASON = {"source_native_project": "native", "workspace_path_continuity": "path", "weak_path_hint": "weak_path", "metadata_hint": "metadata"}
# What makes a path a weak sign of a project.
WEAK_PATHS, WEAK_PARTS = ["/root", "/tmp"], ["/.config/aionui/aionui/claude-temp-", "/.config/aionui/aionui/codex-temp-"]
WEAK_NAMES, WEAK_STARTS = ["tmp", "temp", "scratchpad"], ["claude-temp-", "codex-temp-"]


def weak_path(path: Column) -> Column:
    """Temporary and home folders, which many projects share."""
    low = F.lower(path)
    name = T.basename(low)
    tests = [low.isin(*WEAK_PATHS), low.startswith("/tmp/"), name.isin(*WEAK_NAMES), *(F.contains(low, F.lit(p)) for p in WEAK_PARTS), *(name.startswith(p) for p in WEAK_STARTS)]
    return reduce(lambda a, b: a | b, tests)


def subpath(path: Column, root: Column) -> Column:
    """Where a path lies below a root: ``.`` for the root itself, null outside of it."""
    below = F.substring(path, F.length(root) + 2, F.length(path))
    return F.when(path == root, ".").when(path.startswith(F.concat(root, F.lit("/"))), F.coalesce(F.nullif(below, F.lit("")), F.lit(".")))


def _rule(when: Column, state: str, reason: str, worth: float, *parts: str | Column) -> Column:
    key = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.when(when, F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"), F.lit(worth).alias("worth"), F.lit(REASONS.index(reason) + 1).alias("priority"), key.alias("key")))


def rules(observations: DataFrame) -> DataFrame:
    """(id, state, reason, worth, priority, key) of every rule that applies to an observation; empty fields count as absent.

    An observation with a committed rule has no candidate ones.
    """
    names = ["host_id", "workspace_path", "repo_root", "repo_remote", "repo_fingerprint", "source_native_project_ref"]
    given = observations.select("id", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in names))
    host, path, root, remote, fingerprint, native = map(F.col, names)
    # What several rules read is found in a step of its own.
    rows = given.select("id", *names, F.coalesce(subpath(path, root), path).alias("_place"), weak_path(path).alias("_weak"))
    place, weak = F.col("_place"), F.col("_weak")
    there = lambda *c: reduce(lambda a, b: a & b, [x.isNotNull() for x in c])
    at_host = [F.lit("host:"), host]
    printed, remoted, rooted = there(fingerprint, place), there(remote, host, place), there(root, host, place)
    unsure = ~(printed | remoted | rooted)
    found = F.array(
        _rule(printed, "committed", "repo_fingerprint_match", 0.95, "fingerprint:", fingerprint, "|workspace:", place),
        _rule(remoted, "committed", "repo_remote_match", 0.85, *at_host, "|remote:", remote, "|workspace:", place),
        _rule(rooted, "committed", "repo_root_match", 0.82, *at_host, "|repo_root:", root, "|workspace:", place),
        _rule(unsure & there(native, host), "candidate", "source_native_project", WORTH["source_native_project"], *at_host, "|native:", native),
        _rule(unsure & there(path, host) & weak, "candidate", "weak_path_hint", WORTH["weak_path_hint"], *at_host, "|workspace:", path),
        _rule(unsure & there(path, host) & ~weak, "candidate", "workspace_path_continuity", WORTH["workspace_path_continuity"], *at_host, "|workspace:", path),
        _rule(unsure & there(remote, host), "candidate", "metadata_hint", WORTH["metadata_hint"], *at_host, "|remote_hint:", remote),
    )
    return rows.select("id", F.explode(found).alias("r")).where("r IS NOT NULL").select("id", "r.*")


def components(edges: DataFrame, node: str, key: str) -> DataFrame:
    """(node, component): nodes that share keys, directly or through others; component is the smallest node.

    Keys of one node link nothing and go first. Each other key links its nodes to its smallest one, and stars are contracted
    until no link moves: every node's larger neighbours, then its smaller ones, are linked to the smallest node it knows of.
    """
    links = edges.select(F.col(node).alias("node"), F.col(key).alias("key")).where("node IS NOT NULL")
    least = links.where("key IS NOT NULL").groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("_m")).where("v != _m").drop("_m")
    now = settled(links.join(least, "key").where("node != v").select(F.col("node").alias("u"), "v").distinct(), "links")
    mark = None
    while (row := now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != mark:
        mark = row
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        known = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(known, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(own, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = settled(moved.unionByName(own.select("u", F.col("m").alias("v"))).distinct(), "links")
        forget(now)
        now = new
    return links.select("node").distinct().join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def metrics(members: DataFrame, component: str, session: str, platform: str, root: Column) -> DataFrame:
    """Per component its distinct sessions and platforms, and whether any member names a repository root."""
    return members.groupBy(component).agg(F.countDistinct(session).alias("sessions"), F.countDistinct(platform).alias("platforms"), F.max(root.cast("int")).alias("has_root"))


def pick_rule(rules: DataFrame, component: str, shared: str, priority: str, score: str, key: str) -> DataFrame:
    """The rule that names a component: shared first, then priority, confidence and key."""
    order = Window.partitionBy(component).orderBy(F.desc(shared), priority, F.desc(score), key)
    return rules.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def related(fragments: DataFrame) -> DataFrame:
    """Delegation and automation edges: to a child inbound from its parent, to the parent outbound; automation to itself and outbound."""
    edges = F.array(
        F.when(F.col("child").isNotNull() & (F.col("relation") == "delegated"), F.struct(F.col("child").alias("session"), F.lit("inbound").alias("direction"), F.col("parent").alias("other"), F.lit(0.95).alias("confidence"))),
        F.when(F.col("parent").isNotNull() & (F.col("relation") == "delegated"), F.struct(F.col("parent").alias("session"), F.lit("outbound").alias("direction"), F.col("child").alias("other"), F.lit(0.95).alias("confidence"))),
        F.when(F.col("relation") == "automation", F.struct(F.col("child").alias("session"), F.lit("self").alias("direction"), F.col("child").alias("other"), F.lit(0.8).alias("confidence"))),
        F.when(F.col("parent").isNotNull() & (F.col("relation") == "automation"), F.struct(F.col("parent").alias("session"), F.lit("outbound").alias("direction"), F.col("parent").alias("other"), F.lit(0.8).alias("confidence"))),
    )
    return fragments.select("relation", F.explode(F.filter(edges, lambda e: e.isNotNull())).alias("e")).select("relation", "e.*").distinct()


def grouped(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects (project_id, state, reason, confidence) and the observations (id, project_id) of each.

    First what has committed rules is grouped by shared keys, then, apart from it, what has only candidate ones. A group is
    named by its best rule: shared by several observations first, then by priority, worth and key. A candidate group
    held together by its path over two sessions or more is committed.
    """
    found = settled(rules(observations), "rules")
    # Keys of the two states differ, so one pass groups both without mixing them.
    members = settled(components(found, "id", "key").withColumnRenamed("node", "id"), "members")
    # A reason is known by its priority, so the groups hold numbers alone.
    keyed = found.join(members, "id").groupBy("component", "state", "key").agg((F.min("id") != F.max("id")).alias("shared"), F.min("priority").alias("priority"), F.min_by("worth", "priority").alias("worth"))
    keyed = keyed.withColumn("reason", F.element_at(F.array(*map(F.lit, REASONS)), F.col("priority")))
    named = pick_rule(keyed, "component", "shared", "priority", "worth", "key")
    sizes = metrics(observations.join(members, "id"), "component", "session_ref", "source_platform", F.coalesce(F.nullif("repo_root", F.lit("")).isNotNull(), F.lit(False)))
    both = named.join(sizes, "component")
    counts = [F.col("sessions"), F.col("platforms"), F.col("has_root") == 1]
    scored = F.round(F.col("worth"), 2)
    for reason, rule in OF_REASON.items():
        scored = F.when(F.col("reason") == reason, confidence(rule, *counts)).otherwise(scored)
    raised = (F.col("reason") == "workspace_path_continuity") & (F.col("sessions") >= 2)
    both = both.withColumn("project_id", F.concat(F.lit("project-"), F.left(F.sha1("key"), F.lit(12))))
    projects = both.select("component", "project_id", F.when(raised, "committed").otherwise(F.col("state")).alias("state"), "reason", scored.alias("confidence"))
    return projects.drop("component"), members.join(projects.select("component", "project_id"), "component").select("id", "project_id")


def identities(projects: DataFrame, observations: DataFrame, links: DataFrame) -> DataFrame:
    """``projects`` with what their observations most often say, names, slugs, platforms, hosts and times; of equally common values the one seen first."""
    fields = ["workspace_path", "repo_root", "repo_remote", "repo_fingerprint", "source_native_project_ref", "subpath"]
    own = observations.join(links, "id").withColumn("subpath", subpath(F.nullif("workspace_path", F.lit("")), F.nullif("repo_root", F.lit(""))))
    said = own.select("project_id", "observed_at", "id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("s")).select("project_id", "observed_at", "id", "s.*").where("value != ''")
    counts = said.groupBy("project_id", "field", "value").agg(F.count("*").alias("n"), F.min(F.struct("observed_at", "id")).alias("seen"))
    most = counts.groupBy("project_id", "field").agg(F.min_by("value", F.struct((-F.col("n")).alias("n"), "seen")).alias("value"))
    modes = most.groupBy("project_id").pivot("field", fields).agg(F.first("value"))
    text = lambda c: F.nullif(c, F.lit(""))
    times = own.groupBy("project_id").agg(F.min("observed_at").alias("created_at"), F.max("observed_at").alias("updated_at"), F.array_sort(F.collect_set(text(F.col("source_platform")))).alias("platforms"), F.array_sort(F.collect_set(text(F.col("host_id")))).alias("hosts"))
    path, root, remote = F.col("workspace_path"), F.col("repo_root"), F.col("repo_remote")
    parts = F.filter(F.split(remote, "/"), lambda x: x != "")
    repo = F.when(remote.isNotNull(), T.decode_uri(F.get(parts, F.size(parts) - 1))).otherwise(T.decode_uri(F.coalesce(text(T.basename(root)), root)))
    name = F.when(repo.isNotNull() & (F.col("subpath") != "."), F.concat_ws("/", repo, "subpath"))
    name = F.coalesce(name, text(T.basename(path)), path, repo, "source_native_project_ref", F.lit("project"))
    out = projects.join(modes, "project_id", "left").join(times, "project_id", "left").withColumn("display_name", name)
    slug = F.concat(F.coalesce(text(T.slugify(F.col("display_name"))), F.lit("project")), F.lit("-"), F.right("project_id", F.lit(6)))
    return out.withColumn("slug", slug).drop("subpath").withColumnRenamed("workspace_path", "primary_workspace_path")


def by_hand(overrides: DataFrame) -> DataFrame:
    """The projects that overrides name: (project_id, display_name, slug, created_at, updated_at), the first of each id."""
    first = overrides.groupBy("project_id").agg(F.min_by(F.struct("display_name", "created_at", "updated_at"), F.struct("created_at", "target_kind", "target_ref")).alias("o")).select("project_id", "o.*")
    slug = F.concat(F.coalesce(F.nullif(T.slugify(F.col("display_name")), F.lit("")), F.lit("project")), F.lit("-"), F.right("project_id", F.lit(6)))
    return first.withColumn("slug", slug)


class Linked:
    """What linking gives: observations, turns, sessions and projects, each with its project and state."""

    def __init__(self, observations: DataFrame, turns: DataFrame, overrides: DataFrame):
        """``observations``: (id, session_ref, observed_at, source_platform, host_id, workspace_path, repo_root, repo_remote, repo_fingerprint,
        source_native_project_ref); ``turns``: (id, session_id, last_context_activity_at, submission_started_at); ``overrides``: (target_kind,
        target_ref, project_id, display_name, created_at, updated_at), one a target, target_ref as text.
        """
        # Rules cost more than reading, and observations are read several times, so they are dealt out once.
        observations = settled(spread(observations, "id"), "observations")
        projects, links = grouped(observations)
        projects, links = settled(projects, "projects"), settled(links, "project-links")
        manual = by_hand(overrides)
        of = {kind: overrides.where(F.col("target_kind") == kind).select(F.col("target_ref").alias(f"_{kind}"), F.col("project_id").alias(f"_by_{kind}")) for kind in ("turn", "session", "observation")}

        def chosen(rows: DataFrame, levels: dict[str, str]) -> DataFrame:
            for kind, column in levels.items():
                rows = rows.join(of[kind], F.col(column).cast("string") == F.col(f"_{kind}"), "left").drop(f"_{kind}")
            return rows.withColumn("_by_hand", F.coalesce(*(F.col(f"_by_{k}") for k in levels))).drop(*(f"_by_{k}" for k in levels))

        by_hand_ = F.col("_by_hand").isNotNull()
        of_group = links.join(projects, "project_id").select("id", F.col("project_id").alias("_p"), F.col("state").alias("_s"), F.col("reason").alias("_r"))
        seen = chosen(observations, {"observation": "id", "session": "session_ref"}).join(of_group, "id", "left")
        self.observations = seen.select(*observations.columns, F.coalesce("_by_hand", "_p").alias("project_id"), F.when(by_hand_, "committed").otherwise(F.col("_s")).alias("state"), F.when(by_hand_, "manual_override").otherwise(F.col("_r")).alias("reason"))

        known = projects.select("project_id", "state", "confidence").unionByName(manual.join(projects, "project_id", "left_anti").select("project_id", F.lit("committed").alias("state"), F.lit(1.0).alias("confidence")))
        linked = settled(self.observations.where("project_id IS NOT NULL").select("id", "session_ref", "observed_at", "project_id"), "linked")
        # Of observations made at once the one with the largest id counts as the last.
        held = linked.select(F.col("session_ref").alias("session_id"), "observed_at", F.struct("id", "project_id").alias("_found"))
        asked = chosen(turns, {"turn": "id", "session": "session_id"})
        # The choice of a turn without a time is its session's first observation.
        timed = as_of(asked.withColumn("_time", F.coalesce("last_context_activity_at", F.lit(""))), held, "session_id", "_time", "observed_at", "_found").drop("exact", "_time")
        maybe = linked.groupBy(F.col("session_ref").alias("session_id")).agg(F.array_sort(F.collect_set("project_id")).alias("_maybe"))
        timed = timed.withColumn("project_id", F.coalesce("_by_hand", "_found.project_id")).join(known, "project_id", "left").join(maybe, "session_id", "left")
        state = F.when(by_hand_, "committed").otherwise(F.coalesce("state", F.lit("unlinked")))
        candidates = F.when(by_hand_, F.array("project_id")).when(F.col("state") == "candidate", F.col("_maybe"))
        self.turns = timed.select(*turns.columns, "project_id", state.alias("link_state"), F.when(by_hand_, 1.0).otherwise(F.col("confidence")).alias("project_confidence"), candidates.alias("candidate_project_ids"))

        self.projects = identities(projects, observations, links).unionByName(manual.join(projects, "project_id", "left_anti").withColumns({"state": F.lit("committed"), "reason": F.lit("manual_override"), "confidence": F.lit(1.0), "platforms": F.array().cast("array<string>"), "hosts": F.array().cast("array<string>")}), allowMissingColumns=True)
        counts = self.turns.where("project_id IS NOT NULL").groupBy("project_id").agg(
            F.count_if(F.col("link_state") == "committed").alias("committed_turns"), F.count_if(F.col("link_state") == "candidate").alias("candidate_turns"), F.countDistinct("session_id").alias("sessions"), F.max("last_context_activity_at").alias("_last"))
        manual_ids = overrides.select("project_id", F.lit(True).alias("manual")).distinct()
        out = self.projects.join(counts, "project_id", "left").join(manual_ids, "project_id", "left").withColumn("manual", F.coalesce("manual", F.lit(False)))
        zero = F.lit(0).cast("long")
        self.projects = out.withColumns({
            "state": F.when(F.col("manual"), "committed").otherwise(F.col("state")),
            "reason": F.when(F.col("manual"), "manual_override").otherwise(F.col("reason")),
            "committed_turns": F.coalesce("committed_turns", zero),
            "candidate_turns": F.coalesce("candidate_turns", zero),
            "sessions": F.coalesce("sessions", zero),
            "last_activity_at": F.greatest("updated_at", "_last"),
        }).drop("_last")

    def session_projects(self) -> DataFrame:
        """(session_id, primary_project_id): the project of its latest committed turn, else of its latest linked one; of turns at once the smallest id's."""
        own = self.turns.where("project_id IS NOT NULL")
        order = [F.desc(F.col("link_state") == "committed"), F.desc("last_context_activity_at"), "id"]
        return keep(own, ["session_id"], order).select("session_id", F.col("project_id").alias("primary_project_id"))

    def review(self) -> dict[str, DataFrame]:
        """The lists of a linking review, each in its order."""
        recent = [F.desc("confidence"), F.desc_nulls_last("last_activity_at"), "project_id"]
        return {
            "committed_projects": self.projects.where("state = 'committed'").orderBy(F.desc_nulls_last("last_activity_at"), "project_id"),
            "candidate_projects": self.projects.where("state = 'candidate'").orderBy(*recent),
            "unlinked_turns": self.turns.where("link_state = 'unlinked'").orderBy(F.desc("submission_started_at"), "id"),
            "candidate_turns": self.turns.where("link_state = 'candidate'").orderBy(F.desc(F.coalesce("project_confidence", F.lit(0.0))), F.desc("submission_started_at"), "id"),
            "observations": self.observations.orderBy(F.desc("observed_at"), "id"),
        }
