"""Two-stage linking against a loop over observations, and the cases of its rules."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from turnloom.operators import linking as L

OBSERVED = "id string, session_ref string, observed_at string, source_platform string, host_id string, workspace_path string, repo_root string, repo_remote string, repo_fingerprint string, source_native_project_ref string"
TURNS = "id string, session_id string, last_context_activity_at string, submission_started_at string"
OVERRIDES = "target_kind string, target_ref string, project_id string, display_name string, created_at string, updated_at string"
FIELDS = [c.split()[0] for c in OBSERVED.split(", ")]


def observed(**more):
    return {"id": "o1", "session_ref": "s1", "observed_at": "2024-01-01", "source_platform": "codex", "host_id": "h", **more}


def linked(spark, observations, turns=(), overrides=()):
    rows = [tuple(o.get(f) for f in FIELDS) for o in observations]
    return L.Linked(spark.createDataFrame(rows, OBSERVED).repartition(2), spark.createDataFrame(list(turns), TURNS), spark.createDataFrame(list(overrides), OVERRIDES))


def rules_by_hand(o):
    host, path, root, remote, print_, native = (o.get(k) or None for k in ("host_id", "workspace_path", "repo_root", "repo_remote", "repo_fingerprint", "source_native_project_ref"))
    sub = None if not path or not root else "." if path == root else path[len(root) + 1 :] or "." if path.startswith(root + "/") else None
    place = sub or path
    weak = bool(path) and (path in ("/root", "/tmp") or path.startswith("/tmp/") or path.rsplit("/", 1)[-1] in ("tmp", "temp", "scratchpad"))
    sure = [(0, 0.95, f"fingerprint:{print_}|workspace:{place}") if print_ and place else None, (1, 0.85, f"host:{host}|remote:{remote}|workspace:{place}") if remote and host and place else None, (2, 0.82, f"host:{host}|repo_root:{root}|workspace:{place}") if root and host and place else None]
    maybe = [(3, 0.7, f"host:{host}|native:{native}") if native and host else None, ((5, 0.42) if weak else (4, 0.55)) + (f"host:{host}|workspace:{path}",) if path and host else None, (6, 0.6, f"host:{host}|remote_hint:{remote}") if remote and host else None]
    return [r for r in sure if r] or [r for r in maybe if r]


def groups_by_hand(observations):
    """{id: project} and {project: (state, priority, confidence)}."""
    found = {o["id"]: rules_by_hand(o) for o in observations}
    root = {i: i for i, r in found.items() if r}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    for i, r in found.items():
        for _, _, key in r:
            a, b = top(first.setdefault(key, i)), top(i)
            root[max(a, b)] = min(a, b)
    projects, of = {}, {}
    for c in {top(i) for i in root}:
        own = [o for o in observations if o["id"] in root and top(o["id"]) == c]
        seen = Counter(k for o in own for k in {r[2] for r in found[o["id"]]})
        every = {r for o in own for r in found[o["id"]]}
        p, worth, key = min(every, key=lambda r: (seen[r[2]] < 2, r[0], -r[1], r[2]))
        n, wide, rooted = len({o["session_ref"] for o in own}), len({o["source_platform"] for o in own}), any(o.get("repo_root") for o in own)
        state = "committed" if p < 3 or p == 4 and n > 1 else "candidate"
        base, two, three, plat, repo, low, high = {3: (0.72, 0.08, 0.04, 0.03, 0, 0.72, 0.87), 4: (0.68, 0.12, 0.05, 0.03, 0.03, 0.68, 0.88), 5: (0.42, 0.08, 0.04, 0.03, 0, 0.42, 0.6), 6: (0.6, 0.08, 0, 0.04, 0, 0.6, 0.78)}.get(p, (worth, 0, 0, 0, 0, 0, 1))
        score = round(min(high, max(low, base + two * (n > 1) + three * (n > 2) + plat * (wide > 1) + repo * rooted)) + 1e-9, 2)
        name = "project-" + hashlib.sha1(key.encode()).hexdigest()[:12]
        projects[name] = (state, p, score)
        of |= {o["id"]: name for o in own}
    return of, projects


def test_groups_of_random_observations(spark):
    rng = random.Random(6)
    pick = lambda *x: rng.choice([None, None, "", *x])
    rare = lambda c: rng.choice([None, "", None, None, None, *(f"{c}{k}" for k in range(4))] if rng.random() < 0.3 else [None])
    own = []
    for i in range(150):
        root = pick("/r/a", "/r/b")
        own.append(observed(id=f"o{i:03d}", session_ref=f"s{rng.randrange(30)}", source_platform=rng.choice(["codex", "amp"]), host_id=pick("h", "g"), workspace_path=pick("/tmp", "/tmp/x", "/w/tmp", f"/w/{rng.randrange(12)}", *([root, f"{root}/in", f"{root}/"] if root else [])), repo_root=root, repo_remote=rare("m"), repo_fingerprint=rare("f"), source_native_project_ref=rare("n")))
    of, projects = groups_by_hand(own)
    got = linked(spark, own)
    assert {r.id: r.project_id for r in got.observations.collect()} == {o["id"]: of.get(o["id"]) for o in own}
    assert {r.project_id: (r.state, L.REASONS.index(r.reason), r.confidence) for r in got.projects.collect()} == projects
    assert len({s for s, _, _ in projects.values()}) == 2 and len({p for _, p, _ in projects.values()}) >= 5


def test_identity(spark):
    base = {"workspace_path": "/r/a/sub", "repo_root": "/r/a", "repo_remote": "https://x/y/my%20repo//", "repo_fingerprint": "f"}
    own = [observed(id=f"o{i}", observed_at=f"2024-01-0{i}", source_platform=p, host_id=h, **base) for i, p, h in ((1, "codex", "h2"), (2, "amp", "h1"), (3, "codex", None))]
    own += [observed(id="w", workspace_path="/w/Plain Name"), observed(id="n", workspace_path=None, source_native_project_ref="native"), observed(id="r", workspace_path="/")]
    by = {r.display_name: r for r in linked(spark, own).projects.collect()}
    r = by["my repo/sub"]
    assert (r.primary_workspace_path, r.repo_root, r.platforms, r.hosts, r.created_at, r.updated_at, r.state) == ("/r/a/sub", "/r/a", ["amp", "codex"], ["h1", "h2"], "2024-01-01", "2024-01-03", "committed")
    assert r.slug == f"my-repo-sub-{r.project_id[-6:]}" and by["Plain Name"].slug.startswith("plain-name-") and set(by) == {"my repo/sub", "Plain Name", "native", "/"} and by["/"].slug.startswith("project-")


def test_turns_sessions_and_overrides(spark):
    own = [
        observed(id="a", observed_at="2024-01-02", workspace_path="/w/a"), observed(id="b", observed_at="2024-01-05", workspace_path="/w/b"), observed(id="c", session_ref="s2", workspace_path="/w/b"),
        observed(id="d", session_ref="s3", workspace_path="/w/d"), observed(id="e", session_ref="s4"), observed(id="f", session_ref="s5", workspace_path="/w/f"),
    ]
    turns = [("t1", "s1", "2024-01-01", "1"), ("t2", "s1", "2024-01-03", "2"), ("t3", "s1", "2024-01-05", "3"), ("t4", "s3", "2024-01-09", "4"), ("t5", "s4", "2024-01-09", "5"), ("t6", "s5", "2024-01-01", "6"), ("t7", "s9", None, "7"), ("t8", "s5", "2024-01-02", "8")]
    rules = [("turn", "t6", "hand", "By Hand", "2024-02-01", "2024-02-02"), ("session", "s3", "hand", "By Hand", "2024-02-01", "2024-02-02"), ("observation", "f", "other", "", "2024-02-03", "2024-02-04")]
    got = linked(spark, own, turns, rules)
    name = {r.primary_workspace_path: r.project_id for r in got.projects.collect()}
    a, b = name["/w/a"], name["/w/b"]
    assert {r.id: (r.project_id, r.link_state, r.project_confidence, r.candidate_project_ids) for r in got.turns.collect()} == {
        "t1": (a, "candidate", 0.68, sorted([a, b])), "t2": (a, "candidate", 0.68, sorted([a, b])), "t3": (b, "committed", 0.8, None),
        "t4": ("hand", "committed", 1.0, ["hand"]), "t5": (None, "unlinked", None, None), "t6": ("hand", "committed", 1.0, ["hand"]), "t7": (None, "unlinked", None, None), "t8": ("other", "committed", 1.0, None),
    }
    assert {r.session_id: r.primary_project_id for r in got.session_projects().collect()} == {"s1": b, "s3": "hand", "s5": "other"}
    projects = {r.project_id: r for r in got.projects.collect()}
    assert (projects["hand"].committed_turns, projects["hand"].sessions, projects["hand"].slug, projects["hand"].last_activity_at, projects["hand"].reason) == (2, 2, "by-hand-hand", "2024-02-02", "manual_override")
    assert (projects[a].candidate_turns, projects[a].sessions, projects[a].last_activity_at) == (2, 1, "2024-01-03") and projects["other"].slug == "project-other"
    lists = {k: [r[0] for r in v.collect()] for k, v in got.review().items()}
    assert lists["unlinked_turns"] == ["t7", "t5"] and lists["candidate_turns"] == ["t2", "t1"] and lists["committed_projects"][:2] == ["other", "hand"] and a in lists["candidate_projects"] and lists["observations"][0] == "b"


def test_nothing_to_link(spark):
    got = linked(spark, [], [("t", "s", "1", "1")])
    assert [r.link_state for r in got.turns.collect()] == ["unlinked"] and got.projects.collect() == [] and got.session_projects().collect() == []


def test_weak_paths(spark):
    paths = ["/root", "/ROOT", "/tmp", "/tmp/x", "/a/TEMP", "/a/scratchpad", "/a/codex-temp-1", "/x/.config/AionUi/aionui/claude-temp-9/in", "/roots", "/a/tmp/b", "/w/a"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", L.weak_path(F.col("p")).alias("w")).collect()
    assert [r.w for r in rows] == [True] * 8 + [False] * 3


def test_observations_of_one_file_are_dealt_out(spark):
    rows = [observed(id=f"o{i}", workspace_path=f"/w/{i % 7}") for i in range(200)]
    one = spark.createDataFrame([tuple(o.get(f) for f in FIELDS) for o in rows], OBSERVED).coalesce(1)
    out = L.Linked(one, spark.createDataFrame([], TURNS), spark.createDataFrame([], OVERRIDES))
    held = [f for f in out.observations.inputFiles() if "turnloom-observations-" in f]
    assert len(held) == int(spark.conf.get("spark.sql.shuffle.partitions")) and out.observations.count() == 200
