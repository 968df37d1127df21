"""Collection, deletion, tombstones, rebuild scopes and variants, on small stores and against loops."""

import random
from dataclasses import fields

from turnloom.operators import lifecycle as L
from turnloom.operators import variants

KINDS = {
    "turns": "turn_id string, revision_id string, source_id string, session_id string, project_id string, link_state string, submitted_at string, last_activity_at string, value_axis string, retention_axis string, blob_refs array<string>, candidate_refs array<string>",
    "contexts": "turn_id string", "sessions": "session_id string, updated_at string, turn_count long", "observations": "id string, session_id string, project_id string", "blobs": "blob_id string, source_id string",
    "overrides": "id string, project_id string, target_ref string", "audits": "id string, session_id string, candidate_id string, blob_id string", "artifacts": "artifact_id string, revision int, project_id string, turn_refs array<string>", "tombstones": L.TOMBSTONE,
}


def turn(i, session, project, blobs=(), state="candidate", at="2024-01-01"):
    return (i, f"{i}:r1", "s", session, project, state, at, at, "active", "keep", list(blobs), [f"c{i}"])


def store(spark, **tables):
    return L.History(**{k: spark.createDataFrame(tables.get(k, []), v) for k, v in KINDS.items()})


def seen(history):
    return {f.name: sorted(map(str, getattr(history, f.name).collect())) for f in fields(history)}


def ids(rows, key):
    return sorted(r[key] for r in rows.collect())


def small(spark):
    return store(
        spark,
        turns=[turn("t1", "a", "p", ["b1", "b2"]), turn("t2", "a", "q", ["b2"], at="2024-02-01"), turn("t3", "c", "p", ["b3"], "committed"), turn("t4", "d", None, None or []), ("t5", "t5:r1", "s", None, "q", None, None, None, "active", "keep", None, None)],
        contexts=[("t1",), ("t2",), ("t3",)],
        sessions=[("a", "2024-03-01", 9), ("c", "2024-03-01", 9), ("d", "2024-03-01", 9)],
        observations=[("o1", "a", "p"), ("o2", "c", "q"), ("o3", "d", None)],
        blobs=[("b1", "s"), ("b2", "s"), ("b3", "s"), ("b4", "s")],
        overrides=[("v1", "p", "x"), ("v2", "q", "t1"), ("v3", "q", "c"), ("v4", "q", "o1"), ("v5", "q", "a"), ("v6", None, None)],
        audits=[("a1", "c", None, None), ("a2", "a", "ct1", None), ("a3", "a", None, "b1"), ("a4", "a", "ct2", "b2"), ("a5", None, "o1", None), ("a6", None, None, None)],
        artifacts=[("k1", 1, "p", ["t2"]), ("k2", 1, "q", ["t1", "t3"]), ("k3", 4, "q", ["t1", "t2"]), ("k4", 1, "q", ["t2"]), ("k5", 1, None, [])],
    )


def test_project_deletion_cascades_and_repeats(spark):
    out = L.delete_project(small(spark), "p", "asked", "2024-06-01", "p:r3")
    assert ids(out.turns, "turn_id") == ["t2", "t4", "t5"] and ids(out.contexts, "turn_id") == ["t2"] and ids(out.blobs, "blob_id") == ["b2", "b4"]
    assert sorted(map(tuple, out.sessions.collect())) == [("a", "2024-02-01", 1), ("d", "2024-03-01", 9)]
    assert ids(out.observations, "id") == ["o3"] and ids(out.overrides, "id") == ["v5", "v6"] and ids(out.audits, "id") == ["a4", "a6"]
    assert sorted((r.artifact_id, r.revision, r.turn_refs) for r in out.artifacts.collect()) == [("k3", 5, ["t2"]), ("k4", 1, ["t2"]), ("k5", 1, [])]
    assert sorted((r.object_kind, r.logical_id, r.last_revision_id) for r in out.tombstones.collect()) == [("artifact", "k1", "1"), ("artifact", "k2", "1"), ("project", "p", "p:r3"), ("turn", "t1", "t1:r1"), ("turn", "t3", "t3:r1")]
    assert seen(L.delete_project(out, "p", "again", "2025-01-01")) == seen(out)
    nothing = L.delete_project(small(spark), "nobody", "asked", "2024-06-01")
    assert seen(nothing) | {"tombstones": []} == seen(small(spark)) | {"tombstones": []} and ids(nothing.tombstones, "logical_id") == ["nobody"]


def test_purging_twice_is_purging_once(spark):
    wanted = spark.createDataFrame([("t1",), ("t3",), ("t1",), ("t9",), (None,)], "turn_id string")
    once = L.purge(small(spark), wanted, "manual", "2024-06-01")
    assert ids(once.turns, "turn_id") == ["t2", "t4", "t5"] and ids(once.blobs, "blob_id") == ["b2", "b4"] and ids(once.tombstones, "logical_id") == ["t1", "t3"]
    assert seen(L.purge(once, wanted, "again", "2025-01-01")) == seen(once)
    # A turn that came back doesn't show; its tombstone rules.
    assert ids(L.alive(small(spark).turns, once.tombstones, "turn", "turn_id"), "turn_id") == ["t2", "t4", "t5"]


def test_candidates_are_archived_or_purged(spark):
    old = L.collect_candidates(small(spark), "2024-02-01", "now")
    assert {r.turn_id: (r.value_axis, r.retention_axis) for r in old.turns.collect()} == {"t1": ("archived", "keep_raw_only"), "t2": ("active", "keep"), "t3": ("active", "keep"), "t4": ("archived", "keep_raw_only"), "t5": ("active", "keep")}
    gone = L.collect_candidates(small(spark), "2024-02-01", "now", "purge")
    assert ids(gone.turns, "turn_id") == ["t2", "t3", "t5"] and {(r.purge_reason, tuple(r.lineage_refs)) for r in gone.tombstones.collect()} == {("candidate_gc", ("ct1",)), ("candidate_gc", ("ct4",))}
    assert seen(L.collect_candidates(store(spark), "2024", "now", "purge")) == seen(store(spark))


def test_rebuild_scope_against_a_loop(spark):
    rng = random.Random(8)
    some = lambda c, n: rng.choice([None, "", *(f"{c}{k}" for k in range(n))])
    ledger = [(some("s", 4), f"p{i}", some("b", 12), some("f", 3)) for i in range(15)]
    spans = [(f"r{i}", some("s", 4), some("b", 12), some("n", 20), some("f", 9)) for i in range(25)]
    turns = [(f"t{i}", some("s", 4), some("n", 20), some("j", 9)) for i in range(20)]
    contexts = [(f"t{i}", some("s", 9)) for i in range(0, 20, 2)]
    caches = [(f"c{i}", some("s", 9), *rng.choice([("session", some("n", 20)), ("origin_path", some("p", 15)), ("source", some("s", 9)), ("odd", "x")]), some("f", 9)) for i in range(25)]
    frame = lambda rows, kind: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in kind.split()))
    rows = L.scope_rows(frame(ledger, "source_id origin_path blob_id profile"), frame(spans, "record_id source_id blob_id session_id profile"), frame(turns, "turn_id source_id session_id project_id"), frame(contexts, "turn_id source_id"), frame(caches, "id source_id scope_kind scope_ref profile"))

    def looped(source=(), origin=(), session=(), project=(), passes=None):
        L_, S, T, C, K = (set() for _ in range(5))
        keys = {("origin", o) for o in origin} | {("session", n) for n in session}
        for x in source:
            L_ |= {r for r in ledger if r[0] == x}
            S |= {r for r in spans if r[1] == x}
            T |= {r for r in turns if r[1] == x}
            C |= {r for r in contexts if r[1] == x}
            K |= {r for r in caches if r[1] == x}
        L_ |= {r for r in ledger if r[1] in origin}
        T |= {r for r in turns if r[3] in project}
        while True:
            before = (len(L_), len(S), len(T), len(C), len(K), len(keys))
            keys |= {("source", r[0]) for r in L_} | {("origin", r[1]) for r in L_} | {("source", r[1]) for r in S | T | C | K} | {("session", r[3]) for r in S} | {("session", r[2]) for r in T} | {("session" if r[2] == "session" else "origin", r[3]) for r in K if r[2] in ("session", "origin_path")}
            keys = {k for k in keys if k[1]}
            blobs = {(r[0], r[2]) for r in L_} | {(r[1], r[2]) for r in S}
            blobs = {b for b in blobs if b[0] and b[1]}
            L_ |= {r for r in ledger if (r[0], r[2]) in blobs}
            S |= {r for r in spans if (r[1], r[2]) in blobs or ("session", r[3]) in keys}
            T |= {r for r in turns if ("session", r[2]) in keys}
            C |= {r for r in contexts if r[0] in {t[0] for t in T}}
            K |= {r for r in caches if r[3] and ({"session": "session", "origin_path": "origin", "source": "source"}.get(r[2]), r[3]) in keys}
            if before == (len(L_), len(S), len(T), len(C), len(K), len(keys)):
                break
        return sorted([("ledger", "|".join(x for x in r[:2] if x is not None)) for r in L_] + [("span", r[0]) for r in S] + [("turn", r[0]) for r in T] + [("context", r[0]) for r in C] + [("cache", r[0]) for r in K])

    for asked in ({"session": ["n1"]}, {"origin": ["p0", "p3"]}, {"source": ["s1"]}, {"project": ["j2", "j3"]}, {"session": ["never"]}):
        assert sorted(map(tuple, L.rebuild_scope(rows, L.seeds(spark, **asked), None).collect())) == looped(**asked)
    near = L.rebuild_scope(rows, L.seeds(spark, session=["n1"]), 0).collect()
    assert {r.kind for r in near} <= {"span", "turn", "cache"} and L.rebuild_scope(rows, L.seeds(spark)).collect() == []


def test_variants_against_a_loop(spark):
    rng = random.Random(5)
    words = "please write the tests for our new parser and its errors quickly now".split()
    rows = []
    for s in range(6):
        clock = 1_704_067_200
        for i in range(40):
            clock += rng.choice([0, 30, 300, 700])
            who = rng.choice(["user", "user", "user", "assistant", "system"])
            text = rng.choice([None, "", " ".join(rng.sample(words, rng.randrange(4, 12))), "Write **the** `tests` for our new parsers", "write the test for our new parser"])
            time = rng.choice(["soon", None]) if rng.random() < 0.05 else __import__("datetime").datetime.fromtimestamp(clock, __import__("datetime").UTC).isoformat().replace("+00:00", "Z")
            rows.append((f"s{s}", i, who, who == "user" and rng.random() < 0.95, "text", rng.choice(["show", "show", "hide", None]), text, time))
    want, last = [], {}
    for r in rows:
        s, i, who, is_turn, _, policy, text, time = r
        if who == "assistant" and policy != "hide":
            last[s] = None
        if is_turn:
            if last.get(s) and variants.likeness(last[s][0], text) and variants._seconds(last[s][1], time) <= 600:
                continue
            last[s] = (text, time)
        want.append((s, i))
    df = spark.createDataFrame(rows, "session string, seq_no long, actor_kind string, is_turn boolean, kind string, display_policy string, text string, time_key string").repartition(3)
    got = sorted((r.session, r.seq_no) for r in variants.collapse(df).collect())
    assert got == sorted(want) and len(want) < len(rows)
    assert variants.collapse(df.limit(0)).collect() == []


def test_likeness():
    like = variants.likeness
    assert like("Do **it**", "do it") and like("write the parser tests quickly", "write parser test quick") is False
    assert like("write parser tests for errors", "write the parser test for error now") and not like("one two", "one three") and not like(None, "") and not like("", "x")
    assert like("please rename all of the files", "well: please rename all of the files, and more words that don't matter at all here")


def test_parts_of_a_deletion_do_not_share_tasks(spark):
    # A union's branches that still sort share a stage's tasks, so whole tables meet in a few.
    from turnloom.plans import lifecycle as plans

    for query in (plans._delete, plans._purge):
        assert "Exchange" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
