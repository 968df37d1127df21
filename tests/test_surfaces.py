"""Exports, verdicts on origins, page tokens, projects shown, path texts, related work and reports on odd rows."""

import base64
import datetime
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnloom.operators import relate, reports, search, surface
from turnloom.sources import exports, store


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def written(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def test_export_of_lines_in_order(spark, tmp_path):
    turns = spark.createDataFrame([("b", "two\nlines \"quoted\""), ("a", None), (None, "no id"), ("a", None)], "id string, `odd name` string").repartition(3)
    host = spark.createDataFrame([("h",)], "name string")
    lines = exports.json_lines(spark, {"turn": turns, "source": turns.limit(0)}, {"turn": "id", "source": "id"}, host, "own.v1")
    exports.write(lines, str(tmp_path / "out"))
    said = [json.loads(x) for x in written(tmp_path / "out").splitlines()]
    assert [(x["kind"], x.get("value")) for x in said] == [
        ("manifest", None), ("host", {"name": "h"}), ("turn", {"odd name": "no id"}), ("turn", {"id": "a"}), ("turn", {"id": "a"}), ("turn", {"id": "b", "odd name": "two\nlines \"quoted\""}),
    ]
    assert {x["schema"] for x in said} == {"own.v1"}
    with pytest.raises(ValueError, match="trun"):
        exports.json_lines(spark, {"trun": turns}, {"trun": "id"})


def test_export_as_markdown(spark, tmp_path):
    turns = spark.createDataFrame([("2024", "b", "x\n\ny"), ("2023", "c", None), ("2024", "a", ""), ("2024", "a", "")], "submission_started_at string, id string, canonical_text string").repartition(3)
    exports.write(exports.markdown_lines(spark, {"turn": turns, "project": turns.limit(0)}), str(tmp_path / "out"))
    text = written(tmp_path / "out")
    assert text.startswith("# Export\n\nSchema: `turnloom.export.v1`\n\n> One-way") and "- Projects: 0\n- Sessions: 0\n- Turns: 4\n- Related work: 0\n\n## Turns\n\n" in text
    assert text.split("## Turns\n\n")[1] == "### 2023 · c\n\n\n\n" + "### 2024 · a\n\n\n\n" * 2 + "### 2024 · b\n\nx\n\ny\n\n"
    empty = exports.markdown_lines(spark, {})
    assert empty.where("value LIKE '- %: 0'").count() == 5


HELD = "source_id string, origin string, session string, text string"


def test_failed_sibling_keeps_what_a_session_held(spark, tmp_path):
    path = str(tmp_path / "store")
    held = [("s", "a", "one", "old a"), ("s", "b", "one", "old b"), ("s", "c", "two", "old c"), ("s", "d", None, "old d"), ("s", "e", None, "old e"), ("t", "a", "one", "other source")]
    store.merge_by_origin(spark.createDataFrame(held, HELD), path)
    new = [("s", "a", "one", "new a"), ("s", "b", "one", "half read"), ("s", "c", "two", "new c"), ("s", "d", None, "new d"), ("s", "f", "one", "first"), ("s", "c", "two", "new c")]
    bad = spark.createDataFrame([("s", "b"), ("s", "e"), ("s", "b"), ("t", "z")], "source_id string, origin string")
    told = store.merge_unless_vetoed(spark.createDataFrame(new, HELD), bad, path)
    assert rows(told) == [("s", "a", "veto"), ("s", "b", "failed"), ("s", "c", "replace"), ("s", "d", "replace"), ("s", "e", "failed"), ("s", "f", "replace"), ("t", "z", "failed")]
    now = {(r.source_id, r.origin): r.text for r in spark.read.parquet(path).collect()}
    assert now == {("s", "a"): "old a", ("s", "b"): "old b", ("s", "c"): "new c", ("s", "d"): "new d", ("s", "e"): "old e", ("s", "f"): "first", ("t", "a"): "other source"}
    assert spark.read.parquet(path).where("origin = 'c'").count() == 2
    # Once the sibling is read well, all of the session is replaced.
    store.merge_unless_vetoed(spark.createDataFrame(new[:2], HELD), bad.limit(0), path)
    assert {r.text for r in spark.read.parquet(path).where("session = 'one' AND source_id = 's'").collect()} == {"new a", "half read", "first"}


def test_page_tokens():
    assert search.offset_of(search.page_token(0)) == 0 == search.offset_of(None) == search.offset_of("") and search.offset_of(search.page_token(12345)) == 12345
    assert json.loads(base64.urlsafe_b64decode(search.page_token(7) + "==")) == {"v": 1, "offset": 7}

    def token(said):
        return base64.urlsafe_b64encode(json.dumps(said).encode()).decode().rstrip("=")

    for bad in ("?", "abc", "é", token([1]), token({"offset": 1}), token({"v": 2, "offset": 1}), token({"v": True, "offset": 1}), token({"v": 1, "offset": -1}), token({"v": 1, "offset": "1"}), token({"v": 1, "offset": True})):
        with pytest.raises(ValueError, match="page token"):
            search.offset_of(bad)


def test_pages_by_tokens_hold_every_row_once(spark):
    found = spark.createDataFrame([(i, float(i % 3), None if i % 5 == 0 else i % 4) for i in range(23)], "id int, score double, seen int")
    got, token = [], None
    while True:
        page, token = search.token_page(found, search.by_relevance("seen", "id"), token, 5)
        own = [r.id for r in page.collect()]
        if not own:
            break
        got += own
    want = sorted(range(23), key=lambda i: (-(i % 3), i % 5 == 0, 0 if i % 5 == 0 else -(i % 4), i))
    assert got == want


def test_path_texts(spark):
    cases = [("/a/b", ["/a/b", None, "c", " "]), (None, None), ("", []), ("/", ["//"]), ("C:\\x\\y", ["y", "C:/x/y/"]), ("\u00a0/p q/ ", None)]
    own = spark.createDataFrame(cases, "one string, more array<string>")
    got = [r.t for r in own.select(surface.path_text(surface.one_path(F.col("one")), F.col("more")).alias("t")).collect()]
    assert got == ["/a/b b c", None, None, "/ //", "C:/x/y y C:/x/y/", "/p q/ p q"]


def test_native_reference_only_where_there_is_one(spark):
    blobs = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "a"), (2, "b"), (3, ""), (3, None), (None, "x")], "s int, r string")
    assert rows(surface.native_project_ref(blobs, "s", F.col("r"))) == [(1, "a"), (2, None), (3, None), (None, "x")]
    assert surface.native_project_ref(blobs.limit(0), "s", F.col("r")).count() == 0


def test_project_shown(spark):
    turns = spark.createDataFrame([(1, "s", "p"), (2, "s", None), (3, "s", "gone"), (4, "u", None), (5, None, None), (None, "s", None), (1, "s", "p"), (6, "w", None)], "id long, session_id string, project_id string")
    projects = spark.createDataFrame([("p",), ("q",), ("r",), ("r",), (None,)], "project_id string")
    rules = spark.createDataFrame([("turn", "1", "q"), ("turn", "2", "gone"), ("session", "s", "r"), ("session", "s", "p"), ("session", None, "p")], "kind string, ref string, project_id string")
    sessions = spark.createDataFrame([("s", "p"), ("u", "q"), ("w", "gone"), (None, "p")], "session_id string, project_id string")
    got = rows(surface.resolve_project(turns.withColumn("id", F.col("id").cast("string")), projects, rules, sessions), "id", "shown_project")
    assert got == [("1", "q"), ("1", "q"), ("2", "r"), ("3", "r"), ("4", "q"), ("5", None), ("6", None), (None, "r")]
    assert surface.resolve_project(turns.withColumn("id", F.col("id").cast("string")), projects.limit(0), rules, sessions).where("shown_project IS NOT NULL").count() == 0


def fold(entries):
    """The same by a loop over one key's entries in order."""
    out = None
    for created, updated, refs, status, detail, tool in entries:
        refs, detail = [r for r in refs or [] if r is not None], {k: v for k, v in (detail or {}).items() if v is not None}
        if out is None:
            out = [created, updated, list(dict.fromkeys(refs)), status, detail, tool]
            continue
        out[0], out[1] = min(out[0], created), max(out[1], updated)
        out[2] = list(dict.fromkeys(out[2] + refs))
        out[3], out[4], out[5] = status if status is not None else out[3], out[4] | detail, out[5] if out[5] is not None else tool
    return tuple(out)


def test_related_work_merges_like_a_loop(spark):
    deal = random.Random(5)
    entries = []
    for at in range(160):
        refs = deal.choice([None, [], [deal.choice("abcd"), None, deal.choice("abcd")]])
        detail = deal.choice([None, {}, {deal.choice("xyz"): deal.choice(["1", "2", None])}])
        entries.append((deal.choice(["k", "l", "", None]), at, deal.randrange(99), deal.randrange(99), refs, deal.choice([None, "ok", "bad"]), detail, deal.choice([None, None, "t"])))
    kind = "key string, at int, created_at int, updated_at int, fragment_refs array<string>, status string, raw_detail map<string,string>, parent_tool_ref string"
    own = spark.createDataFrame(entries, kind).repartition(5)
    got = {r.key: (r.created_at, r.updated_at, r.fragment_refs, r.status, r.raw_detail, r.parent_tool_ref) for r in surface.merge_related(own, ["key"], ["at"], first=("parent_tool_ref",)).collect()}
    assert got == {k: fold([e[2:] for e in entries if e[0] == k]) for k in ("k", "l", "", None)}
    assert surface.merge_related(own.limit(0), ["key"], ["at"], first=("parent_tool_ref",)).count() == 0


def test_edges_of_atoms_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (3, 1), (3, 4), (None, 1), (1, None), (3, 4), (1, 2)], "a int, b int")
    atoms = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    assert rows(relate.edges_of(edges, atoms, "a", "b", "id")) == sorted([(1, 2), (1, 2), (2, 1), (1, 1), (3, 1), (None, 1), (1, None)], key=str)
    assert relate.edges_of(edges, atoms.limit(0), "a", "b", "id").count() == 0


def test_picks_and_reports_on_odd_rows(spark):
    own = spark.createDataFrame([("g", 1, 5, "é"), ("g", 2, 5, "é"), ("g", 3, None, None), (None, 4, 1, ""), ("h", 5, None, "x")], "g string, id int, v int, t string")
    assert rows(reports.last_of(own, ["g"], ["v", "id"], "t")) == [("g", "é"), ("h", "x"), (None, "")]
    assert rows(reports.keep_max(own, ["g"], "v", "id", "place")) == [("g", 1, 5, 1), ("h", 5, None, 5), (None, 4, 1, 4)]
    assert rows(reports.inventory(own, "g", "t")) == [("g", 3, 4, 2), ("h", 1, 1, 1), (None, 1, 0, 0)]
    assert rows(reports.largest(own, "g", "id", "t", 2)) == [("g", 1, 2, 1), ("g", 2, 2, 2), ("h", 5, 1, 1), (None, 4, 0, 1)]
    assert rows(reports.summary(own, "g")) == [("all", 5), ("g", 3), ("h", 1), ("none", 1)]
    assert rows(reports.stage_stats(own, "g", F.col("v") > 4, ["g", "new", "new"])) == [("g", 3, 2), ("h", 1, 0), ("new", 0, 0), (None, 1, 0)]
    assert rows(reports.counts({"a": own, "b": own.limit(0)})) == [("a", 5), ("b", 0)]
    assert rows(relate.last_before(own.where("g = 'g'"), ["g"], ["id"], F.col("v"), "before"), "id", "before") == [(1, None), (2, 5), (3, 5)]
    assert rows(relate.only_with(own, "g", own, own.where("g = 'h'")), "id") == [(1,), (2,), (3,)]
    nothing = own.limit(0)
    assert rows(reports.drift(nothing, F.col("v") > 0, nothing, F.col("v") > 0)) == [(0, 0.0, 0, 0.0, 1.0)]
    assert all(r.count() == 0 for r in (reports.last_of(nothing, ["g"], ["v"], "t"), reports.largest(nothing, "g", "id", "t"), reports.top_labels(nothing, "g", "t", 2)))
    dated = spark.createDataFrame([(datetime.date(2024, 3, 1),), (datetime.date(2024, 2, 28),), (None,), (datetime.date(2024, 1, 1),)], "d date")
    assert rows(reports.timeline(dated, "d", 3)) == [("2024-02-28", 1, 1), ("2024-02-29", 0, 1), ("2024-03-01", 1, 2)] and reports.timeline(dated.limit(0), "d").count() == 0
    assert rows(reports.recount(own.select("g").distinct(), "g", {"n": (own, "g", None), "texts": (own, "g", "t"), "none": (nothing, "g", None)})) == [("g", 3, 1, 0), ("h", 1, 1, 0), (None, 0, 0, 0)]
    assert rows(surface.recent(own, "v", "id", 2), "id") == [(1,), (2,)]
