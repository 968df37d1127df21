"""Derivation, linking, text functions, sources and streaming on literal rows."""

import json
from datetime import datetime, timedelta, timezone

import pytest

from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.time import since_day, start_of_day, start_of_month, start_of_week
from turnloom.functions.user_text import split_user_text
from turnloom.operators import derive, linking, relate, search, usage
from turnloom.sources import jsonl, store
from turnloom.streaming import sessions


def groups_of(spark, line):
    kinds = {"U": ("user", "user_authored"), "I": ("user", "injected"), "A": ("assistant", "assistant_authored"), "S": ("system", "source_meta")}
    rows = [("s", i, *kinds[c], "hidden" if c == "S" else "show", c) for i, c in enumerate(line.replace(" ", ""))]
    atoms = spark.createDataFrame(rows, "session string, seq_no int, actor_kind string, origin_kind string, display_policy string, text string")
    return [r.group_index for r in derive.submission_groups(atoms).orderBy("seq_no").collect()]


def test_submission_groups(spark):
    assert groups_of(spark, "UA UA") == [0, 1]
    assert groups_of(spark, "UUA U") == [0, 0, 1]
    assert groups_of(spark, "U A I U") == [0, 0, 1]
    assert groups_of(spark, "I U A U") == [0, 0, 1]
    assert groups_of(spark, "A U S U") == [0, 0]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_path_identity(spark):
    cases = {"file:///c/x": "/c/x", "/a//b/./c/../d/": "/a/b/d", "/": "/", "  ": None, "C:\\Work\\A": "c:/Work/A", "\\\\host\\share\\x": "//host/share/x", "file:///tmp/a%20b": "/tmp/a b", "/tmp/a%20b": "/tmp/a b", "\\\\server\\share\\project\\": "//server/share/project", "file://server/share/folder%20name": "//server/share/folder name", "file://localhost/x/y": "/x/y", "file:///C:/Work": "c:/Work", "file://C:/Work/": "c:/Work", "../a/../../b": "../../b", "a/..": ".", "/../x": "/x", "C:": "c:/", "50%zz": "50%zz"}
    for raw, wanted in cases.items():
        assert one(spark, T.path_identity(F.lit(raw))) == wanted, raw


def test_text_functions(spark):
    assert one(spark, T.fnv1a(F.lit("a"))) == "e40c292c"
    assert one(spark, T.slugify(F.lit("--My Project! 2"))) == "my-project-2"
    assert one(spark, T.git_remote(F.lit("git@host.example:team/repo.git"))) == "ssh://git@host.example/team/repo"
    assert one(spark, T.decode_uri(F.lit("a+b%20c"))) == "a+b c"
    assert one(spark, T.decode_uri(F.lit("50%zz"))) == "50%zz"
    assert one(spark, T.stable_id(F.lit("a"), F.lit(None).cast("string"))) == one(spark, F.sha1(F.lit("a::")))


def test_masks(spark):
    key = "sk-" + "a1" * 12
    text = f"Hi  \n\n\n\n<INSTRUCTIONS>use {key}</INSTRUCTIONS> and {key}, Bearer abcdefghijklmnop.q"
    got = one(spark, T.segments(F.lit(text)))
    # What the block claims stays its own: the key in it is no second region.
    assert [(s.type, s.mask_label) for s in got] == [("text", None), ("masked", "Instructions"), ("text", None), ("masked", "API Key"), ("text", None), ("masked", "Bearer Token")]
    assert "".join(s.original_content or s.content for s in got) == text and all(s.mask_char_count == len(s.original_content) for s in got if s.type == "masked")
    assert one(spark, T.canonical(F.lit(text))) == "Hi\n\n and ,"
    assert one(spark, T.canonical(F.lit("You are a helper\n\nUser: hello"), "system_message")) == "User: hello"
    assert one(spark, T.canonical(F.lit("You are a helper\n\nUser: hello"))) == "You are a helper\n\nUser: hello"
    assert [tuple(s)[:2] for s in one(spark, T.segments(F.lit(None).cast("string")))] == [("text", "")]


def test_small_text_functions(spark):
    assert one(spark, T.without_markup(F.lit("<command-name>/fix</command-name>\n<command-args>x</command-args> now"))) == "/fix now"
    assert one(spark, T.is_control_phrase(F.lit("  CONTINUE "))) and not one(spark, T.is_control_phrase(F.lit("continue on")))
    assert one(spark, T.coerce_iso(F.lit("2026-03-09T09:00:00+01:00"))) == "2026-03-09T08:00:00.000Z" and one(spark, T.coerce_iso(F.lit("soon"))) is None
    assert one(spark, T.min_iso(F.lit("2026"), F.lit(""))) == "2026" == one(spark, T.max_iso(F.lit("2025"), F.lit("2026")))
    for n in range(16_366, 16_390):
        text = "a" * (n % 4) + "é😀漢" * (n // 9)
        own = text.encode()
        cut = own[: 16_384 - 14].decode("utf-8", "ignore") + "...[truncated]"
        assert one(spark, T.bounded(F.lit(text))) == (text if len(own) <= 16_384 else cut), n


def test_windows_of_time():
    now = datetime(2026, 3, 4, 1, 30, tzinfo=timezone(timedelta(hours=9)))
    assert [since_day(v, now) for v in (None, "", "2h", "7d", "2W", "2026-03-01", "2026-02-28T20:00:00Z")] == [None, None, "2026-03-03", "2026-02-25", "2026-02-18", "2026-03-01", "2026-03-01"]
    assert (start_of_day(now), start_of_week(now), start_of_month(now)) == ("2026-03-04", "2026-03-02", "2026-03-01")
    with pytest.raises(ValueError):
        since_day("yesterday", now)


def test_split_user_text(spark):
    block = "<environment_context>\ncwd\n</environment_context>"
    cases = {
        None: [], " \n": [], "  do it \r\n now ": [("user_authored", "do it \n now")],
        "[Subagent Context] x": [("delegated_instruction", "[Subagent Context] x")], "[cron:1] y": [("automation_trigger", "[cron:1] y")],
        "<command-name>/clear</command-name><command-args></command-args>": [("injected_user_shaped", "<command-name>/clear</command-name><command-args></command-args>")],
        "<command-name>/review</command-name> <command-args>the plan</command-args>": [("injected_user_shaped", "<command-name>/review</command-name> <command-args>the plan</command-args>"), ("user_authored", "the plan")],
        "<command-name>/review</command-name> and more": [("user_authored", "<command-name>/review</command-name> and more")],
        "ctx [User Request] go": [("injected_user_shaped", "ctx"), ("user_authored", "go")], "[User Request]": [],
        f"{block}\n\n<system-reminder>r</system-reminder>\nmine": [("injected_user_shaped", block), ("injected_user_shaped", "<system-reminder>r</system-reminder>"), ("user_authored", "mine")],
        "<system-reminder> never closed": [("injected_user_shaped", "<system-reminder> never closed")], "<turn_aborted>": [("injected_user_shaped", "<turn_aborted>")],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: [(c.origin_kind, c.text) for c in r.c] for r in rows.select("t", split_user_text(F.col("t")).alias("c")).collect()}
    assert got == cases
    path = split_user_text(F.lit("x"), F.lit("claude_code"), F.lit("/a/subagents/b.jsonl"))
    assert one(spark, path)[0].origin_kind == "delegated_instruction"
    messages = spark.createDataFrame([("s", 1, "user", f"{block} ask"), ("s", 2, "assistant", "ok"), ("s", 3, "user", block)], "s string, n int, role string, text string")
    atoms = derive.atomize_user_text(messages, "s", "n", "role", "text")
    assert [(r.seq_no, r.origin_kind, r.display_policy) for r in atoms.orderBy("seq_no").collect()] == [(0, "injected_user_shaped", "collapse"), (1, "user_authored", "show"), (2, "assistant_authored", "show"), (3, "injected_user_shaped", "collapse")]
    assert [r.group_index for r in derive.submission_groups(atoms).orderBy("seq_no").collect()] == [0, 0, 0]


def test_usage_normalised(spark):
    cases = {
        '{"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 3, "model": "m"}': (6, 3, 13, 4, None, 4, None, "m"),
        '{"prompt_tokens": 5, "cacheReadTokens": 2, "cache_creation_tokens": 1, "thinkingTokens": 9}': (5, None, 8, 2, 1, 3, 9, None),
        '{"totalTokens": 7}': (None, None, 7, None, None, None, None, None),
        '{"input_tokens": "12"}': None, "{}": None, '{"usage": {"input_tokens": 1}}': None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.u and tuple(r.u) for r in rows.select("t", usage.normalised(F.parse_json("t")).alias("u")).collect()}
    assert got == cases


def test_joins_keep_repeated_rows(spark):
    left = spark.createDataFrame([("a", 5)] * 2 + [(None, 5), ("a", None)], "k string, at int")
    right = spark.createDataFrame([("a", 3, 30), ("a", 5, 50), (None, 1, 10)], "k string, t int, v int")
    got = sorted((str(r.k), str(r.at), r.v, r.exact) for r in relate.as_of(left, right, "k", "at", "t", "v").collect())
    assert got == [("None", "5", None, False), ("a", "5", 50, True), ("a", "5", 50, True), ("a", "None", 30, False)]
    paths = spark.createDataFrame([("/a/b/c",)] * 2 + [("/ab",), (None,)], "p string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    assert sorted((str(r.p), r.root) for r in relate.longest_prefix(paths, "p", roots, "root").collect()) == [("/a/b/c", "/a/b"), ("/a/b/c", "/a/b"), ("/ab", None), ("None", None)]


def test_revisions(spark):
    old = spark.createDataFrame([("p", "x", 4), ("q", "x", 1), ("r", "x", 2), ("gone", "x", 1)], "k string, sig string, rev int")
    new = spark.createDataFrame([("p", "y", False), ("q", "x", False), ("r", "y", True), ("n", "x", None)], "k string, sig string, hand boolean")
    got = sorted(tuple(r) for r in relate.revisions(old, new, "k", "sig", "rev", F.col("hand")).collect())
    assert got == [("n", "created", 1, None), ("p", "revised", 5, 4), ("p", "superseded", 4, 5), ("q", "unchanged", 1, None), ("r", "manual_override", 3, 2), ("r", "superseded", 2, 3)]


def test_highlights_merge_what_touches(spark):
    rows = spark.createDataFrame([("ababab xx AB",), (None,)], "t string")
    got = [[(s.start, s.stop) for s in r.h] for r in rows.select(search.spans("t", ["ab", "ba"]).alias("h")).collect()]
    assert got == [[(0, 6), (10, 12)], []]


def test_link_components_and_confidence(spark):
    edges = spark.createDataFrame([(i, f"k{i}") for i in range(6)] + [(i + 1, f"k{i}") for i in range(5)] + [(9, "z")], "node long, key string")
    got = {r.node: r.component for r in linking.components(edges, "node", "key").collect()}
    assert got == {**dict.fromkeys(range(6), 0), 9: 9}
    assert one(spark, linking.confidence("weak_path", F.lit(2), F.lit(2), F.lit(False))) == 0.53


def test_related_work_edges(spark):
    rows = spark.createDataFrame([("delegated", "p", "c"), ("automation", "p", "c")], "relation string, parent string, child string")
    got = {(r.session, r.relation, r.direction, r.other) for r in linking.related(rows).collect()}
    assert got == {("p", "delegated", "outbound", "c"), ("p", "automation", "outbound", "p"), ("c", "delegated", "inbound", "p"), ("c", "automation", "self", "c")}


def test_as_of_falls_back_to_the_first(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 0), (3, "b", 1)], "id int, k string, at int")
    right = spark.createDataFrame([("a", 3, 30), ("a", 4, 40), ("a", 9, 90)], "k string, t int, v int")
    got = {r.id: (r.v, r.exact) for r in relate.as_of(left, right, "k", "at", "t", "v").collect()}
    assert got == {1: (40, True), 2: (30, False), 3: (None, False)}


def test_json_lines(spark, tmp_path):
    good = {"timestamp": "2026-03-09T09:00:00Z", "type": "user", "sessionId": "s1", "message": {"role": "user", "content": "ask"}}
    reply = {"timestamp": "2026-03-09T09:00:01Z", "type": "assistant", "sessionId": "s1", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "usage": {"input_tokens": 30, "cache_creation_input_tokens": 5, "cache_read_input_tokens": 2, "output_tokens": 10}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.jsonl").write_bytes("\r\n".join([json.dumps(good), "", "{bad", "[1]", json.dumps(reply)]).encode())
    records, audit = jsonl.parsed(jsonl.lines(spark, str(tmp_path / "in")))
    assert sorted((r.ordinal, r.fault) for r in audit.collect()) == [(1, "record_json_parse_failed"), (2, "record_not_object")]
    got = jsonl.conversation_fragments(records, "claude_code").orderBy("ordinal").collect()
    assert [(r.session, r.role, r.text, r.input_tokens, r.cached_tokens, r.output_tokens) for r in got] == [("s1", "user", "ask", None, 0, None), ("s1", "assistant", "a\nb", 30, 7, 10)]


def test_store_replaces_merges_and_upserts(spark, tmp_path):
    def rows(*own):
        return spark.createDataFrame(own, "source_id string, origin string, id long, at int")

    def held(path):
        return sorted((r.source_id, r.origin, r.id, r.at) for r in spark.read.parquet(path).collect())

    path = f"{tmp_path}/records"
    store.merge_by_origin(rows(("a", "x", 1, 1), ("a", "y", 2, 1), ("b", "x", 3, 1)), path)
    store.merge_by_origin(rows(("a", "x", 4, 2)), path)
    assert held(path) == [("a", "x", 4, 2), ("a", "y", 2, 1), ("b", "x", 3, 1)]
    store.upsert(rows(("a", "z", 4, 1), ("a", "z", 2, 1), ("a", "z", 9, 5)), path, ["id"], "at")
    assert held(path) == [("a", "x", 4, 2), ("a", "z", 2, 1), ("a", "z", 9, 5), ("b", "x", 3, 1)]
    store.replace(rows(("a", "w", 7, 7)), path)
    assert held(path) == [("a", "w", 7, 7), ("b", "x", 3, 1)]
    blobs = spark.createDataFrame([("one",), ("two",), ("one",), (None,)], "content string")
    got = store.put_evidence(blobs, f"{tmp_path}/blobs")
    store.put_evidence(blobs, f"{tmp_path}/blobs")
    assert sorted(r.content for r in spark.read.parquet(f"{tmp_path}/blobs").collect()) == ["one", "two"]
    assert got.where("content IS NULL").first().sha256 is None


def test_cursor_pages_add_up(spark):
    rows = spark.createDataFrame([(i, i * 7 % 5) for i in range(23)], "id long, n int")
    order, cursor, seen = [("n", True), ("id", False)], None, []
    while part := search.after_cursor(rows, order, cursor, 4).collect():
        seen += [(r.n, r.id) for r in part]
        cursor = part[-1].asDict()
    assert seen == sorted(((i * 7 % 5, i) for i in range(23)), key=lambda x: (-x[0], x[1]))
    assert search.with_total(rows, ["id"], 2, 3)[1].first().total == 23


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    # The second half of every session arrives later, in a second run of the same stream.
    rows.where("turn % 2 = 1").coalesce(1).write.parquet(f"{tmp_path}/in/a")

    def derived(part):
        return derive.context(derive.atomize(part, "conv_id", "turn", "role", "text")).withColumnRenamed("session", "conv_id")

    def run():
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        sessions.run(stream, f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/state", "conv_id", derived)

    run()
    rows.where("turn % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    run()
    batch = derived(rows)
    got = sessions.current(spark, f"{tmp_path}/out", "conv_id").select(*batch.columns)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()}
