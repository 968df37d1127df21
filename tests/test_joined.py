"""Sessions in many files, and projects by the files beside them."""

import json

from turnloom.sources import joined


def table(spark, files):
    rows = [(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in files]
    return spark.createDataFrame(rows, "origin string, value string")


FILES = [
    ("/d/storage/session/p/s1.json", {"id": "s1", "title": "One", "directory": "/w/a/../b", "time": {"created": 1704067200000, "updated": 1704067260000}}),
    ("/d/storage/session/p/q/s2.json", {"title": "Named by its file"}),
    ("/d/storage/session/z/other.json", {"id": "s1", "title": "A later path"}),
    ("/d/storage/session/bad.json", "{"),
    ("/d/storage/message/s1/m1.json", {"id": "m1", "role": "user", "parts": [{"type": "text", "text": "inside"}, 5]}),
    ("/d/storage/message/s1/m2.json", "no json"),
    ("/d/storage/message/s1/m3.json", {"info": {"id": "m3", "role": "assistant", "agent": "helper"}, "path": {"cwd": "/w/c"}, "time": {"created": 1704067201500}}),
    ("/d/storage/message/s1/m4.json", {"id": "m4"}),
    ("/d/storage/message/s1/m5.json", {"id": "m5", "agent": "late", "finish": "length", "role": "model", "tokens": {"input": 7, "cache": {"write": 2}}}),
    ("/d/storage/message/lost/m6.json", {"id": "m6", "role": "user"}),
    ("/d/storage/part/m1/a.json", {"type": "text", "text": "beside"}),
    ("/d/storage/part/m1/b.json", {"type": "reasoning", "text": " \t"}),
    ("/d/storage/part/m3/a.json", {"type": "tool", "callID": "k", "tool": "ls", "state": {"input": {"p": 1}, "output": None, "metadata": {"n": 2}}}),
    ("/d/storage/part/m3/b.json", {"type": "tool", "callId": "l", "name": "cat", "state": {"input": "x"}}),
    ("/d/storage/part/m3/c.json", {"type": "step-finish", "reason": "tool-calls", "tokens": {"input": 1, "output": 2, "reasoning": 3}}),
    ("/d/storage/part/m3/d.json", {"type": "step-finish", "reason": "stop", "tokens": {}}),
    ("/d/storage/part/m3/e.json", [1]),
    ("/d/storage/part/m5/a.json", {"type": "step-finish", "reason": "stop", "tokens": {"input": 99}}),
    ("/d/storage/part/none/a.json", {"type": "text", "text": "no message"}),
    ("/other/storage/part/m1/a.json", {"type": "text", "text": "another storage"}),
    ("/d/elsewhere/x.json", {"id": "x"}),
    ("/d/storage/session/p/null.json", None),
]


def read(spark, files):
    sessions, messages, fragments = joined.joined(table(spark, files), "x")
    return {r.session_id: r for r in sessions.collect()}, messages.orderBy("session_id", "ordinal").collect(), fragments.orderBy("session_id", "ordinal", "file", "place").collect()


def test_messages_and_parts_meet(spark):
    # Repeated files count once.
    sessions, messages, fragments = read(spark, FILES + FILES[4:6] + FILES[10:11])
    assert set(sessions) == {"sess:x:s1", "sess:x:s2"}
    s = sessions["sess:x:s1"]
    assert (s.title, s.workspace, s.created_at, s.updated_at, s.agent) == ("One", "/w/b", "2024-01-01T00:00:00.000Z", "2024-01-01T00:01:00.000Z", "helper")
    assert sessions["sess:x:s2"].title == "Named by its file" and sessions["sess:x:s2"].agent is None
    # The second file is no JSON and takes its number; the fourth has neither role nor part.
    assert [(m.ordinal, m.message_id, m.role, m.workspace, m.stop_reason) for m in messages] == [(0, "m1", "user", "/w/b", None), (2, "m3", "assistant", "/w/c", "end_turn"), (4, "m5", "assistant", "/w/b", "max_tokens")]
    assert messages[0].usage is None and messages[1].observed_at == "2024-01-01T00:00:01.500Z"
    # Counts of the last end that has some; those of the message go first.
    assert (messages[1].usage.input_tokens, messages[1].usage.total_tokens, messages[1].usage.cached_input_tokens) == (1, 6, None)
    assert (messages[2].usage.input_tokens, messages[2].usage.total_tokens, messages[2].usage.cached_input_tokens) == (7, 9, 2)
    assert [(f.ordinal, f.file, f.place, f.kind, f.text, f.call_id, f.tool_name) for f in fragments] == [
        (0, None, 0, "text", "inside", None, None),
        (0, "a", 0, "text", "beside", None, None),
        (2, "a", 0, "tool_call", '{"p":1}', "k", "ls"),
        (2, "a", 1, "tool_result", '{"n":2}', "k", None),
        (2, "b", 0, "tool_call", "x", "l", "cat"),
    ]


def test_no_files_and_files_of_a_folder(spark, tmp_path):
    assert [list(x) for x in read(spark, [])] == [[], [], []]
    for path, value in FILES:
        if value is not None and path.startswith("/d/storage"):
            target = tmp_path / path[1:].replace("/p/", "/a b%/")
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(value if isinstance(value, str) else json.dumps(value))
    of_folder = joined.joined(joined.json_files(spark, str(tmp_path)), "x")
    of_rows = joined.joined(table(spark, [f for f in FILES if f[0].startswith("/d/storage")]), "x")
    for a, b in zip(of_folder, of_rows, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_companions(spark):
    logs = [f"/u/.gemini/tmp/{p}/chats/1.json" for p in "abcdef"] + ["/u/.gemini/tmp/a/chats/1.json", "/u/.gemini/tmp/a/logs/1.json", "/v/.gemini/tmp/a/chats/1.json"]
    files = [
        ("/u/.gemini/tmp/a/.project_root", " /w/a/ \n"),
        ("/u/.gemini/history/a/.project_root", "/w/other"),
        ("/u/.gemini/tmp/b/.project_root", "\n"),
        ("/u/.gemini/history/b/.project_root", "/w/b"),
        ("/u/.gemini/tmp/f/.project_root", None),
        ("/u/.gemini/projects.json", {"projects": {"/w/b": "Title of b", "/w/z": "c", "/w/c": "c", "/w/n": 5, "/w/a2": "a"}}),
        ("/v/.gemini/projects.json", "[]"),
    ]
    origins = spark.createDataFrame([(p, 1) for p in logs], "origin string, title int")
    got = sorted((r.origin, r.project, r.workspace, r.title) for r in joined.companions(origins, table(spark, files)).collect() if r.project)
    by_project = {r[1]: r[2:] for r in got if r[0].startswith("/u")}
    assert by_project == {"a": ("/w/a", "a"), "b": ("/w/b", "Title of b"), "c": ("/w/c", "c"), "d": (None, "d"), "e": (None, "e"), "f": (None, "f")}
    assert [r for r in got if r[0].startswith("/v")] == [("/v/.gemini/tmp/a/chats/1.json", "a", None, "a")]
    assert joined.companions(origins, table(spark, files)).count() == len(logs)
    assert joined.companions(origins.limit(0), table(spark, [])).count() == 0
