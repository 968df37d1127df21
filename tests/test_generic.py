"""Fragments of records without a reader of their own."""

import json

from pyspark.sql import functions as F

from turnloom.sources import generic

RECORDS = [
    {"timestamp": "2024-01-02T03:04:05Z", "cwd": "/w/a", "model": "m1", "role": "human", "content": "hello"},
    {"message": {"role": "bot", "content": ["", "one", {"type": "text", "text": "two"}, {"type": "toolUse", "id": "c1", "name": "ls", "input": {"p": 1}}, {"type": "image"}]}},
    {"role": "toolResult", "toolCallId": "c1", "content": [{"text": "x"}, {"n": 1}]},
    {"role": "assistant", "tool_calls": [{"id": "c2", "name": "cat", "arguments": "raw"}], "tool_results": [{"call_id": "c2", "output": "done"}]},
    {"type": "user", "text": "by type", "parentId": "p", "agentId": "k"},
    {"n": 1},
    {"title": "only a title"},
    {"role": 5, "content": None, "parts": [7], "text": "  "},
]


def test_fragments(spark):
    rows = [("o", i, json.dumps(r)) for i, r in enumerate(RECORDS)]
    records = spark.createDataFrame(rows, "origin string, ordinal int, raw string").select("origin", "ordinal", F.parse_json("raw").alias("record"))
    got = generic.fragments(records).orderBy("ordinal", "place").collect()
    by = [[(f.kind, f.role, f.text, f.call_id, f.tool_name) for f in got if f.ordinal == i] for i in range(len(RECORDS))]
    none = (None, None)
    assert by[0] == [("workspace_signal", "user", "/w/a", *none), ("model_signal", "user", "m1", *none), ("text", "user", "hello", *none)]
    assert got[0].time_key.startswith("2024-01-02T03:04:05") and [f.time_key for f in got if f.ordinal == 1][0] is None
    assert by[1] == [("text", "assistant", "one", *none), ("text", "assistant", "two", *none), ("tool_call", "assistant", '{"p":1}', "c1", "ls"), ("unknown", "assistant", '{"type":"image"}', *none)]
    assert by[2] == [("tool_result", "assistant", 'x\n{"n":1}', "c1", None)]
    assert by[3] == [("tool_call", "assistant", "raw", "c2", "cat"), ("tool_result", "assistant", "done", "c2", None)]
    assert by[4] == [("session_relation", "user", "p", "k", None), ("text", "user", "by type", *none)]
    assert by[5] == [("unknown", "assistant", '{"n":1}', *none)]
    assert by[6] == [("title_signal", "assistant", "only a title", *none)]
    assert by[7] == [("unknown", "assistant", json.dumps(RECORDS[7], separators=(",", ":"), sort_keys=True), *none)]


def test_token_usage(spark):
    use = {"input_tokens": 3, "output_tokens": 2}
    rows = [
        {"role": "assistant", "content": "a", "usage": use, "stop_reason": "end"},
        {"usage": {"input_tokens": 9}, "message": {"role": "ai", "content": "a", "usage": use, "stopReason": "length"}},
        {"role": "user", "content": "a", "usage": use},
        {"usage": use},
        {"content": "no role", "usage": use},
        {"role": "assistant", "usage": "much", "stop_reason": 5},
        {"role": "assistant", "stop_reason": "aborted"},
        {"role": "assistant", "usage": use, "message": {"usage": None, "stop_reason": None}, "stop_reason": "stop"},
    ]
    made = spark.createDataFrame([("o", i, json.dumps(r)) for i, r in enumerate(rows)], "origin string, ordinal int, raw string").select("origin", "ordinal", F.parse_json("raw").alias("record"))
    got = {r.ordinal: (r.usage and (r.usage.input_tokens, r.usage.output_tokens, r.usage.total_tokens), r.stop_reason) for r in generic.token_usage(made).collect()}
    assert got == {0: ((3, 2, 5), "end_turn"), 1: ((3, 2, 5), "max_tokens"), 4: ((3, 2, 5), None), 6: (None, "error"), 7: ((3, 2, 5), "end_turn")}


def test_no_records(spark):
    empty = spark.createDataFrame([], "origin string, ordinal int, raw string").select("origin", "ordinal", F.parse_json("raw").alias("record"))
    assert generic.fragments(empty).count() == 0
    assert generic.token_usage(empty).count() == 0
