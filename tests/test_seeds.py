"""Conversations in JSON of unknown shape."""

import json

from pyspark.sql import functions as F

from turnloom.sources import seeds

ASK, SAY = {"role": "user", "content": "hello there"}, {"role": "assistant", "content": "yes"}


def search(spark, docs):
    rows = spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in docs.items()], "origin string, raw string").select("origin", F.try_parse_json("raw").alias("value"))
    found, messages = seeds.find(rows, "x")
    return {(r.doc, r.session_id.removeprefix("sess:x:")): r for r in found.collect()}, messages.orderBy("doc", "session_id", "ordinal").collect()


def nested(value, depth):
    for _ in range(depth):
        value = {"in": value}
    return value


def test_shapes_and_depths(spark):
    docs = {
        "list": [ASK, SAY],
        "object": {"id": "a", "title": "T", "model": "m", "cwd": "/w/p", "messages": [ASK], "items": [SAY, SAY]},
        "map": {"chatId": "b", "mapping": {"2": {"message": SAY}, "1": ASK, "3": 5}},
        "deep": nested({"session_id": "c", "turns": [{"info": {"role": "user", "created": 1704067200000}, "parts": [{"text": "part"}]}]}, 8),
        "deeper": nested({"session_id": "d", "turns": [ASK]}, 9),
        "within": {"id": "e", "messages": [{**ASK, "extra": {"id": "f", "messages": [ASK]}}]},
        "systems": {"id": "g", "messages": [{"role": "system", "content": "x"}], "more": [{"id": "h", "history": [SAY]}]},
        "nothing": {"messages": [1, "x", {"n": 1}, []], "k": None},
        "plain": "5",
        "broken": "{",
        "null": None,
        "two": {"z": {"id": "i", "messages": [ASK]}, "y": [{"id": "j", "messages": [SAY]}]},
    }
    got, messages = search(spark, docs)
    named = {k for k in got if len(k[1]) < 20}
    assert named == {("object", "a"), ("map", "b"), ("deep", "c"), ("within", "e"), ("systems", "h"), ("two", "i"), ("two", "j")}
    assert {k[0] for k in got if len(k[1]) == 40} == {"list"}
    r = got["object", "a"]
    assert (r.title, r.model, r.workspace, r.n_messages) == ("T", "m", "/w/p", 1)
    assert got["map", "b"].n_messages == 2 and got["map", "b"].title == "hello there" and got["systems", "h"].title is None
    assert got["deep", "c"].created_at == "2024-01-01T00:00:00.000Z" and got["deep", "c"].title == "part"
    assert [m.role for m in messages if m.doc == "map"] == ["user", "assistant"]


def test_seeds_of_one_id_are_merged(spark):
    at = lambda m, t: {**m, "timestamp": t}
    doc = {
        "a": {"id": "s", "messages": [at(SAY, "2024-01-03T00:00:00Z"), at(SAY, "2024-01-01T00:00:00Z")], "model": "m1"},
        "b": {"id": "s", "title": "second", "model": "m2", "createdAt": "2023-01-01T00:00:00Z", "updatedAt": 1735689600000, "messages": [at(ASK, "2024-01-02T00:00:00Z"), ASK]},
    }
    got, messages = search(spark, {"d": doc, "other": {"id": "s", "messages": [ASK]}})
    r = got["d", "s"]
    assert (r.title, r.model, r.created_at, r.updated_at, r.n_messages) == ("second", "m1", "2023-01-01T00:00:00.000Z", "2025-01-01T00:00:00.000Z", 4)
    assert [(m.role, m.observed_at and m.observed_at[:10]) for m in messages if m.doc == "d"] == [("user", None), ("assistant", "2024-01-01"), ("user", "2024-01-02"), ("assistant", "2024-01-03")]
    assert got["other", "s"].n_messages == 1


def test_nothing_to_search(spark):
    assert search(spark, {}) == ({}, []) and search(spark, {"a": "7", "b": None}) == ({}, [])
