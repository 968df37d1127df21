"""Lines of files in splits, files that grow, and usage whose state is carried from run to run."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import usage
from turnloom.sources import appends, jsonl


@pytest.fixture
def tiny_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def by_hand(data: bytes) -> list[str]:
    import re

    return [x for x in (p.decode("utf-8", "replace").strip(T.SPACE) for p in re.split(rb"\r\n|\r|\n", data)) if x]


def test_lines_of_files_in_splits(spark, tmp_path, tiny_splits):
    rng = random.Random(1)
    want = {}
    for i in range(4):
        parts = [rng.choice(["", "\t  ", "x" * rng.randrange(90), f"line {k} ä　", " a\tb "]) + rng.choice(["\n", "\r\n", "\n\n", "\r"]) for k in range(300 if i else 2000)]
        data = ("".join(parts) + ("last" if i % 2 else "")).encode()
        (tmp_path / f"f{i}.jsonl").write_bytes(data)
        want[f"f{i}.jsonl"] = by_hand(data)
    (tmp_path / "empty.jsonl").write_bytes(b"")
    got = {}
    frame = jsonl.lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    for r in frame.collect():
        got.setdefault(os.path.basename(r.origin), {})[r.ordinal] = r.raw
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    assert {os.path.basename(r.origin): r.raw for r in jsonl.first_lines(spark, str(tmp_path)).collect()} == {k: v[0] for k, v in want.items()}


def test_tail_time(spark):
    rows = [("a", i, x) for i, x in enumerate(['{"timestamp":"2030-01-01T00:00:00Z"}', '{"timestamp":"2024-01-03T00:00:00Z"}', "not json", '{"timestamp":"2024-01-03T01:00:00+01:00"}', '{"timestamp":5}', '{"timestamp":"never"}', "[1]"])]
    rows += [("b", 0, "[]"), ("c", 0, "no")]
    got = {r.origin: r.tail_time for r in jsonl.tail_time(spark.createDataFrame(rows, "origin string, ordinal long, raw string")).collect()}
    assert got == {"a": "2024-01-03T01:00:00+01:00", "b": None}


def step(spark, folder, ledger):
    planned = appends.plan(appends.listing(spark, str(folder)), ledger).checkpoint()
    read = appends.records(spark, planned)
    rows = [(os.path.basename(r.origin), r.ordinal, r.raw) for r in read.collect()]
    actions = {os.path.basename(r.origin): r.action for r in planned.collect()}
    after = appends.next_ledger(planned, read, ledger).collect()
    return actions, rows, spark.createDataFrame(after, appends.LEDGER)


def line(i, **more):
    return json.dumps({"timestamp": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "n": i, **more})


def put(path, data, at):
    path.write_bytes(data)
    os.utime(path, (at, at))


def test_growing_files_read_in_steps(spark, tmp_path):
    rng = random.Random(4)
    whole = {f"f{k}": "".join(line(i, t="ä" * rng.randrange(5)) + rng.choice(["\n", "\r\n", "\n\t\n"]) for i in range(40)).encode() for k in range(3)}
    ledger, held, actions = spark.createDataFrame([], appends.LEDGER), {}, []
    cuts = {k: sorted([0, *rng.sample(range(len(d)), 2), len(d)]) for k, d in whole.items()}
    # One file is always cut at line ends.
    ends = [i + 1 for i, b in enumerate(whole["f0"]) if b == 10]
    cuts["f0"] = [ends[0], ends[3], ends[20], len(whole["f0"])]
    for s in range(4):
        for k, d in whole.items():
            put(tmp_path / k, d[: cuts[k][s]], 1_700_000_000 + 60 * s)
        did, rows, ledger = step(spark, tmp_path, ledger)
        actions.append(did)
        for k in did:
            if did[k] == "full":
                held[k] = {}
        for k, n, raw in rows:
            assert n not in held[k] or did[k] == "full"
            held[k][n] = raw
    assert {k: [v[i] for i in range(len(v))] for k, v in held.items()} == {k: by_hand(d) for k, d in whole.items()}
    assert [a["f0"] for a in actions] == ["full", "append", "append", "append"]
    did, rows, ledger = step(spark, tmp_path, ledger)
    assert set(did.values()) == {"reuse"} and rows == []


def test_what_forces_a_full_reading(spark, tmp_path):
    first = "".join(line(i) + "\n" for i in range(5)).encode()
    more = (line(7) + "\n").encode()
    grown = {
        "append": first + more,
        "changed": first.replace(b'"n": 2', b'"n": 9') + more,
        "same_time": first + more,
        "same_tail": first + b'{"n": 1}\n',
        "inside": first[:-1] + b" " + more,
        "shrunk": first[:-20],
        "failed": b"not json\n" + first + more,
    }
    for name in grown:
        put(tmp_path / name, b"not json\n" + first if name == "failed" else first, 1_700_000_000)
    _, _, ledger = step(spark, tmp_path, spark.createDataFrame([], appends.LEDGER))
    for name, data in grown.items():
        put(tmp_path / name, data, 1_700_000_000 if name == "same_time" else 1_700_000_900)
    (tmp_path / "new").write_bytes(b"\n\n")
    (tmp_path / "empty").write_bytes(b"")
    did, rows, after = step(spark, tmp_path, ledger)
    assert did == dict.fromkeys([*grown, "new"], "full") | {"append": "append"}
    assert [(n, json.loads(x)["n"]) for k, n, x in rows if k == "append"] == [(5, 7)]
    assert {os.path.basename(r.origin): (r.n_records, r.failed) for r in after.collect()}["append"] == (6, False)
    many = ledger.withColumn("n_sessions", F.lit(2))
    assert step(spark, tmp_path, many)[0]["append"] == "full"


def struct(n, model=None):
    return None if n is None else {c: None for c in usage.COUNTS} | {"input_tokens": n, "total_tokens": n + 1, "model": model}


def test_growth_is_the_same_in_one_run_and_in_many(spark):
    rng = random.Random(9)
    rows = []
    for i in range(160):
        total = None if rng.random() < 0.2 else rng.randrange(50)
        rows.append((rng.choice("ab"), i, struct(rng.choice([None, 3, 7, total])), struct(total, rng.choice([None, "m"]))))
    kind = f"session string, ordinal long, usage {usage.USAGE}, total {usage.USAGE}"

    # A loop over each session, as a log is read.
    want, most, last = {}, {}, {}
    for s, i, use, total in rows:
        diff = lambda now, old: now if now is None or old is None else {c: None if now[c] is None and old[c] is None else max(0, (now[c] or 0) - (old[c] or 0)) for c in usage.COUNTS} | {"model": now["model"]}
        if use and total:
            key = (s, total["model"] or use["model"] or "", *(None if total[c] is None else total[c] - (use[c] or 0) for c in usage.KEYED))
            want[i] = diff(use, most.get(key))
            old = most.get(key) or dict.fromkeys(usage.COUNTS)
            most[key] = {c: max((x for x in (old[c], use[c]) if x is not None), default=None) for c in usage.COUNTS}
        else:
            want[i] = diff(total, last.get(s))
        last[s] = total or last.get(s)

    frame = spark.createDataFrame(rows, kind)
    once = {r.ordinal: r.growth and r.growth.asDict() for r in usage.checkpoint_growth(frame).collect()}
    assert once == want
    state, split = None, {}
    for a, b in ((0, 31), (31, 32), (32, 120), (120, 160)):
        part = frame.where((F.col("ordinal") >= a) & (F.col("ordinal") < b))
        split |= {r.ordinal: r.growth and r.growth.asDict() for r in usage.checkpoint_growth(part, state).collect()}
        kept = usage.checkpoint_state(part, state).collect()
        assert len({(r.session, r.baseline) for r in kept}) == len(kept)
        state = spark.createDataFrame(kept, usage.STATE)
    assert split == want


def test_nested_usage(spark):
    rows = [
        {"usage": {"input_tokens": 3}},
        {"metadata": {"usage": {"prompt_tokens": 2, "model": "m"}}, "output_tokens": 4},
        {"a": 1},
        {"usage": 5, "tokens": {"metadata": {"usage": {"input_tokens": 1, "metadata": {"input_tokens": 100}}}}},
        {"usage": {"input_tokens": 1}, "last_token_usage": {"input_tokens": 2, "output_tokens": 1}},
        {"usage": {"input_tokens": 3}},
    ]
    made = spark.createDataFrame([(i, json.dumps(r), "u") for i, r in enumerate(rows)] + [(8, "[1]", "u"), (9, None, "u")], "i int, raw string, _v string").withColumn("record", F.try_parse_json("raw"))
    got = {r.i: r.usage and (r.usage.input_tokens, r.usage.output_tokens, r.usage.total_tokens, r.usage.model) for r in usage.nested_usage(made, "record").collect()}
    assert got == {0: (3, None, 3, None), 1: (2, 4, 6, "m"), 2: None, 3: (1, None, 1, None), 4: (3, 1, 4, None), 5: (3, None, 3, None), 8: None, 9: None}
    total = spark.createDataFrame([('{"info":{"total_token_usage":{"input_tokens":7}},"usage":{"input_tokens":1}}',)], "raw string").withColumn("record", F.parse_json("raw"))
    assert usage.nested_usage(total, "record", "total", totals=True).first().total.input_tokens == 7
    assert usage.nested_usage(made.limit(0), "record").collect() == []


def test_white_space_of_every_kind(spark):
    odd = "\t  stop　\n"
    r = spark.createDataFrame([(odd, "\t﻿")], "a string, b string").select(T.stop_reason(F.col("a")), T.optional(F.col("b")), T.optional(F.col("a")), T.squeezed(F.concat("a", F.lit(" x"))), T.tidy(F.concat("a", F.lit(" ")))).first()
    assert tuple(r) == ("end_turn", None, "stop", "stop x", "stop")


def test_growth_over_a_stream(spark, tmp_path):
    from turnloom.streaming import checkpoints

    rng = random.Random(2)
    kind = f"session string, ordinal long, usage {usage.USAGE}, total {usage.USAGE}"
    rows = [(rng.choice("abc"), i, struct(rng.choice([None, 2, 5])), struct(rng.choice([None, 4, 9, 30]), rng.choice([None, "m"]))) for i in range(90)]
    for a in range(0, 90, 30):
        spark.createDataFrame(rows[a : a + 30], kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        checkpoints.checkpoint_growth(spark.readStream.schema(kind).json(str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    key = lambda rows: sorted((r.ordinal, r.session, r.baseline, r.growth and tuple(r.growth)) for r in rows)
    want = usage.checkpoint_growth(spark.createDataFrame(rows, kind)).collect()
    assert key(spark.read.parquet(str(tmp_path / "out")).collect()) == key(want)


def test_overview_of_odd_rows(spark):
    kind = f"use {usage.USAGE}, replies int, reason string, model string, host string"
    rows = [(struct(5), 1, None, "m", "h"), (struct(2), 0, "x", "unknown", None), (None, 0, None, None, "h"), (None, None, None, "m", "g"), (None, 2, "no", "m", "h"), (None, 2, None, "m", "h")]
    made = usage.with_measures(spark.createDataFrame(rows, kind), "use")
    zero = usage.no_tokens(F.col("use"), F.col("replies"), F.col("reason"))
    r = usage.overview_measures(made, zero).first()
    assert (r.turns, r.covered, r.coverage, r.with_model, r.input_tokens, r.total_tokens, r.excluded) == (3, 2, 0.6667, 2, 7, 9, 3)
    assert usage.filtered(made, hosts=["h"], zero=zero).count() == 2 and usage.filtered(made, hosts=[]).count() == 6
    r = usage.overview_measures(made.limit(0), zero).first()
    assert (r.turns, r.coverage, r.input_tokens, r.excluded) == (0, 0.0, 0, 0)
