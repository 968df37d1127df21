"""Signals, replies, calls and questions of a turn's context, against a loop over its atoms and the cases of odd logs."""

import json
import random

from turnloom.functions import ask_user
from turnloom.operators import turn_context as TC

KIND = ", ".join(f"{c} {k or 'string'}" for c, k in TC.COLUMNS.items())


def usage(n=None, out=None, model=None):
    return None if n is None else {"input_tokens": n, "output_tokens": out, "total_tokens": n + (out or 0), "cache_read_input_tokens": None, "cache_creation_input_tokens": None, "cached_input_tokens": None, "reasoning_output_tokens": None, "model": model}


def frame(spark, atoms):
    rows = [tuple({"session": "s", "turn": "t", "seq_no": i, "id": f"a{i:04d}", "actor_kind": "assistant", **a}.get(c) for c in TC.COLUMNS) for i, a in enumerate(atoms)]
    return spark.createDataFrame(rows, KIND).repartition(3)


def said(**more):
    return {"kind": "text", "text": "hi", **more}


def signal(**more):
    return {"kind": "token_usage_signal", "actor_kind": "system", "display_policy": "hide", **more}


def looped(atoms):
    """(signal's place, its reply's place or None) by a queue, one context after the other."""
    out = {}
    for turn in {a.get("turn", "t") for a in atoms} - {None}:
        own = [(i, a) for i, a in enumerate(atoms) if a.get("turn", "t") == turn]
        at, latest, waiting = None, {}, []
        for i, a in own:
            if a["kind"] == "text" and a.get("actor_kind", "assistant") == "assistant" and a.get("display_policy") != "hide":
                at = i
                if a.get("message_id") is not None:
                    latest[a["message_id"]] = i
                out |= dict.fromkeys(waiting, i)
                waiting = []
            elif a["kind"] == "token_usage_signal":
                name = a.get("message_id")
                to = at if name is None else latest.get(name)
                if to is None:
                    waiting.append(i)
                else:
                    out[i] = to
        out |= dict.fromkeys(waiting, at)
    return out


def test_signals_find_their_replies(spark):
    rng = random.Random(3)
    atoms = []
    for _ in range(600):
        turn, name = rng.choice(["t1", "t2", "t3", None]), rng.choice([None, "m1", "m2", "m3", "m4"])
        kind = rng.random()
        atoms.append(said(turn=turn, message_id=name) if kind < 0.2 else said(turn=turn, message_id=name, display_policy="hide") if kind < 0.25 else said(turn=turn, actor_kind="user") if kind < 0.3 else signal(turn=turn, message_id=name))
    atoms += [signal(turn="silent", message_id="m1"), signal(turn="silent")]
    df = frame(spark, atoms)
    ids = {(r.turn, r.reply): r.id for r in TC.replies(df).collect()}
    got = {int(r.id[1:]): ids.get((r.turn, r.reply)) for r in TC.attribute_signals(df).collect()}
    assert got == {i: None if to is None else f"a{to:04d}" for i, to in looped(atoms).items()}
    assert len(got) == sum(a["kind"] == "token_usage_signal" and a.get("turn", "t") is not None for a in atoms)


def test_bills(spark):
    atoms = [
        # Own calls are summed, unknown counts as 0 in a sum; the waiting one comes before.
        signal(turn="sum", message_id="m", usage=usage(5)), said(turn="sum", message_id="m", usage=usage(99, 1, "own")), signal(turn="sum", message_id="m", usage=usage(7, 2, "late"), stop_reason="end_turn"),
        # One alone stays as it is.
        said(turn="one"), signal(turn="one", usage=usage(5)),
        # Running counts: the last one; a trailing orphan is the last.
        said(turn="run"), signal(turn="run", usage=usage(5), source_event_type="token_count"), signal(turn="run", message_id="x", usage=usage(9), source_event_type="token_count"), signal(turn="run", usage=usage(8), source_event_type="token_count"),
        # Growths win over all else.
        said(turn="grow"), signal(turn="grow", usage=usage(50), delta=usage(3), source_event_type="token_count"), signal(turn="grow", usage=usage(60), delta=usage(4)), signal(turn="grow", usage=usage(70)),
        # A last checkpoint without counts bills nothing.
        said(turn="none", usage=usage(1), stop_reason="error"), signal(turn="none", source_event_type="token_count", stop_reason="end_turn"),
    ]
    got = {r.turn: r for r in TC.replies(frame(spark, atoms)).collect()}
    assert {t: (r.usage.input_tokens, r.usage.output_tokens, r.token_count) for t, r in got.items()} == {"sum": (12, 2, 14), "one": (5, None, 5), "run": (9, None, 9), "grow": (7, 0, 7), "none": (1, None, 1)}
    assert got["sum"].model == "own" and got["sum"].stop_reason == "end_turn" and got["one"].model == "unknown" and got["none"].stop_reason == "error"


def test_models_are_carried(spark):
    model = lambda m, **more: {"kind": "model_signal", "actor_kind": "system", "display_policy": "hide", "model": m, **more}
    atoms = [said(), model("a"), said(), said(model="b"), said(), said(model="unknown"), said(), said(usage=usage(1, model="c")), said(), model(""), said(), said(turn="u")]
    df = frame(spark, atoms)
    assert [r.model for r in TC.replies(df).orderBy("id").collect()] == ["unknown", "a", "b", "b", "unknown", "b", "c", "c", "c", "unknown"]
    first = spark.createDataFrame([("s", "z")], "session string, model string")
    assert [r.model for r in TC.replies(df, first).orderBy("id").collect()] == ["z", "a", "b", "b", "unknown", "b", "c", "c", "c", "z"]


def test_calls_and_outputs(spark):
    call = lambda c, **more: {"kind": "tool_call", "call_id": c, "tool_name": "ls", "input": "{}", **more}
    result = lambda c, o, **more: {"kind": "tool_result", "actor_kind": "tool", "call_id": c, "output": o, **more}
    atoms = [
        call("c1"), said(), call("c2", tool_name=None, input=None), result("c1", "one"), result("c1", "again"), call("c1"), result("c1", "two"), said(display_policy="hide"), call("c3"), said(), result("c3", None),
        call("c4", turn="u"), result("c4", "elsewhere", turn="t"), result("c9", "stray"), call(None), result(None, "nameless"), call("c5", display_policy="hide"), said(turn=None), call("c6", turn="v"),
    ]
    df = frame(spark, atoms)
    got = [(r.id, r.sequence, r.reply_id, r.output, r.tool_name) for r in TC.tool_calls(df).orderBy("id").collect()]
    assert got == [
        ("a0000", 0, "a0009", "one", "ls"), ("a0002", 1, "a0001", None, "tool_call"), ("a0005", 2, "a0001", "two", "ls"), ("a0008", 3, "a0009", "", "ls"),
        ("a0011", 0, None, None, "ls"), ("a0014", 4, "a0009", None, "ls"), ("a0018", 0, None, None, "ls"),
    ]
    rows = {r.turn: r for r in TC.turn_context(df).collect()}
    assert set(rows) == {"t", "u", "v"} and [r.id for r in rows["t"].replies] == ["a0001", "a0009"] and rows["t"].replies[1].tool_call_ids == ["a0000", "a0008", "a0014"]
    assert (rows["t"].reply_count, rows["t"].call_count, rows["u"].call_count, rows["u"].zero_token_reason, rows["u"].replies) == (2, 5, 1, "no_assistant_reply", None)
    assert [c.output for c in rows["t"].calls] == ["one", None, "two", "", None] and rows["t"].calls[0].output_preview == "one"
    assert TC.turn_context(df.limit(0)).collect() == []


def test_summary_and_messages(spark):
    atoms = [said(usage=usage(2, 1), stop_reason="error", model="m"), {"kind": "text", "actor_kind": "system", "text": "sk-" + "a" * 30}, {"kind": "text", "actor_kind": "system", "text": None}, said(usage=usage(3), text="Bearer " + "x" * 20)]
    r = TC.turn_context(frame(spark, atoms)).first()
    assert (r.token_usage.input_tokens, r.token_usage.output_tokens, r.primary_model, r.has_errors, r.zero_token_reason) == (5, 1, "m", True, None)
    assert [m.content for m in r.messages] == ["sk-" + "a" * 30, ""] and "Bearer" not in (r.replies[1].preview.replace("Bearer " + "x" * 20, "Bearer") if r.replies[1].preview != r.replies[1].content else "")


def test_questions(spark):
    ask = lambda q, **more: {"kind": "tool_call", "call_id": "q", "tool_name": "AskUserQuestion", "input": q, **more}
    asked = json.dumps({"questions": [{"question": "Which?", "header": "H", "options": [{"label": "Red", "description": "d"}, {"value": "Blue"}, {"x": 1}, 5]}, 7, {"title": "T", "options": [{"name": "Yes"}]}]})
    atoms = [ask(asked), {"kind": "tool_result", "call_id": "q", "output": "first"}, {"kind": "tool_result", "call_id": "q", "output": 'Your questions have been answered: "Which?"="red", "other"="so so"', "time_key": "9"}, ask(asked, call_id="none"), ask("{}", call_id="e"), {"kind": "tool_result", "call_id": "e", "output": "x"}]
    (r,) = TC.ask_user_turns(frame(spark, atoms), "claude_code").collect()
    assert (r.call_id, r.result_id, r.created_at) == ("a0000", "a0002", "9")
    assert [(q.header, q.question, [(o.label, o.description) for o in q.options], q.id) for q in r.questions] == [("H", "Which?", [("Red", "d"), ("Blue", None)], None), ("T", "", [("Yes", None)], None)]
    assert [tuple(a) for a in r.answers] == [(0, "Red", None), (1, None, "so so")]
    assert TC.ask_user_turns(frame(spark, atoms), "amp").collect() == []


def test_answers_of_every_shape():
    call = json.dumps({"questions": [{"id": "a", "question": "A?", "options": [{"label": "One"}, {"label": "one"}]}, {"id": "b", "question": "B?", "options": [{"label": "Two"}]}]})
    own = lambda o, p="claude_code": [tuple(a.values()) for a in ask_user.answers(p, call, o)]
    assert own('[{"label": "one"}, 3, {"answer": "TWO ", "question_index": 5}, {}]') == [(0, "one", None), (5, "Two", None), (2, None, None)]
    assert own('{"free_text": "else"}') == [(0, None, "else")] and own("two") == [(1, "Two", None)] and own("what") == [(0, None, "what")] and own("") == own(None) == []
    assert own('[{"type": "text", "text": "Two"}]') == [(1, "Two", None)] and own("7") == [(0, None, "7")]
    assert own('{"answers": {"b": {"answers": ["Two", "more"]}, "a": {"answers": ["x", "", "y", 4]}}}', "codex") == [(0, None, "x, y"), (1, "Two", "more")]
    assert own('{"answers": {"z": {"answers": ["One"]}, "y": 3}}', "codex") == [(0, "One", None)]
    assert own("two", "codex") == [(1, "Two", None)] and own('{"answers": []}', "codex") == [(0, None, '{"answers": []}')]
    assert [tuple(a.values()) for a in ask_user.answers("claude_code", None, "free")] == [(0, None, "free")]
