"""A turn's context: replies with the tokens they cost, system messages, tool calls with their outputs, questions put to the user.

Atoms are rows of (session, turn, seq_no, id, kind, actor_kind, display_policy, time_key,
text, message_id, model, call_id, tool_name, input, output, usage, delta, source_event_type, stop_reason):
kind is ``text``, ``tool_call``, ``tool_result``, ``token_usage_signal`` or ``model_signal``, turn the
turn in whose context an atom lies (null for none), usage and delta structs of ``usage.normalised``. Columns
that a log doesn't have may be missing; they count as null. Atoms of equal seq_no are ordered by id.

Everything is windows over a session's or a context's atoms, so a context's rows are
sorted and streamed, never gathered, until ``turn_context`` nests them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import ask_user
from turnloom.functions import text as T

COUNTS = ["input_tokens", "output_tokens", "total_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cached_input_tokens", "reasoning_output_tokens"]
USAGE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ",model:string>"
COLUMNS = {
    "session": None, "turn": None, "seq_no": "long", "id": None, "kind": "string", "actor_kind": "string", "display_policy": "string", "time_key": "string", "text": "string", "message_id": "string",
    "model": "string", "call_id": "string", "tool_name": "string", "input": "string", "output": "string", "usage": USAGE, "delta": USAGE, "source_event_type": "string", "stop_reason": "string",
}
CONTEXT = ["session", "turn"]


def shaped(atoms: DataFrame) -> DataFrame:
    """Exactly the columns of an atom, nulls for those that are missing."""
    here = set(atoms.columns)
    return atoms.select(*(F.col(c) if c in here else F.lit(None).cast(kind).alias(c) for c, kind in COLUMNS.items()))


def _shown() -> Column:
    return ~F.col("display_policy").eqNullSafe(F.lit("hide"))


def _is_reply() -> Column:
    return (F.col("kind") == "text") & (F.col("actor_kind") == "assistant") & _shown()


def _in_context(*more: str):
    return Window.partitionBy(*CONTEXT, *more).orderBy("seq_no", "id")


def attribute_signals(atoms: DataFrame) -> DataFrame:
    """The token signals of each context with ``reply``, the number from 1 of the reply that they bill, and ``queued``, their place among its signals.

    A signal bills the latest reply before it with its message id; one without an id the reply before it. Any other waits: the
    next reply takes all that wait, and at the end the last reply takes the rest. A context
    without replies has nothing to bill: its signals have no reply.
    """
    signal = F.col("kind") == "token_usage_signal"
    own = shaped(atoms).where(F.col("turn").isNotNull() & (_is_reply() | signal)).withColumn("_reply", _is_reply())
    so_far = F.count_if("_reply").over(_in_context().rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_n", so_far).withColumn("_all", F.count_if("_reply").over(Window.partitionBy(*CONTEXT)))
    same = F.last(F.when(F.col("_reply"), F.col("_n")), ignorenulls=True).over(_in_context("message_id").rowsBetween(Window.unboundedPreceding, -1))
    named = F.col("message_id").isNotNull()
    known = F.when(named, same).when(F.col("_n") > 0, F.col("_n"))
    waits = F.when(F.col("_n") < F.col("_all"), F.col("_n") + 1).when(F.col("_all") > 0, F.col("_all"))
    own = own.withColumn("_known", known)
    # What no later reply takes comes after the last reply's own signals.
    left = F.col("_known").isNull() & (F.col("_n") == F.col("_all"))
    return own.where(signal).withColumn("reply", F.coalesce("_known", waits)).withColumn("queued", F.struct(left.alias("left"), "seq_no", "id")).drop("_reply", "_n", "_all", "_known")


def merged(value: str, order: str) -> Column:
    """An aggregate: the sum of usage structs. One alone stays as it is; in a sum unknown counts are 0, and the last model named counts."""
    n = F.count(value)
    counts = [F.when(n > 1, F.coalesce(F.sum(f"{value}.{c}"), F.lit(0))).otherwise(F.sum(f"{value}.{c}")).cast("long").alias(c) for c in COUNTS]
    model = F.nullif(F.col(f"{value}.model"), F.lit(""))
    return F.when(n > 0, F.struct(*counts, F.max_by(model, F.when(model.isNotNull(), F.col(order))).alias("model")))


def billed(signals: DataFrame) -> DataFrame:
    """(session, turn, reply, usage, stop_reason) of each reply with signals: the sum of their growths where any reports one, the last
    checkpoint where all are running counts, else the sum of what they report."""
    counts = F.coalesce(F.col("source_event_type") == "token_count", F.lit(False))
    each = signals.where("reply IS NOT NULL").groupBy(*CONTEXT, "reply").agg(
        merged("delta", "queued").alias("grown"),
        F.bool_or(F.col("delta").isNotNull()).alias("grows"),
        F.bool_and(counts).alias("running"),
        F.max_by("usage", "queued").alias("final"),
        merged("usage", "queued").alias("total"),
        F.max_by("stop_reason", "queued").alias("stop_reason"),
    )
    usage = F.when(F.col("grows"), F.col("grown")).when(F.col("running"), F.col("final")).otherwise(F.col("total"))
    return each.select(*CONTEXT, "reply", usage.alias("usage"), "stop_reason")


def replies(atoms: DataFrame, session_models: DataFrame | None = None) -> DataFrame:
    """The shown assistant texts of each context, numbered from 1, with model, usage, tokens and stop reason.

    A reply's model is its own, its usage's, the last one that a model signal or a reply before it named, the session's
    (``session_models``: session, model), or ``unknown``. What its signals bill replaces its own usage.
    """
    own = shaped(atoms).where(F.col("turn").isNotNull())
    signals = attribute_signals(own)
    own = own.where(_is_reply() | (F.col("kind") == "model_signal")).withColumn("_reply", _is_reply())
    named = F.when(F.col("_reply"), F.coalesce("model", F.col("usage.model"))).otherwise(F.nullif("model", F.lit("")))
    carried = F.last(F.when(~F.col("_reply") | (F.col("_named") != "unknown"), F.col("_named")), ignorenulls=True).over(_in_context().rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_named", named).withColumn("_active", carried).where("_reply").withColumn("reply", F.row_number().over(_in_context()))
    if session_models is not None:
        own = own.join(session_models.select("session", F.col("model").alias("_of_session")), "session", "left")
    else:
        own = own.withColumn("_of_session", F.lit(None).cast("string"))
    model = F.coalesce("_named", "_active", "_of_session", F.lit("unknown"))
    bill = billed(signals).select(*CONTEXT, "reply", F.col("usage").alias("_billed"), F.col("stop_reason").alias("_stop"))
    own = own.withColumn("model", model).join(bill, [*CONTEXT, "reply"], "left")
    return own.select(
        *CONTEXT,
        "reply",
        "id",
        "time_key",
        F.coalesce("text", F.lit("")).alias("content"),
        F.coalesce("_billed", "usage").alias("usage"),
        F.coalesce(F.col("_billed.total_tokens"), F.col("usage.total_tokens")).alias("token_count"),
        F.when((F.col("model") == "unknown") & F.col("_billed.model").isNotNull(), F.col("_billed.model")).otherwise(F.col("model")).alias("model"),
        F.when(F.col("_billed").isNull(), F.col("stop_reason")).otherwise(F.coalesce("stop_reason", "_stop")).alias("stop_reason"),
    )


def result_edges(atoms: DataFrame) -> DataFrame:
    """(session, result_id, result_seq, call): each tool result with the latest earlier call of its session that has its call_id."""
    own = shaped(atoms).where("kind IN ('tool_call', 'tool_result') AND call_id IS NOT NULL")
    before = Window.partitionBy("session", "call_id").orderBy("seq_no", "id").rowsBetween(Window.unboundedPreceding, -1)
    call = F.last(F.when(F.col("kind") == "tool_call", F.col("id")), ignorenulls=True).over(before)
    return own.withColumn("call", call).where("kind = 'tool_result' AND call IS NOT NULL").select("session", F.col("id").alias("result_id"), F.col("seq_no").alias("result_seq"), "turn", "output", "time_key", "call")


def tool_calls(atoms: DataFrame) -> DataFrame:
    """The shown calls of each context in order, with the reply they belong to and the output of their first result, if that lies in the context.

    A call belongs to the assistant text before it in its session, if that is a reply of the context, else to the context's last reply.
    """
    own = shaped(atoms)
    before = Window.partitionBy("session").orderBy("seq_no", "id").rowsBetween(Window.unboundedPreceding, -1)
    spoken = (F.col("kind") == "text") & (F.col("actor_kind") == "assistant")
    said = F.last(F.when(spoken, F.struct("id", "turn", _shown().alias("shown"))), ignorenulls=True).over(before)
    last = F.max_by(F.when(_is_reply(), F.col("id")), F.when(_is_reply(), F.struct("seq_no", "id"))).over(Window.partitionBy(*CONTEXT))
    calls = own.withColumn("_said", said).withColumn("_last", last).where((F.col("kind") == "tool_call") & _shown() & F.col("turn").isNotNull())
    near = F.col("_said.shown") & (F.col("_said.turn") == F.col("turn"))
    calls = calls.withColumn("reply_id", F.when(near, F.col("_said.id")).otherwise(F.col("_last")))
    first = result_edges(own).groupBy("session", "call").agg(F.min_by(F.struct("turn", F.coalesce("output", F.lit("")).alias("output")), F.struct("result_seq", "result_id")).alias("r"))
    calls = calls.drop("output").join(first.withColumnRenamed("call", "id"), ["session", "id"], "left")
    return calls.select(
        *CONTEXT,
        (F.row_number().over(_in_context()) - 1).alias("sequence"),
        "id",
        "time_key",
        F.coalesce("tool_name", F.lit("tool_call")).alias("tool_name"),
        F.coalesce("input", F.lit("{}")).alias("input"),
        "reply_id",
        F.when(F.col("r.turn") == F.col("turn"), F.col("r.output")).alias("output"),
    )


def system_messages(atoms: DataFrame) -> DataFrame:
    own = shaped(atoms).where(F.col("turn").isNotNull() & (F.col("kind") == "text") & (F.col("actor_kind") == "system") & _shown())
    return own.select(*CONTEXT, (F.row_number().over(_in_context()) - 1).alias("sequence"), "id", "time_key", F.coalesce("text", F.lit("")).alias("content"))


def _preview(text: str, context: str) -> Column:
    return T.truncate(F.coalesce(F.nullif(T.canonical(F.col(text), context), F.lit("")), F.col(text)), 140)


def turn_context(atoms: DataFrame, session_models: DataFrame | None = None, previews: bool = True) -> DataFrame:
    """One row per context: replies, messages and calls as arrays in order, and the summary of its replies.

    ``previews`` adds short masked texts of replies, inputs and outputs. A context that holds none of the three still has its row.
    """
    said, calls, notes = replies(atoms, session_models), tool_calls(atoms), system_messages(atoms)
    if previews:
        said = said.withColumn("preview", _preview("content", "assistant_reply"))
        calls = calls.withColumn("input_summary", _preview("input", "tool_input")).withColumn("output_preview", _preview("output", "tool_output"))
    by_reply = calls.groupBy(*CONTEXT, F.col("reply_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence", F.col("id").alias("c")))), lambda x: x["c"]).alias("tool_call_ids"))
    said = said.join(by_reply, [*CONTEXT, "id"], "left").withColumn("tool_call_ids", F.coalesce("tool_call_ids", F.array().cast(by_reply.schema["tool_call_ids"].dataType)))

    def nested(rows: DataFrame, order: str, name: str, *more: Column) -> DataFrame:
        kept = [order, *(c for c in rows.columns if c not in (*CONTEXT, order))]
        return rows.groupBy(*CONTEXT).agg(F.array_sort(F.collect_list(F.struct(*kept)), lambda a, b: a[order] - b[order]).alias(name), *more)

    summary = [
        F.count("*").alias("reply_count"),
        merged("usage", "reply").alias("token_usage"),
        F.min_by("model", "reply").alias("primary_model"),
        F.bool_or(F.coalesce(F.col("stop_reason") == "error", F.lit(False))).alias("has_errors"),
    ]
    out = shaped(atoms).where(F.col("turn").isNotNull()).select(*CONTEXT).distinct()
    for part in (nested(said, "reply", "replies", *summary), nested(calls, "sequence", "calls", F.count("*").alias("call_count")), nested(notes, "sequence", "messages")):
        out = out.join(part, CONTEXT, "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({
        "reply_count": F.coalesce("reply_count", zero),
        "call_count": F.coalesce("call_count", zero),
        "has_errors": F.coalesce("has_errors", F.lit(False)),
        "zero_token_reason": F.when(F.col("reply_count").isNull(), "no_assistant_reply"),
    })


def ask_user_turns(atoms: DataFrame, platform: str) -> DataFrame:
    """Questions put to the user: (session, call_id, result_id, created_at, tool_name, questions, answers).

    A call without a result, or without a question that can be read, gives no row; of several results the last counts.
    """
    own = shaped(atoms)
    calls = own.where((F.col("kind") == "tool_call") & (F.col("tool_name") == F.lit(ask_user.TOOLS.get(platform)))).select("session", "id", "tool_name", "input")
    last = result_edges(own).groupBy("session", F.col("call").alias("id")).agg(F.max_by(F.struct("result_id", "time_key", "output"), F.struct("result_seq", "result_id")).alias("r"))
    asked = calls.join(last, ["session", "id"]).withColumn("questions", ask_user.asked_of("input")).where(F.size("questions") > 0)
    return asked.select("session", F.col("id").alias("call_id"), "r.result_id", F.col("r.time_key").alias("created_at"), "tool_name", "questions", ask_user.answers_of(platform, F.col("input"), F.col("r.output")).alias("answers"))
