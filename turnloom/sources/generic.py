"""Fragments of records whose platform has no reader of its own: roles, contents and tools are found under their usual names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import usage

# Where records keep each thing, the first string found counting.
TIMES = "timestamp updatedAt createdAt created_at"
ROLES = "role author.role author.type author sender.role sender from info.role"
WORKSPACES = "cwd workingDirectory working_directory workspacePath directory metadata.cwd metadata.workingDirectory session.cwd session.workingDirectory message.cwd workspace.path workspace.uri project.path"
MODELS = "model modelId model_id modelName model_name providerModel metadata.model session.model message.model data.modelId data.model"
TITLES = "title name label sessionTitle session.title"
PARENTS = "parentUuid parentId parent_id callingSessionId calling_session_id session.parentUuid session.parentId session.parent_id session.callingSessionId session.calling_session_id"
CHILDREN = "agentId agent_id childAgentKey child_agent_key session.agentId session.agent_id session.childAgentKey session.child_agent_key"
TEXTS = "text thinking output_text input_text content"
STOPS = "stop_reason stopReason"
PLAIN_TEXTS = "text output_text input_text output response message"
CALLS, RESULTS = ["tool_use", "tool_call", "function_call"], ["tool_result", "function_result", "function_call_output", "toolresult"]


def _at(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "variant")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _string(record: Column, paths: str) -> Column:
    """The first of these paths that holds a string."""
    return F.coalesce(*(F.when(_is(_at(record, p), "STRING"), F.try_variant_get(record, f"$.{p}", "string")) for p in paths.split()))


def _tag(value: Column) -> Column:
    """toolUse, tool-use and tool_use are one."""
    return F.lower(F.regexp_replace(F.regexp_replace(T.trimmed(value), "([a-z0-9])([A-Z])", "$1_$2"), f"[{T.SPACE}-]+", "_"))


def role(record: Column) -> Column:
    """user, assistant, system or the name given; where none is, the record's type if that is a role. Tools speak as the assistant."""
    named = F.lower(T.trimmed(_string(record, ROLES)))
    kind = F.lower(T.trimmed(_string(record, "type")))
    known = (
        F.when(named.isin("human", "user", "operator"), "user")
        .when(named.isin("assistant", "ai", "model", "bot", "tool"), "assistant")
        .when(named.isin("developer", "system", "instruction"), "system")
        .otherwise(named)
    )
    return F.when(F.coalesce(named, F.lit("")) != "", known).when(kind.isin("user", "assistant", "system", "developer"), kind)


def _joined(items: Column, otherwise: str) -> Column:
    """Texts of a list's objects, one a line; an object without one counts as ``otherwise``: nothing, or its JSON."""
    objects = F.filter(items, lambda x: _is(x, "OBJECT"))
    spare = F.to_json if otherwise == "json" else lambda _: F.lit(None).cast("string")
    return F.array_join(F.transform(objects, lambda x: F.coalesce(_string(x, "text content"), spare(x))), "\n")


def _output(value: Column) -> Column:
    """A tool's output as text."""
    return F.when(_is(value, "ARRAY"), _joined(F.try_variant_get(value, "$", "array<variant>"), "json")).when(_is(value, "OBJECT"), F.to_json(value)).otherwise(F.coalesce(F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string")), F.lit("")))


def _first(record: Column, paths: str) -> Column:
    """The first of these paths that holds anything but null."""
    return F.coalesce(*(F.when(~_is(_at(record, p), "VOID"), _at(record, p)) for p in paths.split()))


def _shaped(kind: Column | str, text: Column, call: Column | None = None, tool: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"), (none if call is None else call).alias("call_id"), (none if tool is None else tool).alias("tool_name"))


def _call(item: Column) -> Column:
    given = _first(item, "input arguments args")
    put = F.when(_is(given, "STRING"), F.try_variant_get(given, "$", "string")).otherwise(F.coalesce(F.to_json(given), F.lit("{}")))
    return _shaped("tool_call", put, _string(item, "id call_id tool_call_id"), F.coalesce(_string(item, "name tool_name"), _tag(_string(item, "type"))))


def _result(item: Column) -> Column:
    return _shaped("tool_result", _output(_first(item, "content output result text")), _string(item, "tool_use_id call_id id"))


def _item(value: Column) -> Column:
    """One entry of a content list: an object, or a string."""
    tag = _tag(_string(value, "type"))
    inner = F.when(_is(_at(value, "content"), "ARRAY"), _joined(F.try_variant_get(value, "$.content", "array<variant>"), "nothing"))
    said = F.coalesce(F.nullif(_string(value, TEXTS), F.lit("")), F.nullif(inner, F.lit("")))
    of_object = F.when(tag.isin(CALLS), _call(value)).when(tag.isin(RESULTS), _result(value)).when(said.isNotNull(), _shaped("text", said)).otherwise(_shaped("unknown", F.to_json(value)))
    return F.when(_is(value, "STRING"), _shaped("text", F.try_variant_get(value, "$", "string"))).otherwise(of_object)


def _entries(record: Column, path: str) -> Column:
    """A list as it is, anything else as a list of one; of these the objects and, in contents, strings that aren't blank."""
    value = _at(record, path)
    listed = F.coalesce(F.try_variant_get(record, f"$.{path}", "array<variant>"), F.when(value.isNotNull(), F.array(value)), F.array().cast("array<variant>"))
    if path.startswith("tool_"):
        return F.filter(listed, lambda x: _is(x, "OBJECT"))
    return F.filter(listed, lambda x: _is(x, "OBJECT") | (_is(x, "STRING") & (T.trimmed(F.try_variant_get(x, "$", "string")) != "")))


def _part(origin: str, value: Column | None = None, text: Column | None = None, more: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(origin).alias("of"), (none if value is None else value).cast("variant").alias("value"), (none if text is None else text).cast("string").alias("text"), (none if more is None else more).cast("string").alias("more"))


def _parts(message: Column) -> Column:
    """What a message holds, in order, still as it was; its plain text where that is all, and as a whole where it is a tool's result."""
    paths = {"item": ("content", "parts", "blocks"), "tool_call": ("tool_calls", "tool_call"), "tool_result": ("tool_results", "tool_result")}

    def parts(of: str, path: str) -> Column:
        return F.transform(_entries(message, path), lambda x: _part(of, x))

    found = F.concat(*(parts(of, p) for of, held in paths.items() for p in held))
    plain = _string(message, PLAIN_TEXTS)
    spare = F.filter(F.array(_part("plain", text=plain)), lambda x: T.trimmed(x["text"]) != "")
    held = F.when(F.size(found) > 0, found).otherwise(spare)
    tool = _tag(_string(message, ROLES)).isin("tool_result", "toolresult")
    return F.transform(F.when(tool, F.slice(held, 1, 1)).otherwise(held), lambda x: F.when(tool, _part("of_tool", message)).otherwise(x))


def _message(record: Column) -> Column:
    """The record's message, or the record where it holds none."""
    return F.when(_is(_at(record, "message"), "OBJECT"), _at(record, "message")).otherwise(record)


def _actor(role: Column) -> Column:
    return F.when(role == "user", "user").when(role.isin("system", "developer"), "system").otherwise("assistant")


def token_usage(records: DataFrame) -> DataFrame:
    """(origin, ordinal, usage, stop_reason) of the assistant's records among (origin, ordinal, record) that report either.

    usage is the struct of ``usage.normalised``, null where a record gives only its reason to stop. What a message says goes before
    what its record says. A record with neither role nor content reports nothing.
    """
    whole, message = F.col("record"), F.col("_m")
    rows = records.withColumn("_m", _message(whole)).withColumn("_role", F.coalesce(role(whole), role(message)))
    spoken = rows.where((_actor(F.col("_role")) == "assistant") & (F.col("_role").isNotNull() | (F.size(_parts(message)) > 0)))
    told = spoken.withColumn("_use", F.coalesce(_first(message, "usage"), _first(whole, "usage"))).withColumn("_stop", F.coalesce(_first(message, STOPS), _first(whole, STOPS)))
    counts = F.when(_is(F.col("_use"), "OBJECT"), usage.normalised(F.col("_use")))
    reason = F.when(_is(F.col("_stop"), "STRING"), T.stop_reason(F.try_variant_get("_stop", "$", "string")))
    return told.select("origin", "ordinal", counts.alias("usage"), reason.alias("stop_reason")).where("usage IS NOT NULL OR stop_reason IS NOT NULL")


def fragments(records: DataFrame) -> DataFrame:
    """(origin, ordinal, place, time_key, kind, role, text, call_id, tool_name) of records (origin, ordinal, record).

    Signals come first: workspace_signal, model_signal and title_signal carry their value as text, session_relation the parent as
    text and the child as call_id. Then come the contents: text, tool_call (its input as text), tool_result (its output), and unknown
    with its JSON. A record without role, content or signal is one unknown fragment; a record without a time has a null time_key.
    """
    whole, message = F.col("record"), F.col("_m")
    rows = records.withColumn("_m", _message(whole))
    # Each is found once, in a step of its own: what follows reads it several times.
    found = {"_parent": PARENTS, "_child": CHILDREN, "_workspace": WORKSPACES, "_model": MODELS, "_title": TITLES}
    rows = rows.select("origin", "ordinal", "record", "_m", F.coalesce(role(whole), role(message)).alias("_role"), _parts(message).alias("_parts"), *(_string(whole, x).alias(c) for c, x in found.items()), *(_string(whole, x).alias(f"_{x}") for x in TIMES.split()))
    parent, child = F.col("_parent"), F.col("_child")
    apart = F.coalesce(F.try_variant_get(whole, "$.isSidechain", "boolean"), F.try_variant_get(whole, "$.sidechain", "boolean"), F.lit(False))
    signals = [F.when(v != "", _part(k, text=v)) for k, v in (("workspace_signal", T.path_identity(F.col("_workspace"))), ("model_signal", F.col("_model")), ("title_signal", F.col("_title")))]
    signals.append(F.when(parent.isNotNull() | child.isNotNull() | apart, _part("session_relation", text=parent, more=child)))
    parts = F.concat(F.filter(F.array(*signals), lambda s: s.isNotNull()), F.col("_parts"))
    time = F.coalesce(*(T.coerce_iso(F.col(f"_{p}")) for p in TIMES.split()))
    # Records become rows before their parts are read, so that no expression repeats another.
    named = rows.select("origin", "ordinal", "record", time.alias("time_key"), "_role", F.posexplode_outer(parts).alias("place", "_p"))
    value, of = F.col("_p.value"), F.col("_p.of")
    of_tool = _shaped("tool_result", _output(_at(value, "content")), _string(value, "toolUseId tool_use_id toolCallId tool_call_id id"), _string(value, "toolName tool_name"))
    bare = _shaped("unknown", F.when(F.col("_role").isNull(), F.to_json("record")))
    told = F.when(of.isNull(), bare).when(of == "item", _item(value)).when(of == "tool_call", _call(value)).when(of == "tool_result", _result(value)).when(of == "of_tool", of_tool).when(of == "plain", _shaped("text", F.col("_p.text"))).otherwise(_shaped(of, F.col("_p.text"), F.col("_p.more")))
    actor = _actor(F.col("_role"))
    # A record that has a role but says nothing gives no fragment.
    read = named.where("_p IS NOT NULL OR _role IS NULL").select("origin", "ordinal", F.coalesce("place", F.lit(0)).alias("place"), "time_key", actor.alias("role"), told.alias("_f"))
    return read.select("origin", "ordinal", "place", "time_key", "_f.kind", "role", "_f.text", "_f.call_id", "_f.tool_name")
