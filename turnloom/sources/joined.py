"""Sessions in many files: messages and their parts are joined by keys that paths carry, projects are named by files beside.

Files are (origin, value), from ``json_files`` or from stored evidence. A storage holds ``session/**/<session>.json``,
``message/<session>/<name>.json`` and ``part/<message>/<name>.json``. No row gathers a session or a message: parts stay rows, and
only the names of a session's messages meet for their numbers.

Defined cases: a file that is no JSON object gives nothing, though a message's file takes its number all the same; of files that
repeat a path, the least value counts, and of files that repeat a session's id in one storage the first path does; messages without a session, parts
without a message and files elsewhere give nothing; a session without messages has no message rows; a message that has neither a role
nor a part is left out; messages of one id all get its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.session import settled
from turnloom.sources import generic as G
from turnloom.sources.seeds import _iso

FILED = r"^(.*/storage|storage)/(session|message|part)/(?:(?:.*/)?([^/]+)/)?([^/]+)\.json$"
# How parts count tokens.
COUNTS = {"input": "input", "output": "output", "reasoning": "reasoning", "read": "cache.read", "write": "cache.write"}


def json_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(origin, value) of every JSON file below a folder; each is a session, a message or a part, and one row."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(path)
    return text.select(T.decode_uri(F.col("_metadata.file_path")).alias("origin"), "value")


def _usage(record: Column, path: str) -> Column:
    """The struct of ``usage.normalised`` from counts by kind; the total is their sum, null where none is given."""
    at = lambda p: F.try_variant_get(record, f"$.{path}.{p}", "variant")
    n = {k: F.when(~G._is(at(p), "STRING") & ~G._is(at(p), "BOOLEAN"), F.try_variant_get(record, f"$.{path}.{p}", "double")) for k, p in COUNTS.items()}
    total = sum((F.coalesce(c, F.lit(0.0)) for c in n.values()), F.lit(0.0))
    cached = F.when(n["read"].isNotNull() | n["write"].isNotNull(), F.coalesce(n["read"], F.lit(0.0)) + F.coalesce(n["write"], F.lit(0.0)))
    fields = {"input_tokens": n["input"], "output_tokens": n["output"], "total_tokens": total, "cache_read_input_tokens": n["read"], "cache_creation_input_tokens": n["write"], "cached_input_tokens": cached, "reasoning_output_tokens": n["reasoning"]}
    return F.when(F.coalesce(*n.values()).isNotNull(), F.struct(*(c.cast("long").alias(k) for k, c in fields.items()), F.lit(None).cast("string").alias("model")))


def _items(part: Column) -> Column:
    """What a part's file says, in order: a text, or a tool's call and its result."""
    kind = G._string(part, "type")
    text = G._string(part, "text")
    call, tool = G._string(part, "callID callId"), G._string(part, "tool name")
    state = G._at(part, "state")
    state = F.when(G._is(state, "OBJECT"), state)
    given = F.coalesce(*(G._at(state, p) for p in ("output", "result", "metadata")))
    put = F.when(G._is(G._at(state, "input"), "STRING"), F.try_variant_get(state, "$.input", "string")).otherwise(F.coalesce(F.to_json(G._at(state, "input")), F.lit("{}")))
    result = G._shaped("tool_result", G._output(F.coalesce(G._first(state, "output result metadata"), state)), call)
    said = F.when(kind.isin("text", "reasoning") & (T.trimmed(text) != ""), F.array(G._shaped("text", text)))
    used = F.when(kind == "tool", F.filter(F.array(G._shaped("tool_call", put, call, tool), F.when(given.isNotNull(), result)), lambda x: x.isNotNull()))
    return F.coalesce(said, used, F.array().cast("array<struct<kind:string,text:string,call_id:string,tool_name:string>>"))


def _filed(files: DataFrame) -> DataFrame:
    """(origin, root, kind, folder, name, v, is_object) of the files of a storage."""
    once = files.where(F.col("origin").isNotNull()).groupBy(F.translate("origin", "\\", "/").alias("origin")).agg(F.min("value").alias("value"))
    parts = [F.regexp_extract("origin", FILED, i + 1).alias(n) for i, n in enumerate(("root", "kind", "folder", "name"))]
    rows = once.where(F.col("origin").rlike(FILED)).select("origin", *parts, F.try_parse_json("value").alias("v"))
    return settled(rows.withColumn("is_object", G._is(F.col("v"), "OBJECT")), "joined-files")


def sessions(filed: DataFrame, platform: str) -> DataFrame:
    """(root, key, session_id, title, model, workspace, created_at, updated_at) of session files."""
    v = F.col("v")
    told = filed.where("kind = 'session' AND is_object").select(
        "root",
        "origin",
        F.coalesce(G._string(v, "id sessionId session_id"), "name").alias("key"),
        G._string(v, G.TITLES).alias("title"),
        G._string(v, G.MODELS).alias("model"),
        G._string(v, G.WORKSPACES).alias("said"),
        _iso(v, "createdAt created_at created time.created").alias("created_at"),
        _iso(v, "updatedAt updated_at updated time.updated").alias("updated_at"),
    )
    own = ["title", "model", "workspace", "created_at", "updated_at"]
    # A step of its own, as the path is read several times.
    told = told.withColumn("workspace", T.path_identity(F.col("said")))
    first = told.groupBy("root", "key").agg(F.min_by(F.struct(*own), "origin").alias("s"))
    return first.select("root", "key", F.concat(F.lit(f"sess:{platform}:"), "key").alias("session_id"), *(F.col(f"s.{c}").alias(c) for c in own))


def joined(files: DataFrame, platform: str = "joined") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, messages and fragments of a storage's files.

    Sessions: session_id, title, model, workspace, created_at, updated_at, agent (the first that a message names). Messages: session_id,
    ordinal (the file's place by name), message_id, parent_id, agent, role, model, workspace, observed_at, stop_reason, usage. Fragments:
    session_id, ordinal, file (the part's name, null for those inside the message, which come first), place, kind, text, call_id, tool_name.
    """
    filed = _filed(files)
    own = settled(sessions(filed, platform), "joined-sessions")
    of_message = filed.where("kind = 'message'")
    by_name = Window.partitionBy("root", "folder").orderBy("name")
    # Names alone meet per session.
    numbers = of_message.select("root", "folder", "name", (F.row_number().over(by_name) - 1).alias("ordinal"))
    v = F.col("v")
    inline = F.transform(F.filter(F.coalesce(F.try_variant_get(v, "$.parts", "array<variant>"), F.array().cast("array<variant>")), lambda x: G._is(x, "OBJECT")), G._item)
    told = of_message.where("is_object").select(
        "root",
        "folder",
        "name",
        G._string(v, "id info.id").alias("message_id"),
        G._string(v, "parentID parentId info.parentID info.parentId").alias("parent_id"),
        G._string(v, "agentId agent info.agentId info.agent").alias("agent"),
        G.role(v).alias("role"),
        G._string(v, "modelID model info.model").alias("model"),
        G._string(v, "path.cwd").alias("said"),
        _iso(v, "timestamp info.timestamp createdAt info.createdAt time.created").alias("observed_at"),
        G._string(v, "finish stopReason info.stopReason").alias("stop"),
        F.coalesce(_usage(v, "tokens"), _usage(v, "usage")).alias("use"),
        inline.alias("inline"),
    ).withColumn("cwd", T.path_identity(F.col("said")))
    keyed = own.select("root", F.col("key").alias("folder"), "session_id", F.col("workspace").alias("of_session"))
    placed = settled(told.join(numbers, ["root", "folder", "name"]).join(keyed, ["root", "folder"]), "joined-messages")

    part = filed.where("kind = 'part' AND is_object").select("root", F.col("folder").alias("message_id"), F.col("name").alias("file"), _items(v).alias("items"), F.when(G._string(v, "type") == "step-finish", F.struct(_usage(v, "tokens").alias("use"), G._string(v, "reason").alias("stop"))).alias("end"))
    part = settled(part, "joined-parts")
    last = lambda c: F.max_by(f"end.{c}", F.when(F.col(f"end.{c}").isNotNull(), F.col("file"))).alias(f"last_{c}")
    ends = part.groupBy("root", "message_id").agg(last("use"), last("stop"), F.bool_or(F.size("items") > 0).alias("has_items"))
    messages = placed.join(ends, ["root", "message_id"], "left").where("role IS NOT NULL OR size(inline) > 0 OR has_items").select(
        "session_id",
        "ordinal",
        "message_id",
        "parent_id",
        "agent",
        "role",
        "model",
        F.coalesce("cwd", "of_session").alias("workspace"),
        "observed_at",
        T.stop_reason(F.coalesce("stop", "last_stop")).alias("stop_reason"),
        F.coalesce("use", "last_use").alias("usage"),
    )
    shape = ["session_id", "ordinal", "file", "place", "item.*"]
    inside = placed.select("session_id", "ordinal", F.lit(None).cast("string").alias("file"), F.posexplode("inline").alias("place", "item")).select(*shape)
    beside = part.select("root", "message_id", "file", F.posexplode("items").alias("place", "item"))
    fragments = inside.unionByName(placed.select("root", "message_id", "session_id", "ordinal").join(beside, ["root", "message_id"]).select(*shape))
    agents = placed.where("agent IS NOT NULL").groupBy("session_id").agg(F.min_by("agent", "ordinal").alias("agent"))
    return own.drop("root", "key").join(agents, "session_id", "left"), messages, fragments


def companions(origins: DataFrame, files: DataFrame, home: str = ".gemini") -> DataFrame:
    """(origin, project, workspace, title) of logs ``<home>/tmp/<project>/chats/...`` by the files beside them.

    A project's workspace stands in ``tmp/<project>/.project_root``, else in ``history/<project>/.project_root``, blank files not
    counting; ``projects.json`` gives the workspace's title. Without such a file the workspace is that which ``projects.json`` titles
    with the project's name, of several the first by path. The title is the project's name where nothing gives one. Logs elsewhere
    have nulls; repeated logs stay. Spark's readers pass over names that begin with a dot: ``files`` (origin, value) come from captures.
    """
    dir_ = "^(.*/" + home.replace(".", "[.]") + "|" + home.replace(".", "[.]") + ")/"
    log = dir_ + r"(?:.*/)?tmp/([^/]+)/chats/[^/]"
    take = lambda pattern, i: F.nullif(F.regexp_extract("origin", pattern, i), F.lit(""))
    logs = origins.select("origin", take(log, 1).alias("root"), take(log, 2).alias("project"))
    beside = files.select(F.translate("origin", "\\", "/").alias("origin"), "value")
    told = beside.select(take(dir_ + r"(tmp|history)/([^/]+)/[.]project_root$", 1).alias("root"), take(dir_ + r"(tmp|history)/([^/]+)/[.]project_root$", 2).alias("of"), take(dir_ + r"(tmp|history)/([^/]+)/[.]project_root$", 3).alias("project"), T.optional(F.col("value")).alias("said"))
    places = told.where("root IS NOT NULL AND said IS NOT NULL").groupBy("root", "project").agg(F.min_by("said", F.struct(F.col("of") == "history", "said")).alias("said"))
    places = settled(places.select("root", "project", T.path_identity(F.col("said")).alias("placed")), "companion-places")
    listed = beside.select(take(dir_ + r"projects[.]json$", 1).alias("root"), F.try_variant_get(F.try_parse_json("value"), "$.projects", "map<string,variant>").alias("m")).where("root IS NOT NULL")
    titles = listed.select("root", F.explode("m").alias("path", "label")).where(G._is(F.col("label"), "STRING")).select("root", "path", F.try_variant_get("label", "$", "string").alias("label"))
    of_path = titles.groupBy("root", F.col("path").alias("placed")).agg(F.min("label").alias("label"))
    of_label = titles.groupBy("root", F.col("label").alias("project")).agg(F.min("path").alias("path"))
    # A row per project, so that logs meet one each.
    projects = logs.where("project IS NOT NULL").select("root", "project").distinct()
    known = projects.join(places, ["root", "project"], "left").join(of_path, ["root", "placed"], "left").join(of_label, ["root", "project"], "left")
    named = known.select("root", "project", F.coalesce("placed", T.path_identity(F.col("path"))).alias("workspace"), F.coalesce(F.when(F.col("placed").isNotNull(), F.col("label")), "project").alias("title"))
    return logs.join(named, ["root", "project"], "left").select("origin", "project", "workspace", "title")
