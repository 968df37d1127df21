"""Chat formatting from reply trees, with DataFrame functions only.

``messages`` has one row per message: ``tree`` (which conversation tree),
``node`` (unique in the tree), ``parent`` (a node of the tree; null at a root),
``role``, ``text`` and ``score``. Every root-to-leaf path is a branch. Branches
of a tree are ranked by the mean score of their messages (highest first, then
the longer one, then the smallest leaf), and each of the ``top`` first ones
becomes one formatted conversation.

Self-joins double the known stretch of each path every round, so a tree of
depth d takes about log2(d) rounds, and no row carries a path while it is
being searched.

Defined cases: a null text counts as empty and a null role as the empty role;
a null score counts as 0; a parent that isn't in the tree makes its row a root;
rows on or under a parent cycle have no root and are left out; so are rows with a
null node. Of rows that repeat a node of a tree the least by parent, role, text
and score stays (nulls as just said, a null parent first). An empty table gives
no rows; more columns of ``messages`` are ignored.

Template, per turn: ``### role: text </turn>\\n``. Inside roles and texts a
backslash becomes ``\\b``, ``</turn>`` becomes ``\\e`` and ``### `` becomes
``\\r``; in roles ``:`` also becomes ``\\c``. Thus no ``</turn>`` inside a role or
text stands in the output, ``### `` stands before a turn's end only where a text
ends in ``###``, and ``parse`` gives back the very turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import cut

OPEN, CLOSE, BETWEEN, END = "### ", "</turn>", ": ", " </turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.replace(out, F.lit(CLOSE), F.lit("\\e"))
    return F.replace(out, F.lit(OPEN), F.lit("\\r"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\e"), F.lit(CLOSE))
    out = F.replace(out, F.lit("\\r"), F.lit(OPEN))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def chain(rows: DataFrame, tree: str, order: list[str], role: str, text: str) -> DataFrame:
    """Messages of plain conversations: each row's parent is the row before it.

    Rows that tie in ``order`` follow each other by role and text.
    """
    by = Window.partitionBy("tree").orderBy("o", "role", "text")
    return (
        rows.select(F.col(tree).alias("tree"), F.struct(*order).alias("o"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumn("node", F.row_number().over(by).cast("long"))
        .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
    )


def _jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depth and score sum of each node that a root reaches, and its 1st, 2nd, 4th ... ancestors.

    A node is done once its known stretch ends at a root. Only the others are
    joined again, so a few deep trees don't carry the shallow ones along. A node
    deeper than the stretch has an ancestor that this round finishes; so a round
    that finishes none leaves only nodes on or under cycles, and ends the search.
    """
    now = cut(nodes.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), "score"), "chat-jumps")
    done = now.where(F.col("up").isNull())
    ways = now.where(F.col("up").isNotNull())
    jumps: list[DataFrame] = []
    while not ways.isEmpty():
        jumps.append(ways.select("tree", "node", "up"))
        above = done.unionByName(ways).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        now = cut(ways.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("score") + F.col("score2")).alias("score")), "chat-jumps")
        rooted = now.where(F.col("up").isNull())
        if rooted.isEmpty():
            break
        done = done.unionByName(rooted)
        ways = now.where(F.col("up").isNotNull())
    return done.drop("up"), jumps


def _once(messages: DataFrame) -> DataFrame:
    """The least row of each node of a tree, without nulls in role, text and score."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    own = messages.where(F.col("node").isNotNull()).select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), score)
    least = Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score")
    return own.withColumn("copy", F.row_number().over(least)).where("copy = 1").drop("copy")


def branches(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """Rows (tree, leaf, rank, depth, node) of the messages on each chosen path; depth is 1 at the root."""
    return _branches(_once(messages), top)


def _branches(nodes: DataFrame, top: int | None) -> DataFrame:
    own = nodes.schema["tree"].dataType
    nodes = nodes.select("tree", "node", "parent", "score")
    # A null tree is a tree of its own: joins below need a key that equals itself.
    nodes = nodes.withColumn("tree", F.struct(F.col("tree").isNull().alias("none"), F.coalesce("tree", F.lit(0).cast(own)).alias("id")))
    have = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    nodes = nodes.join(have, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), "score")
    nodes = cut(nodes, "chat-nodes")
    reached, jumps = _jumps(nodes)
    leaves = reached.join(nodes.select("tree", F.col("parent").alias("node")).where(F.col("node").isNotNull()).distinct(), ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("depth")), F.desc("depth"), "node")
    ranked = leaves.select("tree", F.col("node").alias("leaf"), "node", "depth", F.row_number().over(best).alias("rank"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    # Each row stands for the stretch from ``node`` up; halving the stretch from the longest jump down lists every node once.
    rows = cut(ranked.withColumn("span", F.col("depth")), "chat-paths")
    for level in range(len(jumps) - 1, -1, -1):
        step = 1 << level
        ahead = F.col("span") > step
        halves = F.array(
            F.struct(F.col("node").alias("node"), F.col("depth").alias("depth"), F.lit(step).cast("long").alias("span")),
            F.struct(F.col("up").alias("node"), (F.col("depth") - step).alias("depth"), (F.col("span") - step).alias("span")),
        )
        split = rows.where(ahead).join(jumps[level], ["tree", "node"]).select("tree", "leaf", "rank", F.explode(halves).alias("p")).select("tree", "leaf", "rank", "p.node", "p.depth", "p.span")
        rows = cut(rows.where(~ahead).select("tree", "leaf", "rank", "node", "depth", "span").unionByName(split), "chat-paths")
    return rows.select(F.when(~F.col("tree.none"), F.col("tree.id")).alias("tree"), "leaf", "rank", "depth", "node")


def format_trees(messages: DataFrame, top: int | None = 1, learn: str = "assistant") -> DataFrame:
    """One row per chosen branch: tree, leaf, rank, n_turns, formatted, loss_spans.

    ``loss_spans`` holds (start, length) in code points of ``formatted``: the
    escaped text of each ``learn`` message, in order.
    """
    messages = _once(messages)
    on_path = _branches(messages, top)
    said = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = on_path.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    grouped = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    head = F.transform("turns", lambda x: F.concat(F.lit(OPEN), _escape_role(x["role"]), F.lit(BETWEEN)))
    body = F.transform("turns", lambda x: escape(x["text"]))
    parts = grouped.withColumns({"head": head, "body": body})
    # Running lengths: where each turn's text starts.
    sizes = F.zip_with("head", "body", lambda h, b: F.length(h) + F.length(b) + len(END))
    parts = parts.withColumn("piece", F.zip_with("head", "body", lambda h, b: F.concat(h, b, F.lit(END)))).withColumn("sizes", sizes)
    fold = F.aggregate(
        F.sequence(F.lit(1), F.size("turns")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, i: F.struct(
            (acc["at"] + F.element_at("sizes", i)).alias("at"),
            F.when(
                F.element_at("turns", i)["role"] == learn,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(F.element_at("head", i))).alias("start"), F.length(F.element_at("body", i)).alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return parts.select("tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("", "piece").alias("formatted"), fold["spans"].alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text)."""
    pieces = F.split(formatted, "</turn>\n", -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        at = F.locate(BETWEEN, piece)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(piece, at + len(BETWEEN), F.length(piece) - at - len(BETWEEN))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(whole, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))))
