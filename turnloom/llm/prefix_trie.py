"""The trie of all conversations' common beginnings, by prefix doubling.

A node is a distinct sequence of first turns (role and text). Nodes are found by
naming, in a number of join rounds that is logarithmic in the longest conversation:

1. every turn gets a dense name, equal turns the same one;
2. blocks of 2^k turns, aligned to their size, are pairs of blocks of half the size,
   and distinct pairs get dense names again;
3. the first d turns are the blocks of d's binary digits, from the highest digit down;
   the prefixes whose lowest digit is 2^k are named in one round from shorter
   prefixes and blocks of that size;
4. equal names of equal length are a node. It is known by its smallest member, so the
   ancestor s steps above a node of depth d is that member's node of depth d - s.

What a subtree holds is summed by doubling too: after round k a node's sums hold its
descendants less than 2^k below. No conversation, node or subtree is gathered: turns
are numbered by their place in a sorted table, counts and sums are combined before they
are shuffled, and joins on names leave one side unique, so adaptive execution can
split a hot name. Only the ids that end in one node meet in one task, as a digest
needs them in order; they stream through it as blocks of text.

Turns are ordered by turn number (null first), then role and text, which settles
ties. Defined cases: a null role or text is empty; repeated rows are turns of their
own; rows without a conversation id belong to no conversation and are left out; an
empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import cut, forget

#: Conversations of a block of ids begin with at most SHARED - 1 turns of the block's first one.
BLOCK, SHARED = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, i, digest, words) of each turn, i from 0 in the order of turns, and (conv, n) of each conversation.

    Rows are sorted over all tasks; a turn's number is its place in its task's stretch of the conversation, after
    those of the tasks before, so a long conversation needs no task of its own.
    """
    said = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The head of a text orders as the text does, and keeps the sampled range bounds short.
    spread = said.repartitionByRange("conv", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv", "turn", "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    placed = cut(spread.select("conv", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("at")), "trie-turns")
    part = F.shiftright("at", 33)
    stretches = placed.groupBy("conv", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # A conversation has a stretch for each task that holds a part of it.
    of_conv = stretches.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "first", "n"))).alias("s"))
    before = F.aggregate(F.slice("s", 1, F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    starts = of_conv.select("conv", "s", F.posexplode("s").alias("k", "own")).select("conv", F.col("own.part").alias("part"), (before - F.col("own.first")).alias("shift"))
    turns = placed.withColumn("part", part).join(starts, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("i"), "digest", "words")
    return turns, stretches.groupBy("conv").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of conversation c - c % BLOCK in place of its own, h being crc32(c) % SHARED."""
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    base = F.col("conv") - F.col("conv") % BLOCK
    firsts = lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = lengths.withColumn("h", taken).withColumn("base", base).join(firsts, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = plan.withColumn("own", F.col("conv") == F.col("base"))
    kept = turns.join(plan.select("conv", "h", "lent", "own"), "conv").where("own OR i >= h")
    kept = kept.select("conv", F.when(F.col("own"), F.col("i")).otherwise(F.col("i") - F.col("h") + F.col("lent")).alias("i"), "digest", "words")
    # At most SHARED - 1 turns of a block's first conversation go to each of the block.
    lent = turns.where((F.col("i") < SHARED - 1) & (F.col("conv") % BLOCK == 0)).withColumnRenamed("conv", "base")
    lent = lent.join(plan.where("NOT own").select("conv", "base", "lent"), "base").where("i < lent").select("conv", "i", "digest", "words")
    n = F.when(F.col("own"), F.col("n")).otherwise(F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    return kept.unionByName(lent), plan.select("conv", n.alias("n"))


def _dense(known: DataFrame) -> Column:
    """The place from 0 of each row of a written table whose ``at`` is its increasing id: of each part of the table one number is collected."""
    sizes = {r["part"]: r["n"] for r in known.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for part in range(max(sizes, default=-1) + 1):
        # Ids of a part begin at part << 33.
        starts.append(f"{before - (part << 33)}L")
        before += sizes.get(part, 0)
    return F.col("at") + F.expr(f"get(array({', '.join(starts) or '0L'}), cast(shiftright(at, 33) as int))")


def named(rows: DataFrame, keys: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``name``, a dense number of each distinct combination of ``keys``, which go; and the written names."""
    known = cut(rows.select(*keys).distinct().withColumn("at", F.monotonically_increasing_id()), label)
    return rows.join(known.select(*keys, _dense(known).alias("name")), keys).drop(*keys), known


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """(conv, d, name) of every non-empty prefix: prefixes of equal d and name are equal."""
    spent = []
    blocks, now = [], cut(turns.select("conv", "i", "digest"), "trie-blocks")
    keys = ["digest"]
    for k in range(longest.bit_length()):
        own, known = named(now, keys, "trie-names")
        spent += [now, known]
        blocks.append(own)
        if 2 << k <= longest:
            pair = own.groupBy("conv", F.shiftright("i", 1).alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("b"))
            now, keys = cut(pair.where("a IS NOT NULL AND b IS NOT NULL"), "trie-blocks"), ["a", "b"]
    done: DataFrame | None = None
    for k in reversed(range(len(blocks))):
        # The block of the lowest digit begins where the higher digits' prefix ends.
        low = blocks[k].where("i % 2 = 0").select("conv", F.shiftleft("i", k).alias("start"), F.col("name").alias("b"))
        if done is None:
            both = low.withColumn("a", F.lit(-1).cast("long"))
        else:
            both = low.join(done.select("conv", F.col("d").alias("start"), F.col("name").alias("a")), ["conv", "start"], "left").withColumn("a", F.coalesce("a", F.lit(-1).cast("long")))
        both = cut(both.select("conv", (F.col("start") + (1 << k)).alias("d"), F.col("start").alias("size"), "a", "b"), "trie-prefixes")
        own, known = named(both, ["size", "a", "b"], "trie-names")
        own = cut(own.select("conv", "d", "name"), "trie-prefixes")
        spent += [both, known]
        done = own if done is None else done.unionByName(own)
    forget(*spent)
    return done


def _blocks_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one node as one text of ids, a run for each batch."""
    for batch in batches:
        rep, d, conv = (batch.column(c).to_pylist() for c in ("rep", "d", "conv"))
        out: list[tuple[int, int, int, str]] = []
        at = 0
        while at < len(rep):
            stop = at + 1
            while stop < len(rep) and rep[stop] == rep[at] and d[stop] == d[at]:
                stop += 1
            out.append((rep[at], d[at], conv[at], ",".join(map(str, conv[at:stop]))))
            at = stop
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.string())], ["rep", "d", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids, from its blocks in order."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()])], ["rep", "d", "ends_sha256"])

    for batch in batches:
        for rep, d, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "d", "ids")), strict=True):
            if now == (rep, d):
                state.update(b",")
            else:
                if now is not None:
                    yield row()
                now, state = (rep, d), hashlib.sha256()
            state.update(ids.encode())
    if now is not None:
        yield row()


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` are (conv, i, digest, words) with i from 0 in each conversation, ``lengths`` (conv, n), conversations without turns included.
    """
    turns, lengths = cut(turns, "trie-turns"), cut(lengths, "trie-lengths")
    whole = lengths.agg(F.min("conv").alias("rep"), F.count("*").alias("n"), F.max("n").alias("longest")).first()
    spark = turns.sparkSession
    kind = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not whole["n"]:
        return spark.createDataFrame([], kind)
    root, longest = whole["rep"], whole["longest"]
    if longest:
        named_prefixes = prefixes(turns, longest)
        nodes = named_prefixes.groupBy("d", "name").agg(F.min("conv").alias("rep"), F.count("*").alias("n"))
        members = cut(named_prefixes.join(nodes, ["d", "name"]).select("conv", "d", "rep", "n"), "trie-members")
    else:
        members = spark.createDataFrame([], "conv long, d long, rep long, n long")
    up = members.select(F.col("conv").alias("rep"), F.col("d").alias("above"), F.col("rep").alias("parent"))
    own = members.where("conv = rep").select("rep", "d", "n")
    own = own.join(turns.select(F.col("conv").alias("rep"), (F.col("i") + 1).alias("d"), "words"), ["rep", "d"])
    own = own.withColumn("above", F.col("d") - 1).join(up, ["rep", "above"], "left").withColumn("parent", F.when(F.col("above") == 0, root).otherwise(F.col("parent")))
    own = cut(own, "trie-nodes")
    children = own.groupBy(F.col("parent").alias("rep"), F.col("above").alias("d")).agg(F.count("*").alias("n_children"))
    own = cut(own.join(children, ["rep", "d"], "left").select("rep", "d", "parent", "n", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), ((F.col("n") - 1) * F.col("words")).alias("saved")), "trie-nodes")

    sums = own.select("rep", "d", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    top = sums.agg(F.coalesce(F.sum("leaves"), F.lit(1)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.count_if(F.col("d") == 1).alias("n_children")).first()
    step, spent = 1, []
    while step < longest:
        below = sums.where(F.col("d") > step).withColumn("above", F.col("d") - step)
        moved = below.join(up, ["rep", "above"]).select(F.col("parent").alias("rep"), F.col("above").alias("d"), "leaves", "saved")
        sums = cut(sums.unionByName(moved).groupBy("rep", "d").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-sums")
        spent.append(sums)
        step *= 2
    forget(*spent[:-1])

    ends = lengths.select("conv", F.col("n").alias("d")).join(members.select("conv", "d", "rep"), ["conv", "d"], "left").select(F.when(F.col("d") == 0, root).otherwise(F.col("rep")).alias("rep"), "d", "conv")
    runs = ends.repartitionByRange("rep", "d", "conv").sortWithinPartitions("rep", "d", "conv").mapInArrow(_blocks_of_ids, "rep long, d long, first long, ids string")
    digests = runs.repartition("rep", "d").sortWithinPartitions("rep", "d", "first").mapInArrow(_digests, "rep long, d long, ends_sha256 string")

    crown = spark.range(1).select(F.lit(root).cast("long").alias("rep"), F.lit(0).cast("long").alias("d"), F.lit(None).cast("long").alias("parent"), F.lit(whole["n"]).cast("long").alias("n"), F.lit(top["n_children"]).cast("long").alias("n_children"), F.lit(top["leaves"]).cast("long").alias("leaves"), F.lit(top["saved"]).cast("long").alias("saved"))
    out = own.drop("saved").join(sums, ["rep", "d"]).unionByName(crown).join(digests, ["rep", "d"], "left")
    return out.select(
        F.col("rep").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
