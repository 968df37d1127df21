"""MinHash near-dedup with tensored banding.

A document's set holds its distinct word shingles. Two small collections of
``PARTS`` band parts each (``ROWS`` minhashes a part) are computed, and every pair
of a part from the one and a part from the other forms a table key: PARTS^2
tables from 2 * PARTS * ROWS minhashes. Documents of equal sets are one node, so
copies make no candidates, and rows of one doc_id but of other texts aren't mixed up.

Nodes that share a key are candidates. Candidates are confirmed on full sets in
rounds: in each table bucket every node is compared with one anchor, skipping
what is connected already; then anchors change. When the anchors' rounds end,
each pair that shares a key, lies in different components and wasn't compared
is compared too, so no candidate goes unchecked. Pairs of small buckets are
rows; the nodes of crowded buckets are gathered by the crowd they form, cut into
blocks, and each pair of blocks counts its intersections by a matrix product
and returns links, at most one per node. Sizes that can't reach the threshold
are skipped, which loses nothing.

Words are the runs of other characters between ASCII white space, lower-cased
in A-Z only. Defined cases: a text without words, or null, has the empty set and
links with nothing; fewer words than a shingle make one shingle; a null doc_id
is returned unlinked, its component null; repeated rows link; rows of one doc_id
with different texts are documents of their own, each in the group of its text; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import cut, forget, fresh, small_batches
from turnloom.llm.components import components, roots
from turnloom.llm.mphf import mix
from turnloom.llm.word_bpe import as_bytes, slices

WORDS, SIMILARITY = 5, 80
PARTS, ROWS = 10, 3
ANCHOR_ROUNDS = 2
#: Open members from which a bucket is crowded; documents and shingles of a block of a crowd; shingles multiplied at a time.
CROWDED, BLOCK, BLOCK_SHINGLES, COLUMNS = 32, 256, 250_000, 4096
#: Bytes of text whose words a worker takes at a time.
PIECE = 1 << 18
#: Members that one task compares with their anchor in a row; more are dealt to further tasks.
GROUP = 500

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, _BASE, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Each text's set of shingles as sorted 64-bit hashes."""
    texts = [t or b"" for t in texts]
    if not texts:
        return []
    data = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    solid = ~_SPACE[data]
    begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])) if len(data) else np.zeros(0, np.int64)
    if not len(begins):
        return [np.zeros(0, np.uint64)] * len(texts)
    ends = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
    lens = ends - begins
    firsts = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(firsts, lens)
    with np.errstate(over="ignore"):
        value = (data[solid].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[place]
        word = mix(np.add.reduceat(value, firsts) ^ (lens.astype(np.uint64) << np.uint64(40)), 3)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(begins, starts)
    scale = _powers(words + 1)
    out = []
    with np.errstate(over="ignore"):
        n = len(word) - words + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(words if n > 0 else 0):
            rolled += word[k : k + n] * scale[k + 1]
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            if b - a >= words:
                own = rolled[a : b - words + 1]
            elif b > a:
                own = np.array([(word[a:b] * scale[1 : b - a + 1]).sum(dtype=np.uint64) ^ np.uint64(b - a)], np.uint64)
            else:
                own = np.zeros(0, np.uint64)
            out.append(np.unique(own))
    return out


def _coefficients() -> np.ndarray:
    return mix(np.arange(2 * PARTS * ROWS, dtype=np.uint64), 11) | np.uint64(1)


def band_parts(sets: list[np.ndarray]) -> np.ndarray:
    """2 * PARTS hashed band parts of each set, which must not be empty."""
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = mix(np.concatenate(sets), 17)
    firsts = np.cumsum(lens) - lens
    out = np.zeros((len(sets), 2 * PARTS), np.uint64)
    with np.errstate(over="ignore"):
        for k, a in enumerate(_coefficients().tolist()):
            least = np.minimum.reduceat(flat * np.uint64(a), firsts)
            out[:, k // ROWS] = mix(out[:, k // ROWS] ^ least, k)
    return out


SIGNATURE = "doc_id long, said long, n_shingles long, digest binary, left array<long>, right array<long>"


def signatures(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SIGNATURE of every row: a hash of its text (``said``), set size, a 128-bit digest of the set, and the two collections (null for the empty set)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                sets = shingle_sets(as_bytes(part.column("text")).to_pylist(), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                parts = band_parts([sets[i] for i in full]).view(np.int64) if full else np.zeros((0, 2 * PARTS), np.int64)
                at = np.full(len(sets), -1)
                at[full] = np.arange(len(full))
                sides = []
                for side in (parts[:, :PARTS], parts[:, PARTS:]):
                    offsets = np.concatenate([[0], np.cumsum(np.where(at >= 0, PARTS, 0))])
                    sides.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(side).ravel(), pa.int64())))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("said"), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests, pa.binary()), *sides], ["doc_id", "said", "n_shingles", "digest", "left", "right"])

    own = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(own).alias("said"), own.alias("text")).mapInArrow(rows, SIGNATURE)


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """(anchor, member) of the pairs whose full sets are similar enough. An anchor's members are dealt out in groups."""
    many = pairs.groupBy("anchor").agg(F.ceil(F.count("*") / GROUP).alias("lots"))
    dealt = pairs.join(many, "anchor").select("anchor", F.pmod(F.xxhash64("member"), F.col("lots")).alias("lot"), F.col("member").alias("doc"), F.lit(True).alias("is_member"))
    heads = many.select("anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.col("anchor").alias("doc"), F.lit(False).alias("is_member"))
    wanted = dealt.unionByName(heads).join(texts, "doc")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, head = None, None
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                sets = shingle_sets(as_bytes(part.column("text")).to_pylist(), words)
                found: list[tuple[int, int]] = []
                for anchor, lot, doc, member, own in zip(*(part.column(c).to_pylist() for c in ("anchor", "lot", "doc", "is_member")), sets, strict=True):
                    if not member:
                        group, head = (anchor, lot), own
                    elif group == (anchor, lot):
                        both = len(np.intersect1d(head, own, assume_unique=True))
                        if both and 100 * both >= similarity * (len(head) + len(own) - both):
                            found.append((anchor, doc))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([d for _, d in found], pa.int64())], ["anchor", "member"])

    return wanted.repartition("anchor", "lot").sortWithinPartitions("anchor", "lot", "is_member").select("anchor", "lot", "doc", "is_member", "text").mapInArrow(compare, "anchor long, member long")


def _crossing(similarity: int, words: int):
    """Links between nodes of different labels of two blocks."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = int(key[1]), int(key[2])
        rows = rows.sort_values("doc", ignore_index=True)
        sets = shingle_sets([t.encode() for t in rows["text"]], words)
        left, right = np.flatnonzero(rows["block"] == low), np.flatnonzero(rows["block"] == high)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, code, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = met[code] > 1
        owner, code = owner[shared], code[shared]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        code = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if len(code) else code
        both = np.zeros((len(left), len(right)))
        place = np.zeros(len(sets), np.int64)
        place[left] = np.arange(len(left))
        on_right = np.full(len(sets), -1)
        on_right[right] = np.arange(len(right))
        is_left = rows["block"].to_numpy() == low
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
            a, b = np.searchsorted(code, [at, at + COLUMNS])
            who, what = owner[a:b], code[a:b] - at
            x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
            mine, other = is_left[who], on_right[who] >= 0
            x[place[who[mine]], what[mine]] = 1
            y[on_right[who[other]], what[other]] = 1
            both += x @ y.T
        labels = rows["label"].to_numpy()
        enough = 100 * both >= similarity * (sizes[left][:, None] + sizes[right][None, :] - both)
        i, j = np.nonzero(enough & (both > 0) & (labels[left][:, None] != labels[right][None, :]))
        docs, root = rows["doc"].to_numpy(), roots(len(rows), left[i], right[j])
        moved = np.flatnonzero(root != np.arange(len(rows)))
        return pd.DataFrame({"anchor": docs[root[moved]], "member": docs[moved]})

    return compare


def _crowds(members: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """(anchor, member) links between the labels of each crowd: members are (doc, n, label, crowd)."""
    blocks = members.groupBy("crowd").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "crowd").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("crowd", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc", "label")
    return paired.join(texts, "doc").groupBy("crowd", "low", "high").applyInPandas(_crossing(similarity, words), "anchor long, member long")


def _linked(docs: DataFrame, words: int, similarity: int, key: str, text: str) -> DataFrame:
    """(doc_id, said, n_shingles, component, least) of every row: ``component`` names its group, ``least`` is that group's smallest doc_id; null where a row can't be in one."""
    spark = docs.sparkSession
    with small_batches(spark):
        rows = cut(signatures(docs, words, key, text), "near-signatures")
    real = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # One node per distinct set, whatever the doc_ids of its rows; a row that has it, by id and text, stands for it.
    row = F.struct("doc_id", "said")
    nodes = real.groupBy("digest").agg(F.min(row).alias("row"), F.first("n_shingles").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    nodes = nodes.select("digest", F.col("row.doc_id").alias("least"), F.col("row.said").alias("said"), "n", "left", "right", F.monotonically_increasing_id().alias("doc"))
    nodes = cut(nodes, "near-nodes")
    keys = nodes.select("doc", "n", F.explode(F.flatten(F.transform("left", lambda a: F.transform(F.col("right"), lambda b: F.xxhash64(a, b))))).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("in"), F.min("doc").alias("d1"), F.max("doc").alias("d2"))
    # Buckets of one node are most of the keys; the rest is what travels on.
    buckets = cut(keys.join(shared.where("`in` > 1").select("key"), "key", "left_semi"), "near-buckets")
    wanted = nodes.join(buckets.select("doc").distinct(), "doc", "left_semi").select("doc", "least", "said")
    own = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).cast("long").alias("least"), F.xxhash64(own).alias("said"), own.alias("text")).join(wanted, ["least", "said"])
    near = cut(texts.groupBy("least", "said", "doc").agg(F.min("text").alias("text")).select("doc", "text"), "near-texts")

    fits = (100 * F.least("n", "n2") >= similarity * F.greatest("n", "n2")) & (F.col("doc") != F.col("doc2"))
    labels, tested, links = None, None, None
    spent = [buckets, near]
    for turn in range(ANCHOR_ROUNDS + 1):
        own = buckets.withColumn("label", F.col("doc"))
        if labels is not None:
            own = buckets.join(labels, F.col("doc") == F.col("node"), "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("label"))
        # A bucket whose nodes are all connected has nothing left to compare.
        open_keys = own.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("in"), F.min("doc").alias("least")).where("l1 != l2").drop("l1", "l2")
        own = cut(own.join(open_keys, "key"), "near-open")
        spent.append(own)
        if turn < ANCHOR_ROUNDS:
            # The anchor of a bucket changes from turn to turn; the first is its smallest document.
            order = F.struct((F.col("doc") if turn == 0 else F.xxhash64("doc", F.lit(turn))).alias("o"), "doc", "n", "label")
            heads = own.groupBy("key").agg(F.min(order).alias("h")).select("key", F.col("h.doc").alias("doc2"), F.col("h.n").alias("n2"), F.col("h.label").alias("label2"))
            met = own.join(heads, "key").where(fits & (F.col("label") != F.col("label2"))).select(F.col("doc2").alias("anchor"), F.col("doc").alias("member"))
            crowd = None
        else:
            crowd = components(own.where(F.col("in") > CROWDED), "doc", "least")
            crowd = cut(crowd.select("node", F.col("component").alias("crowd")), "near-crowds")
            small = own.where(F.col("in") <= CROWDED).join(crowd, F.col("doc") == F.col("node"), "left").select("key", "doc", "n", "label", "crowd")
            twin = small.select("key", F.col("doc").alias("doc2"), F.col("n").alias("n2"), F.col("label").alias("label2"), F.col("crowd").alias("crowd2"))
            apart = F.coalesce(F.col("crowd") != F.col("crowd2"), F.lit(True))
            met = small.join(twin, "key").where(fits & (F.col("doc") < F.col("doc2")) & (F.col("label") != F.col("label2")) & apart).select(F.col("doc").alias("anchor"), F.col("doc2").alias("member"))
        # A pair met from both sides is compared once.
        pairs = met.groupBy(F.least("anchor", "member").alias("lo"), F.greatest("anchor", "member").alias("hi")).agg(F.min("anchor").alias("anchor"))
        if tested is not None:
            pairs = pairs.join(tested, ["lo", "hi"], "left_anti")
        pairs = cut(pairs, "near-pairs")
        spent.append(pairs)
        tested = pairs.select("lo", "hi") if tested is None else tested.unionByName(pairs.select("lo", "hi"))
        found = _confirm(pairs.select("anchor", F.when(F.col("anchor") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("member")), near, words, similarity)
        if crowd is not None:
            members = own.select("doc", "n", "label").distinct().join(crowd, F.col("doc") == F.col("node")).select("doc", "n", "label", "crowd")
            found = found.unionByName(_crowds(members, near, words, similarity))
        with small_batches(spark):
            found = cut(found, "near-links")
        spent.append(found)
        links = found if links is None else links.unionByName(found)
        labels = cut(components(links, "anchor", "member"), "near-labels")
    forget(*spent)

    # A group's smallest doc_id is found among the nodes that are linked; any other node is a group of its own.
    joined = labels.join(nodes.select(F.col("doc").alias("node"), "least"), "node")
    smallest = joined.groupBy("component").agg(F.min("least").alias("smallest"))
    grouped = labels.join(smallest, "component").select(F.col("node").alias("doc"), "component", "smallest")
    of_node = nodes.select("digest", "doc", "least").join(grouped, "doc", "left").select("digest", F.coalesce("component", "doc").alias("component"), F.coalesce("smallest", "least").alias("least"))
    out = rows.join(of_node, "digest", "left")
    there = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select("doc_id", "said", "n_shingles", F.when(there, F.col("component")).alias("component"), F.when(there, F.col("least")).alias("least"))


def link(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    out = _linked(docs, words, similarity, key, text).select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def keep_first(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of the smallest doc_id, of rows that share it the one whose text hashes least.

    Rows without words or without an id are in no group and stay.
    """
    rows = cut(_linked(docs, words, similarity, key, text).where("component IS NOT NULL").select("doc_id", "said", "component"), "near-rows")
    row = F.struct("doc_id", "said")
    many = rows.groupBy("component").agg(F.min(row).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    marked = rows.join(many, "component").select("doc_id", "said", (row == F.col("best")).alias("is_best"))
    counted = marked.groupBy("doc_id", "said").agg(F.bool_or("is_best").alias("again"), F.count("*").alias("rows"))
    # A best row that repeats, id, text and all, stays once.
    gone = cut(counted.where("NOT again OR rows > 1").select("doc_id", "said", "again"), "near-gone")
    forget(rows)
    number, mark = fresh(docs, "number", "mark")
    gone = gone.withColumnsRenamed({"doc_id": number, "said": mark})
    named = docs.withColumn(number, F.col(key).cast("long")).withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    out = named.join(gone, [number, mark], "left_anti")
    repeated = gone.where("again")
    if not repeated.isEmpty():
        out = out.unionByName(named.join(repeated, [number, mark], "left_semi").dropDuplicates([number, mark]))
    return out.select(*docs.columns)
