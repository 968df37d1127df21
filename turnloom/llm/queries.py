"""The queries of the training-data operators, and their SQL where SQL can say it.

Each query applies its operator to the whole intended table and derives the
digest columns of its contract from the operator's own outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from turnloom.llm import byte_bpe, centroids, chat, embedding_dedup, exact_dedup, near_dedup, packing, prefix_trie, quality, suffix_dedup, token_store, toxicity, warc
from turnloom.llm.common import cut_small, read_table

END_ID = 2

ODD_CONVERSATION = -7
ODD_TEXT = "\\### Assistant: </turn> ok"


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as binary shards and read back by key."""
    store = token_store.write(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return store.read().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by a rank file and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents")
    out = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row stays of each group of equal texts, for every document."""
    out = exact_dedup.dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def held_out(key: str = "doc_id") -> Column:
    """Rows that no training sees; a null key is one."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by its nearest labelled neighbours of the training folds."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(~held_out())
    out = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels), into="score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings with a cosine of at least 0.95."""
    return embedding_dedup.link(read_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles."""
    return near_dedup.link(read_table(spark, sf_dir, "documents"), words=2, similarity=80)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text when repeated 400-byte strings go; in ``text``, a character of which only some bytes stay is U+FFFD."""
    out = suffix_dedup.remove(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    return out.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    out = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a machine that saw only the labels in the training folds."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(~held_out())
    model = toxicity.train(docs, labels)
    out = cut_small(toxicity.score(docs.select("doc_id", "text"), model, into="score").select("doc_id", "score"), "toxicity")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, formatted and read back."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(ODD_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text")
    )
    out = chat.format_trees(chat.chain(rows.unionByName(odd), "conv_id", ["turn"], "role", "text"), top=None)
    back = out.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("learnt", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), safe AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\r') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '### ', '\r'), ':', '\c') AS head
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 15)::BIGINT AS formatted_chars
FROM safe GROUP BY conv_id
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with the beginning of the first one of its block."""
    turns, lengths = prefix_trie.turns_of(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.rebuilt(turns, lengths))


#: Unsigned crc32 of the decimal conv_id, bit by bit.
CRC_SQL = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(a.c::VARCHAR, ''), lambda x: list_transform(range(8), lambda j: ((ascii(x) >> j) & 1)::BIGINT)))), lambda s, b: xor(s >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295)"

OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT c, count(*) AS n FROM t GROUP BY 1
), p AS (SELECT a.c, a.n, a.c - a.c % 20 AS b, {crc} % 4 AS h, coalesce(z.n, 0) AS bn FROM n a LEFT JOIN n z ON z.c = a.c - a.c % 20
), r AS (
  SELECT p.c, t.i, t.role, t.text FROM p JOIN t ON t.c = p.b AND t.i < p.h WHERE p.b <> p.c
  UNION ALL SELECT p.c, CASE WHEN p.b = p.c THEN t.i ELSE t.i - p.h + least(p.h, p.bn) END, t.role, t.text FROM p JOIN t ON t.c = p.c WHERE p.b = p.c OR t.i >= p.h
), x AS (
  SELECT c, i + 1 AS d, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY i) AS k, len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM r
  UNION ALL SELECT c, 0, '', 0 FROM n
), m AS (SELECT c, d, k, words, min(c) OVER (PARTITION BY d, k) AS rep, count(*) OVER (PARTITION BY d, k) AS n_convs, max(d) OVER (PARTITION BY c) AS len FROM x
), e AS (SELECT rep, d, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM m WHERE d = len GROUP BY 1, 2
), o AS (SELECT rep, d, any_value(n_convs) AS n_convs, any_value(words) AS words FROM m GROUP BY 1, 2
), q AS (SELECT o.*, u.rep AS parent FROM o LEFT JOIN m u ON u.c = o.rep AND u.d = o.d - 1
), k AS (SELECT parent AS rep, d - 1 AS d, count(*) AS n_children FROM q WHERE d > 0 GROUP BY 1, 2
), f AS (SELECT q.*, coalesce(n_children, 0) AS n_children FROM q LEFT JOIN k USING (rep, d)
), s AS (
  SELECT u.rep, u.d, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words)::BIGINT AS saved_tokens FROM f JOIN m u ON u.c = f.rep AND u.d <= f.d GROUP BY 1, 2)
SELECT f.rep AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM f JOIN s USING (rep, d) LEFT JOIN e USING (rep, d)
""".replace("{crc}", CRC_SQL)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every embedding after ten rounds from eight hashed vectors."""
    return centroids.report(*centroids.cluster(read_table(spark, sf_dir, "embeddings")))


def _op12_sql() -> str:
    """Ten rounds, one after the other; vectors and centroids lie as rows of components."""
    sql = """WITH v AS (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), vec_id) - 1 AS place, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS vec
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (SELECT place AS z, vec FROM v WHERE place < 8)"""
    near = "SELECT v.place, v.vec_id, v.vec, min(struct_pack(d := list_sum(list_transform(list_zip(v.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, z := c.z)) AS best FROM v, {c} c GROUP BY 1, 2, 3"
    for r in range(centroids.ROUNDS):
        sql += f""", a{r} AS MATERIALIZED ({near.format(c=f"c{r}")}
), m{r} AS (SELECT best.z AS z, j, sum(vec[j])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, range(1, 65) g(j) GROUP BY 1, 2
), n{r} AS (SELECT z, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY j) AS vec FROM m{r} GROUP BY 1
), c{r + 1} AS MATERIALIZED (SELECT o.z, coalesce(n.vec, o.vec) AS vec FROM c{r} o LEFT JOIN n{r} n USING (z))"""
    last = f"c{centroids.ROUNDS}"
    return (
        sql
        + f""", a AS MATERIALIZED ({near.format(c=last)})
SELECT a.vec_id, a.best.z::INT AS cluster, a.best.d AS distance, (sum(a.best.d) OVER (PARTITION BY a.best.z))::BIGINT AS cluster_inertia, (sum(a.best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(o.vec, ',')) AS centroid_sha256
FROM a JOIN {last} o ON o.z = a.best.z"""
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written as a record of a packaged archive and read back from there."""
    return warc.read(warc.write(read_table(spark, sf_dir, "pages"), least=0)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# A digest's 40 hex digits are 8 times 20 bits, which are 4 letters each.
OP13_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i::INT * 5 + 1, 5))::INT >> (15 - 5 * j::INT)) & 31) + 1, 1)), '')), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to FROM g
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat": op4_chat,
    "op5_quality": op5_quality,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_centroids": op12_centroids,
    "op13_warc": op13_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op4_chat": OP4_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_centroids": _op12_sql(),
    "op13_warc": OP13_SQL,
}
