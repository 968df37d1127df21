"""Hashing, token files, byte-level encoding and chat formatting: round trips and public libraries as references."""

import base64
import string
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnloom.llm import byte_bpe, chat, token_store, word_bpe
from turnloom.llm.common import small_batches
from turnloom.llm.mphf import MinimalPerfectHash
from turnloom.llm.word_bpe import encoder

WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", "  ", "a", "Ábc. Don't 12 <|endoftext|>", "a\x1cb\x85c d　e", "x" * 50_000, "same", "same", "\n\n a  b\t", "😀 漢字", "word " * 3000]


def test_minimal_perfect_hash_fills_its_slots():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    index = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(keys).to_bytes())
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert MinimalPerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3
    with pytest.raises(ValueError):
        MinimalPerfectHash.build(np.array([1, 1], np.uint64))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aB é'st.,!\n\t 12\x1c\x85　漢😀")), max_size=25))
def test_encoders_equal_the_libraries(text):
    ids, _ = encoder(WORDS, None).encode([text.encode()])
    assert ids.tolist() == Tokenizer_().encode(text, add_special_tokens=False).ids
    ids, counts = byte_bpe.encoder(RANKS, P.PATTERN).encode([text])
    assert ids.tolist() == Tik().encode_ordinary(text)
    assert byte_bpe.vocabulary(RANKS).decode(ids, counts)[0].tobytes() == text.encode()


def cached(f):
    held = []
    return lambda: held[0] if held else (held.append(f()), held[0])[1]


Tokenizer_ = cached(lambda: Tokenizer.from_file(WORDS))
Tik = cached(lambda: tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={}))


def test_token_store_round_trip(spark):
    rows = [(None, "no id", 1), *((i * 7 - 3, t, 2) for i, t in enumerate(ODD)), (4, "again", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    store = token_store.write(docs, WORDS, 2, shard_ids=500)
    got = store.read().orderBy(F.asc_nulls_first("doc_id"), "start").collect()
    assert len(got) == len(rows) and got[0].doc_id is None
    starts = np.cumsum([0, *(r.n_tokens for r in got)])
    assert [r.start for r in got] == starts[:-1].tolist()
    wanted = {}
    for key, text, _ in rows:
        ids = np.array(Tokenizer_().encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        wanted.setdefault(key, []).append(zlib.crc32(ids.tobytes()))
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(zlib.crc32(bytes(r.ids)))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}
    asked = spark.createDataFrame([(4,), (999,)], "k long")
    assert sorted(zlib.crc32(bytes(r.ids)) for r in store.lookup(asked, "k").collect()) == sorted(wanted[4])


def test_lookup_of_many_keys(spark):
    keys = [None, *range(0, 9000, 3)]
    docs = spark.createDataFrame([(k, f"word {k}", i) for i, k in enumerate(keys)] + [(300, f"again {i}", 0) for i in range(50)] + [(None, "second", 0)], "doc_id long, text string, k int")
    with small_batches(spark, 200):
        store = token_store.write(docs, WORDS, 2, shard_ids=400)
    assert store.manifest.count() > 8
    asked = spark.createDataFrame([(None,), (300,), *((k,) for k in range(-5, 9005))], "k long")
    got = {}
    for r in store.lookup(asked, "k").collect():
        got.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert set(got) == set(keys) and len(got[300]) == 51 and len(got[None]) == 2
    assert all(got[k] == [np.array(Tokenizer_().encode(f"word {k}", add_special_tokens=False).ids + [2], "<u4").tobytes()] for k in range(0, 9000, 3) if k != 300)
    assert store.lookup(asked.where("k < 0"), "k").count() == 0
    # The index decides what is read: rows of other places give other ids.
    reader = token_store.ShardReader(**{k: v for k, v in store.manifest.orderBy("part", "piece").first().asDict().items() if k in ("path", "width")})
    rows = np.array([5, 2, 9])
    ids, lens = reader.rows_ids(rows)
    assert ids.tolist() == [i for r in rows for i in reader.ids(int(reader.offsets[r]), int(reader.offsets[r] + reader.lens[r])).tolist()] and lens.tolist() == reader.lens[rows].tolist()


def test_ids_outside_the_vocabulary_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, [10_000_000, -5]), (2, [0, 99_999_999, 1]), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(rows, RANKS).collect()}
    assert got == {1: b"", 2: Tik().decode_bytes([0, 1]), 3: b""}


def test_token_store_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.write(docs, WORDS).read().count() == 0


def test_byte_encoding_of_odd_rows(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    for r in got:
        text = ODD[r.doc_id] or ""
        assert r.ids == Tik().encode_ordinary(text) and bytes(r.decoded) == text.encode()


def test_chat_escapes_and_branches(spark):
    rows = [
        (1, 1, None, "user", "### x </turn> \\e \\", 0.0),
        (1, 2, 1, "assistant", "weak", 0.1),
        (1, 3, 1, "assistant", "</turn>\n### user: strong", 0.9),
        (1, 4, 3, "us:er", None, 0.9),
        (2, 1, 9, None, "parent unknown", None),
        (3, 1, 2, "user", "on a cycle", 1.0),
        (3, 2, 1, "user", "on a cycle", 1.0),
        (None, 1, None, "assistant", "no tree", 1.0),
    ]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = chat.format_trees(messages.withColumn("leaf", F.lit(0)).withColumn("path", F.lit("p")), top=1)
    got = {r.tree: r for r in out.select("tree", "n_turns", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("learnt")).collect()}
    assert set(got) == {1, 2, None}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "### x </turn> \\e \\"), ("assistant", "</turn>\n### user: strong"), ("us:er", "")]
    assert got[1].learnt == "</turn>\n### user: strong" and got[None].learnt == "no tree" and got[2].learnt == ""
    assert chat.format_trees(messages, top=None).where("tree = 1").count() == 2
    assert chat.format_trees(messages.limit(0)).count() == 0


def test_other_tokenizer_files_encode_whole_texts():
    path = P.path("byte_bpe_50k.json")
    texts = ["Two  Words\n and  Cases ", "", "a B"]
    ids, counts = encoder(path, 2).encode([t.encode() for t in texts[:2]] + [None, texts[2].encode()])
    own = Tokenizer.from_file(path)
    want = [own.encode(t, add_special_tokens=False).ids + [2] for t in ("Two  Words\n and  Cases ", "", "", "a B")]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert encoder(WORDS, None).by_chunk


def test_words_are_learned_once(monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 200)
    coder, learned = word_bpe.ChunkEncoder(WORDS, None), []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda chunks: learned.extend(chunks) or learn(chunks))
    # Capitals and forgotten words: "The", "nación." and "and" stay known, the others were met once. The last texts keep their case.
    texts = [f"The nación. THE the AND and nación. x{i}y {'abc'[i % 3] * i}q{'.!?)_'[i % 5] * (i % 7)} Été's{i}" for i in range(1, 150)]
    texts += ["H\u0331 h\u0331 J\u030c.", "<|ENDOFTEXT|> Ab<|endoftext|>C", "\u212aelvin 'S don'T A'", "word''. naïve\u0301 (The)"]
    want = [x.ids for x in Tokenizer_().encode_batch(texts, add_special_tokens=False)]
    for text, own in zip(texts, want, strict=True):
        assert coder.encode([text.encode()])[0].tolist() == own
    assert all(learned.count(w) == 1 for w in ("the".encode(), "nación.".encode(), b"and")) and coder.n < 400
    ids, counts = coder.encode([t.encode() for t in texts])
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_only_marks_compose_with_letters():
    joined = {c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))) if any(len(unicodedata.normalize("NFC", x + c)) == 1 for x in string.ascii_letters)}
    assert joined and all(c.encode()[:1] in word_bpe.MARKS for c in joined)


def test_chat_of_repeated_nodes_and_cycles(spark):
    rows = [(1, 1, None, "user", "ask", 0.5), (1, 2, 1, "assistant", "tell", 1.0), (1, 2, 1, "assistant", "tell", 1.0), (1, 1, None, "user", "ask again", 0.5), (1, None, 2, "user", "no node", 9.0)]
    # A long chain in one tree, and cycles with rows that hang from them in others.
    rows += [(2, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(37)]
    rows += [(3, 1, 2, "user", "round", 1.0), (3, 2, 1, "user", "round", 1.0), (3, 3, 2, "user", "hangs", 1.0), (4, 1, 1, "user", "itself", 1.0)]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {r.tree: r for r in chat.format_trees(messages, top=None).select("tree", "leaf", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert set(got) == {1, 2} and chat.format_trees(messages, top=None).count() == 2
    assert [tuple(t) for t in got[1].turns] == [("user", "ask"), ("assistant", "tell")]
    assert [t.text for t in got[2].turns] == [str(i) for i in range(37)]
    assert chat.branches(messages.where("tree >= 3")).count() == 0


def test_deep_chain(spark):
    rows = spark.range(300).select(F.lit(5).alias("conv"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    out = chat.format_trees(chat.chain(rows, "conv", ["turn"], "role", "text")).select(chat.parse(F.col("formatted")).alias("t")).first().t
    assert [x.text for x in out] == [str(i) for i in range(300)]
