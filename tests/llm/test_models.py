"""Classifiers on held-out rows, packing, and the pipeline."""

import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnloom.llm import packing, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,label", [("op5_quality", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    out = queries.QUERIES[name](spark, SF).cache()
    held = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("predicted", F.col(label).alias("y"), "score").toPandas()
    assert out.count() == 1000 and held["score"].between(0, 1).all()
    assert (held["predicted"] == held["y"]).mean() >= 0.9
    assert {zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out.where("held_out").select("doc_id").collect()} == {True}


def test_models_on_odd_rows(spark):
    clean = [f"the quick letter {i} went home and rested well today".encode() for i in range(60)]
    rude = [f"the letter {i} is a worthless moron today".encode() for i in range(60)]
    model = toxicity.fit(clean + rude, np.r_[np.zeros(60), np.ones(60)])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "you moron"), (5, "you m.o.r.o.n!"), (6, "m o r o n"), (7, "home " * 9000), (8, "worthlesss")], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score(odd, model).collect()}
    assert max(got[i] for i in (1, 2, 3, 7)) < 0.5 <= min(got[i] for i in (4, 5, 6, 8))
    assert toxicity.fit(clean, np.zeros(60)).scores([b"moron", None]).tolist() == [0, 0]
    judge = quality.fit([b"A fine text, of plain words. Yes.", b"BAD!! BAD!! BAD!!"] * 9, np.array([1, 0] * 9))
    scores = {r.doc_id: r.quality_score for r in quality.score(odd, judge).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1] == scores[2] == 0.5
    assert quality.fit([], np.zeros(0)).scores([b"x"]).tolist() == [0.5]
    assert toxicity.score(odd.limit(0), model).count() == quality.score(odd.limit(0), judge).count() == 0


def test_pieces_are_whole_and_tight():
    for n in [*range(1, 300), *range(4000, 9000, 37)]:
        own = packing.piece_lengths(n)
        assert sum(own) == n and max(own) <= 4096 and min(own) > 0


def test_packing(spark):
    rows = [(i, "some words to pack here " * (i * 13 % 400)) for i in range(200)] + [(500, None), (501, ""), (7, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    out = packing.pack(docs, P.path("word_bpe_49k.json"), with_ids=True)
    got = out.toPandas()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist() and s["length"].sum() <= 4096
    assert (got["ids"].map(len) == 4 * got["length"]).all() and (got["ids"].map(zlib.crc32) == got["ids_crc32"]).all()
    whole = got[got["doc_id"].between(8, 400)].groupby("doc_id")
    assert (whole["length"].sum() == whole["doc_tokens"].first()).all()
    assert got["length"].sum() / (4096 * got["sequence_id"].nunique()) > 0.9
    for s in packing.sequences(out).select("length", F.octet_length("ids").alias("n")).collect():
        # A power of two is not padded.
        assert s.n == 4 * (s.length if s.length & (s.length - 1) == 0 else 4096)
    # Every id lies in one piece, as the library gives it.
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = dict((i, t) for i, t in rows if i not in (7, None))
    for key, s in got[got["doc_id"].isin(texts)].sort_values("start").groupby("doc_id"):
        assert np.frombuffer(b"".join(s["ids"]), "<u4").tolist() == [*library.encode(texts[key] or "", add_special_tokens=False).ids, 2]
        assert s["start"].tolist() == (s["length"].cumsum() - s["length"]).tolist()
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing_of_repeated_rows(spark, capacity):
    # A half of all rows are copies of one full-length document: no lot runs over, and lots are even.
    full = spark.range(40_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), F.lit(1).alias("class"), F.lit(capacity).cast("long").alias("doc_tokens"), F.lit(9).cast("long").alias("ids_crc32"), F.col("id").alias("turn"), F.lit(None).cast("binary").alias("ids"))
    half = full.withColumn("length", F.lit(capacity // 2).cast("long")).withColumn("class", F.lit(2)).withColumn("doc_id", F.col("turn"))
    got = packing.assign(full.unionByName(half), capacity).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).groupBy("n", "k").count().collect()
    assert max(r.n for r in got) == capacity and sum(r.k * r["count"] for r in got) == 80_000
    # Each lot leaves one sequence part full at most.
    assert sum(r["count"] for r in got if r.n < capacity) <= 40_000 // (2 * packing.LOT_SEQUENCES)


def test_turns_deal_copies_out(spark):
    docs = spark.range(3000).select(F.lit(4).alias("doc_id"), F.lit("a few equal words " * 700).alias("text")).repartition(3)
    pieces = packing.cut_documents(docs, P.path("word_bpe_49k.json"), with_ids=False)
    spread = pieces.groupBy("class").agg(F.count("*").alias("n"), F.countDistinct(F.pmod("turn", F.lit(50))).alias("lots")).collect()
    assert all(r.lots == 50 for r in spread if r.n >= 1000)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.001")
        assert sorted(kept.columns) == sorted(docs.columns)
        kept = corpus_pipeline.cut(kept, "test-stage")
    assert 0 < kept.count() < docs.count()
    assert kept.where("n_chars != length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001")
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kind = dict(docs.dtypes)
    odd = spark.createDataFrame([(None, None), (None, "no id " * 30), (900_001, None), (900_002, ""), (900_003, "twice the same row " * 20), (900_003, "twice the same row " * 20), (900_004, "word " * 40_000)], "doc_id long, text string")
    odd = odd.selectExpr(f"CAST(doc_id AS {kind['doc_id']}) AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", f"CAST(length(text) AS {kind['n_chars']}) AS n_chars")
    kept = docs.unionByName(odd)
    for name in ("digest", "id", "rid", "spans", "kept", "mark", "toxicity", "gone_id", "said", "number", "key", "label"):
        kept = kept.withColumn(name, F.lit(name))
    columns = kept.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.cut(stage(spark, kept, sf), "test-odd")
        assert kept.columns == columns
    got = [(r.doc_id, r.text) for r in kept.where("doc_id IS NULL OR doc_id > 900000").collect()]
    # Empty texts are one group, its first id stays; so is the row that repeats; nothing else goes, whatever is cut inside texts.
    assert sorted(str(i) for i, _ in got) == ["900001", "900003", "900004", "None"]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, sf)
        assert out.count() == 0


def test_pipeline_drops_passages_of_51_words(spark):
    import random

    import corpus_pipeline

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.choice([1, 2, 3]))) for _ in range(51)]
    passage, short = " ".join(words), " ".join("".join(rng.choices("pqrst", k=4)) for _ in range(30))
    assert len(passage) < 200 and 101 < len(short)
    own = [" ".join("".join(rng.choices("klmnouvwxyz", k=6)) for _ in range(40)) for _ in range(8)]
    texts = [f"{own[0]} {passage}. {own[1]}", f"{own[2]}\n{passage}! {own[3]}", f"{own[4]} {short}. {own[5]}", f"{own[6]}\n{short}! {own[7]}"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, docs, "").collect()}
    # Brute force: every stretch of 51 words that two texts share goes; 30 shared words stay.
    assert got[0] == texts[0].replace(passage, "") and got[1] == texts[1].replace(passage, "")
    assert got[2] == texts[2] and got[3] == texts[3]


INSULTS = "idiot moron loser trash clown stupid worthless pathetic scum disgusting".split()


@pytest.fixture(scope="module")
def machine():
    """Trained on made-up sentences of common syllables, a fifth of which hold one or two of ten insults."""
    rng = np.random.default_rng(7)
    syllables = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()
    texts, toxic = [], []
    for i in range(600):
        words = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(rng.integers(20, 60))]
        toxic.append(i % 5 == 0)
        if toxic[-1]:
            for insult in rng.choice(INSULTS, 2):
                words.insert(int(rng.integers(len(words))), str(insult))
        texts.append(" ".join(words).encode())
    return toxicity.fit(texts, np.array(toxic)), [t for t, y in zip(texts, toxic, strict=True) if not y]


def test_insults_in_disguise(machine):
    model, clean = machine
    for insult in INSULTS:
        places = range(1, len(insult))
        disguised = [insult, insult + ".", " ".join(insult), ".".join(insult), *(insult[:i] + c + insult[i:] for i in places for c in ("-", " ", insult[i - 1]))]
        added = [insult[:i] + c + insult[i:] for i in places for c in "xqzaek"]
        assert (model.scores([f"one {d} here".encode() for d in disguised]) >= 0.5).all(), insult
        assert (model.scores([f"one {d} here".encode() for d in added]) >= 0.5).mean() >= 0.95, insult
    assert (model.scores(clean) >= 0.5).mean() <= 0.02
    # Words of different texts are not joined.
    assert max(model.scores([b"the mo", b"ron on it"])) < 0.5


def test_toxicity_of_long_and_repeated_texts(machine):
    model, clean = machine
    assert model.scores([b"the " * 30_000 + b"moron" + b" it" * 30_000, b"the " * 60_000])[0] >= 0.5 > model.scores([b"the " * 60_000])[0]
    assert len(set(model.scores([clean[0]] * 5).tolist())) == 1


def test_memory_of_scoring_is_bounded(machine):
    # A worker keeps what it once took, and in the pipeline the stages after it share the executor with it.
    model, clean = machine
    texts = [b" ".join(clean[i::40]).decode() for i in range(40)]
    texts = texts * (1 + (2 << 20) // sum(map(len, texts)))
    toxicity.scored(model, pa.array(texts[:2]))
    tracemalloc.start()
    got = toxicity.scored(model, pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    assert len(got) == len(texts) and np.allclose(got[:40], [model.scores([t.encode()])[0] for t in texts[:40]])


def test_scores_of_the_pipeline_are_written_in_small_batches(spark):
    # What a stage returns runs with the batches of whoever writes it, which held all texts of a task.
    import corpus_pipeline
    from __spark_entry__ import queries

    sf = "/root/testdata/sf0.001"
    for out in (corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), queries()["op10_toxicity"](spark, sf)):
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and out.count()
