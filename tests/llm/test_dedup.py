"""Dedup operators against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import embedding_dedup, exact_dedup, near_dedup, suffix_dedup
from turnloom.llm.components import components


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200, i) for i in range(150, 200)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = union(400, pairs)
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_cuckoo_filter_grows_and_forgets():
    bucket = exact_dedup.Bucket()
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        bucket.insert(k, 1, 5, i)
    assert all(map(bucket.filter.contains, keys)) and bucket.filter.n > 64
    copy = exact_dedup.CuckooFilter.from_bytes(bucket.filter.to_bytes())
    assert all(map(copy.contains, keys))
    for k in keys[:1500]:
        assert bucket.delete(k)
    assert not bucket.delete(keys[0]) and len(bucket.keys) == 1500 == bucket.filter.count
    assert all(map(bucket.filter.contains, keys[1500:]))


ROWS = [(5, "a b"), (3, "ab"), (9, "a  b"), (2, "A b"), (7, None), (1, ""), (8, " \n\x0b"), (None, "ab"), (4, "x\x1cy"), (6, "xy"), (11, "rep"), (11, "rep"), (None, "alone")]


def test_exact_dedup(spark):
    docs = spark.createDataFrame([(i, t, "junk") for i, t in ROWS], "doc_id long, text string, digest string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs).collect()}
    want = set()
    norm = [re.sub(r"[\x20\x09-\x0d]", "", t or "") for _, t in ROWS]
    for (i, _), n in zip(ROWS, norm, strict=True):
        group = [r for r, m in zip(ROWS, norm, strict=True) if m == n]
        keep = min(group, key=lambda r: (-len(r[1] or ""), 1 << 62 if r[0] is None else r[0]))[0]
        want.add((i, keep, len(group), i == keep))
    assert got == want
    stay = exact_dedup.keep_best(docs.withColumn("ID", F.lit(0)))
    assert stay.columns == [*docs.columns, "ID"]
    kept = [(r.doc_id, r.text) for r in stay.collect()]
    assert len(kept) == len(set(norm)) and {i for i, _ in kept} == {k for _, k, *_ in want}
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def test_exact_index_takes_deletions(spark):
    rows = exact_dedup.digests(spark.createDataFrame([(i, f"t{i % 5}") for i in range(10)], "doc_id long, text string"))
    index = exact_dedup.build(rows, 8)
    index = exact_dedup.update(index, 8, delete=rows.where("doc_id IN (0, 5, 1)"))
    live = {r.digest: r.live for r in exact_dedup.contains(index, 8, rows).collect()}
    assert sorted(live.values()) == [False, True, True, True, True]
    assert {r.group_size for r in exact_dedup.groups(index).collect()} == {1, 2}


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup_equals_brute_force(spark, words, monkeypatch):
    # A low bound sends the big group through the crowded way too.
    monkeypatch.setattr(near_dedup, "CROWDED", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocabulary, k=120) for _ in range(8)]
    texts = [None, "", " \n", "One", "one", "two words", "TWO words", "É é"]
    for _ in range(90):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 9])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[9], "x")], "doc_id long, text string, label string")
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = union(len(texts), pairs)
    got = {r.doc_id: r for r in near_dedup.link(docs, words).collect()}
    assert {i: got[i].n_shingles for i in range(len(texts))} == {i: len(s) for i, s in enumerate(sets)}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert got[None].component_id is None
    assert near_dedup.link(docs.limit(0)).count() == 0


def test_suffix_walk_equals_brute_force():
    rng = np.random.default_rng(3)
    for length in (4, 9, 33, 40):
        for _ in range(25):
            base = rng.integers(97, 99, 90).astype(np.uint8)
            parts = []
            for _ in range(rng.integers(1, 6)):
                a = rng.integers(0, 40)
                parts += [rng.integers(97, 99, rng.integers(0, 30)).astype(np.uint8), base[a : a + rng.integers(0, 90)], np.array([255], np.uint8)]
            data = np.concatenate(parts)
            found = suffix_dedup.repeats(data, length)
            seen = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
            for i, w in enumerate(seen):
                if b"\xff" not in w:
                    assert found[i] == (seen.count(w) > 1)


@pytest.mark.parametrize("crowd", [1000, 1])
def test_suffix_dedup_equals_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(crowd)
    passage = "".join(rng.choices("abcdé ", k=150))
    texts = [None, "", "short", "same text " * 9, "same text " * 9]
    for _ in range(14):
        a = rng.randrange(60)
        texts.append("".join(rng.choices("xyz ", k=rng.randrange(80))) + passage[a : a + rng.randrange(40, 150)] + "".join(rng.choices("uvw ", k=rng.randrange(80))))
    length = 40
    docs = spark.createDataFrame([(i if i != 6 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").withColumn("rid", F.lit(1)).withColumn("Did", F.lit(2)).withColumn("kept", F.lit("k"))
    raw = [(t or "").encode() for t in texts]
    counts = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            counts[r[i : i + length]] = counts.get(r[i : i + length], 0) + 1
    got = {r.doc_id: r for r in suffix_dedup.remove(docs, length).collect()}
    for i, r in enumerate(raw):
        gone = [False] * len(r)
        for k in range(len(r) - length + 1):
            if counts[r[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        own = got[i if i != 6 else None]
        assert bytes(own.kept) == bytes(b for b, g in zip(r, gone, strict=True) if not g), i
        assert len(own.spans or []) == sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
    stripped = suffix_dedup.strip(docs, length)
    assert stripped.columns == docs.columns and stripped.select("spans", "rid", "Did", "kept").distinct().collect() == [("x", 1, 2, "k")]
    assert suffix_dedup.remove(docs.limit(0), length).count() == 0


def test_segments_of_long_strings():
    # A stretch and a length beyond those that tables are made for.
    data = np.random.default_rng(1).integers(97, 123, suffix_dedup.STRETCH + 3000).astype(np.uint8)
    anchor, digest, start, windows, lead = suffix_dedup.segments(data, 3001)
    assert windows.sum() == suffix_dedup.STRETCH and (start[1:] == start[:-1] + windows[:-1]).all()
    moved = suffix_dedup.segments(data[5:], 3001)
    assert np.isin(moved[0], anchor).all() and np.isin(moved[1][1:], digest).all()


def test_suffix_dedup_of_repeated_rows(spark):
    docs = spark.createDataFrame([(3, "once " * 200), (4, "rep " * 200), (4, "rep " * 200), (5, "".join(random.Random(9).choices("abcdefgh", k=900)))], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.kept)) for r in suffix_dedup.remove(docs, 400).collect()) == [(3, 0), (4, 0), (4, 0), (5, 900)]


def test_strip_drops_cut_characters(spark):
    # The passage's copies share their last byte of the letter before it, and the first byte of the letter after it.
    passage = "".join(random.Random(1).choices("abcd ", k=60))
    rows = [(1, f"one \ufffd é{passage}é two"), (2, f"three ©{passage}è four"), (3, None), (4, "short")]
    out = suffix_dedup.strip(spark.createDataFrame(rows, "doc_id long, text string"), 40)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "one \ufffd  two", 2: "three  four", 3: None, 4: "short"}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.vstack([base, base[:20] + 0.02 * rng.normal(size=(20, 16)), base[:1].repeat(30, 0) + 0.05 * rng.normal(size=(30, 16))])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0, 2.0], 1), (n + 4, [None] * 16, 1), (n + 5, rows[3][1], 1), (n + 6, [float("inf")] * 16, 1), (None, rows[3][1], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int")
    u = np.vstack([x, x[3]])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    ids = [*range(n), n + 5]
    near = u @ u.T >= 0.95
    comp = union(len(u), [(i, j) for i in range(len(u)) for j in range(i) if near[i, j]])
    got = {r.vec_id: r for r in embedding_dedup.link(docs).collect()}
    hits = sum(got[i].n_links for i in ids)
    assert 0.9 * (near.sum() - len(u)) <= hits <= near.sum() - len(u)
    assert all(got[i].n_links <= near[k].sum() - 1 for k, i in enumerate(ids))
    assert [got[i].component_id for i in ids] == [ids[c] for c in comp]
    assert all(got[i].n_links == 0 and got[i].kept for i in (n, n + 1, n + 2, n + 3, n + 4, n + 6))
    assert got[None].component_id is None and got[None].n_links == 0
    assert embedding_dedup.link(docs.limit(0)).count() == 0


def test_embedding_dedup_links_vectors_of_every_length(spark):
    # Three lengths of their own pivots and seventeen of few vectors, one of them beyond a block; a vector of two components is no start of another.
    rng = np.random.default_rng(9)
    rows, want = [], {}

    def add(x):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near, first = u @ u.T >= 0.95, len(rows)
        label = union(len(u), [(i, j) for i in range(len(u)) for j in range(i) if near[i, j]])
        for k, v in enumerate(x):
            want[first + k] = (int(near[k].sum()) - 1, first + label[k])
            rows.append((first + k, v.tolist()))

    for size, n in ((16, 300), (24, 200), (48, 60)):
        base = rng.normal(size=(n, size))
        add(np.vstack([base, base[: n // 2] + 0.02 * rng.normal(size=(n // 2, size))]))
    for size in range(2, 18):
        if size != 16:
            add(np.array([[1.0] * size, [1.0] * size, [1.0] * (size - 1) + [-1.0]]))
    add(np.array([[3.0], [0.5], [-2.0]]))
    add(np.ones((1, 99)))
    got = {r.vec_id: r for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want


def test_embedding_dedup_compares_a_rare_length_in_blocks(spark, monkeypatch):
    # Lengths without pivots, their lists cut into blocks of 16.
    monkeypatch.setattr(embedding_dedup, "INDEXED", 0)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(10)
    base = rng.normal(size=(60, 8))
    x = np.vstack([base, base + 0.05 * rng.normal(size=(60, 8))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    got = {r.vec_id: r.n_links for r in embedding_dedup.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert got == {i: int(near[i].sum()) - 1 for i in range(len(x))}


def test_embedding_dedup_of_one_hot_group(spark):
    # A third of all vectors is one direction with noise of their own. With pivots sampled alone, under nine tenths of its links were found.
    rng = np.random.default_rng(4)
    unit = embedding_dedup.unit
    hot = unit([v.tobytes() for v in rng.normal(size=(1, 64))])
    hot = np.sqrt(0.96) * hot + np.sqrt(0.04) * rng.normal(size=(4000, 64)) / 8
    x = np.vstack([hot, rng.normal(size=(8000, 64))])
    u = unit([v.tobytes() for v in x])
    want = (u @ u.T >= 0.95).sum(1) - 1
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.link(docs).collect()}
    assert all(got[i].n_links <= want[i] for i in range(len(x)))
    assert sum(r.n_links for r in got.values()) >= 0.99 * want.sum()
    assert {got[i].component_id for i in range(4000) if want[i]} == {0}


def test_near_dedup_of_repeated_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    other = "nothing like the others at all, told in quite other words"
    # An unrelated text, and a link of another text, share a linked text's id; names of the operator's own come along.
    rows = [(3, a), (5, a), (5, other), (7, a), (7, b), (9, b + " zz"), (3, a), (None, a), (11, ""), (11, "")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, gone_id int, said int, component int").repartition(3)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.link(docs).collect()), key=str)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 5, True), (7, 3, False), (7, 7, True), (9, 7, False), (3, 3, True), (None, None, True), (11, 11, True), (11, 11, True)], key=str)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, a), (5, other), (7, b), (None, a), (11, ""), (11, "")], key=str)


def test_exact_dedup_keeps_the_longest_of_one_id(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a     b", 2), (1, "ab", 3), (2, "a  b", 4)], "doc_id long, text string, row int").repartition(3)
    assert [tuple(r) for r in exact_dedup.keep_best(docs).collect()] == [(1, "a     b", 2)]


def test_only_windows_that_may_meet_are_walked(monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    gram, half = text(suffix_dedup.GRAM), (400 - suffix_dedup.GRAM) // 2
    taken, sort = [], suffix_dedup.repeats
    monkeypatch.setattr(suffix_dedup, "repeats", lambda data, length: taken.append(len(data)) or sort(data, length))
    # Segments of one anchor: all apart; one that stands for two, alone; and two that share 300 bytes before it and 100 behind.
    apart = [(1, i, 1, 300, text(300) + gram + text(300)) for i in range(5)]
    twice = [(2, 9, 2, 300, text(300) + gram + text(300))]
    shared = text(300) + gram + text(100)
    some = [(3, i, 1, 310, bytes([65 + i]) * 10 + shared + text(150)) for i in range(2)]
    runs = {(a, d): [(r["first"], r["last"]) for r in own] for b in suffix_dedup.walked(iter(apart + twice + some), 400) for a, d, own in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert runs == {(2, 9): [(0, 232)], (3, 0): [(10, 42)], (3, 1): [(10, 42)]}
    # Of those two, windows that start at least half before the anchor.
    assert sum(taken) == 2 * (310 - half + 400 + 1)
