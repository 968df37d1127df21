"""The registered queries on the smallest tables against their SQL, the public libraries or brute force."""

import base64
import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.test_dedup import union
from turnloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    rows = duckdb.connect().execute(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    return {i: t for i, t in rows}


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(want)


def word_ids(docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return {i: np.array([*library.encode(t, add_special_tokens=False).ids, queries.END_ID], "<u4") for i, t in docs.items()}


def test_token_store_query(spark, docs):
    want, at = {}, 0
    for i, ids in sorted(word_ids(docs).items()):
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows_of(spark, "op1_token_store")} == want


def test_byte_bpe_query(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in docs.items():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows_of(spark, "op2_byte_bpe")} == want


def test_embedding_query(spark):
    got = {r.vec_id: r for r in rows_of(spark, "op6_embedding_dedup")}
    raw = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert set(got) == set(raw)
    ids = sorted(i for i, v in raw.items() if v is not None and None not in v and np.isfinite(v).all() and np.any(v))
    x = np.array([raw[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    comp = union(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if near[i, j]])
    assert {i: (got[i].n_links, got[i].component_id) for i in ids} == {i: (int(near[k].sum()) - 1, ids[comp[k]]) for k, i in enumerate(ids)}


def test_near_dedup_query(spark, docs):
    sets = {}
    for i, t in docs.items():
        words = t.encode().lower().split()
        sets[i] = {tuple(words[k : k + 2]) for k in range(len(words) - 1)} or ({tuple(words)} if words else set())
    ids = sorted(docs)
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if sets[ids[a]] and 100 * len(sets[ids[a]] & sets[ids[b]]) >= 80 * len(sets[ids[a]] | sets[ids[b]])]
    comp = union(len(ids), pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows_of(spark, "op7_near_dedup")}
    assert got == {i: (len(sets[i]), ids[comp[k]], ids[comp[k]] == i) for k, i in enumerate(ids)}


def test_suffix_query(spark, docs):
    raw = {i: t.encode() for i, t in docs.items()}
    met = Counter(hash(r[k : k + 400]) for r in raw.values() for k in range(len(r) - 399))
    got = {r.doc_id: r for r in rows_of(spark, "op8_suffix_dedup")}
    for i, r in raw.items():
        gone = np.zeros(len(r) + 1, int)
        for k in range(len(r) - 399):
            if met[hash(r[k : k + 400])] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        out = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(r, np.uint8)[~out])
        spans = int((np.diff(np.concatenate([[False], out]).astype(int)) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_query_shows_what_stays(spark, tmp_path):
    # Of passages of over 50 words the one of 400 bytes goes, that of fewer bytes stays; a character cut in two is marked.
    passage, short = (" ".join(f"{w}{i:03d}" for i in range(60)) for w in ("wörd", "w"))
    texts = [f"one {passage} end", f"two {passage} {short} too", f"three {short}", "é" + "a" * 399, "ĩ" + "a" * 399, None, ""]
    assert len(passage.encode()) >= 400 > len(short)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op8_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert [got[i].text for i in range(7)] == ["oneend", f"two{short} too", f"three {short}", "\ufffd", "\ufffd", None, ""]
    for r in got.values():
        if "\ufffd" not in (r.text or ""):
            assert r.kept_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_packing_query(spark, docs):
    want, got = word_ids(docs), rows_of(spark, "op9_packing")
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        own = want[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    cover = {}
    for r in got:
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {i: sum(n for _, n in c) for i, c in cover.items()} == {i: len(x) for i, x in want.items()}
    assert all(a == sum(n for _, n in sorted(c)[:k]) for c in cover.values() for k, (a, _) in enumerate(sorted(c)))
