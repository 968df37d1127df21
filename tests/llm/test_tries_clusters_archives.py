"""The prefix trie, centroid clustering and packaged web archives against brute force, on odd rows."""

import base64
import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from turnloom.llm import centroids, prefix_trie, warc

# Prefix trie


def trie_by_hand(rows):
    said = {}
    for c, t, r, x in rows:
        if c is not None:
            said.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in said.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20
        built[c] = v if base == c else own.get(base, [])[:h] + v[h:]
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    words = lambda x: len([w for w in __import__("re").split("[ \t-\r]+", x) if w])
    out = []
    for k, members in nodes.items():
        below = [n for n in nodes if n[: len(k)] == k]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes)]
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), sum(len(n) == len(k) + 1 for n in below), len(leaves), sum((len(nodes[n]) - 1) * (words(n[-1][1]) if n else 0) for n in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows, rebuilt=True):
    # Columns of the operator's own names come along.
    kind = "conv_id long, turn long, role string, text string, d long, name string, at long, digest string, rep long, i long"
    turns, lengths = prefix_trie.turns_of(spark.createDataFrame([(*r, 1, "n", 2, "x", 3, 4) for r in rows], kind).repartition(3))
    out = prefix_trie.trie(*(prefix_trie.rebuilt(turns, lengths) if rebuilt else (turns, lengths)))
    return sorted(map(tuple, out.collect()), key=str)


def test_trie_on_random_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 47), 100, 113, 119, 250]:
        n = 40 if c == 20 else rng.choice([1, 1, 2, 3, 4, 6, 9])
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "a b", "\ta\x0bb  c\x0c"])))
    rows += [(3, 0, None, None), (3, None, "user", "first"), (3, 0, None, None), (7, 0, "user", "a"), (None, 1, "user", "lost"), (45, 1, "use", "ra"), (45, 1, "user", "a")]
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_of_equal_and_long_conversations(spark):
    rows = [(c, t, "user", f"x {t}") for c in (0, 20, 40, 60) for t in range(33)] + [(80, t, "user", f"x {t}" if t < 17 else "other") for t in range(70)] + [(100, 0, "user", "y" * 300_000)]
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_without_turns_and_without_rows(spark):
    # Conversations shorter than what they would take over, without a first one to take it from.
    short = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0][:3]
    rows = [(c, 0, "user", "a") for c in short]
    got = trie_of(spark, rows)
    assert got == trie_by_hand(rows) and len(got) == 1
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 0, "user", "a")]) == []


# Centroids


def clusters_by_hand(vectors, k=8, rounds=10):
    kept = [(i, np.floor(1024 * np.array(v, float)).astype(object)) for i, v in vectors if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all()]
    kept = [(i, [int(x) for x in v]) for i, v in kept]
    hashed = sorted(kept, key=lambda p: (p[0] is None, hashlib.sha256(f"3:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1]))
    centre = [v for _, v in hashed[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centre)), key=lambda z: (far(v, centre[z]), z))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v), []).append(v)
        centre = [[sum(x) // len(own[z]) for x in zip(*own[z])] if z in own else c for z, c in enumerate(centre)]
    return sorted(((i, near(v), far(v, centre[near(v)]), hashlib.sha256(",".join(map(str, centre[near(v)])).encode()).hexdigest()) for i, v in kept), key=str)


def clusters(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, 2, "t") for i, v in vectors], "vec_id long, embedding array<float>, cluster int, distance long, tree string").repartition(3)
    out = centroids.report(*centroids.cluster(df)).collect()
    assert len({r.inertia for r in out}) <= 1 and all(r.inertia == sum(x.distance for x in out) for r in out)
    assert all(r.cluster_inertia == sum(x.distance for x in out if x.cluster == r.cluster) for r in out)
    return sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in out), key=str)


def test_clusters_on_odd_vectors(spark):
    rng = np.random.default_rng(1)
    tight = [rng.normal(size=64) for _ in range(5)]
    vectors = [(i, (tight[i % 5] + rng.normal(size=64) * 0.01).astype(np.float32).tolist()) for i in range(150)]
    # Copies, ties (vectors on a lattice), repeated ids, a null id, and what isn't kept.
    vectors += [(200 + i, [0.5] * 64) for i in range(40)] + [(300 + i, [float((i >> b) & 1) if b < 5 else 0.0 for b in range(64)]) for i in range(32)]
    vectors += [(7, [0.25] * 64), (7, [0.25] * 64), (None, [-0.1] * 64)]
    vectors += [(400, None), (401, []), (402, [1.0] * 63), (403, [None] + [1.0] * 63), (404, [float("nan")] + [1.0] * 63), (405, [float("-inf")] + [1.0] * 63)]
    assert clusters(spark, vectors) == clusters_by_hand(vectors)


def test_few_vectors_and_none(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clusters(spark, few) == clusters_by_hand(few)
    assert clusters(spark, []) == [] and clusters(spark, [(1, None)]) == []
    with pytest.raises(Exception, match="no exact squared distance"):
        clusters(spark, [(1, [1e20] * 64)])


def test_tree_settles_whole_nodes():
    rng = np.random.default_rng(2)
    middle = rng.integers(-5000, 5000, (4, 64))
    points = np.concatenate([m + rng.integers(-20, 20, (400, 64)) for m in middle])
    tree = centroids.Tree.from_bytes(centroids.Tree.build(np.arange(1600), np.zeros(1600, bool), points).to_bytes())
    cluster, counts, sums, single = tree.filter(middle)
    want = ((points[tree.ids][:, None] - middle[None]) ** 2).sum(2).argmin(1)
    assert (cluster == want).all() and counts.tolist() == [400] * 4 and single == 0
    assert all((sums[z] == points[tree.ids][want == z].sum(0)).all() for z in range(4))


# Web archives


def archived(spark, rows, least=0, **more):
    df = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "page_id long, url string, html string, largest long, same string, refers_to int").repartition(3)
    return warc.read(warc.write(df, least=least, **more), span=300)


def pages_by_hand(rows, least=0):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in payloads:
        ids = [j for j, q in payloads if q == p and j is not None]
        top = max(ids, default=None)
        refers = top if len(p) >= least and i != top else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2\r\nWARC-Type: revisit", "<p>one</p>"),
    (3, None, None),
    (4, "http://ä/ö", ""),
    (5, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
    (-6, "u", "ü" * 2000),
    (9, "u", "ü" * 2000),
    (9, "u", "ü" * 2000),
    (None, "u", "<p>one</p>"),
    (None, "u", "only here"),
    (10, "u", "z" * 500_000),
    (11, "u", "x"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_pages_return_from_their_archives(spark, least):
    got = archived(spark, PAGES, least, package=2000).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == pages_by_hand(PAGES, least)
    texts = {i: (h or "").encode() for i, _, h in PAGES if i is not None}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert archived(spark, []).collect() == []


def packed(names_and_data, before=b"", comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    out.write(before)
    with zipfile.ZipFile(out, "a", method) as z:
        for name, data in names_and_data:
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def places(data):
    return list(warc.located(pa.PythonFile(io.BytesIO(data), mode="r"), "here"))


RECORDS = [warc.record(i, f"http://a/{i}", b"page" * i) for i in range(1, 5)]


def test_foreign_packages():
    plain = b"".join(RECORDS)
    gz = b"".join(__import__("gzip").compress(r) for r in RECORDS)
    for before, comment in ((b"", b""), (b"#!/bin/sh\n" * 5, b"PK\5\6 in a comment")):
        data = packed([("a/x.warc", plain), ("archive/y.warc.gz", gz), ("readme", "no archive")], before, comment)
        got = places(data)
        assert len(got) == 8
        for (_, at, n), want in zip(got, RECORDS + RECORDS, strict=True):
            own = data[at : at + n]
            assert (zlib.decompress(own, 31) if own[:2] == b"\x1f\x8b" else own) == want
    # An index names some of the records: only those are given.
    line = b'com,a)/2 2020 {"filename": "x.warc", "offset": %d, "length": "%d"}\n' % (len(RECORDS[0]), len(RECORDS[1]))
    data = packed([("archive/x.warc", plain), ("indexes/index.cdx.gz", __import__("gzip").compress(b"!meta {}\n" + line))])
    (_, at, n), = places(data)
    assert warc.parse(data[at : at + n])["page_id"] == 2
    assert places(packed([])) == []


def test_own_package_is_a_zip_file():
    out = io.BytesIO()
    package = warc.Package(out)
    package.begin("archive/ä.warc")
    assert [package.add(r) for r in RECORDS] == [sum(map(len, RECORDS[:k])) for k in range(4)]
    package.end()
    package.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and z.read("archive/ä.warc") == b"".join(RECORDS)
    assert len(places(out.getvalue())) == 4


def test_damaged_packages():
    data = packed([("x.warc", b"".join(RECORDS))])
    cases = [(data[:-30], "cut off"), (b"", "no ZIP"), (packed([("x.warc", b"".join(RECORDS))], method=zipfile.ZIP_DEFLATED), "compressed"), (packed([("x.warc", RECORDS[0][:-9])]), "cut off"), (packed([("x.warc.gz", zlib.compress(b"x" * 99, 9, 31)[:-9])]), "cut off")]
    outside = b'k 2020 {"filename": "x.warc", "offset": 0, "length": 99999}\n'
    cases += [(packed([("x.warc", RECORDS[0]), ("indexes/i.cdxj", outside)]), "outside"), (packed([("indexes/i.cdxj", outside)]), "isn't there")]
    for broken, why in cases:
        with pytest.raises(ValueError, match=why):
            places(broken)
    for broken in (RECORDS[0][:-12], b"junk", RECORDS[0].replace(b"page", b"pagf")):
        with pytest.raises(ValueError):
            warc.parse(broken)
