"""Binary messages of unknown schema."""

import base64
import random

from pyspark.sql import functions as F

from turnloom.plans import messages as plans
from turnloom.sources import messages


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def written(fields):
    """The bytes of (field, wire, value) in order."""
    out = b""
    for field, wire, value in fields:
        out += varint(field << 3 | wire) + (varint(value) if wire == 0 else varint(len(value)) + value if wire == 2 else value)
    return out


def held(field, value):
    return field, 2, value if isinstance(value, bytes) else value.encode() if isinstance(value, str) else written(value)


def parse(spark, raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "i long, value binary").repartition(3)
    got = {r.i: r.f for r in rows.select("i", messages.fields("value").alias("f")).collect()}
    return [got[i] if got[i] is None else [(f.field, f.wire, f.number if f.wire == 0 else bytes(f.payload)) for f in got[i]] for i in range(len(raws))]


def test_round_trip_of_random_messages(spark):
    rng = random.Random(5)

    def any_field():
        wire = rng.choice([0, 1, 2, 5])
        value = rng.getrandbits(rng.choice([1, 7, 31, 32, 56])) if wire == 0 else rng.randbytes({1: 8, 5: 4}.get(wire) or rng.choice([0, 1, 127, 128, 3000]))
        return rng.choice([1, 15, 16, 2047, (1 << 29) - 1]), wire, value

    whole = [[any_field() for _ in range(rng.randrange(6))] for _ in range(200)]
    assert parse(spark, [written(m) for m in whole]) == whole


def test_broken_messages_are_null(spark):
    good = written([(1, 0, 300), held(2, "abc"), (3, 5, b"four"), (4, 1, b"eight by")])
    # Cut anywhere but between fields.
    ends = {0, 3, 8, 13, 22}
    got = parse(spark, [good[:n] for n in range(len(good) + 1)])
    assert [n for n, f in enumerate(got) if f is not None] == sorted(ends)
    eight, nine = (1 << 56) - 1, b"\x08" + b"\xff" * 8 + b"\x01"
    assert parse(spark, [None, b"", b"\x0b", b"\x0c", b"\x0e", b"\x0f", nine, written([(1, 0, eight)]), b"\x0a" + varint(eight)]) == [None, [], None, None, None, None, None, [(1, 0, eight)], None]


def test_walk_to_a_depth(spark):
    deep = b"\x08\x01"
    for field in range(2, 7):
        deep = written([held(field, deep)])
    rows = spark.createDataFrame([(1, deep, "x"), (2, None, "y"), (3, b"\x0f", "z"), (4, written([held(1, "\x0f"), held(1, "")]), "w")], "doc long, value binary, path string")
    got = sorted((r.doc, r.path, r.places, r.number) for r in messages.walk(rows, depth=3).collect())
    assert got == [(1, [6], [0], None), (1, [6, 5], [0, 0], None), (1, [6, 5, 4], [0, 0, 0], None), (4, [1], [0], None), (4, [1], [1], None)]
    assert max(len(r.path) for r in messages.walk(rows).collect()) == 6
    assert messages.walk(rows.limit(0)).count() == 0


def test_trajectories(spark):
    b64 = lambda m: base64.b64encode(m if isinstance(m, bytes) else written(m)).decode()
    trip = lambda id_, inner: held(1, [held(1, id_), held(2, [held(1, inner)])])
    time = lambda field, s, *more: held(field, [(1, 0, s), *more])
    whole = [
        trip(" a ", b64([held(1, "First"), time(3, 1704067200), time(10, 1704067260, (2, 0, 999_999_999)), held(9, [held(1, "file:///w/a%20b")])])),
        trip("b", b64([held(7, b"\xff"), time(3, 1704067200)])),
        trip("b", b64([held(7, b"\xff"), time(3, 1704067200)])),
        trip("empty", b64([])),
        trip("c", "!!"),
        trip("", b64([])),
        held(1, [held(1, "no wrapper")]),
        held(1, b"\xff"),
        (1, 0, 5),
        trip("d", b64(b"\x0a")),
        trip("e", b64([held(1, b"\xffx"), held(1, "second")]).rstrip("=")),
    ]
    url = base64.urlsafe_b64encode(written([trip("f", b64([held(1, "?>" * 9)]))])).decode()
    rows = spark.createDataFrame([("x", b64(whole), 1), ("y", None, 1), ("z", "%%%", 1), ("v", "", 1), ("u", url, 1)], "origin string, value string, title int")
    got = sorted((tuple(r) for r in messages.trajectories(rows, "p").collect()), key=str)
    at = "2024-01-01T00:00:00.000Z"
    assert got == sorted(
        [
            ("u", "sess:p:f", "?>" * 9, None, None, None),
            ("x", "sess:p:a", "First", at, "2024-01-01T00:01:00.999Z", "/w/a b"),
            ("x", "sess:p:b", "P trajectory b", at, at, None),
            ("x", "sess:p:b", "P trajectory b", at, at, None),
            ("x", "sess:p:e", "�x", None, None, None),
        ],
        key=str,
    )


def test_queries_on_small_files_use_all_partitions(spark):
    # What a row costs has nothing to do with its bytes, and these tables lie in one file.
    for query in (plans._trajectories, plans._fields):
        each = query(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count()
        assert each >= int(spark.conf.get("spark.sql.shuffle.partitions"))
