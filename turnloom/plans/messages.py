"""Queries on binary messages: orders written as such, and customers as summaries of trajectories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.text import bound
from turnloom.plans.registry import query, table
from turnloom.session import spread
from turnloom.sources import messages


def _varint(n: Column) -> Column:
    """Hex of a number below 2^56 as a varint."""
    return bound(n.cast("long"), _bytes)


def _bytes(n: Column) -> Column:
    byte = lambda i: F.shiftright(n, 7 * i).bitwiseAND(F.lit(127)) + F.when(F.shiftright(n, 7 * (i + 1)) > 0, 128).otherwise(0)
    long = F.concat(*(F.when((F.shiftright(n, 7 * i) > 0) | F.lit(i == 0), F.lpad(F.hex(byte(i)), 2, "0")).otherwise("") for i in range(8)))
    # Most numbers are small.
    return F.when(n.between(0, 127), F.lpad(F.hex(n), 2, "0")).otherwise(long)


def _key(field: int, wire: int) -> Column:
    """Hex of a field's key, which has one byte to field 15."""
    return F.lit(f"{field * 8 + wire:02X}")


def _number(field: int, n: Column) -> Column:
    return F.concat(_key(field, 0), _varint(n))


def _held(field: int, content: Column) -> Column:
    """Hex of a field with a length, from the hex of its content."""
    return bound(content, lambda x: F.concat(_key(field, 2), _varint(F.length(x) / 2), x))


def _text(field: int, content: Column) -> Column:
    return _held(field, F.hex(F.encode(content, "UTF-8")))


def _base64(content: Column) -> Column:
    return F.base64(F.unhex(content))


@query(
    "message_fields",
    """WITH o AS (SELECT o_orderkey AS doc, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT doc, '1' AS path, 0 AS wire, doc * 1000003 AS number, NULL AS text FROM o UNION ALL SELECT doc, '2', 2, NULL, p FROM o UNION ALL SELECT doc, '3.1', 0, c, NULL FROM o UNION ALL SELECT doc, '3.2', 2, NULL, s FROM o
UNION ALL SELECT doc, '4', 5, NULL, 'four' FROM o UNION ALL SELECT doc, '5', 1, NULL, 'and eigh' FROM o
-- One text reads as a field of four bytes as well.
UNION ALL SELECT doc, '2.6', 5, NULL, '-LOW' FROM o WHERE p = '5-LOW'""",
)
def _fields(spark, sf_dir):
    key = F.col("o_orderkey")
    inner = F.concat(_number(1, F.col("o_custkey")), _text(2, F.col("o_orderstatus")))
    raw = F.concat(_number(1, key * 1000003), _text(2, F.col("o_orderpriority")), _held(3, inner), _key(4, 5), F.hex(F.lit("four")), _key(5, 1), F.hex(F.lit("and eigh")))
    own = spread(table(spark, sf_dir, "orders"), "o_orderkey").select(key.alias("doc"), F.unhex(raw).alias("value"))
    out = messages.walk(own, depth=2).select("doc", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "wire", "number", F.col("payload").cast("string").alias("text"))
    # The nested message's own bytes are no text.
    return out.where("path <> '3'")


@query(
    "trajectory_seeds",
    """WITH c AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS n, unnest(range(1, c_custkey % 4 + 1)) AS i FROM customer WHERE c_custkey % 11 > 0), t AS (SELECT *, 1704067200 + k * 60 + i AS s FROM c)
SELECT k::VARCHAR AS origin, 'sess:x:' || k || '-' || i AS session_id, CASE WHEN i % 3 > 0 THEN name || ' é' || i ELSE 'X trajectory ' || k || '-' || i END AS title,
  strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.') || CASE WHEN i % 2 = 0 THEN '250Z' ELSE '000Z' END AS created_at, strftime(to_timestamp(s + CASE WHEN i % 2 = 0 THEN 3600 ELSE 0 END) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS updated_at,
  CASE WHEN i < 3 THEN '/n/' || n END AS workspace FROM t""",
)
def _trajectories(spark, sf_dir):
    # Up to three trajectories a customer; every eleventh customer's summary is cut short.
    key = F.col("c_custkey")
    id_ = lambda i: F.concat(key.cast("string"), F.lit("-"), i.cast("string"))
    time = lambda field, s, nanos=None: _held(field, F.concat(_number(1, s), F.lit("") if nanos is None else _number(2, nanos)))

    def one(i: Column) -> Column:
        s = F.lit(1704067200) + key * 60 + i
        title = F.when(i % 3 > 0, _text(1, F.concat("c_name", F.lit(" é"), i.cast("string")))).otherwise("")
        times = F.when(i % 2 == 0, F.concat(time(7, s, F.lit(250_999_999)), time(10, s + 3600))).otherwise(time(3, s))
        place = F.when(i < 3, _held(9, _text(1, F.concat(F.lit("file:///n//"), F.col("c_nationkey").cast("string"))))).otherwise("")
        wrapper = _text(1, _base64(F.concat(title, times, place)))
        return _held(1, F.concat(_text(1, id_(i)), _held(2, wrapper)))

    n = (key % 4).cast("int")
    whole = F.array_join(F.transform(F.filter(F.array(*(F.lit(i) for i in (1, 2, 3))), lambda i: i <= n), one), "")
    cut = F.when(key % 11 == 0, F.concat(F.left(whole, F.lit(20)), F.lit("0A"))).otherwise(whole)
    own = spread(table(spark, sf_dir, "customer"), "c_custkey").select(key.cast("string").alias("origin"), _base64(cut).alias("value"))
    return messages.trajectories(own, "x")
