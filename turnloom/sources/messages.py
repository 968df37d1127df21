"""Binary messages whose schema nobody knows: numbered fields of the usual wire types, nested as deep as a reader asks.

A field's key is a varint, its number above three bits of wire type: 0 a varint, 1 eight bytes, 2 a length and so many bytes, 5 four
bytes. Whether bytes are a text or a message isn't said, so each level is read on request: ``fields`` parses one level of a column in
Arrow batches, columns pick from it, and ``walk`` tries level by level whatever parses.

Defined cases: a message that ends within a field, has another wire type or a varint of more than eight bytes is broken as a
whole and gives null; an empty one has no fields; null stays null. Varints are whole numbers of up to 56 bits, without sign.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from turnloom.functions import text as T

FIELDS = ArrayType(StructType([StructField("field", LongType()), StructField("wire", IntegerType()), StructField("number", LongType()), StructField("payload", BinaryType())]))
_FIELD = pa.struct([("field", pa.int64()), ("wire", pa.int32()), ("number", pa.int64()), ("payload", pa.binary())])
FIXED = {1: 8, 5: 4}
MOST_BYTES = 8


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    """A varint and where it ends."""
    value = 0
    for i, byte in enumerate(raw[at : at + MOST_BYTES]):
        value |= (byte & 127) << (7 * i)
        if byte < 128:
            return value, at + i + 1
    raise ValueError("varint without an end")


def _parsed(raw: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(raw):
        key, at = _varint(raw, at)
        number, wire = None, key & 7
        if wire == 0:
            number, end = _varint(raw, at)
        elif wire == 2:
            size, at = _varint(raw, at)
            end = at + size
        else:
            end = at + FIXED[wire]
        if end > len(raw):
            raise ValueError("a field beyond the end")
        out.append({"field": key >> 3, "wire": wire, "number": number, "payload": None if wire == 0 else raw[at:end]})
        at = end
    return out


@F.arrow_udf(FIELDS)
def fields(value: pa.Array) -> pa.Array:
    """The fields of a binary message in order: field, wire, number (wire type 0), payload (else); null for a broken one."""

    def one(raw: bytes | None) -> list[dict] | None:
        try:
            return None if raw is None else _parsed(raw)
        except (ValueError, KeyError):
            return None

    return pa.array([one(v) for v in value.to_pylist()], pa.list_(_FIELD))


def of_base64(text: Column) -> Column:
    """The bytes of a base64 text of either alphabet, with or without padding; null where it is none."""
    bare = F.regexp_replace(F.translate(text, "-_", "+/"), f"[{T.SPACE}=]+", "")
    return F.try_to_binary(F.rpad(bare, ((F.length(bare) + 3) / 4).cast("int") * 4, "="), F.lit("base64"))


def payloads(parsed: Column, number: int) -> Column:
    """Payloads of all fields of this number that have a length."""
    return F.transform(F.filter(parsed, lambda x: (x["field"] == number) & (x["wire"] == 2)), lambda x: x["payload"])


def payload(parsed: Column, number: int) -> Column:
    """The first of ``payloads``, null without one."""
    return F.get(payloads(parsed, number), F.lit(0))


def text(parsed: Column, number: int) -> Column:
    """The first payload as a trimmed text, bytes that are no UTF-8 replaced; blank is null."""
    return T.optional(F.make_valid_utf8(payload(parsed, number).cast("string")))


def number(parsed: Column, of: int) -> Column:
    """The first varint of this number."""
    return F.get(F.filter(parsed, lambda x: (x["field"] == of) & (x["wire"] == 0)), F.lit(0))["number"]


def moment(parsed: Column) -> Column:
    """The time that a message of seconds (1) and nanoseconds (2) tells; null without seconds."""
    millis = number(parsed, 1) * 1000 + F.floor(F.coalesce(number(parsed, 2), F.lit(0)) / 1_000_000)
    return T.iso_of_millis(millis)


def walk(rows: DataFrame, value: str = "value", depth: int = 8, key: str = "doc") -> DataFrame:
    """(key, path, places, wire, number, payload) of every field to ``depth`` levels; path holds field numbers from the top, places where each stood.

    Whatever payload parses as a message is looked into as well as kept, be it meant as one or not. Rows whose value is null or broken give none.
    """
    level = rows.select(F.col(key), F.array().cast("array<long>").alias("path"), F.array().cast("array<int>").alias("places"), F.col(value).cast("binary").alias("payload"))
    out = None
    for _ in range(depth):
        each = level.select(key, "path", "places", F.posexplode(fields("payload")).alias("place", "f"))
        level = each.select(key, F.array_append("path", F.col("f.field")).alias("path"), F.array_append("places", F.col("place")).alias("places"), "f.wire", "f.number", "f.payload")
        out = level if out is None else out.unionByName(level)
        level = level.where("wire = 2")
    return out


def trajectories(rows: DataFrame, platform: str, value: str = "value", key: str = "origin") -> DataFrame:
    """(key, session_id, title, created_at, updated_at, workspace) of summaries in base64.

    A summary is a message of trajectories (1), each an id (1) and a wrapper (2), in whose text (1) lies another base64 message:
    title (1), times (7, else 3; and 10, else 3), workspace (9, its text 1). A trajectory without id or wrapper, or whose inner
    message is missing or broken, gives no row, and neither does a broken summary; a broken time or workspace is null. Repeated
    trajectories are rows of their own.
    """
    # Each level is parsed in a step of its own, as what follows reads it several times.
    top = rows.select(F.col(key).alias("k"), fields(of_base64(F.col(value))).alias("f"))
    each = top.select("k", F.explode(payloads(F.col("f"), 1)).alias("m")).select("k", fields("m").alias("f"))
    wrapped = each.select("k", text(F.col("f"), 1).alias("id"), payload(F.col("f"), 2).alias("m")).where("id IS NOT NULL AND m IS NOT NULL").select("k", "id", fields("m").alias("f"))
    inner = wrapped.select("k", "id", fields(of_base64(text(F.col("f"), 1))).alias("f")).where("f IS NOT NULL")
    f = F.col("f")
    read = inner.select("k", "id", text(f, 1).alias("title"), *(fields(payload(f, n)).alias(f"f{n}") for n in (3, 7, 9, 10)))
    read = read.select("k", "id", "title", *(moment(F.col(f"f{n}")).alias(f"at{n}") for n in (3, 7, 10)), text(F.col("f9"), 1).alias("place"))
    created = F.coalesce("at7", "at3")
    named = F.coalesce("title", F.concat(F.lit(platform[:1].upper() + platform[1:] + " trajectory "), "id"))
    return read.select(
        F.col("k").alias(key),
        F.concat(F.lit(f"sess:{platform}:"), "id").alias("session_id"),
        named.alias("title"),
        created.alias("created_at"),
        F.coalesce("at10", "at3", created).alias("updated_at"),
        T.path_identity(F.col("place")).alias("workspace"),
    )
