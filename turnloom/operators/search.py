"""Substring search with ranking, highlights, groups and pages.

A query is its distinct white-space separated terms, lower-cased. A row matches
when all terms are in one of its fields. Rows are read once, filters and
columns reach the scan, and a page is a bounded top-k.
"""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_DAYS, OLD = 90.0, 100.0


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(query.lower().split()))


def has_all(field: str, terms: list[str]) -> Column:
    lowered = F.lower(F.coalesce(F.col(field), F.lit("")))
    return reduce(lambda a, b: a & b, [F.contains(lowered, F.lit(t)) for t in terms], F.lit(True))


def matches(rows: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows of which one field holds every term; an empty query matches all."""
    terms = terms_of(query)
    return rows.where(reduce(lambda a, b: a | b, [has_all(f, terms) for f in fields])) if terms else rows


def _places(lowered: Column, term: str) -> Column:
    """(start, stop) of a term's hits: hits of one term don't overlap, so the pieces between them give their places."""
    k = len(term)
    ends = F.transform(F.split(lowered, "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), lambda x: F.length(x))

    def put(acc: Column, n: Column) -> Column:
        span = F.struct((acc["at"] + n).alias("start"), (acc["at"] + n + k).alias("stop"))
        return F.struct((acc["at"] + n + k).alias("at"), F.concat(acc["done"], F.array(span)).alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("done"))
    return F.aggregate(F.slice(ends, 1, F.size(ends) - 1), start, put, lambda acc: acc["done"])


def spans(field: str, terms: list[str]) -> Column:
    """(start, stop) of every literal hit of a term, in code points, overlapping and touching hits merged."""
    lowered = F.lower(F.coalesce(F.col(field), F.lit("")))
    hits = [_places(lowered, t) for t in terms]
    ordered = F.array_sort(F.concat(*hits)) if hits else F.array().cast("array<struct<start:int,stop:int>>")
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    return F.aggregate(
        ordered,
        empty,
        lambda acc, x: F.when(F.size(acc) == 0, F.array(x))
        .when(
            x["start"] <= F.element_at(acc, -1)["stop"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))),
        )
        .otherwise(F.concat(acc, F.array(x))),
    )


def relevance(n_spans: Column, age_days: Column) -> Column:
    """Ten points a highlight, and up to five for being recent."""
    age = F.greatest(F.lit(0.0), age_days) / HALF_LIFE_DAYS
    return 10.0 * n_spans + 5.0 * F.greatest(F.lit(0.0), 1.0 - F.log1p(age) / F.log1p(F.lit(OLD)))


def ranked(rows: DataFrame, query: str, field: str, age_days: Column, fields: list[str] | None = None) -> DataFrame:
    out = matches(rows, query, fields or [field])
    return out.withColumn("highlights", spans(field, terms_of(query))).withColumn("score", relevance(F.size("highlights"), age_days))


def by_relevance(when: str, ident: str) -> list[Column]:
    """The order of results: best score, then latest (unknown times last), then smallest id."""
    return [F.desc("score"), F.desc_nulls_last(when), F.asc(ident)]


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def after_cursor(rows: DataFrame, order: list[tuple[str, bool]], cursor: dict | None, limit: int) -> DataFrame:
    """The next ``limit`` rows behind ``cursor`` (the last row's values of the order's columns) in order of (column, descending).

    Unlike an offset, a cursor skips nothing and repeats nothing when rows are added. The columns must not be null.
    """
    if cursor is not None:
        behind, equal = F.lit(False), F.lit(True)
        for name, down in order:
            here = F.lit(cursor[name])
            behind |= equal & (F.col(name) < here if down else F.col(name) > here)
            equal &= F.col(name) == here
        rows = rows.where(behind)
    return rows.orderBy(*(F.desc(n) if d else F.asc(n) for n, d in order)).limit(limit)


#: Version of a page token's own shape.
TOKEN_VERSION = 1


def page_token(offset: int) -> str:
    """An opaque token of the page that starts at ``offset``."""
    said = json.dumps({"v": TOKEN_VERSION, "offset": offset}, separators=(",", ":"))
    return base64.urlsafe_b64encode(said.encode()).decode().rstrip("=")


def offset_of(token: str | None) -> int:
    """The offset that a token stands for; without one the first page. A token that ``page_token`` didn't give is a ValueError."""
    if not token:
        return 0
    try:
        said = json.loads(base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True))
    except ValueError as e:
        raise ValueError("a page token must be base64url of JSON") from e
    if not isinstance(said, dict) or isinstance(said.get("v"), bool) or said.get("v") != TOKEN_VERSION:
        raise ValueError(f"a page token must be of version {TOKEN_VERSION}")
    offset = said.get("offset")
    if isinstance(offset, bool) or not isinstance(offset, int) or offset < 0:
        raise ValueError("a page token's offset must be a whole number from 0 on")
    return offset


def token_page(rows: DataFrame, order: list, token: str | None = None, limit: int = 50) -> tuple[DataFrame, str]:
    """The page that a token stands for, and the token of the next one; the page after the last is empty."""
    offset = offset_of(token)
    return page(rows, order, offset, limit), page_token(offset + limit)


def with_total(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page, and one row with the number of all rows."""
    return page(rows, order, offset, limit), rows.agg(F.count("*").alias("total"))


def on_axes(rows: DataFrame, **wanted: list[str] | None) -> DataFrame:
    """Rows whose column of each named axis has one of the wanted values; an axis without values filters nothing."""
    for axis, values in wanted.items():
        if values:
            rows = rows.where(F.col(axis).isin(values))
    return rows


def snippet(text: Column, n: int) -> Column:
    """The text, or its first n-1 characters and three dots."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(n - 1)), F.lit("...")))


def snippet_clusters(rows: DataFrame, text: str, when: str, n: int, least: int = 3) -> DataFrame:
    """Equal snippets met at least ``least`` times, with the range of ``when``."""
    return rows.groupBy(snippet(F.col(text), n).alias("snippet")).agg(F.count("*").alias("hits"), F.min(when).alias("first"), F.max(when).alias("last")).where(F.col("hits") >= least)


def groups(rows: DataFrame, key: str, when: str) -> DataFrame:
    """Hits per key, ordered by hits, latest activity and name."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("hits"), F.max(when).alias("last")).orderBy(F.desc("hits"), F.desc("last"), "key")


def consecutive(rows: DataFrame, order: list, key: str) -> DataFrame:
    """Rows numbered by run of equal keys in order (one global order: for a page of results)."""
    by = Window.orderBy(*order)
    change = F.when(F.lag(key).over(by).eqNullSafe(F.col(key)), 0).otherwise(1)
    return rows.withColumn("run", F.sum(change).over(by))
