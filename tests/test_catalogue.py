"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from turnloom.plans import bundles, catalogue, contexts, joined, lifecycle, links, messages, records, seeds, surfaces  # noqa: F401  (they register their queries)
from turnloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows):
    def cell(v):
        if v is None or v != v:
            return "null"
        return repr(round(float(v), 4)) if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio") else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    rows = plain(tuple(r) for r in out.select(*columns).collect())
    if name in ORACLE_SQL:
        listed = ", ".join(f'"{c}"' for c in columns)
        assert rows == plain(duck.execute(f"SELECT {listed} FROM ({ORACLE_SQL[name]})").fetchall())
    else:
        assert rows
