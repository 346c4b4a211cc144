"""Every query that has SQL gives the same rows in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from cellmend.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(float(r[i]), 6) + 0.0 if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order)) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, rel.fetchall())
