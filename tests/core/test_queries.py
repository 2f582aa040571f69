"""Every query against its SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tracelake.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cell(x):
    return f"{x:.6g}" if isinstance(x, float) and not math.isnan(x) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    expected = rows_of(want.columns, want.fetchall())
    assert got == expected
    kinds = {c: t for c, t in zip(want.columns, map(str, want.types))}
    spark_kinds = dict(df.dtypes)
    whole = {c for c, t in kinds.items() if t in ("BIGINT", "HUGEINT")}
    assert all(spark_kinds[c] == "bigint" and kinds[c] == "BIGINT" for c in whole)
