"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from loomline.plans import registry

FOLDER = Path(os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001"))


def rows(frame):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if type(v).__name__ in ("bool", "bool_"):
            return bool(v)
        if isinstance(v, str):
            return v
        return round(float(v), 9) if hasattr(v, "__float__") else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, str(FOLDER)).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
