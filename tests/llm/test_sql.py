"""The training-data queries that have SQL, against DuckDB."""

import duckdb
import pytest

from loomline.llm import queries
from tests.test_oracles import FOLDER, rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = queries.queries()[name](spark, str(FOLDER)).toPandas()
    want = duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
