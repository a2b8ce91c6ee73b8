"""Each query over checks, guards, sources and consolidation gives the rows of its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

import lodestone.queries_checks as added
from lodestone.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
NAMES = [n for n, f in QUERIES.items() if f.__module__ == added.__name__]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    return round(value, 7) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_those_of_the_sql(spark, tables, name):
    got = QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=repr)
    found = tables.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=repr)
    assert columns == sorted(names) and rows == want
