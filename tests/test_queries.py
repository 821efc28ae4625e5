"""Every query of the engine against its SQL twin in DuckDB, rows and all."""

import glob
import math
import os

import duckdb
import pytest

from tesserine.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    if isinstance(x, bool) or x is None:
        return (str(x),)
    if isinstance(x, (int, float)) and not (isinstance(x, float) and math.isnan(x)):
        return ("n", round(float(x), 6))
    return (type(x).__name__, str(x))


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_like_twin(spark, sf, duck, name):
    found = catalog.QUERIES[name](spark, sf)
    rows = found.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    twin = duck.sql(catalog.ORACLE_SQL[name])
    assert table_of(found.columns, rows) == table_of(twin.columns, twin.fetchall())
