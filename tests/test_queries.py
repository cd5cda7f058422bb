"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

from quire import catalog

SF = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, name):
    import duckdb

    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(value(r[c]) for c in names)) for r in df.collect())
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    relation = con.sql(catalog.oracle_sql()[name])
    at = [relation.columns.index(c) for c in names]
    assert sorted(relation.columns) == names
    assert got == sorted(repr(tuple(value(r[i]) for i in at)) for r in relation.fetchall())


def test_entry_has_rows(spark):
    assert catalog.entry(spark, SF).count() > 0


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
