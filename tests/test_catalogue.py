"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from auralake.plans.catalogue import ORACLES, QUERIES


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or str(v) in ("<NA>", "nan", "None"):
        return "null"
    return repr(int(v) if isinstance(v, float) and v == int(v) else v) if not isinstance(v, str) else v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(got) == rows(con.execute(ORACLES[name]).fetchdf())


def test_entry_works(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
