"""Every registered query against its SQL check on the smallest tables."""
import decimal
import numbers
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(frame):
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (float, decimal.Decimal)):
            return round(float(v), 6)
        return int(v) if isinstance(v, numbers.Integral) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(repr(tuple(map(cell, row))) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def oracle(sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_its_check(spark, sf, oracle, name):
    got = entry.queries()[name](spark, sf).toPandas()
    if name in entry.oracle_sql():
        assert cells(got) == cells(oracle.sql(entry.oracle_sql()[name]).df())
    else:
        assert len(got) > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
