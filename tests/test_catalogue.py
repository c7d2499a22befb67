"""Queries against the SQL that gives the same rows."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from skein.plans import catalogue, catalogue_index, catalogue_load, catalogue_search  # noqa: F401  the others add to the first

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(catalogue.SQL)


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, pd.Timestamp):
            return str(x)
        return f"{float(x):.6g}" if not isinstance(x, str) and hasattr(x, "__float__") else str(x)

    return sorted((tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    assert rows(catalogue.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(catalogue.SQL[name]).df())


def test_strategies_run(spark):
    out = catalogue.QUERIES["strategy_multi"](spark, DATA).toPandas()
    assert len(out) and out.groupby("qid").pos.max().max() <= 10 and not out.duplicated(["qid", "chunk_id"]).any()
