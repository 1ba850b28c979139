"""Named queries against DuckDB (all of them with CATALOG=all)."""

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUICK = [
    "volume_bars", "rsi", "macd", "kama", "run", "cusum_events", "triple_barrier", "concurrent_labels", "average_uniqueness",
    "asof_forward_strict", "overlap_anti_join", "levene", "classification_report", "purged_splits", "symmetric_cv",
]
NAMES = sorted(oracle_sql()) if os.environ.get("CATALOG") == "all" else QUICK


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_contract():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got, want = queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    for f in (got, want):
        for c in f.select_dtypes("datetime").columns:
            f[c] = f[c].astype("datetime64[us]")
    exact = [c for c in cols if "float" not in str(want[c].dtype)] or cols
    got, want = (f[cols].sort_values(exact + [c for c in cols if c not in exact], ignore_index=True) for f in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)
