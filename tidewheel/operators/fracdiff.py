"""Fractional differencing with a fixed-width filter and the search for the least order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.lookup import attach
from tidewheel.operators import stats
from tidewheel.storage import materialize
from tidewheel.timeline import Timeline

C = F.col


def ffd_weights(d: float, thres: float = 1e-5) -> np.ndarray:
    """Filter weights, newest row first, down to absolute value ``thres``."""
    w = [1.0]
    while True:
        k = len(w)
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < thres:
            return np.array(w)
        w.append(nxt)


def frac_diff(tl: Timeline, cols: Sequence[str], d: float, thres: float = 1e-5) -> Timeline:
    """Differenced columns (same names).

    Per column: missing values are carried forward, rows before the first value
    are null, the first ``width`` values and rows missing in the source are 0.
    The filter is a convolution over chunk plus halo.
    """
    cols = list(cols)
    tl = tl.settle([*tl.order, *cols])
    weights = ffd_weights(d, thres)
    width = len(weights) - 1
    ready = tl.running(keep=[*tl.order, *cols], **{f"_f_{c}": ("last", c) for c in cols})
    first = tl.df.groupBy(*tl.by).agg(*(F.min(F.when(C(c).isNotNull(), C("rn"))).alias(f"_s_{c}") for c in cols))
    ready = ready.with_df(attach(ready.df, first, tl.by))

    def fn(pdf: pd.DataFrame) -> dict:
        out = {}
        rn = pdf["rn"].to_numpy()
        for c in cols:
            x = np.nan_to_num(pdf[f"_f_{c}"].to_numpy(dtype=float))
            start = pdf[f"_s_{c}"].to_numpy(dtype=float)
            y = np.convolve(x, weights)[: len(x)]
            age = rn - start
            y = np.where((age >= width) & ~np.isnan(pdf[c].to_numpy(dtype=float)), y, 0.0)
            out[f"_o_{c}"] = np.where(age >= 0, y, np.nan)
        return out

    helper = [n for c in cols for n in (f"_f_{c}", f"_s_{c}", c)]
    done = ready.map_chunks(fn, {f"_o_{c}": "double" for c in cols}, helper, back=width, keep=list(tl.order))
    named = [F.nanvl(C(f"_o_{c}"), F.lit(None)).alias(c) for c in cols]
    return done.with_df(done.df.select(*tl.by, "rn", *tl.order, *named))


def minimum_order(
    tl: Timeline, cols: Sequence[str], steps: int = 11, thres: float = 1e-5, alpha: float = 0.05
) -> tuple[DataFrame, DataFrame]:
    """Least order of 0, 0.1 .. 1 per key for which every column is stationary (else 1).

    Returns (choice per key, test table).  All orders and columns are tested in
    one job: the differenced columns are melted to (key, order, feature) series.
    """
    cols = list(cols)
    base = tl.settle([*tl.order, *cols])
    tests = []
    for d in np.linspace(0, 1, steps):
        diff = frac_diff(base, cols, float(d), thres)
        rows = materialize(diff.df.na.drop(), "orders")
        shift = rows.groupBy(*tl.by).agg(F.min("rn").alias("_lo"))
        long = stats.melt(
            attach(rows, shift, tl.by).withColumn("rn", C("rn") - C("_lo") + 1), [*tl.by, "rn"], cols
        )
        series = Timeline(long, (*tl.by, "feature"), ("rn",), tl.chunk_rows)
        tests.append(stats.adf(series, "value").withColumn("d", F.lit(round(float(d), 10))))
    table = materialize(reduce(DataFrame.unionByName, tests), "orders")
    ok = table.groupBy(*tl.by, "d").agg(F.every(C("adf_pvalue").isNotNull() & (C("adf_pvalue") < alpha)).alias("_ok"))
    choice = ok.groupBy(*tl.by).agg(F.coalesce(F.min(F.when(C("_ok"), C("d"))), F.lit(1.0)).alias("d"))
    return choice, table
