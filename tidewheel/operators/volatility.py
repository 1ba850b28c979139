"""Realised variance and the heterogeneous autoregressive forecast."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import rolling as R
from tidewheel.lookup import attach
from tidewheel.operators.bars import calendar_bars, day
from tidewheel.operators.stats import scalar
from tidewheel.timeline import Recipe, Timeline

C = F.col
REGRESSORS = ("rv_daily_lag", "rv_weekly_lag", "rv_monthly_lag")


def realized_variance(tl: Timeline, price: str = "Close", bucket: Column | None = None, width: str = "1 day") -> DataFrame:
    """Sum of squared log returns per period; periods without rows are 0."""
    def s(w):
        return {"_lr": F.log(C(price)) - F.log(R.prev(C(price), w))}

    rows = tl.apply(Recipe(("_lr",), (s,), (price,), 1), keep=["ts"]).df
    b = day() if bucket is None else bucket
    agg = F.coalesce(F.sum(C("_lr") * C("_lr")), F.lit(0.0)).alias("rv")
    return calendar_bars(rows, tl.by, b, [agg], width, ["rv"])


def har_table(tl: Timeline, rv: str = "rv") -> Timeline:
    """Lagged daily, weekly (5) and monthly (22) means and the next value; incomplete rows stay null."""
    def s1(w):
        return {"rv_daily_lag": R.prev(C(rv), w), "rv_daily_next": R.following(C(rv), w)}

    def s2(w):
        return {
            "rv_weekly_lag": R.mean(C("rv_daily_lag"), 5, w),
            "rv_monthly_lag": R.mean(C("rv_daily_lag"), 22, w),
        }

    outs = (*REGRESSORS, "rv_daily_next")
    return tl.apply(Recipe(outs, (s1, s2), (rv,), 23, 1))


def har_backtest(tl: Timeline, initial_days: int = 90, min_rows: int = 23, strict: bool = True, ts: str = "bucket", rv: str = "rv") -> DataFrame:
    """Expanding least-squares forecast for every day, without a loop.

    The normal equations of all earlier days are running sums (exact across
    chunks); a 4x4 system is solved per row.  ``strict`` trains only on rows whose
    target is already known on the forecast day; with ``strict=False`` the row of
    the day before, whose target is the forecast day itself, is used too.
    """
    full = har_table(tl, rv).settle()
    rows = full.df.na.drop(subset=[*REGRESSORS, "rv_daily_next", rv])
    start = rows.groupBy(*tl.by).agg(F.min(ts).alias("_t0"), F.min("rn").alias("_lo"))
    # the complete rows are consecutive, so renumbering by a shift is enough
    base = full.with_df(
        attach(rows, start, tl.by).withColumn("rn", C("rn") - C("_lo") + 1).drop("_lo")
    )
    x = [F.lit(1.0), *(C(c) for c in REGRESSORS)]
    y = C("rv_daily_next")
    prods = {f"_xx{i}{j}": x[i] * x[j] for i in range(4) for j in range(i, 4)}
    prods |= {f"_xy{i}": x[i] * y for i in range(4)}
    keep = [ts, rv, *REGRESSORS, "_t0"]
    summed = base.extend(**prods).running(keep=keep, **{f"_s{p}": ("sum", p) for p in prods})
    cut = 2 if strict else 1

    def s(w):
        out = {f"_t{p}": R.prev(C(f"_s{p}"), w, cut) for p in prods}
        # the row of the day before holds the regressors of the forecast
        out |= {f"_l{i}": R.prev(C(c), w) for i, c in enumerate(REGRESSORS)}
        return out

    names = tuple(f"_t{p}" for p in prods) + tuple(f"_l{i}" for i in range(3))
    lagged = summed.apply(Recipe(names, (s,), tuple([*(f"_s{p}" for p in prods), *REGRESSORS]), cut), keep=keep)

    def solve(*v):
        a, b, last = np.zeros((4, 4)), np.array(v[10:14]), np.array([1.0, *v[14:17]])
        a[np.triu_indices(4)] = v[:10]
        a = a + np.triu(a, 1).T
        # balance the columns: variances are tiny against the constant
        scale = np.sqrt(np.diag(a))
        if (scale == 0).any():
            return math.nan
        coef, *_ = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-13)
        return float(last @ (coef / scale))

    forecast = scalar(solve, *(C(n) for n in names))
    ready = (C("rn") - cut >= min_rows) & (C(ts) >= C("_t0") + F.expr(f"interval {initial_days} days"))
    got = lagged.df.where(ready)
    return got.select(*tl.by, ts, C(rv).alias("actual_rv"), F.nanvl(forecast, F.lit(None)).alias("forecast_rv"))
