"""Information-driven and calendar bars."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import rolling as R
from tidewheel.lookup import attach
from tidewheel.operators.recursive import reach
from tidewheel.operators.scans import guess_and_verify, reset_scan
from tidewheel.operators.sweeps import sweep_bars
from tidewheel.timeline import Recipe, Timeline

C = F.col
OHLCV = ("ts", "seq", "Open", "High", "Low", "Close", "Volume", "volume_usdt", "trade_count")


def bar_aggregates(open_from: str = "Open") -> list[Column]:
    """First, extreme and last prices with summed volumes, as partial aggregates."""
    return [
        F.max_by("ts", "rn").alias("ts"),
        F.min_by(open_from, "rn").alias("Open"),
        F.max("High").alias("High"),
        F.min("Low").alias("Low"),
        F.max_by("Close", "rn").alias("Close"),
        F.sum("Volume").alias("Volume"),
        F.sum("volume_usdt").alias("volume_usdt"),
        F.sum("trade_count").alias("trade_count"),
    ]


def closed_bars(assigned: DataFrame, by: Sequence[str], bar: str = "bar_id") -> DataFrame:
    """Rows with a bar number to bars; the open bar at the end is dropped."""
    return (
        assigned.groupBy(*by, bar)
        .agg(*bar_aggregates(), F.max("closes").alias("_closed"))
        .where("_closed")
        .drop("_closed")
    )


def assign_bars(tl: Timeline, metric: Column, threshold: Column | float, keep=OHLCV) -> Timeline:
    """Row-level bar numbers for any metric and a fixed or per-row threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    ready = tl.extend(_step=metric.cast("double"), _limit=limit.cast("double"))
    return reset_scan(ready, "_step", "_limit", keep)


def assign_threshold_bars(tl: Timeline, metric: str, threshold: float, keep=OHLCV) -> Timeline:
    """Row-level bar numbers: a bar closes when its sum of ``metric`` reaches the threshold."""
    return assign_bars(tl, C(metric), threshold, keep)


def volume_bars(tl: Timeline, threshold: float) -> DataFrame:
    return closed_bars(assign_bars(tl, C("Volume"), threshold).df, tl.by)


def dollar_bars(tl: Timeline, threshold: float) -> DataFrame:
    return closed_bars(assign_bars(tl, C("volume_usdt"), threshold).df, tl.by)


def price_change_bars(tl: Timeline, threshold: float) -> DataFrame:
    """Sums absolute fractional changes; the change runs across bar borders."""
    pre = tl.apply(
        Recipe(
            ("_move",),
            (lambda w: {"_move": F.coalesce(F.abs(R.pct(C("Close"), w)), F.lit(0.0))},),
            ("Close",),
            1,
        ),
        keep=OHLCV,
    )
    return closed_bars(assign_bars(pre, C("_move"), threshold).df, tl.by)


def extended_volume_bars(tl: Timeline, threshold: float, open_from: str = "Open") -> DataFrame:
    """Volume bars with open/close time, deviation of in-bar log returns and bar return.

    ``open_from="Close"`` gives the variant that opens at the first close and has
    no high and low.  The previous close inside the bar is the previous row of the
    series, so one row of halo before the scan replaces a window per bar.
    """
    pre = tl.apply(
        Recipe(("_prev",), (lambda w: {"_prev": R.prev(C("Close"), w)},), ("Close",), 1),
        keep=OHLCV,
    )
    rows = assign_bars(pre, C("Volume"), threshold, [*OHLCV, "_prev"]).df
    inside = F.when(C("rn") > C("bar_open"), F.log(C("Close") / C("_prev")))
    out = (
        rows.withColumn("_ret", inside)
        .groupBy(*tl.by, "bar_id")
        .agg(
            F.min_by("ts", "rn").alias("open_time"),
            F.max_by("ts", "rn").alias("close_time"),
            F.min_by(open_from, "rn").alias("open_price"),
            F.max("High").alias("High"),
            F.min("Low").alias("Low"),
            F.max_by("Close", "rn").alias("close_price"),
            F.sum("Volume").alias("total_volume"),
            F.when(F.count("_ret") > 1, F.stddev_samp("_ret")).otherwise(0.0).alias("intra_bar_std"),
            F.max("closes").alias("_closed"),
        )
        .where("_closed")
        .drop("_closed")
        .withColumn("bar_return", F.try_divide(C("close_price"), C("open_price")) - 1)
    )
    return out.drop("High", "Low") if open_from == "Close" else out


# -------------------------------------------------------------- tick signs
def tick_signs(tl: Timeline, c: str = "Close", out: str = "sign", keep=None) -> Timeline:
    """Sign of the price change; no change repeats the last sign, +1 at the start."""
    keep = list(tl.df.columns) if keep is None else list(keep)

    def s(w):
        d = C(c) - R.prev(C(c), w)
        return {"_sgn": F.when(d > 0, 1).when(d < 0, -1)}

    done = tl.apply(Recipe(("_sgn",), (s,), (c,), 1), keep=keep).running(
        keep=keep, _last=("last", "_sgn")
    )
    res = done.df.withColumn(out, F.coalesce("_last", F.lit(1))).drop("_last")
    return done.with_df(res)


def run_medians(tl: Timeline, sign: str, window: int, out: str, keep) -> Timeline:
    """Median length of the sign runs inside the last ``window`` rows (runs cut at the window edge)."""

    def s(w):
        f = w.rowsBetween(-(window - 1), 0)
        full = F.count(sign).over(f) == window
        return {"_ws": F.when(full, F.collect_list(sign).over(f))}

    def lengths(w):
        # fold into (finished lengths, current sign, current length)
        start = F.struct(
            F.array().cast("array<int>").alias("done"), F.lit(0).alias("s"), F.lit(0).alias("n")
        )

        def step(acc, x):
            same = acc["s"] == x
            return F.struct(
                F.when(same | (acc["n"] == 0), acc["done"])
                .otherwise(F.concat(acc["done"], F.array(acc["n"])))
                .alias("done"),
                x.cast("int").alias("s"),
                F.when(same, acc["n"] + 1).otherwise(F.lit(1)).alias("n"),
            )

        def finish(acc):
            return F.array_sort(F.concat(acc["done"], F.array(acc["n"])))

        return {"_runs": F.aggregate("_ws", start, step, finish)}

    def median(w):
        size = F.size("_runs")
        lo = F.element_at("_runs", F.floor((size + 1) / 2).cast("int"))
        hi = F.element_at("_runs", F.floor((size + 2) / 2).cast("int"))
        return {out: F.when(C("_ws").isNotNull(), (lo + hi) / 2.0)}

    return tl.apply(Recipe((out,), (s, lengths, median), (sign,), window), keep=keep)


def tick_imbalance(
    tl: Timeline,
    threshold_type: str = "dynamic_imbalance",
    static_threshold: float = 100.0,
    initial_bar_size: int = 1,
    span_bar_size: int = 20,
    span_tick_imbalance: int = 20,
    window_run_length: int = 20,
    warm_up: int = 20_000,
) -> DataFrame:
    """Row table with ``threshold``, ``cum_imbalance``, bar key and ``closes``.

    ``static`` and ``dynamic_runs`` know the threshold of every row beforehand
    and use the step-function scan.  ``dynamic_imbalance`` multiplies the mean
    bar size so far by the mean sign, a floating memory of all earlier bars,
    and uses the verified scan.
    """
    signed = tick_signs(tl, keep=OHLCV)
    if threshold_type in ("static", "dynamic_runs"):
        if threshold_type == "static":
            ready = signed.extend(threshold=F.lit(float(static_threshold)))
        else:
            ready = run_medians(signed, "sign", window_run_length, "threshold", [*OHLCV, "sign"])
        ready = ready.extend(_step=C("sign").cast("double"))
        done = reset_scan(ready, "_step", "threshold", [*OHLCV, "threshold"], two_sided=True)
        return done.df.withColumnRenamed("level", "cum_imbalance").drop("bar_id")
    if threshold_type != "dynamic_imbalance":
        raise ValueError(f"unknown threshold_type: {threshold_type}")
    alpha = 2.0 / (span_bar_size + 1)

    def run(pdf: pd.DataFrame, state: list[float]):
        size, cum, opened = state
        n = len(pdf)
        theta, level, first, fired = np.empty(n), np.empty(n), np.empty(n), np.zeros(n, bool)
        rows = zip(pdf["sign"].tolist(), pdf["_mean_sign"].tolist(), pdf["rn"].tolist())
        for i, (s, m, rn) in enumerate(rows):
            cum += s
            theta[i], level[i], first[i] = abs(size * m), cum, opened
            if theta[i] > 0 and abs(cum) >= theta[i]:
                fired[i] = True
                size = (1 - alpha) * size + alpha * (rn + 1 - opened)
                cum, opened = 0.0, rn + 1.0
        out = {"threshold": theta, "cum_imbalance": level, "bar_open": first.astype("int64"), "closes": fired}
        return out, [size, cum, opened]

    smoothed = _mean_sign(signed, span_tick_imbalance)
    return guess_and_verify(
        smoothed,
        ["sign", "_mean_sign"],
        run,
        [float(initial_bar_size), 0.0, 1.0],
        {"threshold": "double", "cum_imbalance": "double", "bar_open": "bigint", "closes": "boolean"},
        OHLCV,
        warm_up,
    ).df


def _mean_sign(signed: Timeline, span: int) -> Timeline:
    def fn(pdf):
        s = pdf["sign"].astype(float)
        return {"_mean_sign": s.ewm(span=span, adjust=False).mean().to_numpy()}

    keep = list(signed.df.columns)
    return signed.map_chunks(fn, {"_mean_sign": "double"}, ["sign"], back=reach(span), keep=keep)


def volume_imbalance(
    tl: Timeline,
    volume: str = "Volume",
    initial_bar_volume: float | None = None,
    span_bar_volume: int = 20,
    span_tick_imbalance: int = 20,
    warm_up: int = 20_000,
) -> DataFrame:
    """Like :func:`tick_imbalance` on signed volume with a moving mean bar volume.

    Without ``initial_bar_volume`` the start value is 1 % of the whole key's
    volume, which looks at all data; streams must give it.
    """
    signed = tick_signs(tl, keep=OHLCV)
    smoothed = _mean_sign(signed, span_tick_imbalance)
    if initial_bar_volume is None:
        totals = tl.df.groupBy(*tl.by).agg((F.sum(volume) / 100).alias("_init"))
        smoothed = smoothed.with_df(attach(smoothed.df, totals, tl.by))
    else:
        smoothed = smoothed.extend(_init=F.lit(float(initial_bar_volume)))
    alpha = 2.0 / (span_bar_volume + 1)

    def run(pdf: pd.DataFrame, state: list[float]):
        cum, inside, opened, mean = state
        n = len(pdf)
        theta, level, first, fired = np.empty(n), np.empty(n), np.empty(n), np.zeros(n, bool)
        rows = zip(*(pdf[c].tolist() for c in ("sign", "_mean_sign", "rn", volume)))
        for i, (s, m, rn, v) in enumerate(rows):
            cum += s * v
            inside += v
            theta[i], level[i], first[i] = abs(mean * m), cum, opened
            if theta[i] > 0 and abs(cum) >= theta[i]:
                fired[i] = True
                mean = (1 - alpha) * mean + alpha * inside
                cum, inside, opened = 0.0, 0.0, rn + 1.0
        out = {"threshold": theta, "cum_imbalance": level, "bar_open": first.astype("int64"), "closes": fired}
        return out, [cum, inside, opened, mean]

    return guess_and_verify(
        smoothed,
        ["sign", "_mean_sign", volume, "_init"],
        run,
        [0.0, 0.0, 1.0],
        {"threshold": "double", "cum_imbalance": "double", "bar_open": "bigint", "closes": "boolean"},
        OHLCV,
        warm_up,
        key_state=lambda pdf: [float(pdf["_init"].iloc[0])],
    ).df


def imbalance_bars(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bars of a row table made by one of the imbalance rules."""
    return closed_bars(rows, by, "bar_open")


# ------------------------------------------------------------ calendar bars
def _spine(counts: DataFrame, by: Sequence[str], width: str) -> DataFrame:
    """Every bucket between the first and last one of each key."""
    span = counts.groupBy(*by).agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_b"))
    return span.select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"interval {width}"))).alias("bucket"))


def day(ts: str = "ts") -> Column:
    return F.date_trunc("day", C(ts)).cast("timestamp_ntz")


def week_end(ts: str = "ts") -> Column:
    """Sunday that ends the calendar week of ``ts``."""
    monday = F.date_trunc("week", C(ts)).cast("timestamp_ntz")
    return monday + F.expr("interval 6 days")


def calendar_bars(df: DataFrame, by: Sequence[str], bucket: Column, aggs: list[Column], width: str | None = None, zero: Sequence[str] = ()) -> DataFrame:
    """Group by a calendar bucket; with ``width`` empty buckets appear (``zero`` columns as 0)."""
    got = df.groupBy(*by, bucket.alias("bucket")).agg(*aggs)
    if width is None:
        return got
    full = _spine(got, by, width).join(got, [*by, "bucket"], "left")
    return full.withColumns({z: F.coalesce(C(z), F.lit(0).cast(full.schema[z].dataType)) for z in zero})


def daily_last(df: DataFrame, by: Sequence[str], c: str = "Close") -> DataFrame:
    """Last value of each day; days without rows are null."""
    return calendar_bars(df, by, day(), [F.max_by(c, F.struct("ts", "seq")).alias(c)], "1 day")


def weekly_count(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return calendar_bars(df, by, week_end(), [F.count(F.lit(1)).alias("n")], "7 days", ["n"])


def bar_durations(bars: Timeline, ts: str = "ts", out: str = "hours") -> Timeline:
    """Hours between consecutive bar ends."""

    def s(w):
        return {out: F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), C(ts)) / 3.6e9}

    return bars.apply(Recipe((out,), (s,), (ts,), 1))


# ------------------------------------------------------------ threshold sweeps
def linspace(low: Column, high: Column, steps: int) -> Column:
    """``steps`` evenly spaced values from ``low`` to ``high``."""
    i = F.sequence(F.lit(0), F.lit(steps - 1))
    return F.transform(i, lambda k: low + (high - low) * k / F.lit(float(steps - 1)))


def threshold_sweep(tl: Timeline, metric: str, steps: int, low_of_mean: float = 1.0, high_of_max: float = 4.0) -> DataFrame:
    """Bars for a grid of thresholds between multiples of the mean and the maximum.

    The grid is one small array per key; rows are read once for all thresholds (see :mod:`tidewheel.operators.sweeps`).
    """
    stats = tl.df.groupBy(*tl.by).agg(F.avg(metric).alias("_m"), F.max(metric).alias("_x"))
    grid = stats.select(
        *tl.by,
        F.posexplode(linspace(C("_m") * low_of_mean, C("_x") * high_of_max, steps)).alias("step", "threshold"),
    )
    return sweep_bars(tl, metric, grid)
