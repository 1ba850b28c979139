"""Summaries, tests and error measures over long tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import rolling as R
from tidewheel.functions import tails
from tidewheel.lookup import attach
from tidewheel.storage import materialize
from tidewheel.timeline import DEFAULT_CHUNK_ROWS, Recipe, Timeline

C = F.col


def scalar(fn, *cols: Column) -> Column:
    """Numeric helper on result rows (one row per key or feature), Arrow batched."""

    @F.pandas_udf("double")
    def run(frame: pd.DataFrame) -> pd.Series:
        rows = frame.itertuples(index=False, name=None)
        return pd.Series([None if any(pd.isna(x) for x in r) else fn(*r) for r in rows], dtype="float64")

    return run(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cols))))


# ------------------------------------------------------------------- summaries
def describe(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles, maximum."""
    plain = df.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    quart = quantiles(df, by, x, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return plain.join(quart, list(by)).select(*by, "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def quantiles(df: DataFrame, by: Sequence[str], x: str, wanted: dict[str, float], chunk_rows: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles without holding a key's values in one task.

    Values are counted per distinct value first; a balanced layout by value gives
    each its range of ranks, and the one or two values around every wanted rank
    are picked out.
    """
    kw = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    by = list(by)
    counts = df.where(C(x).isNotNull()).groupBy(*by, C(x).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    tl = Timeline.build(counts, by, ("_v",), **kw)
    n = tl.df.groupBy(*by).agg(F.sum("_n").alias("_all"))
    ranked = attach(tl.running(keep=["_v", "_n"], _hi=("sum", "_n")).df, n, by)
    low = C("_hi") - C("_n")
    picks = []
    for name, q in wanted.items():
        pos = (C("_all") - 1) * F.lit(float(q))
        for part, rank in (("f", F.floor(pos)), ("c", F.ceil(pos))):
            picks.append(F.max(F.when((rank >= low) & (rank < C("_hi")), C("_v"))).alias(f"_{part}_{name}"))
    got = ranked.groupBy(*by).agg(F.first("_all").alias("_all"), *picks)

    def between(name: str, q: float) -> Column:
        pos = (C("_all") - 1) * F.lit(float(q))
        return C(f"_f_{name}") + (C(f"_c_{name}") - C(f"_f_{name}")) * (pos - F.floor(pos))

    return got.select(*by, *(between(k, q).alias(k) for k, q in wanted.items()))


def threshold_levels(df: DataFrame, by: Sequence[str], x: str, exact: bool = True) -> DataFrame:
    """Mean, 75 % and 90 % quantile.  ``exact=False`` uses the mergeable sketch for huge keys."""
    if not exact:
        q = F.percentile_approx
        return df.groupBy(*by).agg(F.avg(x).alias("mean"), q(x, 0.75).alias("q75"), q(x, 0.9).alias("q90"))
    mean = df.groupBy(*by).agg(F.avg(x).alias("mean"))
    return mean.join(quantiles(df, by, x, {"q75": 0.75, "q90": 0.9}), list(by))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*(f(c).alias(c) for c in cols))


def melt(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Wide to (keys, feature, value)."""
    return df.select(*keys, *(C(c).cast("double") for c in cols)).unpivot(list(keys), list(cols), "feature", "value")


def histogram(df: DataFrame, by: Sequence[str], x: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; the last bin is closed on the right."""
    width = (high - low) / bins
    b = F.least(F.floor((C(x) - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(C(x).between(low, high)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ecdf(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Share of values up to each distinct value.

    Values are counted first; the running sum then runs over chunks of the
    distinct values, so a key with many values is spread.
    """
    counts = df.where(C(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_n"))
    tl = Timeline.build(counts, by, (x,))
    n = tl.df.groupBy(*by).agg(F.sum("_n").alias("_all"))
    run = attach(tl.running(keep=[x], _upto=("sum", "_n")).df, n, by)
    return run.select(*by, x, (C("_upto") / C("_all")).alias("ecdf"))


# ------------------------------------------------------------------------ runs
def runs(tl: Timeline, x: str) -> DataFrame:
    """Signed length of every block of equal change signs, numbered in order (zero blocks left out)."""
    from tidewheel.operators.features import run_length

    live = run_length(tl.with_df(tl.df.select(*tl.by, "rn", x)), x, "_run", [x])

    def s(w):
        nxt = R.following(C("_run"), w)
        return {"_last": (C("_run") != 0) & (nxt.isNull() | (F.abs(nxt) <= F.abs("_run")) | (F.signum(nxt) != F.signum("_run")))}

    ends = live.apply(Recipe(("_last",), (s,), ("_run",), 0, 1), keep=["_run"]).df.where("_last")
    return ends.select(*tl.by, C("rn").alias("end_rn"), C("_run").alias("run"))


def run_transitions(found: DataFrame, by: Sequence[str], limit: int = 5, chunk_rows: int | None = None) -> DataFrame:
    """Dense matrix (long form) of transition probabilities between run lengths -limit..limit.

    Row shares count every following run; only lengths inside the limit are shown.
    """
    kw = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    tl = Timeline.build(found, by, ("end_rn",), **kw)

    def s(w):
        return {"to_run": R.following(C("run"), w)}

    pairs = tl.apply(Recipe(("to_run",), (s,), ("run",), 0, 1), keep=["run"]).df.where(C("to_run").isNotNull())
    counts = pairs.groupBy(*by, C("run").alias("from_run"), "to_run").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy(*by, "from_run").agg(F.sum("n").alias("total"))
    span = F.filter(F.sequence(F.lit(-limit), F.lit(limit)), lambda k: k != 0)
    dense = (
        found.select(*by).distinct()
        .withColumn("from_run", F.explode(span)).withColumn("to_run", F.explode(span))
    )
    return (
        dense.join(counts, [*by, "from_run", "to_run"], "left").join(rows, [*by, "from_run"], "left")
        .select(*by, "from_run", "to_run", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)).alias("probability"))
    )


def run_continuation(found: DataFrame, by: Sequence[str], lengths: int = 5) -> DataFrame:
    """P(run reaches n + 1 | it reached n) by sign, from one aggregate over run lengths."""
    at_least = lambda sign, n: F.count_if(C("run") * sign >= n)
    wide = found.groupBy(*by).agg(
        *(
            F.coalesce(F.try_divide(at_least(sign, n + 1), at_least(sign, n)), F.lit(0.0)).alias(f"{tag}_{n}")
            for tag, sign in (("p", 1), ("m", -1))
            for n in range(1, lengths + 1)
        )
    )
    rows = F.array(
        *(
            F.struct(F.lit(n).alias("length"), C(f"p_{n}").alias("positive"), C(f"m_{n}").alias("negative"))
            for n in range(1, lengths + 1)
        )
    )
    return wide.select(*by, F.inline(rows))


def count_stability(counts: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """Mean, deviation and coefficient of variation of counts per period."""
    got = counts.groupBy(*by).agg(F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"))
    return got.withColumn("cv", F.try_divide("std", "mean"))


# ---------------------------------------------------------------- distributions
def moments(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis with the normality statistic."""
    g = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2")
    )
    n = C("n").cast("double")
    jb = n / 6 * (F.pow("_g1", F.lit(2.0)) + F.pow("_g2", F.lit(2.0)) / 4)
    return g.select(
        *by,
        "n",
        F.when(n > 2, C("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * C("_g2") + 6)).alias("kurtosis"),
        jb.alias("jb"),
        F.exp(-jb / 2).alias("jb_pvalue"),
    )


def autocovariances(tl: Timeline, x: str, lags: int) -> DataFrame:
    """n and autocorrelations 1..lags per key (full-series mean, biased form).

    Lag products are row-wise in one chunked pass; the mean is one row per key.
    """
    by = list(tl.by)
    tl = tl.settle([x])
    mean = tl.df.groupBy(*by).agg(F.avg(x).alias("_m"))
    centred = tl.with_df(attach(tl.df, mean, by).withColumn("_x", C(x) - C("_m")))

    def s(w):
        return {f"_p{k}": C("_x") * R.prev(C("_x"), w, k) for k in range(1, lags + 1)}

    outs = tuple(f"_p{k}" for k in range(1, lags + 1))
    rows = centred.apply(Recipe(outs, (s,), ("_x",), lags), keep=["_x"]).df
    sums = rows.groupBy(*by).agg(
        F.count("_x").alias("n"), F.sum(C("_x") * C("_x")).alias("_s0"), *(F.sum(p).alias(p) for p in outs)
    )
    return sums.select(*by, "n", *(F.try_divide(C(p), C("_s0")).alias(f"acf_{k + 1}") for k, p in enumerate(outs)))


def ljung_box(tl: Timeline, x: str, max_lags: int = 10) -> DataFrame:
    """Portmanteau test at ``min(max_lags, n // 5)`` lags."""
    ac = autocovariances(tl, x, max_lags)
    n = C("n").cast("double")
    lags = F.least(F.lit(max_lags), F.floor(C("n") / 5))
    q = reduce(
        lambda a, k: a + F.when(F.lit(k) <= lags, F.pow(f"acf_{k}", F.lit(2.0)) / (n - k)).otherwise(0.0),
        range(1, max_lags + 1),
        F.lit(0.0),
    )
    got = ac.select(*tl.by, "n", lags.cast("int").alias("lags"), (n * (n + 2) * q).alias("lb"))
    return got.withColumn("lb_pvalue", scalar(tails.chi2_tail, C("lb"), C("lags")))


def acf_pacf(tl: Timeline, x: str, lags: int = 40) -> DataFrame:
    """Autocorrelation and (Durbin-Levinson) partial autocorrelation by lag."""
    ac = autocovariances(tl, x, lags)
    arr = ac.select(*tl.by, F.array(*(C(f"acf_{k}") for k in range(1, lags + 1))).alias("acf"))

    @F.pandas_udf("array<double>")
    def partial(rows: pd.Series) -> pd.Series:
        return rows.map(_durbin_levinson)

    both = arr.withColumn("pacf", partial("acf"))
    z = F.arrays_zip("acf", "pacf")
    return both.select(*tl.by, F.posexplode(z).alias("lag", "_v")).select(
        *tl.by, (C("lag") + 1).alias("lag"), "_v.acf", "_v.pacf"
    )


def _durbin_levinson(rho) -> list[float]:
    phi, out = np.zeros(0), []
    for k, r in enumerate(rho):
        num = r - (phi * np.asarray(rho[:k])[::-1]).sum()
        den = 1 - (phi * np.asarray(rho[:k])).sum()
        last = num / den if den else float("nan")
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    return out


def levene(tl: Timeline, x: str) -> DataFrame:
    """Median-centred variance test between the first and second half of each key."""
    by = list(tl.by)
    tl = tl.settle([x])
    n = tl.rows_per_key()
    half = attach(tl.df, n, by).withColumn("_h", F.when(C("rn") <= F.floor(C("n_rows") / 2), 1).otherwise(2))
    med = quantiles(half, [*by, "_h"], x, {"_med": 0.5}, tl.chunk_rows)
    dev = attach(half, med, [*by, "_h"]).withColumn("_z", F.abs(C(x) - C("_med")))
    part = dev.groupBy(*by, "_h").agg(
        F.count("_z").alias("_n"), F.avg("_z").alias("_m"), F.var_pop("_z").alias("_v")
    )
    g = part.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.sum(C("_n") * C("_v")).alias("_within"),
        F.sum(C("_n") * C("_m")).alias("_sum"),
        F.sum(C("_n") * C("_m") * C("_m")).alias("_sq"),
        F.min("_n").alias("_least"),
    )
    stat = (C("n") - 2) * (C("_sq") - C("_sum") * C("_sum") / C("n")) / C("_within")
    got = g.select(*by, "n", F.when(C("_least") > 5, stat).alias("levene"))
    return got.withColumn("levene_pvalue", scalar(tails.f_tail, C("levene"), F.lit(1.0), C("n") - 2.0))


def return_properties(tl: Timeline, x: str) -> DataFrame:
    """Skew, kurtosis and the three test p-values; nulls below 20 values."""
    by = list(tl.by)
    a = moments(tl.df, by, x)
    b = ljung_box(tl, x).select(*by, "lb_pvalue")
    c = levene(tl, x).select(*by, "levene_pvalue")
    got = a.join(b, by).join(c, by)
    cols = ["skew", "kurtosis", "jb_pvalue", "lb_pvalue", "levene_pvalue"]
    return got.select(*by, C("n").alias("num_bars"), *(F.when(C("n") >= 20, C(v)).alias(v) for v in cols))


# ------------------------------------------------------------------ unit roots
def adf(tl: Timeline, x: str, lag: int = 1) -> DataFrame:
    """Unit-root test with constant and ``lag`` lagged differences, per key of the timeline.

    The regression needs only sums of products, taken in one chunked pass.  A
    constant or singular series is reported as not stationary with null statistic.
    """
    by = list(tl.by)
    names = ["_y", "_l", *(f"_d{k}" for k in range(1, lag + 1))]

    def s(w):
        out = {"_y": C(x) - R.prev(C(x), w), "_l": R.prev(C(x), w)}
        out |= {f"_d{k}": R.prev(C(x), w, k) - R.prev(C(x), w, k + 1) for k in range(1, lag + 1)}
        return out

    rows = tl.apply(Recipe(tuple(names), (s,), (x,), lag + 1), keep=[]).df.na.drop()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(a).alias(f"m{a}") for a in names),
        *((F.covar_pop(a, b) * F.count(F.lit(1))).alias(f"c{a}{b}") for a, b in pairs),
    )
    k = lag + 1

    def solve(n, *c):
        cov = np.zeros((k + 1, k + 1))
        it = iter(c)
        for i in range(k + 1):
            for j in range(i, k + 1):
                cov[i, j] = cov[j, i] = next(it)
        xx, xy = cov[1:, 1:], cov[1:, 0]
        dof = n - k - 1
        if dof <= 0 or np.linalg.matrix_rank(xx) < k:
            return math.nan
        beta = np.linalg.solve(xx, xy)
        rss = cov[0, 0] - beta @ xy
        if rss <= 0:
            return math.nan
        return float(beta[0] / math.sqrt(rss / dof * np.linalg.inv(xx)[0, 0]))

    got = sums.withColumn("adf", F.nanvl(scalar(solve, C("n"), *(C(f"c{a}{b}") for a, b in pairs)), F.lit(None)))
    got = got.withColumn("adf_pvalue", scalar(tails.adf_p_value, C("adf")))
    return got.select(*by, "n", "adf", "adf_pvalue", F.coalesce(C("adf_pvalue") < 0.05, F.lit(False)).alias("stationary"))


def adf_auto(tl: Timeline, x: str, max_lag: int) -> DataFrame:
    """Unit-root test with the lag of least information criterion among 0..max_lag.

    All candidate regressions use the rows every candidate can use and come from
    one pass over the product sums of the largest one.
    """
    by = list(tl.by)
    names = ["_y", "_l", *(f"_d{k}" for k in range(1, max_lag + 1))]

    def s(w):
        out = {"_y": C(x) - R.prev(C(x), w), "_l": R.prev(C(x), w)}
        out |= {f"_d{k}": R.prev(C(x), w, k) - R.prev(C(x), w, k + 1) for k in range(1, max_lag + 1)}
        return out

    rows = tl.apply(Recipe(tuple(names), (s,), (x,), max_lag + 1), keep=[]).df.na.drop()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *((F.covar_pop(a, b) * F.count(F.lit(1))).alias(f"c{a}{b}") for a, b in pairs),
    )
    p = len(names)

    def best(n, *c):
        cov = np.zeros((p, p))
        it = iter(c)
        for i in range(p):
            for j in range(i, p):
                cov[i, j] = cov[j, i] = next(it)
        scores = []
        for lag in range(max_lag + 1):
            k = lag + 1
            xx, xy = cov[1 : k + 1, 1 : k + 1], cov[1 : k + 1, 0]
            if np.linalg.matrix_rank(xx) < k:
                continue
            rss = cov[0, 0] - np.linalg.solve(xx, xy) @ xy
            if rss > 0:
                scores.append((n * math.log(rss / n) + 2 * (k + 1), lag))
        return float(min(scores)[1]) if scores else math.nan

    lag = scalar(best, C("n"), *(C(f"c{a}{b}") for a, b in pairs))
    chosen = sums.select(*by, F.nanvl(lag, F.lit(None)).cast("int").alias("lag"))
    tested = [adf(tl, x, k).withColumn("lag", F.lit(k)) for k in range(max_lag + 1)]
    every = reduce(DataFrame.unionByName, tested)
    return chosen.join(every, [*by, "lag"], "left")


# ---------------------------------------------------------------- correlations
def correlation_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Unordered feature pairs with their pairwise-complete correlation, from one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = df.groupBy(*by).agg(*(_corr(C(a), C(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    items = F.array(
        *(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), C(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs))
    )
    return wide.select(*by, F.inline(items))


def _corr(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    return F.corr(F.when(both, a.cast("double")), F.when(both, b.cast("double")))


def extreme_pairs(pairs: DataFrame, k: int = 10, largest: bool = True) -> DataFrame:
    return pairs.orderBy(F.desc("corr") if largest else F.asc("corr"), "a", "b").limit(k)


def feature_correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Correlation, count and two-sided p-value of every feature with the target."""
    both = lambda f: C(f).isNotNull() & C(target).isNotNull()
    wide = df.agg(
        *(_corr(C(f), C(target)).alias(f"r{i}") for i, f in enumerate(features)),
        *(F.count_if(both(f)).alias(f"n{i}") for i, f in enumerate(features)),
    )
    items = F.array(
        *(F.struct(F.lit(f).alias("feature"), C(f"r{i}").alias("corr"), C(f"n{i}").alias("n")) for i, f in enumerate(features))
    )

    def p(r, n):
        if n <= 2:
            return 1.0
        return 0.0 if abs(r) >= 1 else tails.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    return wide.select(F.inline(items)).withColumn("p_value", scalar(p, C("corr"), C("n")))


def select_features(df: DataFrame, features: Sequence[str], target: str, min_corr: float = 0.7, max_p: float = 0.1) -> DataFrame:
    found = feature_correlations(df, features, target)
    return found.where((C("n") >= 2) & (F.abs("corr") >= min_corr) & (C("p_value") < max_p))


def selection_counts(found: DataFrame, max_p: float = 0.1) -> DataFrame:
    """How many features each correlation threshold 0.1 .. 0.9 keeps."""
    steps = [i / 10 for i in range(1, 10)]
    wide = found.agg(
        *(F.count_if((F.abs("corr") >= t) & (C("p_value") < max_p)).alias(f"t{i}") for i, t in enumerate(steps))
    )
    items = F.array(*(F.struct(F.lit(t).alias("threshold"), C(f"t{i}").alias("n")) for i, t in enumerate(steps)))
    return wide.select(F.inline(items))


# ---------------------------------------------------------------- performance
def buy_and_hold(tl: Timeline, days: DataFrame, price: str = "Close", year: int = 365) -> DataFrame:
    """Total return, yearly volatility, Sharpe ratio and largest drawdown.

    ``days`` is the dense daily table (``bucket`` and price); missing days are
    skipped by the change and carry no return.
    """
    by = list(tl.by)
    ends = tl.df.groupBy(*by).agg(
        (F.try_divide(F.max_by(price, "rn"), F.min_by(price, "rn")) - 1).alias("total_return")
    )
    d = Timeline.build(days, by, ("bucket",), tl.chunk_rows)
    d = d.running(keep=[price], _p=("last", price))
    r = d.apply(Recipe(("_r",), (lambda w: {"_r": R.pct(C("_p"), w)},), ("_p",), 1), keep=[])
    r = r.with_df(r.df.where(C("_r").isNotNull())).extend(_lg=F.log1p("_r"))
    c = r.running(keep=["_r"], _sum=("sum", "_lg"))
    p = c.running(keep=["_r", "_sum"], _top=("max", "_sum"))
    agg = p.df.groupBy(*by).agg(
        (F.stddev_samp("_r") * math.sqrt(year)).alias("volatility"),
        F.avg("_r").alias("_mean"),
        F.min(F.exp(C("_sum") - C("_top")) - 1).alias("max_drawdown"),
    )
    sharpe = F.when(C("volatility") > 0, C("_mean") * year / C("volatility")).otherwise(0.0)
    return ends.join(agg, by).select(*by, "total_return", "volatility", sharpe.alias("sharpe"), "max_drawdown")


def path_sharpe(df: DataFrame, by: Sequence[str], ret: str = "ret", periods: int = 365 * 24) -> DataFrame:
    """Yearly mean over deviation; undefined values are 0."""
    ratio = F.try_divide(F.avg(ret), F.stddev_samp(ret)) * math.sqrt(periods)
    return df.groupBy(*by).agg(F.coalesce(ratio, F.lit(0.0)).alias("sharpe"))


# --------------------------------------------------------------------- errors
def error_columns(df: DataFrame, actual: str = "actual_close", forecast: str = "mean") -> DataFrame:
    e = C(actual) - C(forecast)
    pct = F.try_divide(e, C(actual)) * 100
    return df.withColumns(
        {"error": e, "absolute_error": F.abs(e), "percentage_error": pct, "absolute_percentage_error": F.abs(pct)}
    )


def error_metrics(tl: Timeline, actual: str = "actual_close", forecast: str = "mean") -> DataFrame:
    """MAE, MAPE, RMSE and error relative to the naive forecast."""
    by = list(tl.by)
    rec = Recipe(("_step",), (lambda w: {"_step": F.abs(C(actual) - R.prev(C(actual), w))},), (actual,), 1)
    d = error_columns(tl.apply(rec, keep=[actual, forecast]).df, actual, forecast)
    got = d.groupBy(*by).agg(
        F.avg("absolute_error").alias("mae"),
        F.avg("absolute_percentage_error").alias("mape"),
        F.sqrt(F.avg(C("error") * C("error"))).alias("rmse"),
        F.avg("_step").alias("_naive"),
    )
    return got.withColumn("mase", F.try_divide("mae", "_naive")).drop("_naive")


def quantile_mape(df: DataFrame, by: Sequence[str], actual: str, columns: Sequence[str]) -> DataFrame:
    long = df.select(*by, actual, *columns).unpivot([*by, actual], list(columns), "quantile", "forecast")
    return long.groupBy(*by, "quantile").agg(
        (F.avg(F.abs(F.try_divide(C(actual) - C("forecast"), C(actual)))) * 100).alias("mape")
    )


def error_by_age(df: DataFrame, by: Sequence[str], error: str, hours: str = "hours_since_last_refit") -> DataFrame:
    """Distribution of the error by whole days since the last refit."""
    d = df.withColumn("days_since_refit", F.floor(C(hours) / 24).cast("int"))
    return describe(d, [*by, "days_since_refit"], error)


def forecast_quality(df: DataFrame, by: Sequence[str], actual: str, forecast: str) -> DataFrame:
    """RMSE and R2 in one pass."""
    e2 = F.pow(C(actual) - C(forecast), F.lit(2.0))
    known = C(actual).isNotNull() & C(forecast).isNotNull()
    return df.where(known).groupBy(*by).agg(
        F.sqrt(F.avg(e2)).alias("rmse"),
        (1 - F.try_divide(F.avg(e2), F.var_pop(actual))).alias("r2"),
    )


def directional_accuracy(tl: Timeline, actual: str, forecast: str) -> DataFrame:
    """Share of rows whose forecast change has the sign of the real change."""
    def s(w):
        p = R.prev(C(actual), w)
        return {"_ok": F.signum(C(actual) - p) == F.signum(C(forecast) - p)}

    d = tl.apply(Recipe(("_ok",), (s,), (actual, forecast), 1), keep=[]).df.where(C("_ok").isNotNull())
    return d.groupBy(*tl.by).agg(F.avg(C("_ok").cast("double")).alias("directional_accuracy"))


# ------------------------------------------------------------- classification
def confusion(df: DataFrame, by: Sequence[str], truth: str, pred: str) -> DataFrame:
    return df.groupBy(*by, C(truth).alias("truth"), C(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, by: Sequence[str], truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted rows.

    Everything derives from the confusion counts, so the data is read once.
    """
    keys = list(by)
    cm = confusion(df, by, truth, pred)
    sides = cm.select(
        *keys,
        F.inline(
            F.array(
                F.struct(C("truth").alias("cls"), C("n").alias("sup"), F.lit(0).cast("bigint").alias("pre"), F.when(C("truth") == C("pred"), C("n")).otherwise(0).alias("tp")),
                F.struct(C("pred").alias("cls"), F.lit(0).cast("bigint").alias("sup"), C("n").alias("pre"), F.lit(0).cast("bigint").alias("tp")),
            )
        ),
    )
    per = sides.groupBy(*keys, "cls").agg(F.sum("sup").alias("sup"), F.sum("pre").alias("pre"), F.sum("tp").alias("tp"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.select(
        *keys,
        C("cls").cast("string").alias("row"),
        safe(C("tp"), C("pre")).alias("precision"),
        safe(C("tp"), C("sup")).alias("recall"),
        safe(2 * C("tp"), C("sup") + C("pre")).alias("f1"),
        C("sup").alias("support"),
        "tp",
    )
    m = ("precision", "recall", "f1")
    whole = per.groupBy(*keys).agg(
        F.sum("support").alias("_n"),
        (F.sum("tp") / F.sum("support")).alias("_acc"),
        *(F.avg(c).alias(f"_a_{c}") for c in m),
        *((F.sum(C(c) * C("support")) / F.sum("support")).alias(f"_w_{c}") for c in m),
    )
    line = lambda name, get: F.struct(
        F.lit(name).alias("row"), *(get(c).alias(c) for c in m), C("_n").alias("support")
    )
    lines = F.array(
        line("accuracy", lambda c: C("_acc")),
        line("macro avg", lambda c: C(f"_a_{c}")),
        line("weighted avg", lambda c: C(f"_w_{c}")),
    )
    return per.drop("tp").unionByName(whole.select(*keys, F.inline(lines)))


def flat_report(report: DataFrame, by: Sequence[str]) -> DataFrame:
    """Report as (metric name, value) with spaces and dashes turned to underscores."""
    long = report.select(
        *by, "row",
        F.inline(F.array(*(F.struct(F.lit(c).alias("m"), C(c).cast("double").alias("value")) for c in ("precision", "recall", "f1", "support")))),
    )
    return long.select(*by, F.translate(F.concat_ws("_", "row", "m"), " -", "__").alias("metric"), "value")


def weighted_f1(df: DataFrame, by: Sequence[str], truth: str, pred: str) -> DataFrame:
    rep = classification_report(df, by, truth, pred)
    return rep.where(C("row") == "weighted avg").select(*by, C("f1").alias("f1_weighted"))


# ---------------------------------------------------------------- rank measures
def weighted_tau(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Additive hyperbolic weighted rank correlation, averaged over both rankings.

    Meant for rankings: each key's two columns become one array, in which agreeing and
    disagreeing partners are counted by merging sorted runs (n log² n, no pairs).
    """
    @F.pandas_udf("double")
    def tau(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([_weighted_tau(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(xs, ys)])

    known = df.where(C(x).isNotNull() & C(y).isNotNull()).select(*by, C(x).alias("x"), C(y).alias("y"))
    got = known.groupBy(*by).agg(F.collect_list(F.struct("x", "y")).alias("_l"))
    return got.select(*by, tau("_l.x", "_l.y").alias("weighted_tau"))


def pairwise_tau(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(first, second, weighted_tau) of all pairs of columns, one task per pair and key."""
    pairs = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), C(a).cast("double").alias("x"), C(b).cast("double").alias("y"))
             for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return weighted_tau(df.select(*by, F.inline(F.array(*pairs))), [*by, "first", "second"], "x", "y")


def _smaller_before(y: np.ndarray) -> np.ndarray:
    """For every place how many places before it hold a smaller value."""
    n = len(y)
    rank = np.unique(y, return_inverse=True)[1]
    out = np.zeros(n, np.int64)
    size = 1
    while size < n:  # runs of ``size`` places are sorted; the right one of two counts against the left one
        base = np.arange(n) // (2 * size) * (int(rank.max()) + 1)
        right = np.arange(n) // size % 2 == 1
        keys = np.sort((base + rank)[~right])
        before = np.searchsorted(keys, base[right])
        out[right] += np.searchsorted(keys, (base + rank)[right]) - before
        size *= 2
    return out


def _balance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For every row the partners that agree in the order of x and y, less those that disagree."""
    n = len(x)
    xr, yr = (np.unique(v, return_inverse=True)[1] for v in (x, y))
    order = np.lexsort((-yr, xr))  # within equal x the larger y first: they never count as smaller before
    below = np.empty(n, np.int64)
    below[order] = _smaller_before(yr[order])
    order = np.lexsort((yr, xr))
    above = np.empty(n, np.int64)  # larger y at smaller x
    above[order] = _smaller_before(-yr[order])

    def sides(v):
        """Rows smaller less rows larger in ``v``."""
        count = np.bincount(v)
        upto = np.cumsum(count)
        return (upto - count)[v] - (n - upto)[v]

    both = np.unique(xr * (int(yr.max()) + 1) + yr, return_inverse=True)[1]  # (x, y) in order
    size, first = np.bincount(both), np.searchsorted(np.sort(xr), xr)
    upto = np.cumsum(size)
    equal = (upto - size)[both] - first - (np.searchsorted(np.sort(xr), xr, "right") - upto[both])
    return 2 * (below - above) - sides(yr) + equal


def _weighted_tau(x: np.ndarray, y: np.ndarray) -> float:
    n = len(x)
    if n < 2:
        return math.nan
    balance = _balance(x, y)
    unequal = [n - np.bincount(c)[c] for c in (np.unique(v, return_inverse=True)[1] for v in (x, y))]

    def one(first, second):
        rank = np.empty(n)
        rank[np.lexsort((second, first))[::-1]] = np.arange(n)
        w = 1 / (rank + 1)
        den = math.sqrt((w * unequal[0]).sum() * (w * unequal[1]).sum())
        return (w * balance).sum() / den if den else math.nan

    return (one(x, y) + one(y, x)) / 2


def percent_ranks(df: DataFrame, x: str, out: str, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``df`` with the share of other rows that are smaller in ``x``; equal values share a rank, nulls come first.

    Rows are counted per distinct value, the values are laid out by range, and a running sum over chunks gives the
    rows before each value: no task sees all rows, and a value that most rows share is one row of the ranking.
    ``df`` is written first: ranks are joined back by value, and an average made twice may differ in its last digit.
    """
    df = materialize(df, "values")
    counts = df.groupBy(C(x).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.lit(0))
    tl = Timeline.build(counts, ("_g",), ("_v",), chunk_rows).running(keep=["_v", "_n"], _upto=("sum", "_n"))
    total = tl.df.agg(F.coalesce(F.sum("_n"), F.lit(0))).head()[0]
    share = (C("_upto") - C("_n")) / F.lit(float(max(total - 1, 1)))
    ranked = materialize(tl.df.select("_v", share.alias(out)), "ranks")
    return df.join(ranked, C(x).eqNullSafe(C("_v")), "left").drop("_v")


def ensemble_score(df: DataFrame, parts: dict[str, float], key: str = "feature", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Weighted sum of percentile ranks of importance columns."""
    got = df.select(key, *parts)
    for i, c in enumerate(parts):
        got = percent_ranks(got, c, f"_r{i}", chunk_rows)
    score = sum((C(f"_r{i}") * w for i, w in enumerate(parts.values())), F.lit(0.0))
    return got.select(key, *parts, score.alias("score"))
