"""Queries: aggregates, tests, error measures, volatility and fractional differencing."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewheel.catalog import (
    CHUNK_ROWS, DAILY, ONE, PART, TICKS, C, daily, final, lag, lead, one, over, query, roll, shape, six_places, ticks,
)
from tidewheel.catalog_bars import WEEKS
from tidewheel.catalog_indicators import BLOCKS, DAY, SIGNED, pct
from tidewheel.catalog_labels import DESC_D, _desc
from tidewheel.operators import bars as B
from tidewheel.operators import fills as P
from tidewheel.operators import fracdiff as D
from tidewheel.operators import indicators as I
from tidewheel.operators import stats as S
from tidewheel.operators import volatility as V
from tidewheel.sources import views
from tidewheel.storage import materialize
from tidewheel.timeline import Timeline

SYM = ("symbol",)
RET = f"rt AS MATERIALIZED (SELECT *, {pct} AS r FROM ticks)"


def returns(spark, sf):
    tl = ticks(spark, sf).apply(I.pct_change(out="r"), keep=["ts", "seq", "Close", "Volume"])
    return tl.settle()


def changes(spark, sf):
    """Changes without the empty first row, numbered from 1."""
    tl = returns(spark, sf)
    return tl.with_df(tl.df.where(C("rn") > 1).withColumn("rn", C("rn") - 1))


@query("describe", final(f"SELECT symbol, {_desc.replace('(x', '(r')} FROM rt GROUP BY 1", (TICKS, RET), SYM, DESC_D, ["n"]))
def _describe(spark, sf):
    return shape(S.describe(returns(spark, sf).df, SYM, "r"), SYM, DESC_D, ["n"])


@query("threshold_levels", final("SELECT symbol, avg(volume) AS mean, quantile_cont(volume, 0.75) AS q75, quantile_cont(volume, 0.9) AS q90 FROM ticks GROUP BY 1", keys=SYM, d=["mean", "q75", "q90"]))
def _levels(spark, sf):
    return shape(S.threshold_levels(views.ticks(spark, sf), SYM, "Volume"), SYM, ["mean", "q75", "q90"])


@query("value_counts", final("SELECT symbol, volume, count(*) AS n FROM ticks GROUP BY 1, 2", keys=("symbol", "volume"), i=["n"]))
def _counts(spark, sf):
    return shape(S.value_counts(views.ticks(spark, sf), ["symbol", "Volume"]), ("symbol", "Volume"), i=["n"])


@query("distinct_counts", "SELECT count(DISTINCT event_type) AS event_type, count(DISTINCT user_id) AS user_id FROM events")
def _distinct(spark, sf):
    return S.distinct_counts(views.table(spark, sf, "events"), ["event_type", "user_id"])


@query("histogram", final("SELECT symbol, least(floor(value / 10), 9) AS bin, count(*) AS n FROM (SELECT symbol, close - 100 AS value FROM ticks) AS q WHERE value BETWEEN 0 AND 100 GROUP BY 1, 2", keys=SYM, i=["bin", "n"]))
def _hist(spark, sf):
    df = views.ticks(spark, sf).withColumn("v", C("Close") - 100)
    return shape(S.histogram(df, SYM, "v", 0.0, 100.0, 10), SYM, i=["bin", "n"])


@query("ecdf", final("SELECT DISTINCT symbol, volume, cume_dist() OVER (PARTITION BY symbol ORDER BY volume) AS ecdf FROM ticks", keys=("symbol", "volume"), d=["ecdf"]))
def _ecdf(spark, sf):
    return shape(S.ecdf(views.ticks(spark, sf), SYM, "Volume"), ("symbol", "Volume"), ["ecdf"])


RUNS = "ru AS MATERIALIZED (SELECT symbol, blk, max(rn) AS end_rn, CAST(any_value(s) * count(*) AS BIGINT) AS run FROM bl WHERE s <> 0 GROUP BY 1, 2)"


def all_runs(spark, sf):
    tl = one(spark, sf).apply(I.pct_change("Close", 1, "pc", 0.0))
    return materialize(S.runs(tl, "pc"), "runs")


@query("runs", final("SELECT * FROM ru", (ONE, SIGNED, BLOCKS, RUNS), SYM, i=["end_rn", "run"]))
def _runs(spark, sf):
    return shape(all_runs(spark, sf), SYM, i=["end_rn", "run"])


@query("run_transitions", final(
    "SELECT 'ALL' AS symbol, a.k AS from_run, b.k AS to_run, coalesce(n / t, 0) AS probability FROM (SELECT unnest(range(-5, 6)) AS k) AS a CROSS JOIN (SELECT unnest(range(-5, 6)) AS k) AS b LEFT JOIN (SELECT run, nx, CAST(count(*) AS DOUBLE) AS n FROM (SELECT run, lead(run) OVER (ORDER BY end_rn) AS nx FROM ru) AS q WHERE nx IS NOT NULL GROUP BY 1, 2) AS c ON c.run = a.k AND c.nx = b.k LEFT JOIN (SELECT run, count(*) AS t FROM (SELECT run, lead(run) OVER (ORDER BY end_rn) AS nx FROM ru) AS q WHERE nx IS NOT NULL GROUP BY 1) AS d ON d.run = a.k WHERE a.k <> 0 AND b.k <> 0",
    (ONE, SIGNED, BLOCKS, RUNS), SYM, ["probability"], ["from_run", "to_run"]))
def _trans(spark, sf):
    return shape(S.run_transitions(all_runs(spark, sf), SYM, chunk_rows=CHUNK_ROWS), SYM, ["probability"], ["from_run", "to_run"])


@query("run_continuation", final(
    "SELECT 'ALL' AS symbol, k AS length, count(*) FILTER (run >= k + 1) / CAST(count(*) FILTER (run >= k) AS DOUBLE) AS positive, count(*) FILTER (run <= -k - 1) / CAST(count(*) FILTER (run <= -k) AS DOUBLE) AS negative FROM ru, range(1, 6) AS r(k) GROUP BY k",
    (ONE, SIGNED, BLOCKS, RUNS), SYM, ["positive", "negative"], ["length"]))
def _cont(spark, sf):
    return shape(S.run_continuation(all_runs(spark, sf), SYM), SYM, ["positive", "negative"], ["length"])


@query("count_stability", final(f"SELECT symbol, avg(n) AS mean, stddev_samp(n) AS std, stddev_samp(n) / avg(n) AS cv FROM ({WEEKS}) AS w GROUP BY 1", (DAILY,), SYM, ["mean", "std", "cv"]))
def _stab(spark, sf):
    return shape(S.count_stability(B.weekly_count(views.bars_daily(spark, sf), SYM), SYM), SYM, ["mean", "std", "cv"])


_g1 = "(m3 / power(m2, 1.5))"
_g2 = "(m4 / (m2 * m2) - 3)"
MOM = f"""SELECT symbol, n, {_g1} * sqrt(n * (n - 1)) / (n - 2) AS skew, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * {_g2} + 6) AS kurtosis, n / 6 * (power({_g1}, 2) + power({_g2}, 2) / 4) AS jb,
  exp(-n / 12 * (power({_g1}, 2) + power({_g2}, 2) / 4)) AS jb_pvalue FROM (SELECT symbol, CAST(count(r) AS DOUBLE) AS n, avg(power(r - m, 2)) AS m2, avg(power(r - m, 3)) AS m3, avg(power(r - m, 4)) AS m4 FROM (SELECT *, avg(r) OVER (PARTITION BY symbol) AS m FROM rt) AS q GROUP BY 1) AS q2"""


@query("moments", final(MOM, (TICKS, RET), SYM, ["skew", "kurtosis", "jb", "jb_pvalue"], ["n"]))
def _moments(spark, sf):
    return shape(S.moments(returns(spark, sf).df, SYM, "r"), SYM, ["skew", "kurtosis", "jb", "jb_pvalue"], ["n"])


_ac = "ac AS MATERIALIZED (SELECT symbol, k, n, s / s0 AS acf FROM (SELECT a.symbol, k, sum(a.x * b.x) AS s FROM ce a JOIN range(1, 11) AS r(k) ON true JOIN ce b ON b.symbol = a.symbol AND b.rn = a.rn - k GROUP BY 1, 2) AS q JOIN (SELECT symbol, count(*) AS n, sum(x * x) AS s0 FROM ce GROUP BY 1) AS z USING (symbol))"
_ce = "ce AS MATERIALIZED (SELECT symbol, rn, r - avg(r) OVER (PARTITION BY symbol) AS x FROM rt WHERE r IS NOT NULL)"
# upper tail of chi-square with 10 degrees of freedom in closed form
_chi10 = "exp(-lb / 2) * (1 + lb / 2 + power(lb / 2, 2) / 2 + power(lb / 2, 3) / 6 + power(lb / 2, 4) / 24)"


@query("ljung_box", final(f"SELECT *, {_chi10} AS lb_pvalue FROM (SELECT symbol, any_value(n) AS n, 10 AS lags, any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - k)) AS lb FROM ac GROUP BY 1) AS q", (TICKS, RET, _ce, _ac), SYM, ["lb", "lb_pvalue"], ["n", "lags"]))
def _lb(spark, sf):
    return shape(S.ljung_box(changes(spark, sf), "r"), SYM, ["lb", "lb_pvalue"], ["n", "lags"])


@query("autocorrelation", final(f"SELECT symbol, k AS lag, acf FROM ({_ac.split('(', 1)[1][:-1].replace('range(1, 11)', 'range(1, 41)')}) AS q", (TICKS, RET, _ce), SYM, ["acf"], ["lag"]))
def _acf(spark, sf):
    return shape(S.acf_pacf(changes(spark, sf), "r", 40), SYM, ["acf"], ["lag"])


@query("partial_autocorrelation")
def _pacf(spark, sf):
    return shape(S.acf_pacf(changes(spark, sf), "r", 40), SYM, ["acf", "pacf"], ["lag"])


@query("levene", final(
    """SELECT symbol, sum(n) AS n, (sum(n) - 2) * (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / sum(w) AS levene FROM (
      SELECT symbol, h, count(*) AS n, avg(z) AS m, sum(z * z) - count(*) * avg(z) * avg(z) AS w FROM (
        SELECT symbol, h, abs(r - median(r) OVER (PARTITION BY symbol, h)) AS z FROM (SELECT *, CASE WHEN rn - 1 <= floor((count(*) OVER (PARTITION BY symbol)) / 2) THEN 1 ELSE 2 END AS h FROM rt WHERE r IS NOT NULL) AS q) AS q2 GROUP BY 1, 2) AS q3 GROUP BY 1""",
    (TICKS, RET), SYM, ["levene"], ["n"]))
def _levene(spark, sf):
    return shape(S.levene(changes(spark, sf), "r"), SYM, ["levene"], ["n"])


@query("return_properties")
def _props(spark, sf):
    return shape(S.return_properties(changes(spark, sf), "r"), SYM, ["skew", "kurtosis", "jb_pvalue", "lb_pvalue", "levene_pvalue"], ["num_bars"])


# one lagged difference: partial out the lag by the closed form of two regressors
ADF = f"""SELECT symbol, n, b / sqrt(rss / (n - 3) * s22 / det) AS adf FROM (
  SELECT *, s00 - b * s01 - (s11 * s02 - s12 * s01) / det * s02 AS rss FROM (
    SELECT *, (s22 * s01 - s12 * s02) / det AS b FROM (
      SELECT *, s11 * s22 - s12 * s12 AS det FROM (
        SELECT symbol, count(*) AS n, covar_pop(l, l) * count(*) AS s11, covar_pop(d, d) * count(*) AS s22, covar_pop(l, d) * count(*) AS s12, covar_pop(y, l) * count(*) AS s01, covar_pop(y, d) * count(*) AS s02, covar_pop(y, y) * count(*) AS s00
        FROM (SELECT symbol, close - {lag('close')} AS y, {lag('close')} AS l, {lag('close')} - {lag('close', 2)} AS d FROM ticks) AS q WHERE d IS NOT NULL GROUP BY 1) AS q1) AS q2) AS q3) AS q4"""


@query("unit_root", final(ADF, keys=SYM, d=["adf"], i=["n"]))
def _adf(spark, sf):
    return shape(S.adf(ticks(spark, sf), "Close"), SYM, ["adf"], ["n"])


@query("unit_root_auto_lag")
def _adfa(spark, sf):
    return shape(S.adf_auto(ticks(spark, sf), "Close", 3).withColumn("stationary", C("stationary").cast("int")), SYM, ["adf", "adf_pvalue"], ["lag", "n", "stationary"])


_cc = ["open", "high", "low", "close", "volume", "trade_count"]
_pairs = [(a, b) for i, a in enumerate(_cc) for b in _cc[i + 1 :]]
CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM bars" for a, b in _pairs)


def correlations(spark, sf):
    df = views.bars_daily(spark, sf)
    return S.correlation_matrix(df.toDF(*[c.lower() for c in df.columns]), _cc)


@query("correlation_pairs", final(CORR, (DAILY,), ("a", "b"), ["corr"]))
def _corr(spark, sf):
    return shape(correlations(spark, sf), ("a", "b"), ["corr"])


@query("extreme_correlations", final(f"(SELECT * FROM ({CORR}) AS q ORDER BY corr DESC, a, b LIMIT 5)", (DAILY,), ("a", "b"), ["corr"]))
def _corrx(spark, sf):
    return shape(S.extreme_pairs(correlations(spark, sf), 5), ("a", "b"), ["corr"])


_ff = ["open", "high", "low", "volume", "trade_count"]
FC = " UNION ALL ".join(f"SELECT '{f}' AS feature, corr({f}, t) AS corr, count(t) AS n FROM fx" for f in _ff)
FX = f"fx AS MATERIALIZED (SELECT *, {lead('close')} AS t FROM bars)"


def feature_table(spark, sf):
    tl = daily(spark, sf)
    df = tl.compute(lambda w: {"t": F.lead("Close").over(w)}, fwd=1).df.where(C("t").isNotNull())
    return df.toDF(*[c.lower() for c in df.columns])


@query("feature_correlations", final(FC.replace("FROM fx", "FROM fx WHERE t IS NOT NULL"), (DAILY, FX), ("feature",), ["corr"], ["n"]))
def _fc(spark, sf):
    return shape(S.feature_correlations(feature_table(spark, sf), _ff, "t"), ("feature",), ["corr"], ["n"])


@query("selected_features")
def _sel(spark, sf):
    return shape(S.select_features(feature_table(spark, sf), _ff, "t", 0.0, 0.5), ("feature",), ["corr", "p_value"], ["n"])


@query("selection_counts")
def _selc(spark, sf):
    return shape(S.selection_counts(S.feature_correlations(feature_table(spark, sf), _ff, "t")), (), ["threshold"], ["n"])


# ---------------------------------------------------------------- performance
_dd = """dd AS MATERIALIZED (SELECT d.symbol, d.bucket, last_value(t.close IGNORE NULLS) OVER (PARTITION BY d.symbol ORDER BY d.bucket) AS p FROM (SELECT symbol, unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL 1 DAY)) AS bucket FROM ticks GROUP BY 1) AS d LEFT JOIN (SELECT symbol, date_trunc('day', ts) AS bucket, arg_max(close, rn) AS close FROM ticks GROUP BY 1, 2) AS t USING (symbol, bucket)),
pr AS MATERIALIZED (SELECT *, product(1 + r) OVER (PARTITION BY symbol ORDER BY bucket) AS c FROM (SELECT *, p / lag(p) OVER (PARTITION BY symbol ORDER BY bucket) - 1 AS r FROM dd) AS q WHERE r IS NOT NULL),
pk AS MATERIALIZED (SELECT *, c / max(c) OVER (PARTITION BY symbol ORDER BY bucket) - 1 AS dw FROM pr)"""


@query("buy_hold_metrics", final(
    "SELECT * FROM (SELECT symbol, arg_max(close, rn) / arg_min(close, rn) - 1 AS total_return FROM ticks GROUP BY 1) AS a JOIN (SELECT symbol, stddev_samp(r) * sqrt(365) AS volatility, avg(r) * 365 / (stddev_samp(r) * sqrt(365)) AS sharpe, min(dw) AS max_drawdown FROM pk GROUP BY 1) AS b USING (symbol)",
    (TICKS, _dd), SYM, ["total_return", "volatility", "sharpe", "max_drawdown"]))
def _bh(spark, sf):
    tl = ticks(spark, sf)
    days = B.daily_last(views.ticks(spark, sf), SYM)
    return shape(S.buy_and_hold(tl, days), SYM, ["total_return", "volatility", "sharpe", "max_drawdown"])


@query("path_sharpe", final("SELECT symbol, avg(r) / stddev_samp(r) * sqrt(8760) AS sharpe FROM rt GROUP BY 1", (TICKS, RET), SYM, ["sharpe"]))
def _ps(spark, sf):
    return shape(S.path_sharpe(returns(spark, sf).df, SYM, "r"), SYM, ["sharpe"])


# --------------------------------------------------------------------- errors
PRED = f"""pd AS MATERIALIZED (SELECT * FROM (SELECT symbol, ts, rn, close AS actual_close, {lag('close')} AS mean, ((rn - 1) % 14) * 24 AS hours FROM bars) AS q WHERE mean IS NOT NULL)"""


def predictions(spark, sf) -> Timeline:
    tl = daily(spark, sf).apply(I.lag("Close", 1, "mean"), keep=["ts", "seq", "Close"])
    df = tl.df.where(C("mean").isNotNull()).withColumns(
        {"hours": ((C("rn") - 1) % 14) * 24, "rn": C("rn") - 1, "q10": C("mean") * 0.98, "q90": C("mean") * 1.02}
    )
    return tl.with_df(df.withColumnRenamed("Close", "actual_close"))


_E = ["error", "absolute_error", "percentage_error", "absolute_percentage_error"]


@query("error_columns", final("SELECT symbol, ts, actual_close - mean AS error, abs(actual_close - mean) AS absolute_error, (actual_close - mean) / actual_close * 100 AS percentage_error, abs((actual_close - mean) / actual_close * 100) AS absolute_percentage_error FROM pd", (DAILY, PRED), DAY, _E))
def _ec(spark, sf):
    return shape(S.error_columns(predictions(spark, sf).df), DAY, _E)


@query("error_metrics", final(
    "SELECT symbol, avg(abs(e)) AS mae, avg(abs(e / actual_close)) * 100 AS mape, sqrt(avg(e * e)) AS rmse, avg(abs(e)) / avg(st) AS mase FROM (SELECT *, actual_close - mean AS e, abs(actual_close - lag(actual_close) OVER (PARTITION BY symbol ORDER BY rn)) AS st FROM pd) AS q GROUP BY 1",
    (DAILY, PRED), SYM, ["mae", "mape", "rmse", "mase"]))
def _em(spark, sf):
    return shape(S.error_metrics(predictions(spark, sf)), SYM, ["mae", "mape", "rmse", "mase"])


@query("quantile_mape", final(
    "SELECT symbol, 'q10' AS quantile, avg(abs(actual_close - mean * 0.98) / actual_close) * 100 AS mape FROM pd GROUP BY 1 UNION ALL SELECT symbol, 'q90', avg(abs(actual_close - mean * 1.02) / actual_close) * 100 FROM pd GROUP BY 1",
    (DAILY, PRED), ("symbol", "quantile"), ["mape"]))
def _qm(spark, sf):
    return shape(S.quantile_mape(predictions(spark, sf).df, SYM, "actual_close", ["q10", "q90"]), ("symbol", "quantile"), ["mape"])


@query("error_by_age", final(f"SELECT symbol, floor(hours / 24) AS days_since_refit, {_desc.replace('(x', '(e')} FROM (SELECT *, abs(actual_close - mean) AS e FROM pd) AS q GROUP BY 1, 2", (DAILY, PRED), SYM, DESC_D, ["days_since_refit", "n"]))
def _ea(spark, sf):
    df = S.error_columns(predictions(spark, sf).df)
    return shape(S.error_by_age(df, SYM, "absolute_error", "hours"), SYM, DESC_D, ["days_since_refit", "n"])


@query("forecast_quality", final("SELECT symbol, sqrt(avg(power(actual_close - mean, 2))) AS rmse, 1 - avg(power(actual_close - mean, 2)) / var_pop(actual_close) AS r2 FROM pd GROUP BY 1", (DAILY, PRED), SYM, ["rmse", "r2"]))
def _fq(spark, sf):
    return shape(S.forecast_quality(predictions(spark, sf).df, SYM, "actual_close", "mean"), SYM, ["rmse", "r2"])


@query("directional_accuracy", final("SELECT symbol, avg(CASE WHEN sign(actual_close - p) = sign(mean * 1.001 - p) THEN 1.0 ELSE 0.0 END) AS directional_accuracy FROM (SELECT *, lag(actual_close) OVER (PARTITION BY symbol ORDER BY rn) AS p FROM pd) AS q WHERE p IS NOT NULL GROUP BY 1", (DAILY, PRED), SYM, ["directional_accuracy"]))
def _da(spark, sf):
    tl = predictions(spark, sf).extend(up=C("mean") * 1.001)
    return shape(S.directional_accuracy(tl, "actual_close", "up"), SYM, ["directional_accuracy"])


# ------------------------------------------------------------- classification
CLS = f"cl AS MATERIALIZED (SELECT symbol, seq, CAST(sign(close - {lag('close')}) AS INT) AS truth, CASE WHEN volume < 20 THEN -1 WHEN volume < 25 THEN 0 ELSE 1 END AS pred FROM ticks)"


def classified(spark, sf):
    tl = ticks(spark, sf).compute(lambda w: {"truth": F.signum(C("Close") - F.lag("Close").over(w)).cast("int")}, back=1)
    pred = F.when(C("Volume") < 20, -1).when(C("Volume") < 25, 0).otherwise(1)
    return tl.df.withColumn("pred", pred).where(C("truth").isNotNull())


@query("confusion_matrix", final("SELECT symbol, truth, pred, count(*) AS n FROM cl WHERE truth IS NOT NULL GROUP BY 1, 2, 3", (TICKS, CLS), SYM, i=["truth", "pred", "n"]))
def _cm(spark, sf):
    return shape(S.confusion(classified(spark, sf), SYM, "truth", "pred"), SYM, i=["truth", "pred", "n"])


REPORT = """per AS MATERIALIZED (SELECT symbol, c, coalesce(tp / nullif(pre, 0), 0) AS precision, coalesce(tp / nullif(sup, 0), 0) AS recall, coalesce(2 * tp / nullif(sup + pre, 0), 0) AS f1, sup AS support, tp FROM (
  SELECT symbol, c, CAST(count(*) FILTER (truth = c AND pred = c) AS DOUBLE) AS tp, count(*) FILTER (truth = c) AS sup, count(*) FILTER (pred = c) AS pre FROM cl, (SELECT unnest([-1, 0, 1]) AS c) AS k WHERE truth IS NOT NULL GROUP BY 1, 2) AS q)"""
REPQ = """SELECT symbol, CAST(c AS VARCHAR) AS row, precision, recall, f1, support FROM per
 UNION ALL SELECT symbol, 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM per GROUP BY 1
 UNION ALL SELECT symbol, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per GROUP BY 1
 UNION ALL SELECT symbol, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM per GROUP BY 1"""
_M = ["precision", "recall", "f1"]


@query("classification_report", final(REPQ.replace("AS row", "AS row"), (TICKS, CLS, REPORT), ("symbol", '"row"'), _M, ["support"]))
def _cr(spark, sf):
    return shape(S.classification_report(classified(spark, sf), SYM, "truth", "pred"), ("symbol", "row"), _M, ["support"])


@query("flat_report", final(
    " UNION ALL ".join(f"SELECT symbol, replace(replace(\"row\" || '_{m}', ' ', '_'), '-', '_') AS metric, CAST({m} AS DOUBLE) AS value FROM ({REPQ}) AS q" for m in (*_M, "support")),
    (TICKS, CLS, REPORT), ("symbol", "metric"), ["value"]))
def _fr(spark, sf):
    return shape(S.flat_report(S.classification_report(classified(spark, sf), SYM, "truth", "pred"), SYM), ("symbol", "metric"), ["value"])


# ------------------------------------------------------------------- rankings
_rk = "rk AS MATERIALIZED (SELECT symbol, CAST(volume AS BIGINT) AS feature, count(*) + volume / 1000 AS x, avg(close) AS y FROM ticks GROUP BY symbol, volume)"
_rr = "rr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY x DESC) - 1 AS rx, row_number() OVER (PARTITION BY symbol ORDER BY y DESC) - 1 AS ry FROM rk)"


def rankings(spark, sf):
    v = views.ticks(spark, sf).groupBy("symbol", C("Volume").cast("bigint").alias("feature"))
    return v.agg(F.count(F.lit(1)).alias("n"), F.avg("Close").alias("y")).withColumn("x", C("n") + C("feature").cast("double") / 1000)


@query("weighted_tau", final(
    "SELECT symbol, (sum(s * wx) / sum(wx) + sum(s * wy) / sum(wy)) / 2 AS weighted_tau FROM (SELECT a.symbol, sign(a.x - b.x) * sign(a.y - b.y) AS s, 1.0 / (a.rx + 1) + 1.0 / (b.rx + 1) AS wx, 1.0 / (a.ry + 1) + 1.0 / (b.ry + 1) AS wy FROM rr a JOIN rr b ON a.symbol = b.symbol AND a.feature < b.feature) AS q GROUP BY 1",
    (TICKS, _rk, _rr), SYM, ["weighted_tau"]))
def _wt(spark, sf):
    return shape(S.weighted_tau(rankings(spark, sf), SYM, "x", "y"), SYM, ["weighted_tau"])


@query("ensemble_score", final(
    "SELECT feature, 0.5 * percent_rank() OVER (ORDER BY y) + 0.5 * percent_rank() OVER (ORDER BY z) AS score FROM (SELECT CAST(volume AS BIGINT) AS feature, avg(close) AS y, count(*) AS z FROM ticks GROUP BY volume) AS q",
    keys=(), d=["score"], i=["feature"]))
def _es(spark, sf):
    df = views.ticks(spark, sf).groupBy(C("Volume").cast("bigint").alias("feature")).agg(F.avg("Close").alias("y"), F.count(F.lit(1)).alias("z"))
    return shape(S.ensemble_score(df, {"y": 0.5, "z": 0.5}, chunk_rows=64), (), ["score"], ["feature"])


# ----------------------------------------------------------------- volatility
RV = f"""rv AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS rn FROM (SELECT d.symbol, d.bucket, coalesce(t.rv, 0) AS rv FROM (SELECT symbol, unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL 1 DAY)) AS bucket FROM {{src}} GROUP BY 1) AS d
  LEFT JOIN (SELECT symbol, date_trunc('day', ts) AS bucket, coalesce(sum(l * l), 0) AS rv FROM (SELECT symbol, ts, ln(close) - ln({lag('close')}) AS l FROM {{src}}) AS q GROUP BY 1, 2) AS t USING (symbol, bucket)) AS q)"""
BK = ("symbol", "bucket")


@query("realized_variance", final("SELECT * FROM rv", (TICKS, RV.format(src="ticks")), BK, ["rv"]))
def _rv(spark, sf):
    return shape(V.realized_variance(ticks(spark, sf)), BK, ["rv"])


_H = ["rv_daily_lag", "rv_weekly_lag", "rv_monthly_lag", "rv_daily_next"]
HAR = f"SELECT symbol, bucket, rn, rv, l AS rv_daily_lag, {roll('avg', 'l', 5)} AS rv_weekly_lag, {roll('avg', 'l', 22)} AS rv_monthly_lag, {lead('rv')} AS rv_daily_next FROM (SELECT *, {lag('rv')} AS l FROM rv) AS q"


def variance_series(spark, sf):
    rv = V.realized_variance(daily(spark, sf))
    return Timeline.build(rv, SYM, ("bucket",), CHUNK_ROWS)


@query("har_features", final(f"SELECT * FROM ({HAR}) AS h WHERE rv_monthly_lag IS NOT NULL AND rv_daily_next IS NOT NULL", (DAILY, RV.format(src="bars")), BK, _H))
def _har(spark, sf):
    return shape(V.har_table(variance_series(spark, sf)).df.na.drop(subset=_H), BK, _H)


@query("har_backtest")
def _harb(spark, sf):
    return shape(V.har_backtest(variance_series(spark, sf)), BK, ["actual_rv", "forecast_rv"])


# --------------------------------------------------- fractional differencing
_w = D.ffd_weights(0.5, 1e-5)
FFD = f"SELECT symbol, seq, CASE WHEN len(l) = {len(_w)} THEN list_sum(list_transform(list_zip(l, [{', '.join(repr(float(x)) for x in _w[::-1])}]), lambda z: z[1] * z[2])) ELSE 0 END AS close FROM (SELECT *, list(close) {over(len(_w))} AS l FROM ticks) AS q"


@query("frac_diff", final(FFD, d=["close"]))
def _ffd(spark, sf):
    return shape(D.frac_diff(ticks(spark, sf), ["Close"], 0.5, 1e-5), d=["Close"])


@query("minimum_order")
def _mind(spark, sf):
    choice, _tests = D.minimum_order(daily(spark, sf), ["Close", "Volume"], steps=11, thres=1e-5)
    return shape(choice, SYM, ["d"])
