"""Queries: sources, filters, fills, bars."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from tidewheel.catalog import (
    CHUNK_ROWS, DAILY, ONE, PART, SQL, TICKS, C, daily, ema, final, lag, lead, one, over, query, recursion, roll, shape, ticks,
)
from tidewheel.catalog_indicators import BLOCKS, DAY, SIGNED, pct
from tidewheel.operators import bars as B
from tidewheel.operators import fills as P
from tidewheel.operators import indicators as I
from tidewheel.operators import joins as J
from tidewheel.operators import sweeps
from tidewheel.operators import weights as W
from tidewheel.functions import scalar as S
from tidewheel.plans import pipeline
from tidewheel.sources import klines, views
from tidewheel.storage import shared_dir
from tidewheel.timeline import Timeline

OUT = ["open", "high", "low", "close", "volume", "volume_usdt"]
AGG = """arg_max(ts, rn) AS ts, arg_min(open, rn) AS open, max(high) AS high, min(low) AS low, arg_max(close, rn) AS close,
  sum(volume) AS volume, sum(volume_usdt) AS volume_usdt, sum(trade_count) AS trade_count"""


def bar_sql(base_ctes, tab, metric, T, keys="symbol"):
    """Sequential accumulation; a bar number is the count of closes before the row."""
    rec = recursion("e", tab, {"acc": metric, "n": "0", "c": f"CASE WHEN {metric} >= {T} THEN 1 ELSE 0 END"},
                    {"acc": f"CASE WHEN e.c = 1 THEN 0 ELSE e.acc END + {metric}", "n": "e.n + e.c",
                     "c": f"CASE WHEN CASE WHEN e.c = 1 THEN 0 ELSE e.acc END + {metric} >= {T} THEN 1 ELSE 0 END"})
    return (*base_ctes, rec), f"SELECT symbol, CAST(n AS BIGINT) AS bar_id, {AGG}, max(c) AS c FROM {tab} t JOIN e USING (symbol, rn) GROUP BY 1, 2 HAVING max(c) = 1"


BAR_KEYS = ("symbol", "bar_id", "ts")


def bars_query(name, base_ctes, tab, metric, T, run):
    ctes, body = bar_sql(base_ctes, tab, metric, T)

    @query(name, final(body, ctes, BAR_KEYS, OUT, ["trade_count"]))
    def go(spark, sf):
        df = run(spark, sf).withColumnsRenamed({c: c.lower() for c in ("Open", "High", "Low", "Close", "Volume")})
        return shape(df, BAR_KEYS, OUT, ["trade_count"])


bars_query("volume_bars", (ONE,), "ticks", "b.volume", 1000, lambda s, f: B.volume_bars(one(s, f), 1000))
bars_query("volume_bars_by_symbol", (TICKS,), "ticks", "b.volume", 333, lambda s, f: B.volume_bars(ticks(s, f), 333))
bars_query("dollar_bars", (TICKS,), "ticks", "b.volume_usdt", 50000, lambda s, f: B.dollar_bars(ticks(s, f), 50000))
PCT = f"px AS MATERIALIZED (SELECT *, coalesce(abs({pct}), 0) AS mv FROM ticks)"
bars_query("price_change_bars", (TICKS, PCT), "px", "b.mv", 1.7, lambda s, f: B.price_change_bars(ticks(s, f), 1.7))

# fractional metrics over many chunk borders: a last digit decides some closes
_LOTS = "lots AS MATERIALIZED (SELECT * REPLACE (volume * CAST(0.01 AS DOUBLE) AS volume) FROM ticks)"


def small_chunks(spark, sf):
    return replace(ticks(spark, sf), chunk_rows=256)


bars_query("volume_bars_fractional", (TICKS, _LOTS), "lots", "b.volume", 2.5,
           lambda s, f: B.volume_bars(small_chunks(s, f).extend(Volume=C("Volume") * F.lit(0.01)), 2.5))
bars_query("price_change_bars_small", (TICKS, PCT), "px", "b.mv", 0.37, lambda s, f: B.price_change_bars(small_chunks(s, f), 0.37))

_ctes, _ = bar_sql((TICKS,), "ticks", "b.volume", 500)
_ext = """SELECT symbol, CAST(n AS BIGINT) AS bar_id, min(ts) AS open_time, max(ts) AS close_time, arg_min(open, rn) AS open_price, max(high) AS high, min(low) AS low,
  arg_max(close, rn) AS close_price, sum(volume) AS total_volume, CASE WHEN count(r) > 1 THEN stddev_samp(r) ELSE 0 END AS intra_bar_std, arg_max(close, rn) / arg_min(open, rn) - 1 AS bar_return, max(c) AS c
  FROM (SELECT t.*, e.n, e.c, ln(close / lag(close) OVER (PARTITION BY symbol, e.n ORDER BY rn)) AS r FROM ticks t JOIN e USING (symbol, rn)) AS q GROUP BY 1, 2 HAVING max(c) = 1"""
EXT_KEYS = ("symbol", "bar_id", "open_time", "close_time")
_ext_d = ["open_price", "high", "low", "close_price", "total_volume", "intra_bar_std", "bar_return"]


@query("extended_volume_bars", final(_ext, _ctes, EXT_KEYS, _ext_d))
def _ext1(spark, sf):
    return shape(B.extended_volume_bars(ticks(spark, sf), 500), EXT_KEYS, ["open_price", "High", "Low", *_ext_d[3:]])


_ext_close = [c for c in _ext_d if c not in ("high", "low")]


@query("extended_volume_bars_close", final(_ext.replace("arg_min(open", "arg_min(close"), _ctes, EXT_KEYS, _ext_close))
def _ext2(spark, sf):
    return shape(B.extended_volume_bars(ticks(spark, sf), 500, "Close"), EXT_KEYS, _ext_close)


@query("bar_durations", final(
    f"SELECT symbol, bar_id, ts, date_diff('microsecond', {'(lag(ts) OVER (PARTITION BY symbol ORDER BY bar_id))'}, ts) / 3.6e9 AS hours FROM ({bar_sql((TICKS,), 'ticks', 'b.volume', 333)[1]}) AS q",
    bar_sql((TICKS,), "ticks", "b.volume", 333)[0], BAR_KEYS, ["hours"]))
def _dur(spark, sf):
    series = pipeline.bar_series(B.volume_bars(ticks(spark, sf), 333), ("symbol",), CHUNK_ROWS)
    return shape(B.bar_durations(series), BAR_KEYS, ["hours"])


# ------------------------------------------------------------------ tick signs
SIGNS = f"""si AS MATERIALIZED (SELECT *, coalesce(last_value(s0 IGNORE NULLS) OVER ({PART}), 1) AS sg FROM
  (SELECT *, nullif(sign(close - {lag('close')}), 0) AS s0 FROM ticks) AS q)"""


@query("tick_signs", final("SELECT symbol, seq, sg AS sign FROM si", (ONE, SIGNS), i=["sign"]))
def _signs(spark, sf):
    return shape(B.tick_signs(one(spark, sf)), i=["sign"])


ROW_D = ["threshold", "cum_imbalance"]


def _imb(spark, sf, df):
    return shape(df.withColumn("closes", C("closes").cast("int")), ("symbol", "seq"), ROW_D, ["closes"])


def imb_sql(tab, ctes, x, theta):
    cum = f"(CASE WHEN e.c = 1 THEN 0 ELSE e.cum END + {x})"
    hit = lambda v: f"CASE WHEN {theta} > 0 AND abs({v}) >= {theta} THEN 1 ELSE 0 END"
    rec = recursion("e", tab, {"cum": x, "c": hit(x)}, {"cum": cum, "c": hit(cum)})
    return final(f"SELECT symbol, seq, {theta} AS threshold, cum AS cum_imbalance, c AS closes FROM {tab} b JOIN e USING (symbol, rn)", (*ctes, rec), d=ROW_D, i=["closes"])


@query("tick_imbalance_static", imb_sql("si", (ONE, SIGNS), "b.sg", "12"))
def _tib1(spark, sf):
    return _imb(spark, sf, B.tick_imbalance(one(spark, sf), "static", 12))


_w = f"OVER ({PART} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
RUNMED = f"""rm AS MATERIALIZED (SELECT s.*, m.med FROM si s LEFT JOIN (
  SELECT symbol, rn, median(len) AS med FROM (SELECT a.symbol, a.rn, b.blk, count(*) AS len FROM blk a JOIN blk b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 11 AND a.rn
    WHERE a.rn >= 12 GROUP BY 1, 2, 3) AS q GROUP BY 1, 2) m USING (symbol, rn))"""
BLK = f"""blk AS MATERIALIZED (SELECT symbol, rn, sum(CASE WHEN rn = 1 OR sg <> p THEN 1 ELSE 0 END) OVER ({PART}) AS blk FROM (SELECT *, {lag('sg')} AS p FROM si) AS q)"""


@query("tick_imbalance_runs", imb_sql("rm", (TICKS, SIGNS, BLK, RUNMED), "b.sg", "b.med"))
def _tib2(spark, sf):
    return _imb(spark, sf, B.tick_imbalance(ticks(spark, sf), "dynamic_runs", window_run_length=12))


def dyn_rec(x, size0, inside):
    """State: mean sign m, bar mean z, sum cum, closed flag c, size so far k."""
    m = f"CASE WHEN b.rn = 1 THEN b.sg ELSE {ema('e.m', 'b.sg', 20)} END"
    z = f"CASE WHEN e.c = 1 THEN {1 - 2 / 21!r} * e.z + {2 / 21!r} * e.k ELSE e.z END"
    cum, k = f"(CASE WHEN e.c = 1 THEN 0 ELSE e.cum END + {x})", f"(CASE WHEN e.c = 1 THEN 0 ELSE e.k END + {inside})"
    hit = lambda z, m, cum: f"CASE WHEN abs({z} * {m}) > 0 AND abs({cum}) >= abs({z} * {m}) THEN 1 ELSE 0 END"
    return recursion("e", "si", {"m": "b.sg", "z": size0, "cum": x, "k": inside, "c": hit(size0, "b.sg", x)},
                    {"m": m, "z": z, "cum": cum, "k": k, "c": hit(f"({z})", f"({m})", cum)})


def dyn_sql(ctes, x, size0, inside, closed_only=False):
    rec = dyn_rec(x, size0, inside)
    if closed_only:
        return final("SELECT symbol, seq, abs(z * m) AS threshold, cum AS cum_imbalance, k AS size FROM si b JOIN e USING (symbol, rn) WHERE c = 1", (*ctes, rec), d=ROW_D, i=["size"])
    return final("SELECT symbol, seq, abs(z * m) AS threshold, cum AS cum_imbalance, c AS closes FROM si b JOIN e USING (symbol, rn)", (*ctes, rec), d=ROW_D, i=["closes"])


@query("tick_imbalance_dynamic", dyn_sql((ONE, SIGNS), "b.sg", "5", "1"))
def _tib3(spark, sf):
    return _imb(spark, sf, B.tick_imbalance(one(spark, sf), initial_bar_size=5))


@query("volume_imbalance", dyn_sql((TICKS, SIGNS.replace("SELECT *, coalesce", "SELECT *, sum(volume) OVER (PARTITION BY symbol) / 100 AS v0, coalesce")), "b.sg * b.volume", "b.v0", "b.volume"))
def _vib(spark, sf):
    return _imb(spark, sf, B.volume_imbalance(ticks(spark, sf)))


_V0 = SIGNS.replace("SELECT *, coalesce", "SELECT *, sum(volume) OVER (PARTITION BY symbol) / 100 AS v0, coalesce")
_DYN_BARS = """SELECT symbol, max(ts) AS ts, arg_min(open, rn) AS open, max(high) AS high, min(low) AS low, arg_max(close, rn) AS close, sum(volume) AS volume, sum(volume_usdt) AS volume_usdt, min(rn) AS bar_open, sum(trade_count) AS trade_count
FROM (SELECT b.*, e.c, coalesce(sum(e.c) OVER (PARTITION BY b.symbol ORDER BY b.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bar FROM si b JOIN e USING (symbol, rn)) AS q GROUP BY symbol, bar HAVING max(c) = 1"""
_DB = ["open", "high", "low", "close", "volume", "volume_usdt"]


def _dyn_bars(rows):
    return shape(B.imbalance_bars(rows, ("symbol",)), ("symbol", "ts"), ["Open", "High", "Low", "Close", "Volume", "volume_usdt"], ["bar_open", "trade_count"])


@query("tick_imbalance_bars", final(_DYN_BARS, (TICKS, SIGNS, dyn_rec("b.sg", "5", "1")), ("symbol", "ts"), _DB, ["bar_open", "trade_count"]))
def _tibb(spark, sf):
    return _dyn_bars(B.tick_imbalance(ticks(spark, sf), initial_bar_size=5))


@query("volume_imbalance_bars", final(_DYN_BARS, (TICKS, _V0, dyn_rec("b.sg * b.volume", "b.v0", "b.volume")), ("symbol", "ts"), _DB, ["bar_open", "trade_count"]))
def _vibb(spark, sf):
    return _dyn_bars(B.volume_imbalance(ticks(spark, sf)))


# --------------------------------------------------------------- calendar bars
@query("daily_last", final(
    "SELECT d.symbol, d.bucket, t.close FROM (SELECT symbol, unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL 1 DAY)) AS bucket FROM ticks GROUP BY 1) AS d LEFT JOIN (SELECT symbol, date_trunc('day', ts) AS bucket, arg_max(close, rn) AS close FROM ticks GROUP BY 1, 2) AS t USING (symbol, bucket)",
    keys=("symbol", "bucket"), d=["close"]))
def _daily_last(spark, sf):
    return shape(B.daily_last(views.ticks(spark, sf), ["symbol"]), ("symbol", "bucket"), ["Close"])


WEEKS = "SELECT d.symbol, d.bucket, coalesce(t.n, 0) AS n FROM (SELECT symbol, unnest(generate_series(min(date_trunc('week', ts)), max(date_trunc('week', ts)), INTERVAL 7 DAY)) + INTERVAL 6 DAY AS bucket FROM bars GROUP BY 1) AS d LEFT JOIN (SELECT symbol, date_trunc('week', ts) + INTERVAL 6 DAY AS bucket, count(*) AS n FROM bars GROUP BY 1, 2) AS t USING (symbol, bucket)"


@query("weekly_counts", final(WEEKS, (DAILY,), ("symbol", "bucket"), i=["n"]))
def _weekly(spark, sf):
    return shape(B.weekly_count(views.bars_daily(spark, sf), ["symbol"]), ("symbol", "bucket"), i=["n"])


@query("daily_candles", final(
    "SELECT symbol, date_trunc('day', ts) AS bucket, arg_min(open, rn) AS open, max(high) AS high, min(low) AS low, arg_max(close, rn) AS close, sum(volume) AS volume, sum(trade_count) AS trade_count FROM ticks GROUP BY 1, 2",
    keys=("symbol", "bucket"), d=["open", "high", "low", "close", "volume"], i=["trade_count"]))
def _candles(spark, sf):
    at = F.struct("ts", "seq")
    aggs = [F.min_by("Open", at).alias("open"), F.max("High").alias("high"), F.min("Low").alias("low"),
            F.max_by("Close", at).alias("close"), F.sum("Volume").alias("volume"), F.sum("trade_count").alias("trade_count")]
    return shape(B.calendar_bars(views.ticks(spark, sf), ["symbol"], B.day(), aggs), ("symbol", "bucket"),
                 ["open", "high", "low", "close", "volume"], ["trade_count"])


_grid = "g AS MATERIALIZED (SELECT q.symbol || '/' || k AS symbol, q.symbol AS sym, k AS step, m + (x - m) * k / 49.0 AS threshold FROM (SELECT symbol, avg(volume) AS m, 4 * max(volume) AS x FROM ticks GROUP BY 1) AS q, range(50) AS r(k))"
_gt = "gt AS MATERIALIZED (SELECT t.* EXCLUDE (symbol), g.symbol, g.sym, g.step, g.threshold FROM ticks t JOIN g ON t.symbol = g.sym)"
_gctes, _gbody = bar_sql((TICKS, _grid, _gt), "gt", "b.volume", "b.threshold")


@query("threshold_sweep", final(
    f"SELECT g.sym AS s, g.step AS step_no, g.threshold, count(*) AS n_bars, avg(q.volume) AS mean_volume FROM ({_gbody}) AS q JOIN g USING (symbol) GROUP BY 1, 2, 3",
    _gctes, ("s",), ["threshold", "mean_volume"], ["step_no", "n_bars"]))
def _sweep(spark, sf):
    got = B.threshold_sweep(ticks(spark, sf), "Volume", 50).groupBy(C("symbol").alias("s"), C("step").alias("step_no"), "threshold")
    return shape(got.agg(F.count(F.lit(1)).alias("n_bars"), F.avg("Volume").alias("mean_volume")), ("s",), ["threshold", "mean_volume"], ["step_no", "n_bars"])


_RETURNS = f"""SELECT sym AS s, step AS step_no, n_bars, CASE WHEN n >= 20 THEN g1 * sqrt(n * (n - 1)) / (n - 2) END AS skew,
  CASE WHEN n >= 20 THEN (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) END AS kurtosis, CASE WHEN n >= 20 THEN exp(-n / 12 * (g1 * g1 + g2 * g2 / 4)) END AS jb_pvalue
FROM (SELECT symbol, n_bars, CAST(n AS DOUBLE) AS n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2
  FROM (SELECT symbol, count(*) AS n_bars, count(r) AS n, avg(pow(r - a, 2)) AS m2, avg(pow(r - a, 3)) AS m3, avg(pow(r - a, 4)) AS m4
    FROM (SELECT *, avg(r) OVER (PARTITION BY symbol) AS a FROM (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_id) - 1 AS r FROM ({_gbody}) AS z) AS y) AS x GROUP BY 1) AS w) AS v
JOIN g USING (symbol)"""


@query("threshold_statistics", final(_RETURNS, _gctes, ("s",), ["skew", "kurtosis", "jb_pvalue"], ["step_no", "n_bars"]))
def _sweep_stats(spark, sf):
    tl = ticks(spark, sf)
    got = sweeps.sweep_statistics(B.threshold_sweep(tl, "Volume", 50), tl.by, CHUNK_ROWS)
    return shape(got.withColumnsRenamed({"symbol": "s", "step": "step_no"}), ("s",), ["skew", "kurtosis", "jb_pvalue"], ["step_no", "n_bars"])


_g2 = "g AS MATERIALIZED (SELECT q.symbol || '/' || k AS symbol, q.symbol AS sym, k AS param_id, 100.0 * k AS threshold FROM (SELECT DISTINCT symbol FROM ticks) AS q, range(1, 31) AS r(k))"
_s2ctes, _s2body = bar_sql((TICKS, _g2, _gt.replace("g.step", "g.param_id")), "gt", "b.volume", "b.threshold")


@query("parameter_sweep", final(
    f"SELECT g.sym AS s, g.param_id, count(*) AS n_bars, sum(q.volume) AS total FROM ({_s2body}) AS q JOIN g USING (symbol) GROUP BY 1, 2 HAVING count(*) >= 10",
    _s2ctes, ("s",), ["total"], ["param_id", "n_bars"]))
def _psweep(spark, sf):
    grid = spark.range(1, 31).select(C("id").alias("param_id"), (C("id") * 100.0).alias("threshold"))
    got = pipeline.sweep(ticks(spark, sf), grid, "Volume", C("threshold"), 10)
    return shape(got.groupBy(C("symbol").alias("s"), "param_id").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("Volume").alias("total")), ("s",), ["total"], ["param_id", "n_bars"])


# ----------------------------------------------------- filters, fills, columns
@query("dataset_profile", f"WITH {TICKS} SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, CAST(10 AS BIGINT) AS n_columns FROM ticks")
def _profile(spark, sf):
    return klines.profile(views.ticks(spark, sf)).withColumn("n_columns", C("n_columns").cast("bigint"))


@query("time_range", final("SELECT symbol, seq, close FROM ticks WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'", d=["close"]))
def _range(spark, sf):
    return shape(P.time_range(views.ticks(spark, sf), "2024-01-05", "2024-01-20 12:00:00"), d=["Close"])


@query("micro_units", final("SELECT symbol, seq, close / 1000000 AS close FROM ticks", d=["close"]))
def _micro(spark, sf):
    return shape(P.to_micro_units(views.ticks(spark, sf)), d=["Close"])


@query("keep_listed", final("SELECT symbol, seq, close, volume FROM ticks", d=["close", "volume"]))
def _listed(spark, sf):
    df, _missing = P.keep_listed(views.ticks(spark, sf), ["Close", "Volume", "Nothing"], ["symbol", "seq"])
    return shape(df, d=["Close", "Volume"])


@query("drop_constant", "SELECT event_type AS symbol, event_id AS seq, user_id FROM events")
def _const(spark, sf):
    df = views.table(spark, sf, "events").select(C("event_type").alias("symbol"), C("event_id").alias("seq"), "user_id", F.lit(1).alias("same"))
    return P.drop_constant(df, ["symbol", "seq"])


@query("fill_chain", final(
    f"SELECT symbol, seq, coalesce(last_value(x IGNORE NULLS) OVER ({PART}), first_value(x IGNORE NULLS) OVER ({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS filled, coalesce(last_value(x IGNORE NULLS) OVER ({PART}), 0) AS causal FROM (SELECT *, CASE WHEN volume >= 70 THEN close END AS x FROM ticks) AS q",
    (ONE,), d=["filled", "causal"]))
def _fill(spark, sf):
    tl = one(spark, sf).extend(filled=F.when(C("Volume") >= 70, C("Close")).when(C("Volume") == 13, F.lit(float("inf"))))
    tl = tl.extend(causal=C("filled"))
    return shape(P.fill(P.fill(tl, ["filled"]), ["causal"], ("ffill",)), d=["filled", "causal"])


@query("forward_fill_rows", final(f"SELECT symbol, seq, f FROM (SELECT *, last_value(CASE WHEN volume >= 70 THEN close END IGNORE NULLS) OVER ({PART}) AS f FROM ticks) AS q WHERE f IS NOT NULL", d=["f"]))
def _ffill(spark, sf):
    tl = ticks(spark, sf).extend(x=F.when(C("Volume") >= 70, C("Close"))).running(keep=["seq"], f=("last", "x"))
    return shape(tl.df.where(C("f").isNotNull()), d=["f"])


@query("recode_labels", final("SELECT symbol, seq, CASE WHEN s = -1 THEN 0 WHEN s = 0 THEN 1 ELSE 2 END AS code, CASE WHEN volume - 50 > 20 THEN 1 WHEN volume - 50 < -20 THEN -1 ELSE 0 END AS bin FROM (SELECT *, sign(volume - 50) AS s FROM ticks) AS q", i=["code", "bin"]))
def _recode(spark, sf):
    df = views.ticks(spark, sf).withColumn("v", C("Volume") - 50).withColumn("s", F.signum("v").cast("int"))
    return shape(df.withColumn("code", P.recode("s", {-1: 0, 0: 1, 1: 2})).withColumn("bin", P.binarize("v", 20)), i=["code", "bin"])


@query("zoom_filter", final(f"SELECT symbol, seq, p FROM (SELECT *, {pct} AS p FROM ticks) AS q WHERE p BETWEEN -0.1 AND 0.1", d=["p"]))
def _zoom(spark, sf):
    return shape(P.zoom(ticks(spark, sf).apply(I.pct_change(out="p")).df, "p"), d=["p"])


@query("class_weights", final("SELECT symbol, seq, count(*) OVER () / (k * CAST(count(*) OVER (PARTITION BY y) AS DOUBLE)) AS weight FROM (SELECT *, CASE WHEN volume > 80 THEN 1 ELSE 0 END AS y, 2 AS k FROM ticks) AS q", d=["weight"]))
def _cw(spark, sf):
    df = views.ticks(spark, sf).withColumn("y", F.when(C("Volume") > 80, 1).otherwise(0))
    return shape(W.class_weights(df, "y"), d=["weight"])


@query("positive_weight", final("SELECT symbol, count(*) FILTER (volume <= 80) / CAST(count(*) FILTER (volume > 80) AS DOUBLE) AS w FROM ticks GROUP BY 1", keys=("symbol",), d=["w"]))
def _pw(spark, sf):
    y = F.when(C("Volume") > 80, 1).otherwise(0)
    return shape(views.ticks(spark, sf).groupBy("symbol").agg(W.positive_weight(y).alias("w")), ("symbol",), ["w"])


@query("calendar_features", final("SELECT symbol, seq, hour(ts) AS hour, isodow(ts) - 1 AS weekday, month(ts) AS month FROM ticks", i=["hour", "weekday", "month"]))
def _cal(spark, sf):
    return shape(P.calendar_features(views.ticks(spark, sf)), i=["hour", "weekday", "month"])


@query("cap_outliers", final("SELECT t.symbol, t.seq, least(greatest(t.close, lo), hi) AS close FROM ticks t JOIN (SELECT symbol, quantile_disc(close, 0.01) AS lo, quantile_disc(close, 0.99) AS hi FROM ticks GROUP BY 1) AS q USING (symbol)", d=["close"]))
def _cap(spark, sf):
    return shape(P.cap_outliers(views.ticks(spark, sf), ["symbol"], "Close", accuracy=1_000_000), d=["Close"])


@query("scaled_columns", final("SELECT symbol, seq, (close - avg(close) OVER p) / stddev_pop(close) OVER p AS z, (volume - min(volume) OVER p) / (max(volume) OVER p - min(volume) OVER p) AS m FROM ticks WINDOW p AS (PARTITION BY symbol)", d=["z", "m"]))
def _scaled(spark, sf):
    df = views.ticks(spark, sf).withColumn("z", C("Close")).withColumn("m", C("Volume"))
    return shape(P.scale(P.scale(df, ["symbol"], ["z"]), ["symbol"], ["m"], "minmax"), d=["z", "m"])


@query("chronological_split", f"WITH {TICKS} SELECT symbol, seq, CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS two, CASE WHEN rn <= floor(n * 0.5) THEN 'train' WHEN rn <= floor(n * 0.75) THEN 'validation' ELSE 'test' END AS three FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM ticks) AS q")
def _split(spark, sf):
    tl = ticks(spark, sf)
    two = P.head_tail(tl, 0.3).withColumnRenamed("role", "two")
    return P.three_way(tl.with_df(two), 0.5, 0.25).select("symbol", "seq", "two", C("role").alias("three"))


@query("top_rows", f"WITH {TICKS} SELECT symbol, seq, close FROM ticks ORDER BY close DESC, seq LIMIT 10")
def _top(spark, sf):
    df = views.ticks(spark, sf).orderBy(F.desc("Close"), "seq").limit(10)
    return df.select("symbol", "seq", C("Close").alias("close"))


@query("latest_row", final("SELECT symbol, arg_max(seq, rn) AS seq, arg_max(close, rn) AS close FROM ticks GROUP BY 1", d=["close"]))
def _latest(spark, sf):
    return shape(P.latest(views.ticks(spark, sf), ["symbol"], ["ts", "seq"], ["seq", "Close"]), d=["Close"])


@query("metric_names", "SELECT DISTINCT event_type || '_' || 'w1_20' AS name, regexp_replace('f1 [' || event_type || ']% (macro)', '[^a-zA-Z0-9_\\-.\\s:/]', '', 'g') AS clean FROM events")
def _names(spark, sf):
    e = views.table(spark, sf, "events").select("event_type").distinct()
    raw = F.concat(F.lit("f1 ["), C("event_type"), F.lit("]% (macro)"))
    return e.select(F.concat_ws("_", "event_type", S.config_name(w1=F.lit(20))).alias("name"), S.metric_name(raw).alias("clean"))


@query("coverage_chunks", final("SELECT symbol, ceil(count(*) * 0.2 / 64) AS n FROM ticks GROUP BY 1", keys=("symbol",), i=["n"]))
def _cover(spark, sf):
    return shape(views.ticks(spark, sf).groupBy("symbol").agg(S.chunks_for_coverage(F.count(F.lit(1)), 64).alias("n")), ("symbol",), i=["n"])


@query("refit_clock", final("SELECT symbol, seq, (rn - 1) % 24 AS age FROM ticks", i=["age"]))
def _clock(spark, sf):
    return shape(ticks(spark, sf).df.withColumn("age", S.rows_since_refit(C("rn"), 24)), i=["age"])


# --------------------------------------------------------- joins and set operations
PAIR_K = ("k",)
_orders = "SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS a FROM orders"
_lines = "SELECT l_orderkey AS k, CAST(l_extendedprice AS DOUBLE) AS b FROM lineitem"


def pair(spark, sf):
    """Whole tables: orders and their lines; some orders have none."""
    left, right = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    return (left.select(C("o_orderkey").alias("k"), C("o_totalprice").cast("double").alias("a")),
            right.select(C("l_orderkey").alias("k"), C("l_extendedprice").cast("double").alias("b")))


@query("inner_join", final(f"SELECT k, a, b FROM ({_orders}) x JOIN ({_lines}) y USING (k)", keys=PAIR_K, d=["a", "b"]))
def _inner(spark, sf):
    return shape(J.inner_on(*pair(spark, sf), PAIR_K), PAIR_K, ["a", "b"])


@query("left_join", final(f"SELECT k, a, b FROM ({_orders}) x LEFT JOIN ({_lines}) y USING (k)", keys=PAIR_K, d=["a", "b"]))
def _left(spark, sf):
    return shape(J.left_on(*pair(spark, sf), PAIR_K), PAIR_K, ["a", "b"])


@query("outer_join", final(f"SELECT k, a, b FROM ({_orders}) x FULL JOIN ({_lines}) y USING (k)", keys=PAIR_K, d=["a", "b"]))
def _outer(spark, sf):
    return shape(J.outer_on(*pair(spark, sf), PAIR_K), PAIR_K, ["a", "b"])


@query("semi_join", final(f"SELECT k, a FROM ({_orders}) x SEMI JOIN ({_lines}) y USING (k)", keys=PAIR_K, d=["a"]))
def _semi(spark, sf):
    return shape(J.semi_on(*pair(spark, sf), PAIR_K), PAIR_K, ["a"])


@query("anti_join", final(f"SELECT k, a FROM ({_orders}) x ANTI JOIN ({_lines}) y USING (k)", keys=PAIR_K, d=["a"]))
def _anti(spark, sf):
    return shape(J.anti_on(*pair(spark, sf), PAIR_K), PAIR_K, ["a"])


def key_sets(spark, sf):
    a, b = pair(spark, sf)
    return a.select("k"), b.select("k")


_ks = f"SELECT k FROM ({_orders}) x {{op}} SELECT k FROM ({_lines}) y"


@query("union_all", _ks.format(op="UNION ALL"))
def _ua(spark, sf):
    a, b = key_sets(spark, sf)
    return a.unionByName(b)


@query("union_distinct", _ks.format(op="UNION"))
def _ud(spark, sf):
    a, b = key_sets(spark, sf)
    return a.unionByName(b).distinct()


@query("intersect", _ks.format(op="INTERSECT"))
def _is(spark, sf):
    a, b = key_sets(spark, sf)
    return a.intersect(b)


@query("except", _ks.format(op="EXCEPT"))
def _ex(spark, sf):
    a, b = key_sets(spark, sf)
    return a.subtract(b)


TRADES = "tr AS MATERIALIZED (SELECT user_id AS k, ts, event_id AS trade_id FROM events)"
VIEW = "vw AS MATERIALIZED (SELECT e.user_id AS k, t.* FROM ticks t JOIN events e ON e.event_id = t.seq)"


def asof_pair(spark, sf):
    """Every trade beside the ticks of its user."""
    left = views.trades(spark, sf).withColumnRenamed("user", "k")
    users = views.table(spark, sf, "events").select(C("event_id").alias("seq"), C("user_id").cast("string").alias("k"))
    right = views.ticks(spark, sf).join(users, "seq").select("k", "ts", "seq", C("Close").alias("last_close"), C("seq").alias("tick"))
    return left, right


def _asof(name, sql_op, **kw):
    order = "ASC" if kw.get("direction") == "forward" else "DESC"
    sql = final(f"SELECT trade_id, last_close, tick FROM (SELECT t.trade_id, (SELECT v.close FROM vw v WHERE v.k = t.k AND v.ts {sql_op} t.ts ORDER BY v.ts {order}, v.seq {order} LIMIT 1) AS last_close, (SELECT v.seq FROM vw v WHERE v.k = t.k AND v.ts {sql_op} t.ts ORDER BY v.ts {order}, v.seq {order} LIMIT 1) AS tick FROM tr t) AS q",
                (TICKS, VIEW, TRADES), ("trade_id",), ["last_close"], ["tick"])

    @query(name, sql)
    def run(spark, sf):
        left, right = asof_pair(spark, sf)
        got = J.asof_join(left, right, ("k",), right_cols=["last_close", "tick"], right_tie=["seq"], chunk_rows=CHUNK_ROWS, **kw)
        return shape(got, ("trade_id",), ["last_close"], ["tick"])


@query("overlap_anti_join", f"WITH {TICKS} SELECT t.symbol, t.seq FROM ticks t WHERE NOT EXISTS (SELECT 1 FROM ticks r WHERE r.symbol = t.symbol AND r.volume > 97 AND r.ts - INTERVAL 30 MINUTE <= t.ts + INTERVAL 1 HOUR AND r.ts + INTERVAL 2 HOUR >= t.ts)")
def _oaj(spark, sf):
    t = views.ticks(spark, sf)
    rows = t.select("symbol", "seq", "ts", (C("ts") + F.expr("interval 1 hour")).alias("t1"))
    ranges = t.where(C("Volume") > 97).select("symbol", (C("ts") - F.expr("interval 30 minutes")).alias("lo"), (C("ts") + F.expr("interval 2 hours")).alias("hi"))
    return J.filter_by_overlap(rows, ranges, chunk_rows=CHUNK_ROWS).select("symbol", "seq")


_asof("asof_backward", "<=")
_asof("asof_backward_strict", "<", strict=True)
_asof("asof_forward", ">=", direction="forward")
_asof("asof_forward_strict", ">", direction="forward", strict=True)


@query("transaction_log", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 100 + value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity, floor((100 + value) * CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1e6 + 0.50037) / 1e6 AS value, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS strategy FROM events")
def _tlog(spark, sf):
    from tidewheel.catalog import six_places

    t = views.trades(spark, sf).withColumn("timestamp", F.unix_millis(C("ts").cast("timestamp"))).withColumn("value", six_places(C("price") * C("quantity")))
    return klines.transaction_rows(t)


# ------------------------------------------------------------------ files
def kline_files(spark, sf) -> str:
    """Ticks as compressed candle archives without a header: times in milliseconds or microseconds, one line in a hundred broken."""
    us = F.unix_micros(C("ts").cast("timestamp"))
    unix = F.when(C("seq") % 2 == 1, us).otherwise(F.call_function("div", us, F.lit(1000)))
    good = F.concat_ws(",", unix, "Open", "High", "Low", "Close", "Volume", unix, "volume_usdt", "trade_count", F.lit(0), F.lit(0), F.lit(0))
    folder = f"{shared_dir(spark)}/klines-{uuid.uuid4().hex}"
    lines = views.ticks(spark, sf).select(F.when(C("seq") % 100 == 7, "broken,line").otherwise(good).alias("value"))
    lines.repartition(8).write.option("compression", "gzip").text(folder)
    return folder


_KLINES = """kl AS MATERIALIZED (SELECT 'ALL' AS symbol, CASE WHEN seq % 2 = 1 THEN ts ELSE date_trunc('millisecond', ts) END AS ts, CASE WHEN seq % 2 = 1 THEN epoch_us(ts) ELSE epoch_us(ts) // 1000 END AS unix,
  open, high, low, close, volume, volume_usdt, trade_count FROM ticks WHERE seq % 100 <> 7)"""
_KD, _KI = ["open", "high", "low", "close", "volume", "volume_usdt"], ["unix", "trade_count"]


@query("klines_read", final("SELECT * FROM kl", (TICKS, _KLINES), ("symbol", "ts"), _KD, _KI))
def _kread(spark, sf):
    got = klines.read_klines(spark, kline_files(spark, sf), "ALL").withColumnRenamed("seq", "unix")
    return shape(got, ("symbol", "ts"), ["Open", "High", "Low", "Close", "Volume", "volume_usdt"], _KI)


@query("kline_quality", f"WITH {TICKS} SELECT CAST(count(*) FILTER (seq % 100 <> 7) AS BIGINT) AS n_good, CAST(count(*) FILTER (seq % 100 = 7) AS BIGINT) AS n_bad FROM ticks")
def _kq(spark, sf):
    return klines.kline_quality(spark, kline_files(spark, sf)).agg(*(F.sum(c).alias(c) for c in ("n_good", "n_bad")))


@query("klines_consolidated", final("SELECT symbol, date_trunc('day', ts) AS day, count(*) AS n_rows, count(DISTINCT ts) AS n_times, sum(volume) AS volume FROM kl WHERE ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM kl) GROUP BY 1, 2", (TICKS, _KLINES), ("symbol", "day"), ["volume"], ["n_rows", "n_times"]))
def _kcons(spark, sf):
    """Archives to one table partitioned by day, read back from its second day on."""
    out = f"{shared_dir(spark)}/candles-{uuid.uuid4().hex}"
    klines.consolidate(spark, kline_files(spark, sf), out, "ALL")
    first = spark.read.parquet(out).agg(F.date_trunc("day", F.min("ts")) + F.expr("interval 1 day")).head()[0]
    rows = klines.read_candles(spark, out, start=str(first), fmt="parquet")
    by_day = rows.groupBy("symbol", F.date_trunc("day", C("ts")).cast("timestamp_ntz").alias("day"))
    return shape(by_day.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ts").alias("n_times"), F.sum("Volume").alias("volume")), ("symbol", "day"), ["volume"], ["n_rows", "n_times"])
