"""Queries: indicators, features and signals."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewheel.catalog import (
    CHUNK_ROWS, DAILY, ONE, PART, TICKS, C, daily, ema, final, lag, lead, nz, one, over, query, recursion, roll, shape, ticks,
)
from tidewheel.functions import scalar, sequences
from tidewheel.operators import features as X
from tidewheel.operators import fills as P
from tidewheel.operators import indicators as I
from tidewheel.operators import recursive as E
from tidewheel.operators import signals as G
from tidewheel.operators.joins import asof_join
from tidewheel.sources import views
from tidewheel.timeline import Recipe

DAY = ("symbol", "ts")


def simple(name, recipes, d, body, on="daily", i=()):
    """Register a recipe query with its SQL select list over the same rows."""
    src, cte, keys, tab = (daily, DAILY, DAY, "bars") if on == "daily" else (ticks, TICKS, ("symbol", "seq"), "ticks")
    sql = final(f"SELECT {', '.join(keys)}, {body} FROM {tab}", (cte,), keys, d, i)

    @query(name, sql)
    def run(spark, sf):
        return shape(src(spark, sf).apply(*recipes()), keys, d, i)


pct = f"(close / {lag('close')} - 1)"
simple("pct_change", lambda: [I.pct_change(), I.pct_change("Close", 3, "pct_3")], ["pct_change", "pct_3"],
       f"{pct} AS pct_change, close / {lag('close', 3)} - 1 AS pct_3", "ticks")
simple("price_difference", lambda: [I.price_difference()], ["price_difference"], f"coalesce({pct}, 0) AS price_difference", "ticks")
simple("sma", lambda: [I.sma("Close", 20, "sma")], ["sma"], f"{roll('avg', 'close', 20)} AS sma", "ticks")
simple("rolling_std", lambda: [I.rolling_std("Close", 20, "std"), I.rolling_sum("Volume", 10, "vsum")], ["std", "vsum"],
       f"{roll('stddev_samp', 'close', 20)} AS std, {roll('sum', 'volume', 10)} AS vsum", "ticks")
simple("momentum", lambda: [I.momentum()], ["momentum"], f"close - {lag('close', 10)} AS momentum", "ticks")
simple("roc", lambda: [I.roc()], ["roc"], f"(close - {lag('close', 10)}) / {lag('close', 10)} * 100 AS roc", "ticks")
simple("zscore", lambda: [I.rolling_z_score()], ["zscore"],
       f"(close - {roll('avg', 'close', 20)}) / {nz(roll('stddev_pop', 'close', 20))} AS zscore", "ticks")
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
simple("true_range", lambda: [I.true_range()], ["true_range"], f"{TR} AS true_range")
simple("awesome_oscillator", lambda: [I.awesome_oscillator()], ["ao"],
       f"{roll('avg', '((high+low)/2)', 5)} - {roll('avg', '((high+low)/2)', 34)} AS ao")
simple("williams_r", lambda: [I.williams_r()], ["willr"],
       f"-100 * ({roll('max', 'high', 14)} - close) / {nz(roll('max', 'high', 14) + ' - ' + roll('min', 'low', 14))} AS willr")
simple("donchian", lambda: [I.donchian()], ["dc_upper", "dc_lower"],
       f"{roll('max', 'high', 20)} AS dc_upper, {roll('min', 'low', 20)} AS dc_lower")
simple("volume_oscillator", lambda: [I.volume_oscillator()], ["vo"],
       f"100 * ({roll('avg', 'volume', 14)} - {roll('avg', 'volume', 28)}) / {nz(roll('avg', 'volume', 28))} AS vo")
MFM = f"(((close - low) - (high - close)) / {nz('high - low')} * volume)"
simple("chaikin_money_flow", lambda: [I.chaikin_money_flow()], ["cmf"],
       f"{roll('sum', MFM, 20)} / {nz(roll('sum', 'volume', 20))} AS cmf")
simple("stochastic_series", lambda: [I.stochastic_series("Close", 14, "stoch")], ["stoch"],
       f"100 * (close - {roll('min', 'close', 14)}) / {nz(roll('max', 'close', 14) + ' - ' + roll('min', 'close', 14))} AS stoch", "ticks")


def staged(name, recipes, d, inner, outer, on="daily", i=()):
    """Like ``simple`` with helper columns computed first."""
    src, cte, keys, tab = (daily, DAILY, DAY, "bars") if on == "daily" else (ticks, TICKS, ("symbol", "seq"), "ticks")
    body = f"SELECT {', '.join(keys)}, {outer} FROM (SELECT *, {inner} FROM {tab}) AS s"
    sql = final(body, (cte,), keys, d, i)

    @query(name, sql)
    def run(spark, sf):
        return shape(src(spark, sf).apply(*recipes()), keys, d, i)


staged("bollinger", lambda: [I.bollinger()], ["bbp", "bb_upper", "bb_lower"],
       f"{roll('avg', 'close', 20)} + 2 * {roll('stddev_samp', 'close', 20)} AS bb_upper, {roll('avg', 'close', 20)} - 2 * {roll('stddev_samp', 'close', 20)} AS bb_lower",
       f"(close - bb_lower) / {nz('bb_upper - bb_lower')} AS bbp, bb_upper, bb_lower", "ticks")
staged("stochastic", lambda: [I.stochastic()], ["stoch_k", "stoch_d"],
       f"100 * ((close - {roll('min', 'low', 14)}) / {nz(roll('max', 'high', 14) + ' - ' + roll('min', 'low', 14))}) AS k",
       f"k AS stoch_k, {roll('avg', 'k', 3)} AS stoch_d")
staged("rsi", lambda: [I.rsi()], ["rsi"],
       f"CASE WHEN close > {lag('close')} THEN close - {lag('close')} ELSE 0 END AS g, CASE WHEN close < {lag('close')} THEN {lag('close')} - close ELSE 0 END AS l",
       f"CASE WHEN {roll('avg', 'l', 14)} = 0 AND {roll('avg', 'g', 14)} > 0 THEN 100 ELSE 100 - 100 / (1 + {roll('avg', 'g', 14)} / nullif({roll('avg', 'l', 14)}, 0)) END AS rsi", "ticks")
TP = "((high + low + close) / 3)"
staged("money_flow_index", lambda: [I.money_flow_index()], ["mfi"],
       f"CASE WHEN {TP} > {lag(TP)} THEN {TP} * volume ELSE 0 END AS p, CASE WHEN {TP} < {lag(TP)} THEN {TP} * volume ELSE 0 END AS m",
       f"CASE WHEN sum(m) {over(14)} = 0 AND sum(p) {over(14)} <> 0 THEN 100 ELSE 100 - 100 / (1 + sum(p) {over(14)} / nullif(sum(m) {over(14)}, 0)) END AS mfi")
staged("ultimate_oscillator", lambda: [I.ultimate_oscillator()], ["uo"],
       f"close - least(low, coalesce({lag('close')}, close)) AS bp, {TR} AS tr",
       "100 * (4 * {0} + 2 * {1} + {2}) / 7 AS uo".format(*(f"({roll('sum', 'bp', n)} / {nz(roll('sum', 'tr', n))})" for n in (7, 14, 28))))
staged("vortex", lambda: [I.vortex()], ["vi_plus", "vi_minus"],
       f"abs(high - {lag('low')}) AS vp, abs(low - {lag('high')}) AS vm, {TR} AS tr",
       f"{roll('sum', 'vp', 14)} / {nz(roll('sum', 'tr', 14))} AS vi_plus, {roll('sum', 'vm', 14)} / {nz(roll('sum', 'tr', 14))} AS vi_minus")
staged("cci", lambda: [I.cci()], ["cci"],
       f"{TP} AS tp, list({TP}) {over(20)} AS l, {roll('avg', TP, 20)} AS m",
       f"CASE WHEN m IS NOT NULL THEN (tp - m) / {nz('0.015 * list_sum(list_transform(l, lambda x: abs(x - m))) / 20')} END AS cci")
staged("aroon", lambda: [I.aroon()], ["aroon_up", "aroon_down"],
       f"list(high) {over(14)} AS lh, list(low) {over(14)} AS ll",
       "CASE WHEN len(lh) = 14 THEN 100.0 * list_position(lh, list_max(lh)) / 14 END AS aroon_up, CASE WHEN len(ll) = 14 THEN 100.0 * list_position(ll, list_min(ll)) / 14 END AS aroon_down")

_lags = [(c, k) for k in range(1, 6) for c in ("open", "high", "low", "close")]
staged("lag_block", lambda: [I.lag_block()], [f"{c}_pct_lag_{k}" for c, k in _lags],
       ", ".join(f"coalesce({c} / {lag(c)} - 1, 0) AS p_{c}" for c in ("open", "high", "low", "close")),
       ", ".join(f"{lag('p_' + c, k)} AS {c}_pct_lag_{k}" for c, k in _lags))
staged("return_stats", lambda: [I.return_stats()], ["returns_roll_sum", "returns_roll_mean", "returns_roll_std", "returns_z_score"],
       f"coalesce({pct}, 0) AS r",
       f"{roll('sum', 'r', 20)} AS returns_roll_sum, {roll('avg', 'r', 20)} AS returns_roll_mean, {roll('stddev_samp', 'r', 20)} AS returns_roll_std, (r - {roll('avg', 'r', 20)}) / {nz(roll('stddev_pop', 'r', 20))} AS returns_z_score")

# ---------------------------------------------------------- exponential family
EWM_ONE = recursion("e", "ticks", {"v": "b.close"}, {"v": ema("e.v", "b.close", 20)})


_GAPPED = "gapped AS (SELECT *, CASE WHEN (rn - 1) % 5000 < 3000 THEN close END AS x FROM ticks)"


def _gap_mean(name: str, base: str, x: str, span: int) -> str:
    """An exponential mean whose old weight shrinks over every row without a value."""
    a = 2.0 / (span + 1.0)
    return recursion(
        name, base, {"v": f"b.{x}", "w": "1"},
        {"v": f"CASE WHEN b.{x} IS NULL THEN e.v WHEN e.v IS NULL THEN b.{x} ELSE (e.w * {1 - a!r} * e.v + {a!r} * b.{x}) / (e.w * {1 - a!r} + {a!r}) END",
         "w": f"CASE WHEN b.{x} IS NULL THEN e.w * {1 - a!r} ELSE 1.0 END"})


@query("ewm_long_gap", final(
    "SELECT t.symbol, t.seq, m.v AS ewm_small, m.v AS ewm_large, l.x AS macd, g.v AS macd_signal FROM gapped t JOIN m USING (symbol, rn) JOIN l USING (symbol, rn) JOIN g USING (symbol, rn)",
    (ONE, _GAPPED, _gap_mean("m", "gapped", "x", 20), _gap_mean("f", "gapped", "x", 12), _gap_mean("s", "gapped", "x", 26),
     "l AS MATERIALIZED (SELECT symbol, rn, f.v - s.v AS x FROM f JOIN s USING (symbol, rn))", _gap_mean("g", "l", "x", 9)),
    d=["ewm_small", "ewm_large", "macd", "macd_signal"]))
def _gap(spark, sf):
    """Runs of 2000 rows without a value, in chunks shorter and longer than the runs."""
    tl = one(spark, sf)
    tl = tl.extend(x=F.when((C("rn") - 1) % 5000 < 3000, C("Close"))).narrow("seq", "x")
    small = E.ewm(replace(tl, chunk_rows=256), "x", {"ewm_small": 20}, keep=["seq", "x"])
    large = E.ewm(tl, "x", {"ewm_large": 20}, keep=["seq"])
    both = E.macd(small, "x", out=("macd", "macd_signal", "hist"), keep=["seq", "ewm_small"])
    return shape(both.df.join(large.df.drop("seq"), ["symbol", "rn"]), d=["ewm_small", "ewm_large", "macd", "macd_signal"])


@query("ewm", final("SELECT t.symbol, t.seq, e.v AS ewm FROM ticks t JOIN e USING (symbol, rn)", (ONE, EWM_ONE), d=["ewm"]))
def _ewm(spark, sf):
    return shape(E.ewm(one(spark, sf), "Close", {"ewm": 20}), d=["ewm"])


_mac = {"f": ("b.close", ema("e.f", "b.close", 12)), "s": ("b.close", ema("e.s", "b.close", 26))}
_line = f"({_mac['f'][1]} - {_mac['s'][1]})"
MACD = recursion("e", "{0}", {"f": "b.close", "s": "b.close", "g": "0"},
                 {"f": _mac["f"][1], "s": _mac["s"][1], "g": ema("e.g", _line, 9)})


@query("macd", final("SELECT t.symbol, t.seq, f - s AS macd, g AS macd_signal, f - s - g AS macd_hist FROM ticks t JOIN e USING (symbol, rn)",
                     (TICKS, MACD.replace("{0}", "ticks")), d=["macd", "macd_signal", "macd_hist"]))
def _macd(spark, sf):
    return shape(E.macd(ticks(spark, sf)), d=["macd", "macd_signal", "macd_hist"])


# inputs of the smoothed indicators as a table of their own
SMOOTH = f"""sm AS MATERIALIZED (SELECT *, {TR} AS tr,
  CASE WHEN high - {lag('high')} > {lag('low')} - low AND high - {lag('high')} > 0 THEN high - {lag('high')} ELSE 0 END AS pdm,
  CASE WHEN {lag('low')} - low > high - {lag('high')} AND {lag('low')} - low > 0 THEN {lag('low')} - low ELSE 0 END AS mdm,
  close - {lag('close')} AS pc FROM bars)"""

ATR = recursion("e", "sm", {"a": "b.tr"}, {"a": ema("e.a", "b.tr", 27)})


@query("atr", final("SELECT t.symbol, t.ts, e.a AS atr FROM sm t JOIN e USING (symbol, rn)", (DAILY, SMOOTH, ATR), DAY, ["atr"]))
def _atr(spark, sf):
    return shape(E.atr(daily(spark, sf)), DAY, ["atr"])


_c = lambda first, step: f"CASE WHEN b.rn = 2 THEN {first} ELSE {step} END"
_n1 = _c("b.pc", ema("e.n1", "b.pc", 13))
_n2 = _c("b.pc", ema("e.n2", f"({_n1})", 25))
_d1 = _c("abs(b.pc)", ema("e.d1", "abs(b.pc)", 13))
_d2 = _c("abs(b.pc)", ema("e.d2", f"({_d1})", 25))
_t = f"(100 * ({_n2}) / {nz(_d2)})"
TSI = recursion("e", "sm", {"n1": "NULL", "n2": "NULL", "d1": "NULL", "d2": "NULL", "t": "NULL", "g": "NULL"},
                {"n1": _n1, "n2": _n2, "d1": _d1, "d2": _d2, "t": _t, "g": _c(_t, ema("e.g", _t, 13))})


@query("true_strength_index", final("SELECT b.symbol, b.ts, e.t AS tsi, e.g AS tsi_signal FROM sm b JOIN e USING (symbol, rn)", (DAILY, SMOOTH, TSI), DAY, ["tsi", "tsi_signal"]))
def _tsi(spark, sf):
    return shape(E.true_strength_index(daily(spark, sf)), DAY, ["tsi", "tsi_signal"])


_a, _p, _m = ema("e.a", "b.tr", 27), ema("e.p", "b.pdm", 27), ema("e.m", "b.mdm", 27)
_dx = lambda a, p, m: f"(100 * abs(100*{p}/{nz(a)} - 100*{m}/{nz(a)}) / {nz(f'100*{p}/{nz(a)} + 100*{m}/{nz(a)}')})"
ADX = recursion("e", "sm", {"a": "b.tr", "p": "b.pdm", "m": "b.mdm", "x": _dx("b.tr", "b.pdm", "b.mdm")},
                {"a": _a, "p": _p, "m": _m, "x": ema("e.x", _dx(_a, _p, _m), 27)})


@query("adx", final(f"SELECT b.symbol, b.ts, e.x AS adx, 100*e.p/{nz('e.a')} AS dmp, 100*e.m/{nz('e.a')} AS dmn FROM sm b JOIN e USING (symbol, rn)", (DAILY, SMOOTH, ADX), DAY, ["adx", "dmp", "dmn"]))
def _adx(spark, sf):
    return shape(E.adx(daily(spark, sf)), DAY, ["adx", "dmp", "dmn"])


KELT = recursion("e", "sm", {"a": "b.tr", "m": "b.close"}, {"a": ema("e.a", "b.tr", 39), "m": ema("e.m", "b.close", 20)})


@query("keltner", final("SELECT b.symbol, b.ts, e.m + 2*e.a AS kc_upper, e.m - 2*e.a AS kc_lower FROM sm b JOIN e USING (symbol, rn)", (DAILY, SMOOTH, KELT), DAY, ["kc_upper", "kc_lower"]))
def _kelt(spark, sf):
    return shape(E.keltner(daily(spark, sf)), DAY, ["kc_upper", "kc_lower"])


# Schaff cycle: two recursions over materialised stages
def _st(x, tab):
    return f"(100 * ({x} - {roll('min', x, 10)}) / {nz(roll('max', x, 10) + ' - ' + roll('min', x, 10))})"


STC = (
    recursion("e1", "bars", {"f": "b.close", "s": "b.close"}, {"f": ema("e.f", "b.close", 23), "s": ema("e.s", "b.close", 50)}).replace("e1 e JOIN", "e1 e JOIN"),
    f"k1 AS MATERIALIZED (SELECT symbol, rn, {_st('l', 'e1')} AS k FROM (SELECT symbol, rn, f - s AS l FROM e1) AS q)",
    recursion("e2", "k1", {"d": "NULL"}, {"d": f"CASE WHEN e.d IS NULL THEN b.k ELSE {ema('e.d', 'b.k', 3)} END"}),
    f"k2 AS MATERIALIZED (SELECT symbol, rn, {_st('d', 'e2')} AS k FROM e2)",
    recursion("e3", "k2", {"d": "NULL"}, {"d": f"CASE WHEN e.d IS NULL THEN b.k ELSE {ema('e.d', 'b.k', 3)} END"}),
)


@query("schaff_trend_cycle", final("SELECT b.symbol, b.ts, e3.d AS stc, k2.k AS stc_stoch FROM bars b JOIN e3 USING (symbol, rn) JOIN k2 USING (symbol, rn)", (DAILY, *STC), DAY, ["stc", "stc_stoch"]))
def _stc(spark, sf):
    return shape(E.schaff_trend_cycle(daily(spark, sf)), DAY, ["stc", "stc_stoch"])


_er = f"abs(close - {lag('close', 10)}) / {nz(roll('sum', 'mv', 10))}"
KAMA_IN = f"""ki AS MATERIALIZED (SELECT *, power({_er} * (2.0/3 - 2.0/31) + 2.0/31, 2) AS sc FROM
  (SELECT *, abs(close - {lag('close')}) AS mv FROM ticks) AS q)"""
KAMA = recursion("e", "ki", {"k": "NULL"}, {"k": "CASE WHEN b.rn < 10 THEN NULL WHEN b.rn = 10 THEN b.close WHEN b.sc IS NULL THEN e.k ELSE e.k + b.sc * (b.close - e.k) END"})


@query("kama", final("SELECT b.symbol, b.seq, e.k AS kama FROM ki b JOIN e USING (symbol, rn)", (TICKS, KAMA_IN, KAMA), d=["kama"]))
def _kama(spark, sf):
    return shape(E.kama(ticks(spark, sf)), d=["kama"])


KALMAN = recursion("e", "ticks", {"k": "0.5", "m": "0.5 * b.close"},
                   {"k": "(e.k + 1) / (e.k + 2)", "m": "e.m + (e.k + 1) / (e.k + 2) * (b.close - e.m)"})


@query("kalman_level", final("SELECT b.symbol, b.seq, e.m AS kalman FROM ticks b JOIN e USING (symbol, rn)", (TICKS, KALMAN), d=["kalman"]))
def _kalman(spark, sf):
    return shape(E.kalman_level(ticks(spark, sf)), d=["kalman"])


@query("volume_price_trend", final(
    f"SELECT symbol, seq, CASE WHEN x IS NOT NULL THEN sum(x) OVER ({PART}) END AS vpt FROM (SELECT *, volume * {pct} AS x FROM ticks) AS s", (ONE,), d=["vpt"]))
def _vpt(spark, sf):
    return shape(E.volume_price_trend(one(spark, sf)), d=["vpt"])


_spans = (10, 15, 20, 30, 40, 50, 60)
ABOVE = recursion("e", "ticks", {f"m{s}": "b.close" for s in _spans}, {f"m{s}": ema(f"e.m{s}", "b.close", s) for s in _spans})


@query("above_ema", final("SELECT b.symbol, b.seq, " + ", ".join(f"CASE WHEN b.close > e.m{s} THEN 1 ELSE 0 END AS above_ema_{s}" for s in _spans) + " FROM ticks b JOIN e USING (symbol, rn)",
                          (TICKS, ABOVE), i=[f"above_ema_{s}" for s in _spans]))
def _above(spark, sf):
    tl = E.ewm(ticks(spark, sf), "Close", {f"m{s}": float(s) for s in _spans})
    tl = tl.extend(**{f"above_ema_{s}": F.when(C("Close") > C(f"m{s}"), 1).otherwise(0) for s in _spans})
    return shape(tl, i=[f"above_ema_{s}" for s in _spans])


# sign of the change with zeros carrying the sign, and the block it belongs to
SIGNED = f"""sg AS MATERIALIZED (SELECT *, coalesce(last_value(s0 IGNORE NULLS) OVER ({PART}), 0) AS s FROM
  (SELECT *, nullif(sign(close - {lag('close')}), 0) AS s0 FROM ticks) AS q)"""
BLOCKS = f"""bl AS MATERIALIZED (SELECT *, sum(CASE WHEN rn = 1 OR s <> ps THEN 1 ELSE 0 END) OVER ({PART}) AS blk FROM
  (SELECT *, {lag('s')} AS ps FROM sg) AS q)"""


@query("run", final("SELECT symbol, seq, s * row_number() OVER (PARTITION BY symbol, blk ORDER BY rn) AS run FROM bl", (ONE, SIGNED, BLOCKS), i=["run"]))
def _run(spark, sf):
    tl = one(spark, sf).apply(I.pct_change("Close", 1, "pc", 0.0))
    return shape(X.run_length(tl, "pc"), i=["run"])


# ------------------------------------------------------------- feature tables
_CF = ["rsi", "momentum", "volatility", "lagged_return", "sma_ratio", "bb_width"]
_cf_rows = f"""SELECT symbol, seq, rn, CASE WHEN {roll('avg', 'l', 14)} = 0 AND {roll('avg', 'g', 14)} > 0 THEN 100 ELSE 100 - 100 / (1 + {roll('avg', 'g', 14)} / nullif({roll('avg', 'l', 14)}, 0)) END AS rsi,
  close - {lag('close', 10)} AS momentum, {roll('stddev_samp', 'close', 20)} AS volatility, {pct} AS lagged_return,
  {roll('avg', 'close', 20)} / {roll('avg', 'close', 50)} AS sma_ratio, 4 * {roll('stddev_samp', 'close', 20)} / {roll('avg', 'close', 20)} AS bb_width
  FROM (SELECT *, CASE WHEN close > {lag('close')} THEN close - {lag('close')} ELSE 0 END AS g, CASE WHEN close < {lag('close')} THEN {lag('close')} - close ELSE 0 END AS l FROM ticks) AS q"""
_NEXT = f"OVER ({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("small_features", final(f"SELECT symbol, seq, " + ", ".join(f"coalesce(first_value({c} IGNORE NULLS) {_NEXT}, last_value({c} IGNORE NULLS) OVER ({PART})) AS {c}" for c in _CF) + f" FROM ({_cf_rows}) AS r", d=_CF))
def _small(spark, sf):
    return shape(X.small_features(ticks(spark, sf)), d=_CF)


_AN = [f"{p}_pct_change_lag_{k}" for p in ("price", "volume") for k in range(1, 8)]
_an_rows = f"""SELECT *, {roll('stddev_samp', 'price_pct_change_lag_1', 20)} AS volatility, max(close) OVER ({PART}) AS max_close FROM
  (SELECT symbol, ts, rn, close, {', '.join(f"{x} / {lag(x, k)} - 1 AS {p}_pct_change_lag_{k}" for p, x in (('price', 'close'), ('volume', 'volume')) for k in range(1, 8))},
   ({roll('avg', 'close', 100)} - {roll('avg', 'close', 200)}) / {roll('avg', 'close', 200)} AS ma_diff_pct, sign({lead('close')} / close - 1) AS target FROM bars) AS q"""


@query("analysis_features", final(
    f"SELECT *, rn - last_value(CASE WHEN close = max_close THEN rn END IGNORE NULLS) OVER ({PART}) AS periods_since_max FROM ({_an_rows}) AS r QUALIFY target IS NOT NULL AND ma_diff_pct IS NOT NULL AND volatility IS NOT NULL AND volume_pct_change_lag_7 IS NOT NULL",
    (DAILY,), DAY, [*_AN, "ma_diff_pct", "volatility", "max_close"], ["periods_since_max", "target"]))
def _analysis(spark, sf):
    return shape(X.analysis_features(daily(spark, sf)), DAY, [*_AN, "ma_diff_pct", "volatility", "max_close"], ["periods_since_max", "target"])


@query("create_features")
def _features(spark, sf):
    return shape(X.create_features(daily(spark, sf)), DAY, X.feature_columns())


@query("channel_positions", final(
    f"SELECT b.symbol, b.ts, (b.close - (e.m - 2*e.a)) / nullif(4*e.a, 0) AS kcp, (b.close - l) / nullif(h - l, 0) AS dcp FROM (SELECT *, {roll('max', 'high', 20)} AS h, {roll('min', 'low', 20)} AS l FROM sm) b JOIN e USING (symbol, rn)",
    (DAILY, SMOOTH, KELT), DAY, ["kcp", "dcp"]))
def _channels(spark, sf):
    tl = X.create_features(daily(spark, sf), fill=None)
    return shape(tl, DAY, ["KCP", "DCP"])


# ------------------------------------------------------------------- sequences
@query("sliding_sequences", final(
    f"SELECT symbol, seq, list_sum(l) AS total, l[1] AS first_value, len(l) AS size FROM (SELECT *, list(close) {over(32)} AS l FROM ticks) AS s WHERE len(l) = 32 AND (rn - 32) % 5 = 0",
    d=["total", "first_value"], i=["size"]))
def _sliding(spark, sf):
    df = sequences.sliding(ticks(spark, sf), "Close", 32, 5)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)
    return shape(df.withColumns({"total": total, "first_value": C("sequence")[0], "size": F.size("sequence")}), d=["total", "first_value"], i=["size"])


@query("context_windows", final(
    f"SELECT symbol, seq, n AS context_rows, c0, f1 AS next_1, coalesce(f2, f1) AS next_2 FROM (SELECT symbol, seq, count(*) OVER ({PART} ROWS BETWEEN 512 PRECEDING AND 1 PRECEDING) AS n, first_value(close) OVER ({PART} ROWS BETWEEN 512 PRECEDING AND 1 PRECEDING) AS c0, close AS f1, {lead('close')} AS f2 FROM ticks) AS s WHERE n > 0",
    d=["c0", "next_1", "next_2"], i=["context_rows"]))
def _context(spark, sf):
    df = sequences.context_and_horizon(ticks(spark, sf), ["ts", "Close"], 512, 2)
    return shape(df.withColumns({"context_rows": F.size("context"), "c0": C("context")[0]["Close"], "next_1": C("future")[0]["Close"], "next_2": C("future")[1]["Close"]}),
                 d=["c0", "next_1", "next_2"], i=["context_rows"])


# --------------------------------------------------------------------- signals
def crossing(a, b, strict=True):
    lt, gt = ("<", ">") if strict else ("<=", ">=")
    return f"CASE WHEN {a} > {b} AND {lag(a)} {lt} {lag(b)} THEN 1 WHEN {a} < {b} AND {lag(a)} {gt} {lag(b)} THEN -1 ELSE 0 END"


@query("ma_cross_signal", final(
    f"SELECT symbol, seq, {crossing('f', 's')} AS signal FROM (SELECT *, {roll('avg', 'r', 50)} AS f, {roll('avg', 'r', 200)} AS s FROM (SELECT *, {pct} AS r FROM ticks) AS q) AS q2", i=["signal"]))
def _g1(spark, sf):
    return shape(ticks(spark, sf).apply(G.ma_cross_on_changes()), i=["signal"])


_bands = f"{roll('avg', 'close', 20)} + 2 * {roll('stddev_samp', 'close', 20)} AS u, {roll('avg', 'close', 20)} - 2 * {roll('stddev_samp', 'close', 20)} AS l"


@query("band_breach_signal", final(f"SELECT symbol, seq, CASE WHEN close < l THEN 1 WHEN close > u THEN -1 ELSE 0 END AS signal FROM (SELECT *, {_bands} FROM ticks) AS q", i=["signal"]))
def _g2(spark, sf):
    return shape(ticks(spark, sf).apply(G.band_breach()), i=["signal"])


@query("macd_cross_signal", final(f"SELECT symbol, seq, {crossing('l', 'g')} AS signal FROM (SELECT t.*, e.f - e.s AS l, e.g FROM ticks t JOIN e USING (symbol, rn)) AS q", (TICKS, MACD.replace("{0}", "ticks")), i=["signal"]))
def _g3(spark, sf):
    return shape(G.macd_cross(ticks(spark, sf)), i=["signal"])


@query("rsi_divergence_signal", final(
    f"""SELECT symbol, ts, CASE WHEN rn > 30 AND low < ml AND rsi > rl THEN 1 WHEN rn > 30 AND high > mh AND rsi < rh THEN -1 ELSE 0 END AS signal FROM (
      SELECT *, {lag('rsi', 0)} AS r0, list_extract(lr, list_position(ll, list_min(ll))) AS rl, list_min(ll) AS ml, list_extract(lr, list_position(lh, list_max(lh))) AS rh, list_max(lh) AS mh FROM (
        SELECT *, list(rsi) OVER p AS lr, list(low) OVER p AS ll, list(high) OVER p AS lh FROM (
          SELECT *, CASE WHEN {roll('avg', 'l', 14)} = 0 AND {roll('avg', 'g', 14)} > 0 THEN 100 ELSE 100 - 100 / (1 + {roll('avg', 'g', 14)} / nullif({roll('avg', 'l', 14)}, 0)) END AS rsi FROM (
            SELECT *, CASE WHEN close > {lag('close')} THEN close - {lag('close')} ELSE 0 END AS g, CASE WHEN close < {lag('close')} THEN {lag('close')} - close ELSE 0 END AS l FROM bars) AS q) AS q1
        WINDOW p AS ({PART} ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING)) AS q2) AS q3""", (DAILY,), DAY, i=["signal"]))
def _g4(spark, sf):
    return shape(daily(spark, sf).apply(G.rsi_divergence()), DAY, i=["signal"])


@query("trend_breakout_signal", final(
    f"SELECT symbol, seq, CASE WHEN close > u AND a > b THEN 1 WHEN close < l AND a < b THEN -1 ELSE 0 END AS signal FROM (SELECT *, {_bands}, {roll('avg', 'close', 50)} AS a, {roll('avg', 'close', 200)} AS b FROM ticks) AS q", i=["signal"]))
def _g5(spark, sf):
    return shape(ticks(spark, sf).apply(G.trend_breakout()), i=["signal"])


_side = "CASE WHEN e.side = 0 THEN CASE WHEN b.high > b.ph THEN 1 WHEN b.low < b.pl THEN -1 ELSE 0 END WHEN e.side = 1 THEN CASE WHEN greatest(e.x, b.high) - b.low > 0.1 * b.close THEN -1 ELSE 1 END ELSE CASE WHEN b.high - least(e.x, b.low) > 0.1 * b.close THEN 1 ELSE -1 END END"
_ext = "CASE WHEN e.side = 0 THEN CASE WHEN b.high > b.ph THEN b.high WHEN b.low < b.pl THEN b.low ELSE 0 END WHEN e.side = 1 THEN CASE WHEN greatest(e.x, b.high) - b.low > 0.1 * b.close THEN b.low ELSE greatest(e.x, b.high) END ELSE CASE WHEN b.high - least(e.x, b.low) > 0.1 * b.close THEN b.high ELSE least(e.x, b.low) END END"
SWING = recursion("e", "sw", {"side": "0", "x": "0"}, {"side": _side, "x": _ext})


@query("swing_signal", final(
    f"SELECT symbol, ts, side AS direction, CASE WHEN side <> 0 THEN x END AS extreme, CASE WHEN {lag('side')} <> 0 AND side <> {lag('side')} THEN side ELSE 0 END AS signal FROM (SELECT b.*, e.side, e.x FROM sw b JOIN e USING (symbol, rn)) AS q",
    (DAILY, f"sw AS MATERIALIZED (SELECT *, {lag('high')} AS ph, {lag('low')} AS pl FROM bars)", SWING), DAY, ["extreme"], ["direction", "signal"]))
def _g6(spark, sf):
    return shape(G.swings(daily(spark, sf), 0.1), DAY, ["extreme"], ["direction", "signal"])


@query("swing_breakout_signal")
def _g6b(spark, sf):
    return shape(G.swings(daily(spark, sf), 0.1, "conservative"), DAY, ["extreme"], ["direction", "reversal", "signal"])


@query("level_signal", final(f"SELECT symbol, seq, CASE WHEN {roll('avg', 'close', 10)} > {roll('avg', 'close', 20)} THEN 1 ELSE 0 END AS signal FROM ticks", i=["signal"]))
def _g7(spark, sf):
    return shape(ticks(spark, sf).apply(G.level_signal()), i=["signal"])


@query("forecast_signal", final(f"SELECT symbol, ts, CASE WHEN m > close * 1.01 THEN 1 WHEN m < close * 0.99 THEN -1 ELSE 0 END AS signal FROM (SELECT *, {lag('close')} AS m FROM bars) AS q WHERE m IS NOT NULL", (DAILY,), DAY, i=["signal"]))
def _g8(spark, sf):
    tl = daily(spark, sf)
    pred = tl.apply(I.lag("Close", 1, "mean")).df.where(C("mean").isNotNull())
    return shape(G.forecast_signal(tl.df, pred, DAY, "mean", 0.01), DAY, i=["signal"])


@query("down_streak_signal", final(
    f"SELECT symbol, seq, rn - brk AS streak, CASE WHEN rn - brk >= 3 THEN 1 ELSE 0 END AS signal FROM (SELECT *, last_value(CASE WHEN close < pc THEN NULL ELSE rn END IGNORE NULLS) OVER ({PART}) AS brk FROM (SELECT *, {lag('close')} AS pc FROM ticks) AS q) AS q2", i=["streak", "signal"]))
def _g9(spark, sf):
    return shape(G.down_streak(ticks(spark, sf), 3), i=["streak", "signal"])


@query("trend_side_signal", final(f"SELECT symbol, seq, CASE WHEN close > {roll('avg', 'close', 50)} THEN 1 WHEN close < {roll('avg', 'close', 50)} THEN -1 ELSE 0 END AS signal FROM ticks", i=["signal"]))
def _g10(spark, sf):
    return shape(ticks(spark, sf).apply(G.trend_side()), i=["signal"])


_sig = f"SELECT *, CASE WHEN close < l THEN 1 WHEN close > u THEN -1 ELSE 0 END AS sig FROM (SELECT *, {_bands} FROM ticks) AS q"


@query("hold_position", final(f"SELECT symbol, seq, coalesce(last_value(nullif(sig, 0) IGNORE NULLS) OVER ({PART}), 0) AS position FROM ({_sig}) AS s", i=["position"]))
def _g11(spark, sf):
    return shape(G.hold_position(ticks(spark, sf).apply(G.band_breach()), "signal"), i=["position"])


@query("path_returns", final(f"SELECT symbol, seq, coalesce({pct} * {lag('sig')}, 0) AS ret, coalesce({pct} * sig, 0) AS ret_same_row FROM ({_sig}) AS s", d=["ret", "ret_same_row"]))
def _g14(spark, sf):
    tl = ticks(spark, sf).apply(G.band_breach())
    return shape(tl.apply(G.path_returns("signal"), G.path_returns("signal", 0, "ret_same_row")), d=["ret", "ret_same_row"])


@query("signal_on_bar_close", final(
    "SELECT symbol, seq, CASE WHEN rn % 10 = 0 THEN sign(close - 150) ELSE 0 END AS signal, CAST((rn - 1) % 24 AS BIGINT) AS age FROM ticks", i=["signal", "age"]))
def _onclose(spark, sf):
    """A bar of ten ticks signals on its last tick; rows also tell how old their model is."""
    rows = ticks(spark, sf).df
    bars = rows.where(C("rn") % 10 == 0).select("symbol", "seq", F.signum(C("Close") - 150).cast("int").alias("signal"))
    got = G.on_bar_close(rows, bars, ["symbol", "seq"], "signal").withColumn("age", scalar.rows_since_refit(C("rn"), 24))
    return shape(got, i=["signal", "age"])


@query("drop_levels", "SELECT event_type AS symbol, event_id AS seq FROM events")
def _dl(spark, sf):
    return P.drop_levels(views.ticks(spark, sf), ["ts", "Open", "High", "Low", "Close", "Volume", "volume_usdt", "trade_count"])


@query("result_json", "SELECT event_id AS seq, '{\"symbol\":\"' || event_type || '\",\"odd\":' || CAST(event_id % 2 AS VARCHAR) || '}' AS text FROM events")
def _rj(spark, sf):
    return views.ticks(spark, sf).select("seq", scalar.as_json(symbol=C("symbol"), odd=C("seq") % 2).alias("text"))
