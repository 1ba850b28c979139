"""Queries: events, labels, concurrency and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.catalog import (
    CHUNK_ROWS, DAILY, ONE, PART, TICKS, C, daily, ema, final, lag, lead, nz, one, over, query, recursion, roll, shape, ticks,
)
from tidewheel.catalog_bars import _ctes as BARS500_CTES, _ext as BARS500
from tidewheel.catalog_indicators import DAY, pct
from tidewheel.operators import bars as B
from tidewheel.operators import features as X
from tidewheel.operators import indicators as I
from tidewheel.operators import labels as L
from tidewheel.operators import weights as W
from tidewheel.plans import pipeline
from tidewheel.sources import views
from tidewheel.storage import materialize
from tidewheel.timeline import Timeline

K3 = ("symbol", "seq", "event_end_time")
RN = ["label", "start_rn", "end_rn"]

CUSUM = (
    f"dv AS MATERIALIZED (SELECT *, close - avg(close) OVER ({PART}) AS x FROM ticks)",
    recursion("e", "dv", {"u": "greatest(0, b.x)", "v": "least(0, b.x)", "c": "0"},
              {"u": "CASE WHEN e.c = 1 THEN greatest(0, b.x) ELSE greatest(0, e.u + b.x) END",
               "v": "CASE WHEN e.c = 1 THEN least(0, b.x) ELSE least(0, e.v + b.x) END",
               "c": "CASE WHEN greatest(0, CASE WHEN e.c = 1 THEN 0 ELSE e.u END + b.x) >= 60 OR least(0, CASE WHEN e.c = 1 THEN 0 ELSE e.v END + b.x) <= -60 THEN 1 ELSE 0 END"}),
)


@query("cusum_events", final("SELECT b.symbol, b.seq, b.close FROM dv b JOIN e USING (symbol, rn) WHERE e.c = 1", (ONE, *CUSUM), d=["close"]))
def _cusum(spark, sf):
    return shape(L.cusum_events(one(spark, sf), 60, keep=("seq", "Close")), d=["Close"])


def horizon_sql(k, up, down, src="ticks"):
    r = f"({lead('close', k)} / close - 1)"
    return f"SELECT *, {lead('ts', k)} AS event_end_time, CASE WHEN {r} <= {down} THEN -1 WHEN {r} >= {up} THEN 1 ELSE 0 END AS label, rn AS start_rn, rn + {k} AS end_rn FROM {src}"


_FIX = f"SELECT * FROM ({horizon_sql(10, '0.02', '-0.03')}) AS h WHERE event_end_time IS NOT NULL"


@query("fixed_horizon_labels", final(_FIX, keys=K3, i=RN))
def _l2(spark, sf):
    return shape(L.fixed_horizon_labels(ticks(spark, sf), 10, 0.02, 0.03), K3, i=RN)


_rp = f"(SELECT *, {roll('stddev_samp', 'p', 20)} * 1.5 AS band FROM (SELECT *, {pct} AS p FROM ticks) AS q) AS s"


@query("volatility_labels", final(f"SELECT * FROM ({horizon_sql(10, 'band', '-band', _rp)}) AS h WHERE event_end_time IS NOT NULL", keys=K3, i=RN))
def _l3(spark, sf):
    return shape(L.volatility_labels(ticks(spark, sf), 10, 20, 1.5), K3, i=RN)


TB = f"""tb AS MATERIALIZED (SELECT *, {lead('ts', 15)} AS tmax, {lead('close', 15)} AS cmax FROM (SELECT *, last_value(v0 IGNORE NULLS) OVER ({PART}) AS v FROM (SELECT *, {roll('stddev_samp', 'p', 20)} AS v0 FROM (SELECT *, {pct} AS p FROM ticks) AS q) AS q1) AS q2)"""
TBX = """tbx AS MATERIALIZED (SELECT a.symbol, a.rn, min(b.rn) AS hit, arg_min(b.ts, b.rn) AS hit_ts, arg_min(b.close, b.rn) AS hit_close FROM tb a JOIN tb b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 15
  AND (b.close >= a.close * (1 + 1.0 * a.v) OR b.close <= a.close * (1 - 1.5 * a.v)) WHERE a.tmax IS NOT NULL AND a.v <> 0 GROUP BY 1, 2)"""
TBQ = "SELECT a.symbol, a.seq, a.ts, a.rn, coalesce(hit_ts, tmax) AS event_end_time, CASE WHEN hit IS NULL THEN sign(cmax / close - 1) WHEN hit_close >= close * (1 + 1.0 * v) THEN 1 ELSE -1 END AS label, rn AS start_rn, coalesce(hit, rn + 15) AS end_rn FROM tb a LEFT JOIN tbx USING (symbol, rn) WHERE tmax IS NOT NULL AND v <> 0"


def barrier_rows(spark, sf):
    tl = ticks(spark, sf).apply(I.pct_change(out="p"))
    tl = tl.apply(I.rolling_std("p", 20, "vol"))
    return L.triple_barrier_labels(tl, "vol", 15, (1.0, 1.5))


@query("triple_barrier", final(TBQ, (TICKS, TB, TBX), K3, i=RN))
def _l4(spark, sf):
    return shape(barrier_rows(spark, sf), K3, i=RN)


# daily volatility: bias-corrected exponential deviation from four running sums
_A = 1 - 2 / 101
DV = (
    "dr AS MATERIALIZED (SELECT t.symbol, t.seq, t.ts, t.close, t.rn, t.close / b.close - 1 AS x FROM ticks t LEFT JOIN LATERAL (SELECT r.close FROM ticks r WHERE r.symbol = t.symbol AND r.ts < t.ts - INTERVAL 1 DAY ORDER BY r.ts DESC, r.seq DESC LIMIT 1) AS b ON true)",
    recursion("e", "dr", {"n": "0", "w": "0", "w2": "0", "s": "0", "q": "0"},
              {"n": "CASE WHEN b.x IS NULL THEN e.n ELSE e.n + 1 END",
               "w": f"CASE WHEN b.x IS NULL THEN e.w ELSE {_A!r} * e.w + 1 END",
               "w2": f"CASE WHEN b.x IS NULL THEN e.w2 ELSE {_A * _A!r} * e.w2 + 1 END",
               "s": f"CASE WHEN b.x IS NULL THEN e.s ELSE {_A!r} * e.s + b.x END",
               "q": f"CASE WHEN b.x IS NULL THEN e.q ELSE {_A!r} * e.q + b.x * b.x END"}),
    "dv AS MATERIALIZED (SELECT b.*, CASE WHEN n > 1 THEN sqrt((q / w - (s / w) * (s / w)) * w * w / (w * w - w2)) END AS vol FROM dr b JOIN e USING (symbol, rn))",
)


@query("daily_volatility", final("SELECT symbol, seq, vol AS daily_vol FROM dv", (TICKS, *DV), d=["daily_vol"]))
def _l5(spark, sf):
    return shape(L.daily_volatility(ticks(spark, sf)), d=["daily_vol"])


VB = "vb AS MATERIALIZED (SELECT t.symbol, t.seq, t.rn, b.ts AS t1, b.rn AS t1_rn FROM ticks t JOIN LATERAL (SELECT r.ts, r.rn FROM ticks r WHERE r.symbol = t.symbol AND r.ts >= t.ts + INTERVAL 2 DAY ORDER BY r.ts, r.seq LIMIT 1) AS b ON true)"


@query("vertical_barrier", final("SELECT * FROM vb", (TICKS, VB), ("symbol", "seq", "t1"), i=["t1_rn"]))
def _l6(spark, sf):
    return shape(L.vertical_barrier(ticks(spark, sf), 2), ("symbol", "seq", "t1"), i=["t1_rn"])


EV = (
    "n AS MATERIALIZED (SELECT symbol, max(rn) AS n_rows FROM ticks GROUP BY 1)",
    "ev AS MATERIALIZED (SELECT d.*, v.t1, v.t1_rn, coalesce(v.t1_rn, n.n_rows) AS stop FROM dv d JOIN n USING (symbol) LEFT JOIN vb v USING (symbol, rn) WHERE d.vol > 0.05)",
    "tx AS MATERIALIZED (SELECT a.symbol, a.rn, min(b.rn) AS hit, arg_min(b.ts, b.rn) AS hit_ts FROM ev a JOIN ticks b ON a.symbol = b.symbol AND b.rn > a.rn AND b.rn <= a.stop AND (b.close / a.close - 1 > 0.15 OR b.close / a.close - 1 < -0.1) GROUP BY 1, 2)",
    "be AS MATERIALIZED (SELECT a.symbol, a.seq, a.close, a.rn AS start_rn, coalesce(hit, t1_rn) AS end_rn, coalesce(hit_ts, a.t1) AS t1, a.vol AS trgt FROM ev a LEFT JOIN tx USING (symbol, rn) WHERE coalesce(hit_ts, a.t1) IS NOT NULL)",
)


def barrier(spark, sf):
    tl = ticks(spark, sf)
    vol = L.daily_volatility(tl)
    t1 = L.vertical_barrier(tl, 2)
    return tl, L.barrier_events(vol, "daily_vol", 0.05, t1, 0.15, 0.1)


@query("barrier_events", final("SELECT * FROM be", (TICKS, *DV, VB, *EV), ("symbol", "seq", "t1"), ["trgt"], ["start_rn", "end_rn"]))
def _l7(spark, sf):
    return shape(barrier(spark, sf)[1], ("symbol", "seq", "t1"), ["trgt"], ["start_rn", "end_rn"])


BINS = "SELECT be.*, t.close / be.close - 1 AS ret, sign(t.close / be.close - 1) AS bin FROM be JOIN ticks t ON t.symbol = be.symbol AND t.rn = be.end_rn"


@query("event_bins", final(BINS, (TICKS, *DV, VB, *EV), ("symbol", "seq", "t1"), ["ret"], ["bin"]))
def _l8(spark, sf):
    tl, ev = barrier(spark, sf)
    return shape(L.event_bins(tl, ev), ("symbol", "seq", "t1"), ["ret"], ["bin"])


REV = f"SELECT *, CASE WHEN nx >= 0 AND nx >= bar_return + 0.35 * intra_bar_std THEN 1 ELSE 0 END AS label FROM (SELECT *, lead(bar_return) OVER (PARTITION BY symbol ORDER BY bar_id) AS nx, lead(close_time) OVER (PARTITION BY symbol ORDER BY bar_id) AS t1 FROM ({BARS500}) AS b) AS q WHERE nx IS NOT NULL"


def reversal_series(spark, sf):
    b = B.extended_volume_bars(ticks(spark, sf), 500).withColumn("ts", C("close_time"))
    return pipeline.bar_series(b, ("symbol",), CHUNK_ROWS)


@query("reversal_labels", final(REV, BARS500_CTES, ("symbol", "bar_id", "t1"), i=["label"]))
def _l9(spark, sf):
    return shape(L.reversal_labels(reversal_series(spark, sf)), ("symbol", "bar_id", "t1"), i=["label"])


@query("bar_lag_features", final(
    f"SELECT *, CASE WHEN count(lag_return) {over(5)} = 5 THEN avg(lag_return) {over(5)} END AS lag_return_mean, CASE WHEN count(lag_return) {over(5)} = 5 THEN stddev_samp(lag_return) {over(5)} END AS lag_return_std FROM (SELECT *, bar_id AS rn, lag(bar_return) OVER (PARTITION BY symbol ORDER BY bar_id) AS lag_return, lag(intra_bar_std) OVER (PARTITION BY symbol ORDER BY bar_id) AS lag_volatility FROM ({BARS500}) AS b) AS q",
    BARS500_CTES, ("symbol", "bar_id"), ["lag_return", "lag_volatility", "lag_return_mean", "lag_return_std"]))
def _w38(spark, sf):
    return shape(reversal_series(spark, sf).apply(I.bar_lag_features()), ("symbol", "bar_id"), ["lag_return", "lag_volatility", "lag_return_mean", "lag_return_std"])


_pr = f"(SELECT *, {lead('p')} AS f, {roll('stddev_samp', 'p', 168)} AS band FROM (SELECT *, {pct} AS p FROM ticks) AS q) AS s"


@query("price_change_target", final(
    f"SELECT symbol, seq, CASE WHEN f < -0.01 THEN -1 WHEN f > 0.01 THEN 1 ELSE 0 END AS fixed_target, CASE WHEN f <= -band THEN -1 WHEN f >= band THEN 1 ELSE 0 END AS std_target FROM {_pr}", i=["fixed_target", "std_target"]))
def _l10(spark, sf):
    tl = L.price_change_target(ticks(spark, sf), out="fixed_target")
    return shape(L.price_change_target(tl, "std_dev", out="std_target"), i=["fixed_target", "std_target"])


_ao = f"{roll('avg', 'm', 5)} - {roll('avg', 'm', 34)}"
_peak = f"CASE WHEN x > {lag('x')} AND x > {lead('x')} THEN 1 WHEN x < {lag('x')} AND x < {lead('x')} THEN -1 ELSE 0 END"


@query("oscillator_target_price", final(f"SELECT symbol, ts, {_peak} AS target FROM (SELECT *, {_ao} AS x FROM (SELECT *, (high + low) / 2 AS m FROM bars) AS q) AS q2", (DAILY,), DAY, i=["target"]))
def _l11a(spark, sf):
    return shape(L.oscillator_target(daily(spark, sf), "ao_on_price"), DAY, i=["target"])


@query("oscillator_target_change", final(f"SELECT symbol, ts, {_peak} AS target FROM (SELECT *, {_ao} AS x FROM (SELECT *, (coalesce(high / {lag('high')} - 1, 0) + coalesce(low / {lag('low')} - 1, 0)) / 2 AS m FROM bars) AS q) AS q2", (DAILY,), DAY, i=["target"]))
def _l11b(spark, sf):
    return shape(L.oscillator_target(daily(spark, sf)), DAY, i=["target"])


@query("oscillator_target_ratio", final(f"SELECT symbol, ts, {_peak} AS target FROM (SELECT *, coalesce(o / {lag('o')} - 1, 0) AS x FROM (SELECT *, {_ao} AS o FROM (SELECT *, (high + low) / 2 AS m FROM bars) AS q) AS q2) AS q3", (DAILY,), DAY, i=["target"]))
def _l11d(spark, sf):
    return shape(L.oscillator_target(daily(spark, sf), "pct_change_on_ao"), DAY, i=["target"])


_SPACED = (
    DAILY,
    f"xs AS MATERIALIZED (SELECT symbol, ts, rn, x, {lag('x')} AS l, {lead('x')} AS r FROM (SELECT *, {_ao} AS x FROM (SELECT *, (high + low) / 2 AS m FROM bars) AS q) AS q2)",
    """pk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, sg ORDER BY v DESC, rn DESC) AS i FROM (
  SELECT symbol, 1 AS sg, rn, x AS v FROM xs WHERE x > l AND x > r AND x - greatest(l, r) >= 5
  UNION ALL SELECT symbol, -1, rn, -x FROM xs WHERE x < l AND x < r AND least(l, r) - x >= 5) AS p)""",
    """kp AS (SELECT DISTINCT symbol, sg, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept FROM pk
  UNION ALL SELECT p.symbol, p.sg, p.i, CASE WHEN len(list_filter(kept, lambda k: abs(k - p.rn) < 10)) = 0 THEN list_append(kept, p.rn) ELSE kept END
  FROM kp JOIN pk p ON p.symbol = kp.symbol AND p.sg = kp.sg AND p.i = kp.i + 1)""",
    "st AS MATERIALIZED (SELECT symbol, sg, unnest(kept) AS rn FROM (SELECT symbol, sg, arg_max(kept, i) AS kept FROM kp GROUP BY 1, 2) AS z)",
)


@query("oscillator_target_spaced", final("SELECT x.symbol, x.ts, coalesce(min(st.sg), 0) AS target FROM xs x LEFT JOIN st USING (symbol, rn) GROUP BY 1, 2", _SPACED, DAY, i=["target"]))
def _l12(spark, sf):
    return shape(L.oscillator_target(daily(spark, sf), "ao_on_price", peak_distance=10, peak_threshold=5.0), DAY, i=["target"])


@query("direction_targets", final(
    f"SELECT symbol, seq, CASE WHEN {lead('close')} > close THEN 1 ELSE 0 END AS up, CASE WHEN {lead('close')} > close THEN 1 ELSE -1 END AS side FROM ticks", i=["up", "side"]))
def _l13(spark, sf):
    return shape(L.direction_target(L.direction_target(ticks(spark, sf), out="up"), signed=True, out="side"), i=["up", "side"])


@query("next_close_target", final(f"SELECT * FROM (SELECT *, {lead('close')} AS target FROM ticks) AS q WHERE target IS NOT NULL", d=["target"]))
def _l14(spark, sf):
    return shape(L.next_close_target(ticks(spark, sf)), d=["target"])


@query("next_row_end", final(f"SELECT symbol, seq, {lead('ts')} AS t1 FROM ticks", keys=("symbol", "seq", "t1")))
def _l15(spark, sf):
    return shape(L.next_row_end(ticks(spark, sf)), ("symbol", "seq", "t1"))


@query("meta_label", final(f"SELECT symbol, seq, CASE WHEN sign(close - {lag('close')}) = sign({lead('close')} - close) THEN 1 ELSE 0 END AS meta FROM ticks", i=["meta"]))
def _l16(spark, sf):
    def s(w):
        return {"_p": F.signum(C("Close") - F.lag("Close").over(w)), "_truth": F.signum(F.lead("Close").over(w) - C("Close"))}

    tl = ticks(spark, sf).compute(s, back=1, fwd=1)
    return shape(tl.df.withColumn("meta", L.meta_label(C("_p"), C("_truth"))), i=["meta"])


# ------------------------------------------------------- concurrency and weights
CONC = f"""ev AS MATERIALIZED ({_FIX}),
mk AS MATERIALIZED (SELECT symbol, ts, sum(d) AS d FROM (SELECT symbol, ts, 1 AS d FROM ev UNION ALL SELECT symbol, event_end_time, -1 FROM ev) AS u GROUP BY 1, 2),
cm AS MATERIALIZED (SELECT symbol, ts, sum(d) OVER (PARTITION BY symbol ORDER BY ts) AS c FROM mk)"""
CONCQ = f"SELECT t.symbol, t.ts, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY t.symbol ORDER BY t.ts), 0) AS concurrency FROM ticks t LEFT JOIN cm USING (symbol, ts)"


def fixed(spark, sf):
    return L.fixed_horizon_labels(ticks(spark, sf), 10, 0.02, 0.03)


@query("concurrent_labels", final(CONCQ, (TICKS, CONC), DAY, i=["concurrency"]))
def _c1(spark, sf):
    return shape(W.concurrent_labels(fixed(spark, sf), views.ticks(spark, sf), chunk_rows=CHUNK_ROWS), DAY, i=["concurrency"])


COEV = f"""lb AS MATERIALIZED ({TBQ}),
co AS MATERIALIZED (SELECT t.symbol, t.seq, t.ts, t.rn, t.close, count(e.start_rn) AS n_co FROM ticks t LEFT JOIN lb e ON e.symbol = t.symbol AND t.rn BETWEEN e.start_rn AND e.end_rn GROUP BY ALL),
st AS MATERIALIZED (SELECT co.* FROM co SEMI JOIN lb ON co.symbol = lb.symbol AND co.rn = lb.start_rn),
un AS MATERIALIZED (SELECT e.symbol, e.seq, e.start_rn, avg(1.0 / s.n_co) AS uniqueness FROM lb e JOIN st s ON s.symbol = e.symbol AND s.rn BETWEEN e.start_rn AND e.end_rn GROUP BY ALL),
sw AS MATERIALIZED (SELECT *, w / sum(w) OVER (PARTITION BY symbol) * 1000 AS weight_per_mille FROM (SELECT un.symbol, un.seq, uniqueness * abs(ln(close) - ln(pc)) AS w FROM un JOIN (SELECT *, {lag('close')} AS pc FROM ticks) AS t ON t.symbol = un.symbol AND t.rn = un.start_rn) AS q)"""
_b = (TICKS, TB, TBX, COEV)


@query("co_events", final("SELECT * FROM co", _b, i=["n_co"]))
def _c2(spark, sf):
    return shape(W.co_events(ticks(spark, sf), barrier_rows(spark, sf)), i=["n_co"])


@query("average_uniqueness", final("SELECT * FROM un", _b, d=["uniqueness"]))
def _c3(spark, sf):
    return shape(W.average_uniqueness(ticks(spark, sf), barrier_rows(spark, sf)), d=["uniqueness"])


@query("sample_weights", final("SELECT * FROM sw", _b, d=["weight_per_mille"]))
def _c4(spark, sf):
    got = W.sample_weights(ticks(spark, sf), materialize(barrier_rows(spark, sf), "labels"))
    return shape(got.withColumn("weight_per_mille", C("sample_weight") * 1000), d=["weight_per_mille"])


_desc = "count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS max"
DESC_D = ["mean", "std", "min", "q25", "q50", "q75", "max"]


@query("concurrency_summary", final(f"SELECT symbol, {_desc.replace('(x', '(concurrency')} FROM ({CONCQ}) AS q GROUP BY 1", (TICKS, CONC), ("symbol",), DESC_D, ["n"]))
def _c5(spark, sf):
    c = W.concurrent_labels(fixed(spark, sf), views.ticks(spark, sf), chunk_rows=CHUNK_ROWS)
    return shape(W.concurrency_summary(c, ["symbol"]), ("symbol",), DESC_D, ["n"])


@query("weighted_bar_labels", final(
    f"""SELECT symbol, start_rn - 1 AS bar_id, label, uniqueness FROM (SELECT e.*, avg(1.0 / s.n_co) AS uniqueness FROM fl e JOIN (SELECT co.* FROM fco co SEMI JOIN fl ON co.symbol = fl.symbol AND co.rn = fl.start_rn) s ON s.symbol = e.symbol AND s.rn BETWEEN e.start_rn AND e.end_rn GROUP BY ALL) AS q""",
    (*BARS500_CTES,
     f"bb AS MATERIALIZED (SELECT *, bar_id + 1 AS rn, close_price AS close FROM ({BARS500}) AS b)",
     f"fv AS MATERIALIZED (SELECT *, {lead('close', 5)} AS cmax FROM (SELECT *, last_value(v0 IGNORE NULLS) OVER ({PART}) AS v FROM (SELECT *, {roll('stddev_samp', 'p', 10)} AS v0 FROM (SELECT *, {pct} AS p FROM bb) AS q) AS q1) AS q2)",
     "fx AS MATERIALIZED (SELECT a.symbol, a.rn, min(b.rn) AS hit, arg_min(b.close, b.rn) AS hit_close FROM fv a JOIN fv b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 5 AND (b.close >= a.close * (1 + a.v) OR b.close <= a.close * (1 - a.v)) WHERE a.cmax IS NOT NULL AND a.v <> 0 GROUP BY 1, 2)",
     "fl AS MATERIALIZED (SELECT a.symbol, a.rn AS start_rn, coalesce(hit, rn + 5) AS end_rn, CASE WHEN hit IS NULL THEN sign(cmax / close - 1) WHEN hit_close >= close * (1 + v) THEN 1 ELSE -1 END AS label FROM fv a LEFT JOIN fx USING (symbol, rn) WHERE cmax IS NOT NULL AND v <> 0)",
     "fco AS MATERIALIZED (SELECT t.symbol, t.rn, count(e.start_rn) AS n_co FROM bb t LEFT JOIN fl e ON e.symbol = t.symbol AND t.rn BETWEEN e.start_rn AND e.end_rn GROUP BY ALL)"),
    ("symbol",), ["uniqueness"], ["bar_id", "label"]))
def _flagship(spark, sf):
    """Ticks to volume bars, triple-barrier labels on the bars, uniqueness per label."""
    b = B.extended_volume_bars(ticks(spark, sf), 500).withColumnsRenamed({"close_price": "Close", "close_time": "ts"})
    series = pipeline.bar_series(b, ("symbol",), CHUNK_ROWS)
    vol = series.apply(I.pct_change(out="p"), keep=["ts", "seq", "Close"]).apply(I.rolling_std("p", 10, "vol"))
    lab = materialize(L.triple_barrier_labels(vol, "vol", 5, (1.0, 1.0)), "labels")
    got = W.average_uniqueness(series, lab).withColumn("bar_id", C("start_rn") - 1)
    return shape(got, ("symbol",), ["uniqueness"], ["bar_id", "label"])
