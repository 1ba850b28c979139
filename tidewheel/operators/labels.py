"""Event sampling and labels.

Labels carry ``start_rn`` and ``end_rn`` besides the end time, so weights and
splits work on row numbers without looking times up again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions import rolling as R
from tidewheel.lookup import attach
from tidewheel.operators.joins import asof_join
from tidewheel.operators.recursive import reach, smooth
from tidewheel.operators.scans import TASK_ROWS, first_hit, reset_scan
from tidewheel.storage import materialize
from tidewheel.timeline import Recipe, Timeline

C = F.col


# ---------------------------------------------------------------- event sampling
def cusum_events(tl: Timeline, h: float, price: str = "Close", keep: Sequence[str] = ("ts",)) -> DataFrame:
    """Rows where the two-sided sum of price minus expanding mean passes ``h``."""
    run = tl.running(keep=[*keep, price], _s=("sum", price), _n=("count", price))
    ready = run.extend(_step=C(price) - C("_s") / C("_n"), _limit=F.lit(float(h)))
    done = reset_scan(ready, "_step", "_limit", list(keep), two_sided=True, clamp=True)
    return done.df.where("closes").drop("bar_id", "bar_open", "level", "closes")


# ------------------------------------------------------------- horizon labels
def _sign_label(ret: Column, up: Column, down: Column) -> Column:
    """1 / -1 / 0; the lower rule is applied last, missing comparisons give 0."""
    return F.when(ret <= down, -1).when(ret >= up, 1).otherwise(0)


def _horizon(tl: Timeline, recipe: Recipe) -> DataFrame:
    done = tl.apply(recipe, keep=[*tl.order, "Close"]).df
    return done.where(C("event_end_time").isNotNull())


def fixed_horizon_labels(tl: Timeline, look_forward: int, up: float, down: float, price: str = "Close") -> DataFrame:
    """Label by the return after a fixed number of rows; the last rows are dropped."""
    out = ("label", "event_end_time", "start_rn", "end_rn")

    def s(w):
        ret = R.following(C(price), w, look_forward) / C(price) - 1
        return {
            "label": _sign_label(ret, F.lit(up), F.lit(-down)),
            "event_end_time": R.following(C("ts"), w, look_forward),
            "start_rn": C("rn"),
            "end_rn": C("rn") + look_forward,
        }

    return _horizon(tl, Recipe(out, (s,), (price, "ts"), 0, look_forward))


def volatility_labels(tl: Timeline, look_forward: int, window: int, mult: float, price: str = "Close") -> DataFrame:
    """Like fixed horizon with thresholds from rolling volatility; no volatility yet gives 0."""
    out = ("label", "event_end_time", "start_rn", "end_rn")

    def s1(w):
        return {"_r": R.pct(C(price), w)}

    def s2(w):
        band = R.std(C("_r"), window, w) * mult
        ret = R.following(C(price), w, look_forward) / C(price) - 1
        return {
            "label": _sign_label(ret, band, -band),
            "event_end_time": R.following(C("ts"), w, look_forward),
            "start_rn": C("rn"),
            "end_rn": C("rn") + look_forward,
        }

    return _horizon(tl, Recipe(out, (s1, s2), (price, "ts"), window + 1, look_forward))


def triple_barrier_labels(
    tl: Timeline,
    volatility: str,
    look_forward: int,
    pt_sl: tuple[float, float],
    timeout_by_sign: bool = True,
    price: str = "Close",
) -> DataFrame:
    """First touch of the upper or lower barrier within the horizon, else the timeout rule.

    Rows without volatility (after forward fill) or with zero volatility and the
    last ``look_forward`` rows have no label.  The search runs per chunk with a
    look-ahead halo; it is a vectorised descent, O(log horizon) per row.
    """
    filled = tl.running(keep=[*tl.order, price], _vol=("last", volatility))
    pt, sl = pt_sl

    def fn(pdf: pd.DataFrame) -> dict:
        p = pdf[price].to_numpy(dtype=float)
        vol = pdf["_vol"].to_numpy(dtype=float)
        n = len(p)
        rows = np.arange(n)
        last = rows + look_forward
        upper, lower = p * (1 + pt * vol), p * (1 - sl * vol)
        ok = (last < n) & ~np.isnan(vol) & (vol != 0)
        upper, lower = np.where(np.isnan(upper), np.inf, upper), np.where(np.isnan(lower), -np.inf, lower)
        hit = first_hit(np.nan_to_num(p, nan=-np.inf), np.nan_to_num(p, nan=np.inf), upper, lower, rows + 1)
        end = np.minimum(np.minimum(hit, last), n - 1)
        touched = hit <= last
        ret = p[end] / p - 1
        side = np.where(p[end] >= upper, 1, -1)
        timeout = np.sign(np.nan_to_num(ret)) if timeout_by_sign else np.zeros(n)
        label = np.where(touched, side, timeout).astype("int32")
        return {
            "label": label,
            "event_end_time": pdf["ts"].to_numpy()[end],
            "end_rn": pdf["rn"].to_numpy()[end],
            "_ok": ok,
        }

    types = {"label": "int", "event_end_time": "timestamp_ntz", "end_rn": "bigint", "_ok": "boolean"}
    done = filled.map_chunks(fn, types, [price, "_vol", "ts"], fwd=look_forward, keep=[*tl.order, price])
    return done.df.where("_ok").drop("_ok").withColumn("start_rn", C("rn"))


# ----------------------------------------------------- daily volatility and events
def daily_volatility(tl: Timeline, span: int = 100, price: str = "Close", out: str = "daily_vol") -> Timeline:
    """Exponential deviation (bias corrected) of the return against the last row before a day ago."""
    keep = [*tl.order, price]
    left = tl.df.select(*tl.by, "rn", *keep, (C("ts") - F.expr("interval 1 day")).alias("_ago"))
    right = tl.df.select(*tl.by, "ts", "rn", C(price).alias("_base"))
    got = asof_join(
        left, right, tl.by, "_ago", "ts", ["_base"], strict=True, right_tie=["rn"], chunk_rows=tl.chunk_rows
    )
    day = tl.with_df(got.withColumn("_dret", F.try_divide(C(price), C("_base")) - 1))

    def fn(pdf):
        return {out: pdf["_dret"].ewm(span=span).std().to_numpy()}

    return smooth(day, fn, [out], ["_dret"], reach(span), keep)


def vertical_barrier(tl: Timeline, days: int, keep: Sequence[str] = ()) -> DataFrame:
    """First row at least ``days`` after each row; rows without one are dropped."""
    left = tl.df.select(
        *tl.by, "rn", *tl.order, *keep, (C("ts") + F.expr(f"interval {days} days")).alias("_due")
    )
    right = tl.df.select(*tl.by, "ts", C("ts").alias("t1"), C("rn").alias("t1_rn"), "rn")
    got = asof_join(
        left, right, tl.by, "_due", "ts", ["t1", "t1_rn"], "forward", right_tie=["rn"], chunk_rows=tl.chunk_rows
    )
    return got.where(C("t1").isNotNull()).drop("_due")


def first_touch(tl: Timeline, events: DataFrame, price: str = "Close") -> DataFrame:
    """First row in (start_rn, end_rn] with price >= upper or <= lower, as ``touch_*`` columns.

    An event searches the chunk it starts in.  If it stays open, the series of chunk maxima and minima is searched the
    same way for the first later chunk that touches, and then that chunk: however many chunks an event crosses, it is
    copied twice per level.  ``start_rn`` tells the events of a key apart.
    """
    by = list(tl.by)
    seen = F.nanvl(C(price).cast("double"), F.lit(None))
    rows = tl.df.select(*by, "rn", seen.alias("_hi"), seen.alias("_lo"), "ts")
    asked = events.where("end_rn > start_rn").select(
        *by, C("start_rn").alias("_id"), C("start_rn").alias("_from"), C("end_rn").alias("_to"), "upper", "lower"
    )
    n = tl.df.agg(F.max("rn")).first()[0] or 0
    first = _first_rows(rows, asked, by, tl.chunk_rows, n).select(
        *by, C("_id").alias("start_rn"), F.struct("touch_rn", "touch_ts", "touch_side").alias("_x")
    )
    return events.join(first, [*by, "start_rn"], "left").select(*events.columns, "_x.*")


def _first_rows(rows: DataFrame, asked: DataFrame, by: Sequence[str], c: int, n: int) -> DataFrame:
    """First touching row per asked interval, level by level over chunks of ``c`` of at most ``n`` rows a key."""
    key = [*by, "_id"]
    here = _search(rows, asked.withColumn("_t", F.expr(f"_from div {c}")), by, c)
    if n <= c:
        return here
    here = materialize(here, "touches")
    wider = asked.where(f"(_to - 1) div {c} > _from div {c}").join(here.select(*key), key, "left_anti")
    wider = materialize(wider, "open")
    chunks = rows.groupBy(*by, F.expr(f"(rn - 1) div {c} + 1").alias("rn")).agg(
        F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"), F.min("ts").alias("ts")
    )
    over = wider.withColumns({"_from": F.expr(f"_from div {c} + 1"), "_to": F.expr(f"(_to - 1) div {c} + 1")})
    found = _first_rows(materialize(chunks, "peaks"), over, by, max(c, 64), -(-n // c))
    later = wider.join(found.select(*key, (C("touch_rn") - 1).alias("_t")), key)
    return here.unionByName(_search(rows, later, by, c))


def _search(rows: DataFrame, asked: DataFrame, by: Sequence[str], c: int) -> DataFrame:
    """Asked intervals against the rows of the one chunk ``_t`` named with each; many intervals on a chunk are many tasks."""
    keys = [*by, "_t", "_part"]
    asked = asked.withColumn("_part", F.expr(f"_id div {TASK_ROWS}"))
    # a chunk goes once to every part that asks for it
    chunks = rows.withColumn("_t", F.expr(f"(rn - 1) div {c}")).join(asked.select(*(C(k).alias(k) for k in keys)).distinct(), [*by, "_t"])
    schema = T.StructType(
        [*(asked.schema[k] for k in [*by, "_id"])]
        + [
            T.StructField("touch_rn", T.LongType()),
            T.StructField("touch_ts", T.TimestampNTZType()),
            T.StructField("touch_side", T.IntegerType()),
        ]
    )

    def search(ev: pd.DataFrame, px: pd.DataFrame) -> pd.DataFrame:
        if ev.empty or px.empty:
            return pd.DataFrame(columns=schema.names)
        px = px.sort_values("rn", ignore_index=True)
        hi, lo, rn = px["_hi"].to_numpy(dtype=float), px["_lo"].to_numpy(dtype=float), px["rn"].to_numpy()
        begin = np.maximum(ev["_from"].to_numpy() + 1, rn[0]) - rn[0]
        stop = np.minimum(ev["_to"].to_numpy(), rn[-1]) - rn[0]
        up, down = ev["upper"].to_numpy(dtype=float), ev["lower"].to_numpy(dtype=float)
        pos = first_hit(np.nan_to_num(hi, nan=-np.inf), np.nan_to_num(lo, nan=np.inf), up, down, begin)
        ok = pos <= stop
        at = pos[ok]
        out = ev.loc[ok, [*by, "_id"]].reset_index(drop=True)
        out["touch_rn"] = rn[at]
        out["touch_ts"] = px["ts"].to_numpy()[at]
        out["touch_side"] = np.where(hi[at] >= up[ok], 1, -1).astype("int32")
        return out

    return asked.groupBy(*keys).cogroup(chunks.groupBy(*keys)).applyInPandas(search, schema)


def barrier_events(
    tl: Timeline,
    target: str,
    min_ret: float,
    t1: DataFrame,
    profit: float,
    loss: float,
    price: str = "Close",
    scale_by_target: bool = False,
) -> DataFrame:
    """Events with target above ``min_ret`` and the earliest of loss touch, profit touch and ``t1``.

    ``profit`` and ``loss`` are absolute returns (times the target with
    ``scale_by_target``); touching means strictly beyond.  Events without t1 look
    to the end of the series and are dropped if nothing is touched.
    """
    by = tl.by
    tl = tl.settle([*tl.order, price, target])
    filled = tl.running(keep=[*tl.order, price], trgt=("last", target)).df
    n = tl.rows_per_key()
    unit = C("trgt") if scale_by_target else F.lit(1.0)
    ends = t1.select(*by, "rn", "t1", "t1_rn")
    next_up = F.lit(1.0) + profit * unit
    next_dn = F.lit(1.0) - loss * unit
    events = (
        attach(filled.where(C("trgt") > min_ret), n, by)
        .join(ends, [*by, "rn"], "left")
        .select(
            *by, *tl.order, price, "trgt", "t1", "t1_rn",
            C("rn").alias("start_rn"),
            F.coalesce("t1_rn", "n_rows").alias("end_rn"),
            _beyond(C(price) * next_up, True).alias("upper"),
            _beyond(C(price) * next_dn, False).alias("lower"),
        )
    )
    touched = first_touch(tl, materialize(events, "events"), price)
    return touched.select(
        *by, *tl.order, price, "trgt", "start_rn",
        F.coalesce("touch_rn", "t1_rn").alias("end_rn"),
        F.coalesce("touch_ts", "t1").alias("t1"),
    ).where(C("t1").isNotNull())


def _beyond(level: Column, up: bool) -> Column:
    """Closest double strictly beyond ``level`` (positive prices), so >= means >."""
    ulp = F.abs(level) * 2.0**-52
    return level + ulp if up else level - ulp


def event_bins(tl: Timeline, events: DataFrame, price: str = "Close") -> DataFrame:
    """Return from start to end of each event and its sign."""
    at_end = tl.df.select(*tl.by, C("rn").alias("end_rn"), C(price).alias("_end_price"))
    got = events.join(at_end, [*tl.by, "end_rn"])
    ret = C("_end_price") / C(price) - 1
    return got.withColumn("ret", ret).withColumn("bin", F.signum("ret").cast("int")).drop("_end_price")


# ----------------------------------------------------------------- row targets
def reversal_labels(tl: Timeline, tau: float = 0.35, ret: str = "bar_return", vol: str = "intra_bar_std", ts: str = "ts") -> DataFrame:
    """1 if the next bar's return is not negative and beats this one by ``tau`` volatilities."""
    out = ("label", "t1", "start_rn", "end_rn", "_next")

    def s(w):
        nxt = R.following(C(ret), w)
        ok = (nxt >= 0) & (nxt >= C(ret) + C(vol) * tau)
        return {
            "label": F.when(ok, 1).otherwise(0),
            "t1": R.following(C(ts), w),
            "start_rn": C("rn"),
            "end_rn": C("rn") + 1,
            "_next": nxt,
        }

    return tl.apply(Recipe(out, (s,), (ret, vol, ts), 0, 1)).df.where(C("_next").isNotNull()).drop("_next")


def price_change_target(
    tl: Timeline, method: str = "fixed_pct", pct_threshold: float = 0.01,
    std_fraction: float = 1.0, window: int = 168, price: str = "Close", out: str = "target",
) -> Timeline:
    """Next row's change against a fixed or a rolling-deviation threshold."""
    if method not in ("fixed_pct", "std_dev"):
        raise ValueError(f"unknown method: {method}")

    def s1(w):
        return {"_r": R.pct(C(price), w)}

    def s2(w):
        nxt = R.following(C("_r"), w)
        if method == "fixed_pct":
            return {out: F.when(nxt < -pct_threshold, -1).when(nxt > pct_threshold, 1).otherwise(0)}
        band = R.std(C("_r"), window, w) * std_fraction
        return {out: _sign_label(nxt, band, -band)}

    back = 1 if method == "fixed_pct" else window + 1
    return tl.apply(Recipe((out,), (s1, s2), (price,), back, 1))


def direction_target(tl: Timeline, price: str = "Close", signed: bool = False, out: str = "target") -> Timeline:
    """Whether the next row is higher, as 1/0 or as 1/-1."""

    def s(w):
        up = R.following(C(price), w) / C(price) - 1 > 0
        return {out: F.when(up, 1).otherwise(-1 if signed else 0)}

    return tl.apply(Recipe((out,), (s,), (price,), 0, 1))


def next_close_target(tl: Timeline, price: str = "Close", out: str = "target") -> DataFrame:
    done = tl.apply(Recipe((out,), (lambda w: {out: R.following(C(price), w)},), (price,), 0, 1))
    return done.df.where(C(out).isNotNull())


def next_row_end(tl: Timeline, ts: str = "ts", out: str = "t1") -> Timeline:
    return tl.apply(Recipe((out,), (lambda w: {out: R.following(C(ts), w)},), (ts,), 0, 1))


def meta_label(primary: Column, truth: Column) -> Column:
    """1 if the primary model was right."""
    return F.when(primary == truth, 1).otherwise(0)


# ------------------------------------------------------------------------ peaks
def peaks(tl: Timeline, x: str, threshold: float = 0.0, distance: int = 1) -> DataFrame:
    """Strict local maxima (plateaus at their middle) with a minimum drop and distance.

    Equal neighbours are collapsed to islands first.  Island numbers are gapless,
    so the islands form a chunked series of their own.
    """
    def s(w):
        return {"_new": F.when(R.prev(C(x), w).eqNullSafe(C(x)) & (C("rn") > 1), None).otherwise(1)}

    marked = tl.apply(Recipe(("_new",), (s,), (x,), 1), keep=[x]).running(keep=[x], _isle=("count", "_new"))
    isles = marked.df.groupBy(*tl.by, "_isle").agg(
        F.first(x).alias("v"), F.min("rn").alias("_a"), F.max("rn").alias("_b")
    )
    series = Timeline(isles.withColumn("rn", C("_isle")), tl.by, ("rn",), tl.chunk_rows)

    def sides(w):
        return {"_l": R.prev(C("v"), w), "_r": R.following(C("v"), w)}

    around = series.apply(Recipe(("_l", "_r"), (sides,), ("v",), 1, 1)).df
    drop = F.when(C("_a") == C("_b"), C("v") - F.greatest("_l", "_r")).otherwise(F.lit(0.0))
    found = around.where(
        (C("v") > C("_l")) & (C("v") > C("_r")) & (drop >= threshold)
    ).select(*tl.by, F.floor((C("_a") + C("_b")) / 2).cast("bigint").alias("rn"), "v")
    return found if distance <= 1 else _thin(found, tl, distance)


def _thin(found: DataFrame, tl: Timeline, distance: int) -> DataFrame:
    """Keep-highest thinning: peaks are taken from the highest down, each drops those nearer than ``distance``.

    A chunk settles its peaks in order of height in one go.  A peak waits only if a higher one within ``distance`` waits
    behind a chunk border; settled states travel over borders, so a round per border that a rising run of peaks crosses is
    the most that is needed, and what is settled never changes.
    """
    keys = (*tl.by, "_t")
    todo = materialize(found.select(*tl.by, "rn", "v", F.lit(0).alias("_state")), "peaks")
    schema = todo.schema

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        rn, state, core = (pdf[c].to_numpy().copy() for c in ("rn", "_state", "_core"))
        order = np.lexsort((-rn, -pdf["v"].to_numpy()))
        place = np.empty(len(rn), np.int64)
        place[order] = np.arange(len(rn))
        low, high = np.searchsorted(rn, rn - distance, "right"), np.searchsorted(rn, rn + distance)
        for i in order[(core & (state == 0))[order]].tolist():
            near = slice(low[i], high[i])
            higher = state[near][place[near] < place[i]]
            state[i] = -1 if (higher == 1).any() else 0 if (higher == 0).any() else 1
        return pdf.assign(_state=state).loc[core, schema.names]

    while not todo.where(C("_state") == 0).isEmpty():
        near = Timeline(todo, tl.by, ("rn",), tl.chunk_rows).halo(back=distance, fwd=distance)
        todo = materialize(near.groupBy(*keys).applyInPandas(settle, schema), "peaks")
    return todo.where(C("_state") == 1).drop("_state")


def oscillator_target(
    tl: Timeline, method: str = "ao_on_pct_change", peak_distance: int = 1,
    peak_threshold: float = 0.0, std_fraction: float = 1.0, out: str = "target",
) -> DataFrame:
    """1 at tops and -1 at bottoms of an oscillator; ``pct_change_std`` uses the deviation rule."""
    if method == "pct_change_std":
        return price_change_target(tl, "std_dev", std_fraction=std_fraction, out=out).df
    mid = {"_hi": C("High"), "_lo": C("Low")}
    if method == "ao_on_pct_change":
        def base(w):
            return {
                k: F.coalesce(R.pct(c, w), F.lit(0.0)) for k, c in mid.items()
            }
    elif method in ("ao_on_price", "pct_change_on_ao"):
        def base(w):
            return mid
    else:
        raise ValueError(f"unknown method: {method}")

    def osc(w):
        m = (C("_hi") + C("_lo")) / 2
        return {"_ao": R.mean(m, 5, w) - R.mean(m, 34, w)}

    def final(w):
        if method != "pct_change_on_ao":
            return {"_x": C("_ao")}
        return {"_x": F.coalesce(R.pct(C("_ao"), w), F.lit(0.0))}

    keep = list(tl.df.columns)
    ready = tl.apply(Recipe(("_x",), (base, osc, final), ("High", "Low"), 36), keep=keep)
    ready = ready.settle()
    tops = peaks(ready, "_x", peak_threshold, peak_distance).select(*tl.by, "rn", F.lit(1).alias("_top"))
    lows = peaks(ready.extend(_x=-C("_x")), "_x", peak_threshold, peak_distance)
    lows = lows.select(*tl.by, "rn", F.lit(-1).alias("_low"))
    keys = [*tl.by, "rn"]
    return (
        ready.df.drop("_x").join(tops, keys, "left").join(lows, keys, "left")
        .withColumn(out, F.coalesce("_low", "_top", F.lit(0))).drop("_top", "_low")
    )
