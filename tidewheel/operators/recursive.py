"""Exponential and other recursive indicators.

Exponential averages forget: after ``ceil(40 / -ln(1 - alpha))`` rows an earlier
value weighs less than 1e-17 of the result, below double rounding.  A halo of
that many *values* therefore gives the same doubles as a scan from the first row,
in one pass and without any carry.  Where a series has few nulls, so many rows
more hold them all; otherwise every chunk gets its last values from as far back as
they lie (:meth:`Timeline.values_halo`), and a run of nulls in between counts as one
of that length, after which older values weigh as little.  Series that forget slowly
or never (KAMA, running sums) use the exact carry kernels instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewheel.functions import rolling as R
from tidewheel.operators.scans import affine
from tidewheel.timeline import Recipe, Timeline

C = F.col


def reach(span: float) -> int:
    """Rows after which an exponential average of ``span`` has forgotten its start."""
    alpha = 2.0 / (span + 1.0)
    return 1 if alpha >= 1 else math.ceil(40.0 / -math.log1p(-alpha)) + 1


def ema(x: pd.Series, span: float) -> pd.Series:
    return x.ewm(span=span, adjust=False).mean()


def _nz(x: pd.Series) -> pd.Series:
    return x.replace(0.0, R.EPS)


def nulls_within(tl: Timeline, sources: Sequence[str]) -> int:
    """Most values that any key lacks in these columns together (NaN counts as none)."""
    known = [c for c in sources if tl.df.schema[c].nullable]
    if not known:
        return 0
    lacking = sum((F.count_if(C(c).isNull() | F.isnan(C(c).cast("double"))) for c in known), F.lit(0))
    return tl.df.groupBy(*tl.by).agg(lacking.alias("n")).agg(F.max("n")).head()[0] or 0


def smooth(tl: Timeline, fn, out, cols, back, keep=None, sources: tuple[Timeline, Sequence[str]] | None = None, nonzero: Sequence[str] = ()) -> Timeline:
    """``fn`` over chunks that see the last ``back`` values of ``cols``.

    ``sources`` are the settled columns behind derived ``cols``, each made from a
    row and the one before it, so a null there makes at most two here.
    """
    keep = list(tl.df.columns) if keep is None else list(keep)
    types = {n: "double" for n in out}
    behind, names = sources or (tl, cols)
    if sources is None and not tl.settled:
        tl = behind = tl.settle([*dict.fromkeys([*keep, *cols])])
    lacking = 2 * nulls_within(behind, names) + 2
    if lacking <= max(back, tl.chunk_rows):
        done = tl.map_chunks(fn, types, cols, back=back + lacking, keep=keep)
    else:
        done = tl.map_chunks(fn, types, cols, back=back, keep=keep, remember=True, nonzero=nonzero)
    # pandas marks a missing value by NaN
    return done.with_df(done.df.withColumns({n: F.nanvl(C(n), F.lit(None)) for n in out}))


def ewm(tl: Timeline, x: str = "Close", spans: dict[str, float] | None = None, keep=None) -> Timeline:
    """Exponential means of one column, one output per entry of ``spans``."""
    spans = spans or {"ewm": 20}

    def fn(pdf):
        return {o: ema(pdf[x], s).to_numpy() for o, s in spans.items()}

    return smooth(tl, fn, list(spans), [x], max(map(reach, spans.values())), keep)


def macd(tl: Timeline, x="Close", fast=12, slow=26, signal=9, out=("macd", "macd_signal", "macd_hist"), keep=None) -> Timeline:
    def fn(pdf):
        line = ema(pdf[x], fast) - ema(pdf[x], slow)
        sig = ema(line, signal)
        return dict(zip(out, (line.to_numpy(), sig.to_numpy(), (line - sig).to_numpy())))

    return smooth(tl, fn, out, [x], max(reach(fast), reach(slow)) + reach(signal), keep)


def ewm_recipe_inputs(h="High", low="Low", c="Close") -> Recipe:
    """Row-level inputs of the smoothed indicators: true range, directional moves, changes."""

    def s(w):
        p = R.prev(C(c), w)
        up, down = C(h) - R.prev(C(h), w), R.prev(C(low), w) - C(low)
        return {
            "_tr": F.greatest(C(h) - C(low), F.abs(C(h) - p), F.abs(C(low) - p)),
            "_pdm": R.true_or_zero((up > down) & (up > 0), up),
            "_mdm": R.true_or_zero((down > up) & (down > 0), down),
            "_pc": C(c) - p,
        }

    return Recipe(("_tr", "_pdm", "_mdm", "_pc"), (s,), (h, low, c), 1)


HLC = ("High", "Low", "Close")
#: only the ratio of their means counts, which zeros do not change: what makes it are the last other values
MOVES = ("_pdm", "_mdm")


def _inputs(tl: Timeline, keep, c: str = "Close") -> tuple[Timeline, Timeline]:
    """The settled series and its row-level inputs."""
    tl = tl.settle()
    return tl, tl.apply(ewm_recipe_inputs(c=c), keep=keep)


def atr(tl: Timeline, n: int = 14, out: str = "atr", keep=None) -> Timeline:
    """Exponential mean of the true range with span 2n - 1."""
    keep = list(tl.df.columns) if keep is None else list(keep)
    tl, pre = _inputs(tl, keep)
    return smooth(pre, lambda p: {out: ema(p["_tr"], 2 * n - 1).to_numpy()}, [out], ["_tr"], reach(2 * n - 1), keep, (tl, HLC))


def _tsi(pc: pd.Series, fast: int, slow: int, signal: int):
    num = ema(ema(pc, fast), slow)
    den = ema(ema(pc.abs(), fast), slow)
    t = 100 * num / _nz(den)
    return t, ema(t, signal)


def true_strength_index(tl: Timeline, fast=13, slow=25, signal=13, out=("tsi", "tsi_signal"), keep=None) -> Timeline:
    keep = list(tl.df.columns) if keep is None else list(keep)
    tl, pre = _inputs(tl, keep)

    def fn(p):
        return dict(zip(out, (s.to_numpy() for s in _tsi(p["_pc"], fast, slow, signal))))

    return smooth(pre, fn, out, ["_pc"], reach(fast) + reach(slow) + reach(signal), keep, (tl, HLC))


def _adx(p: pd.DataFrame, n: int):
    span = 2 * n - 1
    base = _nz(ema(p["_tr"], span))
    pdi, mdi = (100 * ema(p[c].fillna(0.0), span) / base for c in MOVES)  # a row always has moves
    dx = 100 * (pdi - mdi).abs() / _nz(pdi + mdi)
    return ema(dx, span), pdi, mdi


def adx(tl: Timeline, n: int = 14, out=("adx", "dmp", "dmn"), keep=None) -> Timeline:
    keep = list(tl.df.columns) if keep is None else list(keep)
    tl, pre = _inputs(tl, keep)

    def fn(p):
        return dict(zip(out, (s.to_numpy() for s in _adx(p, n))))

    return smooth(pre, fn, out, ["_tr", "_pdm", "_mdm"], 2 * reach(2 * n - 1), keep, (tl, HLC), MOVES)


def _stoch(x: pd.Series, n: int) -> pd.Series:
    lo, hi = x.rolling(n).min(), x.rolling(n).max()
    return 100 * (x - lo) / _nz(hi - lo)


def _stc(x: pd.Series, fast: int, slow: int, n: int, signal: int):
    d = ema(_stoch(ema(x, fast) - ema(x, slow), n), signal)
    k2 = _stoch(d, n)
    return ema(k2, signal), k2


def _stc_reach(fast, slow, n, signal) -> int:
    return max(reach(fast), reach(slow)) + 2 * (n + reach(signal))


def schaff_trend_cycle(tl: Timeline, x="Close", fast=23, slow=50, n=10, signal=3, out=("stc", "stc_stoch"), keep=None) -> Timeline:
    def fn(p):
        return dict(zip(out, (s.to_numpy() for s in _stc(p[x], fast, slow, n, signal))))

    return smooth(tl, fn, out, [x], _stc_reach(fast, slow, n, signal), keep)


def keltner(tl: Timeline, n_ema=20, n_atr=20, mult=2.0, c="Close", out=("kc_upper", "kc_lower"), keep=None) -> Timeline:
    keep = list(tl.df.columns) if keep is None else list(keep)
    tl, pre = _inputs(tl, list(dict.fromkeys([*keep, c])), c)

    def fn(p):
        mid, width = ema(p[c], n_ema), mult * ema(p["_tr"], 2 * n_atr - 1)
        return {out[0]: (mid + width).to_numpy(), out[1]: (mid - width).to_numpy()}

    return smooth(pre, fn, out, [c, "_tr"], max(reach(n_ema), reach(2 * n_atr - 1)), keep, (tl, ("High", "Low", c)))


# ------------------------------------------------------------------ exact carries
def kama(tl: Timeline, x: str = "Close", n: int = 10, fast: int = 2, slow: int = 30, out: str = "kama", keep=None) -> Timeline:
    """Adaptive mean seeded with the n-th value; a missing constant repeats the last value.

    Shorter series than ``n`` give nulls only (the smoothing never starts).
    """
    keep = list(tl.df.columns) if keep is None else list(keep)
    a, b = 2.0 / (fast + 1), 2.0 / (slow + 1)

    def s1(w):
        return {"_move": F.abs(C(x) - R.prev(C(x), w))}

    def s2(w):
        change = F.abs(C(x) - R.prev(C(x), w, n))
        er = change / R.nonzero(R.total(C("_move"), n, w))
        return {"_sc": F.pow(er * (a - b) + b, F.lit(2.0))}

    pre = tl.apply(Recipe(("_sc",), (s1, s2), (x,), n + 1), keep=list(dict.fromkeys([*keep, x])))
    moving = (C("rn") > n) & C("_sc").isNotNull() & C(x).isNotNull()
    seed = C("rn") == n
    ready = pre.extend(
        _m=F.when(moving, 1 - C("_sc")).when(seed, F.lit(0.0)).otherwise(F.lit(1.0)),
        _b=F.when(moving, C("_sc") * C(x)).when(seed, F.coalesce(C(x), F.lit(float("nan")))).otherwise(F.lit(0.0)),
    )
    done = affine(ready, "_m", "_b", out, keep=keep)
    return done.with_df(done.df.withColumn(out, F.when(C("rn") >= n, F.nanvl(C(out), F.lit(None)))))


def kalman_level(tl: Timeline, x: str = "Close", out: str = "kalman", keep=None) -> Timeline:
    """Local-level filter with unit variances and initial mean 0.

    The gain depends on the row number alone: the filtered variance is a ratio
    of consecutive odd and even Fibonacci numbers and settles after 40 rows.
    """
    gains = []
    var = 1.0
    for i in range(60):
        pred = var if i == 0 else var + 1.0
        k = pred / (pred + 1.0)
        var = (1.0 - k) * pred
        gains.append(k)
    table = F.array(*(F.lit(g) for g in gains))
    gain = F.element_at(table, F.least(C("rn"), F.lit(len(gains))).cast("int"))
    known = C(x).isNotNull()
    ready = tl.extend(
        _m=F.when(known, 1 - gain).otherwise(F.lit(1.0)),
        _b=F.when(known, gain * C(x)).otherwise(F.lit(0.0)),
    )
    keep = list(tl.df.columns) if keep is None else list(keep)
    return affine(ready, "_m", "_b", out, keep=keep)


def volume_price_trend(tl: Timeline, c="Close", v="Volume", out: str = "vpt", keep=None) -> Timeline:
    """Running sum of volume times fractional change; null where the term is null."""
    keep = list(tl.df.columns) if keep is None else list(keep)
    pre = tl.apply(
        Recipe(("_term",), (lambda w: {"_term": C(v) * R.pct(C(c), w)},), (c, v), 1), keep=keep
    )
    done = pre.running(keep=[*keep, "_term"], _run=("sum", "_term"))
    res = done.df.withColumn(out, F.when(C("_term").isNotNull(), C("_run")))
    return done.with_df(res.select(*dict.fromkeys([*tl.by, "rn", *keep, out])))


# --------------------------------------------------------- smoothed feature block
def smoothed_features(tl: Timeline, keep) -> Timeline:
    """All exponentially smoothed columns of the feature table in one pass."""

    def s(w):
        return {"_cpct": F.coalesce(R.pct(C("Close"), w), F.lit(0.0))}

    tl = tl.settle()
    pre = tl.apply(ewm_recipe_inputs(), Recipe(("_cpct",), (s,), ("Close",), 1), keep=keep)
    emas = (10, 15, 20, 30, 40, 50, 60)
    out = [
        "MACD_pct", "MACD_Signal_pct", "MACD_Hist_pct", "TSI_25_13", "TSIs_25_13",
        "MACD", "MACD_Signal", "MACD_Hist", "ADX_14", "DMP_14", "DMN_14",
        "STC_10_23_50", "STCst_10_23_50", "_kcu", "_kcl", *(f"_ema_{e}" for e in emas),
    ]

    def fn(p):
        c = p["Close"]
        res = {}
        for tag, x in (("", c), ("_pct", p["_cpct"])):
            line = ema(x, 12) - ema(x, 26)
            sig = ema(line, 9)
            res[f"MACD{tag}"], res[f"MACD_Signal{tag}"], res[f"MACD_Hist{tag}"] = line, sig, line - sig
        res["TSI_25_13"], res["TSIs_25_13"] = _tsi(p["_pc"], 13, 25, 13)
        res["ADX_14"], res["DMP_14"], res["DMN_14"] = _adx(p, 14)
        res["STC_10_23_50"], res["STCst_10_23_50"] = _stc(c, 23, 50, 10, 3)
        width = 2.0 * ema(p["_tr"], 39)
        mid = ema(c, 20)
        res["_kcu"], res["_kcl"] = mid + width, mid - width
        for e in emas:
            res[f"_ema_{e}"] = ema(c, e)
        return {k: np.asarray(v, dtype=float) for k, v in res.items()}

    back = max(
        reach(26) + reach(9), reach(13) + reach(25) + reach(13), 2 * reach(27),
        _stc_reach(23, 50, 10, 3), reach(60), reach(39),
    )
    return smooth(pre, fn, out, ["Close", "_cpct", "_tr", "_pdm", "_mdm", "_pc"], back, keep, (tl, HLC), MOVES)
