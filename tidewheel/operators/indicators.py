"""Technical indicators with bounded look-back, as recipes for ``Timeline.apply``.

Every function names its outputs explicitly and states how many rows it reaches
back, so any set of them runs in one pass over one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions import rolling as R
from tidewheel.timeline import Recipe

C = F.col


def _one(out: str, cols: tuple[str, ...], back: int, *stages, fwd: int = 0) -> Recipe:
    return Recipe((out,), tuple(stages), cols, back, fwd)


# ------------------------------------------------------------------ basic series
def pct_change(x: str = "Close", periods: int = 1, out: str = "pct_change", fill: float | None = None) -> Recipe:
    def s(w):
        v = R.pct(C(x), w, periods)
        return {out: v if fill is None else F.coalesce(v, F.lit(fill))}

    return _one(out, (x,), periods, s)


def price_difference(x: str = "Close", out: str = "price_difference") -> Recipe:
    """Fractional change with 0 on the first row."""
    return pct_change(x, 1, out, 0.0)


def lag(x: str, k: int = 1, out: str | None = None) -> Recipe:
    out = out or f"{x}_lag_{k}"
    return _one(out, (x,), k, lambda w: {out: R.prev(C(x), w, k)})


def sma(x: str = "Close", n: int = 20, out: str = "sma") -> Recipe:
    return _one(out, (x,), n, lambda w: {out: R.mean(C(x), n, w)})


def rolling_std(x: str = "Close", n: int = 20, out: str = "std") -> Recipe:
    return _one(out, (x,), n, lambda w: {out: R.std(C(x), n, w)})


def rolling_sum(x: str = "Close", n: int = 20, out: str = "sum") -> Recipe:
    return _one(out, (x,), n, lambda w: {out: R.total(C(x), n, w)})


def momentum(x: str = "Close", n: int = 10, out: str = "momentum") -> Recipe:
    return _one(out, (x,), n, lambda w: {out: C(x) - R.prev(C(x), w, n)})


def roc(x: str = "Close", n: int = 10, out: str = "roc") -> Recipe:
    def s(w):
        base = R.prev(C(x), w, n)
        change = C(x) - base
        v = F.when((base == 0) & (change != 0), F.lit(0.0)).otherwise(F.try_divide(change, base))
        return {out: v * 100}

    return _one(out, (x,), n, s)


def rolling_z_score(x: str = "Close", n: int = 20, out: str = "zscore") -> Recipe:
    """Distance from the rolling mean in population standard deviations."""

    def s(w):
        sd = R.rolling(F.stddev_pop, C(x), n, w)
        return {out: (C(x) - R.mean_by_blocks(C(x), n, w)) / R.nonzero(sd)}

    return _one(out, (x,), n, s)


# ------------------------------------------------------------- ranges, channels
def _tr(h: str, low: str, c: str, w) -> Column:
    p = R.prev(C(c), w)
    return F.greatest(C(h) - C(low), F.abs(C(h) - p), F.abs(C(low) - p))


def true_range(h="High", low="Low", c="Close", out: str = "true_range") -> Recipe:
    return _one(out, (h, low, c), 1, lambda w: {out: _tr(h, low, c, w)})


def awesome_oscillator(h="High", low="Low", fast: int = 5, slow: int = 34, out: str = "ao") -> Recipe:
    mid = (C(h) + C(low)) / 2
    return _one(
        out, (h, low), max(fast, slow), lambda w: {out: R.mean(mid, fast, w) - R.mean(mid, slow, w)}
    )


def money_flow_index(h="High", low="Low", c="Close", v="Volume", n: int = 14, out: str = "mfi") -> Recipe:
    """Sums need no full window; only inflow gives 100, no flow at all gives null."""
    tp = (C(h) + C(low) + C(c)) / 3

    def flows(w):
        p = R.prev(tp, w)
        return {
            f"_{out}_pos": R.true_or_zero(tp > p, tp * C(v)),
            f"_{out}_neg": R.true_or_zero(tp < p, tp * C(v)),
        }

    def ratio(w):
        f = w.rowsBetween(-(n - 1), 0)
        pos, neg = F.sum(f"_{out}_pos").over(f), F.sum(f"_{out}_neg").over(f)
        # ratio -1 gives an infinite index, which is reported as 100 too
        r = F.try_divide(pos, neg)
        idx = F.when(r == -1, F.lit(100.0)).otherwise(100 - F.try_divide(F.lit(100.0), 1 + r))
        return {
            out: F.when((neg == 0) & (pos != 0), F.lit(100.0)).when(neg != 0, idx)
        }

    return _one(out, (h, low, c, v), n + 1, flows, ratio)


def stochastic(
    h="High", low="Low", c="Close", n: int = 14, d_n: int = 3, out=("stoch_k", "stoch_d")
) -> Recipe:
    k, d = out

    def s1(w):
        lo, hi = R.lowest(C(low), n, w), R.highest(C(h), n, w)
        return {k: 100 * ((C(c) - lo) / R.nonzero(hi - lo))}

    return Recipe((k, d), (s1, lambda w: {d: R.mean(C(k), d_n, w)}), (h, low, c), n + d_n)


def stochastic_series(x: str, n: int, out: str = "stoch") -> Recipe:
    def s(w):
        lo, hi = R.lowest(C(x), n, w), R.highest(C(x), n, w)
        return {out: 100 * ((C(x) - lo) / R.nonzero(hi - lo))}

    return _one(out, (x,), n, s)


def williams_r(h="High", low="Low", c="Close", n: int = 14, out: str = "willr") -> Recipe:
    def s(w):
        lo, hi = R.lowest(C(low), n, w), R.highest(C(h), n, w)
        return {out: -100 * (hi - C(c)) / R.nonzero(hi - lo)}

    return _one(out, (h, low, c), n, s)


def ultimate_oscillator(
    h="High", low="Low", c="Close", fast: int = 7, medium: int = 14, slow: int = 28, out: str = "uo"
) -> Recipe:
    def s1(w):
        p = F.coalesce(R.prev(C(c), w), C(c))
        return {f"_{out}_bp": C(c) - F.least(C(low), p), f"_{out}_tr": _tr(h, low, c, w)}

    def s2(w):
        a = [
            R.total(C(f"_{out}_bp"), n, w) / R.nonzero(R.total(C(f"_{out}_tr"), n, w))
            for n in (fast, medium, slow)
        ]
        return {out: 100 * (4 * a[0] + 2 * a[1] + a[2]) / 7}

    return _one(out, (h, low, c), max(fast, medium, slow) + 1, s1, s2)


def aroon(h="High", low="Low", n: int = 14, out=("aroon_up", "aroon_down")) -> Recipe:
    """Rows since the extreme; the oldest of equal extremes counts."""
    up, dn = out

    def s(w):
        f = w.rowsBetween(-(n - 1), 0)

        def pos(x: str, agg) -> Column:
            at = F.array_position(F.collect_list(x).over(f), agg(x).over(f))
            return F.when(F.count(x).over(f) == n, 100.0 * at / n)

        return {up: pos(h, F.max), dn: pos(low, F.min)}

    return Recipe((up, dn), (s,), (h, low), n)


def cci(h="High", low="Low", c="Close", n: int = 20, k: float = 0.015, out: str = "cci") -> Recipe:
    """Mean absolute deviation is taken about the mean of the same window."""
    tp = (C(h) + C(low) + C(c)) / 3

    def s1(w):
        f = w.rowsBetween(-(n - 1), 0)
        full = F.count(tp).over(f) == n
        return {
            f"_{out}_tp": tp,
            f"_{out}_m": F.when(full, F.avg(tp).over(f)),
            f"_{out}_l": F.when(full, F.collect_list(tp).over(f)),
        }

    def s2(w):
        dev = F.aggregate(
            f"_{out}_l", F.lit(0.0), lambda acc, x: acc + F.abs(x - C(f"_{out}_m"))
        )
        return {out: (C(f"_{out}_tp") - C(f"_{out}_m")) / R.nonzero(k * dev / n)}

    return _one(out, (h, low, c), n, s1, s2)


def rsi(x: str = "Close", n: int = 14, out: str = "rsi") -> Recipe:
    """Simple-average form; no losses gives 100, no movement gives null."""

    def s1(w):
        d = C(x) - R.prev(C(x), w)
        return {f"_{out}_g": R.true_or_zero(d > 0, d), f"_{out}_l": R.true_or_zero(d < 0, -d)}

    def s2(w):
        g, lo = R.mean(C(f"_{out}_g"), n, w), R.mean(C(f"_{out}_l"), n, w)
        return {
            out: F.when((lo == 0) & (g > 0), F.lit(100.0)).otherwise(
                100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(g, lo))
            )
        }

    return _one(out, (x,), n + 1, s1, s2)


def vortex(h="High", low="Low", c="Close", n: int = 14, out=("vi_plus", "vi_minus")) -> Recipe:
    p, m = out

    def s1(w):
        return {
            f"_{p}_p": F.abs(C(h) - R.prev(C(low), w)),
            f"_{p}_m": F.abs(C(low) - R.prev(C(h), w)),
            f"_{p}_tr": _tr(h, low, c, w),
        }

    def s2(w):
        tr = R.nonzero(R.total(C(f"_{p}_tr"), n, w))
        return {p: R.total(C(f"_{p}_p"), n, w) / tr, m: R.total(C(f"_{p}_m"), n, w) / tr}

    return Recipe((p, m), (s1, s2), (h, low, c), n + 1)


def bollinger(
    x: str = "Close", n: int = 20, k: float = 2.0, out=("bbp", "bb_upper", "bb_lower")
) -> Recipe:
    p, u, lo = out

    def s1(w):
        m, sd = R.mean_by_blocks(C(x), n, w), R.std(C(x), n, w)
        return {u: m + k * sd, lo: m - k * sd}

    return Recipe(
        (p, u, lo), (s1, lambda w: {p: (C(x) - C(lo)) / R.nonzero(C(u) - C(lo))}), (x,), n
    )


def donchian(h="High", low="Low", n: int = 20, out=("dc_upper", "dc_lower")) -> Recipe:
    u, lo = out
    return Recipe(
        (u, lo), (lambda w: {u: R.highest(C(h), n, w), lo: R.lowest(C(low), n, w)},), (h, low), n
    )


# ---------------------------------------------------------------------- volume
def volume_oscillator(v: str = "Volume", short: int = 14, long: int = 28, out: str = "vo") -> Recipe:
    def s(w):
        a, b = R.mean(C(v), short, w), R.mean(C(v), long, w)
        return {out: 100 * (a - b) / R.nonzero(b)}

    return _one(out, (v,), max(short, long), s)


def chaikin_money_flow(h="High", low="Low", c="Close", v="Volume", n: int = 20, out: str = "cmf") -> Recipe:
    mult = ((C(c) - C(low)) - (C(h) - C(c))) / R.nonzero(C(h) - C(low))

    def s(w):
        return {out: R.total(mult * C(v), n, w) / R.nonzero(R.total(C(v), n, w))}

    return _one(out, (h, low, c, v), n, s)


# ------------------------------------------------------------- feature blocks
def lag_block(lags: int = 5, cols=("Open", "High", "Low", "Close")) -> Recipe:
    """Lags 1..n of the fractional change of each price (first change is 0)."""
    base = {f"_{c.lower()}_pct": c for c in cols}

    def s1(w):
        return {b: F.coalesce(R.pct(C(c), w), F.lit(0.0)) for b, c in base.items()}

    names = {
        f"{c.lower()}_pct_lag_{k}": (f"_{c.lower()}_pct", k)
        for k in range(1, lags + 1)
        for c in cols
    }

    def s2(w):
        # rows before the series starts have no lag, even though a change of 0 is filled in
        return {o: R.prev(C(b), w, k) for o, (b, k) in names.items()}

    return Recipe(tuple(names), (s1, s2), tuple(cols), lags + 2)


def return_stats(x: str = "Close", n: int = 20) -> Recipe:
    """Rolling sum, mean, deviation and z-score of the fractional change."""
    out = ("returns_roll_sum", "returns_roll_mean", "returns_roll_std", "returns_z_score")

    def s1(w):
        return {"_ret": F.coalesce(R.pct(C(x), w), F.lit(0.0))}

    def s2(w):
        r = C("_ret")
        m = R.mean(r, n, w)
        return {
            out[0]: R.total(r, n, w),
            out[1]: m,
            out[2]: R.std(r, n, w),
            out[3]: (r - m) / R.nonzero(R.rolling(F.stddev_pop, r, n, w)),
        }

    return Recipe(out, (s1, s2), (x,), n + 1)


def bar_lag_features(ret: str = "bar_return", vol: str = "intra_bar_std", n: int = 5) -> Recipe:
    """Previous bar's return and volatility with rolling mean and deviation of the lagged return."""
    out = ("lag_return", "lag_volatility", "lag_return_mean", "lag_return_std")

    def s1(w):
        return {out[0]: R.prev(C(ret), w), out[1]: R.prev(C(vol), w)}

    def s2(w):
        return {out[2]: R.mean(C(out[0]), n, w), out[3]: R.std(C(out[0]), n, w)}

    return Recipe(out, (s1, s2), (ret, vol), n + 1)


def compact_features(x: str = "Close") -> tuple[Recipe, ...]:
    """Small set: RSI, momentum, volatility, return, ratio of averages, band width."""

    def s1(w):
        m20, sd20 = R.mean(C(x), 20, w), R.std(C(x), 20, w)
        return {
            "volatility": sd20,
            "lagged_return": R.pct(C(x), w),
            "sma_ratio": F.try_divide(m20, R.mean(C(x), 50, w)),
            "bb_width": F.try_divide(4 * sd20, m20),
        }

    block = Recipe(("volatility", "lagged_return", "sma_ratio", "bb_width"), (s1,), (x,), 50)
    return (rsi(x, 14, "rsi"), momentum(x, 10, "momentum"), block)
