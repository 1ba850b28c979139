"""Trading rules as columns: 1 long, -1 short, 0 nothing."""

from __future__ import annotations

from collections.abc import Sequence

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import rolling as R
from tidewheel.operators import indicators as I
from tidewheel.operators.joins import with_grid
from tidewheel.operators.recursive import macd
from tidewheel.operators.scans import guess_and_verify
from tidewheel.timeline import Recipe, Timeline

C = F.col


def cross(a: Column, b: Column, w, strict_prev: bool = True) -> Column:
    """1 where ``a`` moves above ``b``, -1 where it moves below."""
    pa, pb = R.prev(a, w), R.prev(b, w)
    was_below = pa < pb if strict_prev else pa <= pb
    was_above = pa > pb if strict_prev else pa >= pb
    return F.when((a > b) & was_below, 1).when((a < b) & was_above, -1).otherwise(0)


def cross_recipe(a: str, b: str, out: str = "signal", strict_prev: bool = True) -> Recipe:
    return Recipe((out,), (lambda w: {out: cross(C(a), C(b), w, strict_prev)},), (a, b), 1)


def _blocks(w):
    return {"_blocks": R.block_sums(C("Close"), w)}


def _close_mean(n: int, w) -> Column:
    return R.mean_by_blocks(C("Close"), n, w, C("_blocks"))


def ma_cross_on_changes(fast: int = 50, slow: int = 200, out: str = "signal") -> Recipe:
    """Crossing of rolling means of the fractional change."""

    def s1(w):
        return {"_r": R.pct(C("Close"), w)}

    def s2(w):
        return {"_f": R.mean(C("_r"), fast, w), "_s": R.mean(C("_r"), slow, w)}

    return Recipe((out,), (s1, s2, lambda w: {out: cross(C("_f"), C("_s"), w)}), ("Close",), slow + 2)


def band_breach(n: int = 20, k: float = 2.0, out: str = "signal") -> Recipe:
    """Below the lower band long, above the upper band short."""
    bb = I.bollinger("Close", n, k, ("_bp", "_bu", "_bl"))

    def s(w):
        return {out: F.when(C("Close") < C("_bl"), 1).when(C("Close") > C("_bu"), -1).otherwise(0)}

    return Recipe((out,), (*bb.stages, s), ("Close",), n)


def macd_cross(tl: Timeline, fast=12, slow=26, signal=9, strict_prev: bool = True, out: str = "signal") -> Timeline:
    keep = list(tl.df.columns)
    lines = macd(tl, "Close", fast, slow, signal, ("_line", "_sig", "_hist"))
    return lines.apply(cross_recipe("_line", "_sig", out, strict_prev), keep=keep)


def rsi_divergence(n: int = 14, period: int = 30, out: str = "signal") -> Recipe:
    """A lower low with a higher RSI than at the earliest lowest low before, and the mirror."""
    base = I.rsi("Close", n, "_rsi")

    def s(w):
        f = w.rowsBetween(-(period - 1), -1)
        at = lambda agg, k: agg(F.struct(C(k).alias("v"), C("_rsi").alias("r")), k)
        low = at(F.min_by, "_lk").over(f)
        high = at(F.min_by, "_hk").over(f)
        enough = C("rn") >= period + 1
        up = enough & (C("Low") < low["v"]["p"]) & (C("_rsi") > low["r"])
        down = enough & (C("High") > -high["v"]["p"]) & (C("_rsi") < high["r"])
        return {out: F.when(up, 1).when(down, -1).otherwise(0)}

    def keys(w):
        # order by price, then by age: the oldest extreme wins
        return {
            "_lk": F.struct(C("Low").alias("p"), C("rn").alias("i")),
            "_hk": F.struct((-C("High")).alias("p"), C("rn").alias("i")),
        }

    return Recipe((out,), (*base.stages, keys, s), ("Close", "High", "Low"), n + period + 1)


def trend_breakout(n: int = 20, k: float = 2.0, fast: int = 50, slow: int = 200, out: str = "signal") -> Recipe:
    """Band breach in the direction of the averages."""
    bb = I.bollinger("Close", n, k, ("_bp", "_bu", "_bl"))
    first, *others = bb.stages

    def s(w):
        a, b = _close_mean(fast, w), _close_mean(slow, w)
        up = (C("Close") > C("_bu")) & (a > b)
        down = (C("Close") < C("_bl")) & (a < b)
        return {out: F.when(up, 1).when(down, -1).otherwise(0)}

    return Recipe((out,), (lambda w: _blocks(w) | first(w), *others, s), ("Close",), slow)


def level_signal(fast: int = 10, slow: int = 20, out: str = "signal") -> Recipe:
    def s(w):
        return {out: F.when(_close_mean(fast, w) > _close_mean(slow, w), 1).otherwise(0)}

    return Recipe((out,), (_blocks, s), ("Close",), slow)


def trend_side(n: int = 50, out: str = "signal") -> Recipe:
    def s(w):
        m = _close_mean(n, w)
        return {out: F.when(C("Close") > m, 1).when(C("Close") < m, -1).otherwise(0)}

    return Recipe((out,), (_blocks, s), ("Close",), n)


def forecast_signal(rows: DataFrame, predictions: DataFrame, keys: Sequence[str], column: str, threshold: float, target: str = "nominal", out: str = "signal") -> DataFrame:
    """Forecast beyond the close by a share (``nominal``) or beyond a fixed band (``diff``)."""
    up = C("Close") * (1 + threshold) if target == "nominal" else F.lit(threshold)
    down = C("Close") * (1 - threshold) if target == "nominal" else F.lit(-threshold)
    got = rows.join(predictions.select(*keys, column), list(keys))
    return got.withColumn(out, F.when(C(column) > up, 1).when(C(column) < down, -1).otherwise(0))


def down_streak(tl: Timeline, k: int, out: str = "signal") -> Timeline:
    """At least ``k`` lower closes in a row."""
    keep = list(tl.df.columns)

    def s(w):
        down = C("Close") < R.prev(C("Close"), w)
        return {"_break": F.when(F.coalesce(down, F.lit(False)), None).otherwise(C("rn"))}

    marked = tl.apply(Recipe(("_break",), (s,), ("Close",), 1), keep=keep)
    done = marked.running(keep=keep, _last=("last", "_break"))
    streak = C("rn") - C("_last")
    return done.with_df(
        done.df.withColumns({"streak": streak, out: F.when(streak >= k, 1).otherwise(0)}).drop("_last")
    )


def hold_position(tl: Timeline, signal: str, out: str = "position") -> Timeline:
    """Keep the last non-zero signal."""
    done = tl.extend(_s=F.when(C(signal) != 0, C(signal))).running(keep=list(tl.df.columns), _p=("last", "_s"))
    return done.with_df(done.df.withColumn(out, F.coalesce("_p", F.lit(0))).drop("_p"))


def on_bar_close(rows: DataFrame, bars: DataFrame, keys: Sequence[str], signal: str) -> DataFrame:
    """The bar's signal on the row that closes it, 0 elsewhere."""
    b = bars.select(*keys, C(signal).alias("_s"))
    return rows.join(b, list(keys), "left").withColumn(signal, F.coalesce("_s", F.lit(0))).drop("_s")


def path_returns(signal: str, shift: int = 1, out: str = "ret") -> Recipe:
    """Change times signal; ``shift=0`` uses the signal of the same row (look-ahead)."""

    def s(w):
        pos = R.prev(C(signal), w, shift) if shift else C(signal)
        return {out: F.coalesce(R.pct(C("Close"), w) * pos, F.lit(0.0))}

    return Recipe((out,), (s,), ("Close", signal), max(1, shift))


def swings(tl: Timeline, share: float = 0.025, mode: str = "aggressive", warm_up: int = 5_000) -> DataFrame:
    """Zig-zag segmentation: direction, running extreme, reversal and entry signal per row.

    ``aggressive`` trades at the reversal, ``conservative`` when the swing breaks
    the extreme of the swing before last.
    """
    if mode not in ("aggressive", "conservative"):
        raise ValueError(f"unknown mode: {mode}")
    nan = math.nan

    def s(w):
        return {"_ph": R.prev(C("High"), w), "_pl": R.prev(C("Low"), w)}

    pre = tl.apply(Recipe(("_ph", "_pl"), (s,), ("High", "Low"), 1))

    def run(pdf: pd.DataFrame, state: list[float]):
        side, extreme, h1, h2, l1, l2, used = state
        directions, extremes, turns, entries = [], [], [], []
        cols = ("High", "Low", "Close", "_ph", "_pl")
        for hi, lo, close, ph, pl in zip(*(pdf[c].tolist() for c in cols)):
            turn = entry = 0
            if side == 0:
                if hi > ph:
                    side, l1, l2, extreme = 1.0, pl, l1, hi
                elif lo < pl:
                    side, h1, h2, extreme = -1.0, ph, h1, lo
            else:
                # mirror a downswing so that one rule serves both directions
                far, near = (hi, lo) if side > 0 else (-lo, -hi)
                level = side * extreme
                before_last = h2 if side > 0 else -l2
                if far > level:
                    level = far
                    if mode == "conservative" and not used and level > before_last:
                        entry, used = int(side), 1.0
                if level - near > share * close:
                    if side > 0:
                        h1, h2, extreme = level, h1, lo
                    else:
                        l1, l2, extreme = -level, l1, hi
                    side, used = -side, 0.0
                    turn = int(side)
                    if mode == "aggressive":
                        entry = turn
                else:
                    extreme = side * level
            directions.append(int(side))
            extremes.append(extreme if side else nan)
            turns.append(turn)
            entries.append(entry)
        out = {"direction": directions, "extreme": extremes, "reversal": turns, "signal": entries}
        return out, [side, extreme, h1, h2, l1, l2, used]

    done = guess_and_verify(
        pre,
        ["High", "Low", "Close", "_ph", "_pl"],
        run,
        [0.0, 0.0, nan, nan, nan, nan, 0.0],
        {"direction": "int", "extreme": "double", "reversal": "int", "signal": "int"},
        [*tl.order, "High", "Low", "Close"],
        warm_up,
    )
    return done.df.withColumn("extreme", F.nanvl("extreme", F.lit(None)))


def cross_grid(tl: Timeline, grid: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Row returns of an average-crossing rule with a stop for every grid row.

    ``grid`` has ``config, short, long, stop`` and is small (counted).  A cross
    opens a position at its close, held from the next row; a close beyond the
    stop leaves the market until the next cross.  Averages are made once per
    window length, then every (key, config) is its own chunked series.
    """
    lengths = sorted({r[c] for r in grid.select("short", "long").collect() for c in ("short", "long")})
    pre = tl.apply(
        Recipe(("_ret",), (lambda w: {"_ret": R.pct(C("Close"), w)},), ("Close",), 1),
        *(I.sma("Close", n, f"_m{n}") for n in lengths),
        keep=[*tl.order, "Close"],
    )
    table = F.create_map(*(x for n in lengths for x in (F.lit(n), C(f"_m{n}"))))
    rows = with_grid(pre.df, grid).withColumns({"_a": table[C("short")], "_b": table[C("long")]})
    rows = rows.drop(*(f"_m{n}" for n in lengths))
    per = Timeline(rows, (*tl.by, "config"), tl.order, chunk_rows or tl.chunk_rows)

    def s(w):
        x = cross(C("_a"), C("_b"), w)
        hit = x != 0
        return {
            "_side": F.when(hit, x),
            "_entry": F.when(hit, C("Close")),
            "_from": F.when(hit, C("rn")),
        }

    base = [*tl.order, "Close", "_ret", "stop"]
    marked = per.apply(Recipe(("_side", "_entry", "_from"), (s,), ("_a", "_b"), 1), keep=base)
    held = marked.running(
        keep=base, _side=("last", "_side"), _entry=("last", "_entry"), _from=("last", "_from")
    )
    move = C("_side") * (C("Close") / C("_entry") - 1)
    stopped = _stops(held, move)

    def ret(w):
        pos = F.when(C("_out"), 0).otherwise(F.coalesce("_side", F.lit(0)))
        return {"ret": F.coalesce(R.prev(pos, w) * C("_ret"), F.lit(0.0))}

    done = stopped.apply(Recipe(("ret",), (ret,), ("_out", "_side", "_ret"), 1), keep=list(tl.order))
    return done.df


def _stops(held: Timeline, move: Column) -> Timeline:
    keep = list(held.df.columns)
    marked = held.extend(_stop_at=F.when(move <= -C("stop"), C("rn")))
    done = marked.running(keep=keep, _last_stop=("last", "_stop_at"))
    return done.with_df(
        done.df.withColumn("_out", F.coalesce(C("_last_stop") >= C("_from"), F.lit(False))).drop("_last_stop")
    )
