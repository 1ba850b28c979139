"""Threshold bars for many thresholds at once.

The thresholds are a second axis inside the chunk task: a chunk's rows are read once and give one step function per
threshold, the functions are composed per (key, threshold), and the same task later replays the chunk for all its entry
states.  A row is one vector step over all thresholds.  No row is copied per threshold, what leaves a task are functions
and bars, and only the pieces of bars that cross a chunk border are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.lookup import attach
from tidewheel.operators import scans, stats
from tidewheel.storage import materialize
from tidewheel.timeline import Timeline

C = F.col
_START = [0.0, 0.0, 1.0, 0.0]
_SUMS = ("Volume", "volume_usdt", "trade_count")
_LANES = 128  # rows that can close first, per threshold, up to which restarts run as vector lanes


def _closes(step: np.ndarray, limits: np.ndarray, entry: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows close a bar of each threshold (rows x thresholds), and the open sums at the end; sums go row by row."""
    fired, u = np.empty((len(step), len(limits)), bool), np.array(entry, float)
    for x, hit in zip(step.tolist(), fired):
        u += x
        np.greater_equal(u, limits, out=hit)
        np.copyto(u, 0.0, where=hit)
    return fired, u


def _functions(step: np.ndarray, limits: np.ndarray, rn: np.ndarray, floor: float) -> list[dict]:
    """Step function of a chunk for every threshold.

    With steps that are not negative only the rows up to the first sum past the threshold can close first; the restarts
    behind these rows are lanes of one pass.  Thresholds with many such rows get their functions by descent.
    """
    n, cum = len(step), np.cumsum(step)
    rows = np.minimum(np.searchsorted(cum, limits) + 1, n) if floor == 0 else np.full(len(limits), n)
    few = rows <= _LANES if floor == 0 else np.zeros(len(limits), bool)
    slot = np.repeat(np.flatnonzero(few), rows[few])
    begin = np.concatenate([np.arange(k) for k in rows[few]]) if len(slot) else np.empty(0, np.int64)
    by_begin = np.argsort(begin, kind="stable")
    limit, at = limits[slot[by_begin]], begin[by_begin]
    u, opened, count = np.zeros(len(at)), at + 1, np.ones(len(at))
    if len(at):
        for i, (x, k) in enumerate(zip(step.tolist(), np.searchsorted(at, np.arange(n)).tolist())):
            v = u[:k]
            v += x
            hit = v >= limit[:k]
            np.copyto(v, 0.0, where=hit)
            np.copyto(opened[:k], i + 1, where=hit)
            count[:k] += hit
    lane = np.empty(len(at), np.int64)
    lane[by_begin] = np.arange(len(at))
    opens = np.append(rn, rn[-1] + 1).astype(float)
    through, made, done = [-np.inf, cum[-1], np.inf, cum[-1]], [], 0
    for t, k, lanes in zip(limits, rows, few):
        if not lanes:
            made.append(scans._chunk_function(step, np.full(n, t), rn, False, False, floor))
            continue
        mine = lane[done : done + k]
        done += k
        ends = {"exit_u": u[mine], "exit_v": u[mine], "exit_open": opens[opened[mine]], "exit_n": count[mine]}
        made.append(scans._prune({"theta_u": t - cum[:k], "theta_v": np.full(k, -np.inf), **ends, "through": through}, floor))
    return made


def sweep_bars(tl: Timeline, metric: str, grid: DataFrame, param: str = "step") -> DataFrame:
    """Closed bars of every threshold of a key: by, ``param``, threshold, bar_id, ts and the OHLCV columns.

    ``grid`` has the keys, ``param`` and ``threshold``; thresholds that are null or not positive make no bars.  The
    result equals that of :func:`tidewheel.operators.bars.assign_bars` per threshold, at any chunk size.
    """
    by, keys = list(tl.by), [*tl.by, "_t"]
    cols = ["ts", "Open", "High", "Low", "Close", *_SUMS]
    tl = tl.settle([*cols, metric])
    n_chunks, low = scans.chunk_count(tl, metric)
    floor = 0.0 if low >= 0 else -np.inf
    per_key = tl.rows_per_key()
    grid = grid.select(*by, param, C("threshold").cast("double").alias("threshold")).where("threshold > 0")
    slots = attach(grid, per_key, by).withColumn("_t", F.explode(F.expr(f"sequence(0L, (n_rows - 1) div {tl.chunk_rows})"))).drop("n_rows")
    slots = materialize(slots, "slots")
    field = {f.name: f for f in [*slots.schema.fields, *tl.df.schema.fields]}
    head = [*(field[k] for k in by), field[param], T.StructField("_t", T.LongType())]
    numbers = T.ArrayType(T.DoubleType())

    def schema(*more: T.StructField) -> T.StructType:
        return T.StructType([*head, *more])

    def sorted_steps(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        rows = rows.sort_values("rn", ignore_index=True)
        return rows, np.nan_to_num(rows[metric].to_numpy(dtype=float)), rows["rn"].to_numpy()

    def summarise(rows: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        rows, step, rn = sorted_steps(rows)
        made = _functions(step, slots["threshold"].to_numpy(float), rn, floor)
        return pd.concat([slots[[*by, param, "_t"]].reset_index(drop=True), pd.DataFrame(made, columns=list(scans.FN_COLS))], axis=1)

    def compose(fs: list[dict]) -> dict:
        whole = fs[0]
        for f in fs[1:]:
            whole = scans._compose_two(whole, f, floor)
        return whole

    def walk(fs: list[dict], start: Sequence[float]) -> list[list[float]]:
        states, state = [], list(start)
        for f in fs:
            states.append([float(x) for x in state])
            state = [x[0] for x in scans._evaluate(f, *([s] for s in state))]
        return states

    narrow = tl.chunked([metric]).groupBy(*keys)
    functions = narrow.cogroup(slots.groupBy(*keys)).applyInPandas(
        summarise, schema(*(T.StructField(c, T._parse_datatype_string(t)) for c, t in scans.FN_COLS.items())))
    entries = scans.tree_prefix(materialize(functions, "steps"), [*by, param], n_chunks, scans.FN_COLS, compose, walk, _START)
    # the tree adds in another order than a plain loop, so each chunk's real end is compared with the next one's entry
    states_of = schema(T.StructField("threshold", T.DoubleType()), T.StructField("entry", numbers), T.StructField("exit", numbers), T.StructField("fires", T.LongType()))

    def run(rows: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        rows, step, rn = sorted_steps(rows)
        out = slots[[*by, param, "_t", "threshold"]].copy()
        entry = [[float(x) for x in e[:3]] for e in slots["entry"]]
        fired, u = _closes(step, slots["threshold"].to_numpy(float), [e[0] for e in entry])
        last = len(step) - 1 - fired[::-1].argmax(axis=0)
        opened = np.where(fired.any(axis=0), rn[last] + 1.0, [e[2] for e in entry])
        out["entry"], out["exit"], out["fires"] = entry, [[x, x, o] for x, o in zip(u.tolist(), opened.tolist())], fired.sum(axis=0)
        return out

    place = [*by, param, "_t"]
    states = narrow.cogroup(slots.join(entries, place).groupBy(*keys)).applyInPandas(run, states_of)
    order = Window.partitionBy(*by, param).orderBy("_t")
    while True:
        states = materialize(states, "states")
        want = states.withColumn("_want", F.lag("exit").over(order)).where("_want IS NOT NULL AND NOT (_want <=> entry)")
        want = materialize(want.select(*place, "threshold", C("_want").alias("entry")), "borders")
        if want.isEmpty():
            break
        again = narrow.cogroup(want.groupBy(*keys)).applyInPandas(lambda r, s: run(r, s) if len(s) else s.reindex(columns=states_of.names), states_of)
        states = states.join(want.select(*place), place, "left_anti").unionByName(again)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ready = states.select(*place, "threshold", "entry", F.coalesce(F.sum("fires").over(earlier), F.lit(0)).alias("_bars"))
    ready = materialize(ready, "entries")
    sums = [T.StructField(c, field[c].dataType) for c in _SUMS]
    prices = [T.StructField(c, T.DoubleType()) for c in ("Open", "High", "Low", "Close")]
    pieces_of = schema(
        T.StructField("threshold", T.DoubleType()), T.StructField("bar_id", T.LongType()), T.StructField("_first", T.LongType()),
        T.StructField("_last", T.LongType()), field["ts"], *prices, *sums, T.StructField("_closed", T.BooleanType()))

    def pieces(whole: bool, rows: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        """Bars that lie inside the chunk (``whole``), or the pieces of those that cross its borders."""
        if slots.empty:
            return pd.DataFrame(columns=pieces_of.names)
        rows, step, rn = sorted_steps(rows)
        n, k = len(step), len(slots)
        fired = _closes(step, slots["threshold"].to_numpy(float), [e[0] for e in slots["entry"]])[0].T
        starts = np.ones((k, n), bool)
        starts[:, 1:] = fired[:, :-1]
        begin = np.flatnonzero(starts)
        stop = np.append(begin[1:], k * n) - 1
        slot, first, last = begin // n, begin % n, stop % n
        closed = fired.ravel()[stop]
        opened = np.array([e[2] for e in slots["entry"]])
        inside = closed & ((first > 0) | (opened[slot] == rn[0]))
        take = inside if whole else ~inside
        number = np.arange(len(begin)) - np.searchsorted(begin, slot * n) + slots["_bars"].to_numpy()[slot]

        def over(f, c: str) -> np.ndarray:
            return f.reduceat(np.tile(rows[c].to_numpy(), k), begin)[take]

        slot, first, last = slot[take], first[take], last[take]
        made = {c: slots[c].to_numpy()[slot] for c in (*by, param, "_t", "threshold")}
        made |= {"bar_id": number[take], "_first": rn[first], "_last": rn[last], "ts": rows["ts"].to_numpy()[last]}
        made |= {"Open": rows["Open"].to_numpy()[first], "High": over(np.fmax, "High"), "Low": over(np.fmin, "Low"), "Close": rows["Close"].to_numpy()[last]}
        made |= {c: over(np.add, c) for c in _SUMS} | {"_closed": closed[take]}
        return pd.DataFrame(made)[pieces_of.names]

    # the replay is cheaper than writing or shuffling all bars, so it runs once for either kind
    chunks = tl.chunked([*cols, metric]).groupBy(*keys).cogroup(ready.groupBy(*keys))
    inside = chunks.applyInPandas(lambda r, s: pieces(True, r, s), pieces_of)
    parts = chunks.applyInPandas(lambda r, s: pieces(False, r, s), pieces_of)
    across = parts.groupBy(*by, param, "threshold", "bar_id").agg(
        F.max_by("ts", "_last").alias("ts"), F.min_by("Open", "_first").alias("Open"), F.max("High").alias("High"), F.min("Low").alias("Low"),
        F.max_by("Close", "_last").alias("Close"), *(F.sum(c).alias(c) for c in _SUMS), F.max("_closed").alias("_closed"))
    across = across.where("_closed").drop("_closed")
    return inside.select(*across.columns).unionByName(across)


def sweep_statistics(bars: DataFrame, by: Sequence[str], chunk_rows: int, param: str = "step") -> DataFrame:
    """Per threshold: number of bars and of returns, skew, kurtosis and three p-values of the close-to-close returns.

    Statistics are null below 20 returns.  Bars are numbered without gaps, so no new numbering is needed.
    """
    keys = (*by, param)
    series = materialize(bars.select(*keys, "threshold", (C("bar_id") + 1).alias("rn"), "Close"), "bars")
    tl = Timeline(series, keys, ("rn",), chunk_rows, True)
    n = series.groupBy(*keys).agg(F.first("threshold").alias("threshold"), F.count(F.lit(1)).alias("n_bars"))
    ret = tl.compute(lambda w: {"ret": C("Close") / F.lag("Close").over(w) - 1}, back=1).df.where("ret IS NOT NULL")
    ret = materialize(ret.select(*keys, (C("rn") - 1).alias("rn"), "ret"), "returns")
    found = stats.return_properties(Timeline(ret, keys, ("rn",), chunk_rows, True), "ret")
    return n.join(found, list(keys), "left")
