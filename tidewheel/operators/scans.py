"""Stateful scans over chunked series.

Three kernels, all keyed by (key, chunk) so that no task ever holds a key:

``affine``
    y[t] = m[t] * y[t-1] + b[t].  Each chunk is summarised by (product of m,
    local y); summaries are composed in a tree with bounded fan-in.
``reset_scan``
    accumulate, fire on a threshold, restart at zero (threshold bars, static
    imbalance, CUSUM).  A chunk is summarised by a step function: for every row
    that can be the first to fire, which entry value makes it fire and what the
    state at the chunk end is then.  Step functions are closed under
    composition, so the same tree gives each chunk its exact entry state.
``guess_and_verify``
    scans whose state carries floating memory through all earlier events.
    Chunks start from a warm-up guess; the guesses are compared with the real
    end state of the chunk before and wrong chunks are run again until every
    border agrees, so the result equals the sequential one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.lookup import attach
from tidewheel.storage import materialize
from tidewheel.timeline import Timeline

FAN_IN = 16
TASK_ROWS = 65_536  # a threshold scan takes as many whole chunks into one task as fit


def _key_fields(df: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in by]


def _key_values(pdf: pd.DataFrame, by: Sequence[str]) -> dict:
    return {k: pdf[k].iloc[0] for k in by}


# ------------------------------------------------------------------ tree prefix
def tree_prefix(
    summaries: DataFrame,
    by: Sequence[str],
    n_chunks: int,
    fn_cols: dict[str, str],
    compose: Callable[[list[dict]], dict],
    walk: Callable[[list[dict], Sequence[float]], list[list[float]]],
    initial: Sequence[float],
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Entry state of every chunk from per-chunk transfer functions.

    Up-sweep: groups of ``fan_in`` neighbouring functions are composed until one
    group is left.  Down-sweep: the entry of a group is walked through its
    members.  A task sees at most ``fan_in`` functions at any level.
    """
    fn_fields = [T.StructField(c, T._parse_datatype_string(t)) for c, t in fn_cols.items()]
    key_fields = _key_fields(summaries, by)
    node_schema = T.StructType([*key_fields, T.StructField("_t", T.LongType()), *fn_fields])
    entry_schema = T.StructType(
        [*key_fields, T.StructField("_t", T.LongType()), T.StructField("entry", T.ArrayType(T.DoubleType()))]
    )
    names = list(fn_cols)

    def records(pdf: pd.DataFrame) -> list[dict]:
        return [dict(zip(names, r)) for r in pdf[names].itertuples(index=False, name=None)]

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t", ignore_index=True)
        whole = compose(records(pdf))
        row = {**_key_values(pdf, by), "_t": int(pdf["_t"].iloc[0]) // fan_in}
        return pd.DataFrame([{**row, **{c: whole[c] for c in names}}])

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t", ignore_index=True)
        start = pdf["_entry"].iloc[0]
        states = walk(records(pdf), [float(x) for x in start])
        out = pdf[[*by, "_t"]].copy()
        out["entry"] = states
        return out

    parent = F.expr(f"_t div {fan_in}").alias("_p")
    levels, width = [summaries], n_chunks
    while width > fan_in:
        nodes = levels[-1].withColumn("_p", parent).groupBy(*by, "_p").applyInPandas(up, node_schema)
        levels.append(materialize(nodes, "prefix"))
        width = -(-width // fan_in)
    start = F.array(*(F.lit(float(x)) for x in initial))
    top = levels[-1].withColumns({"_p": F.lit(0).cast("bigint"), "_entry": start})
    entries = top.groupBy(*by, "_p").applyInPandas(down, entry_schema)
    for level in reversed(levels[:-1]):
        above = entries.select(*by, F.col("_t").alias("_p"), F.col("entry").alias("_entry"))
        entries = (
            level.withColumn("_p", parent)
            .join(above, [*by, "_p"])
            .groupBy(*by, "_p")
            .applyInPandas(down, entry_schema)
        )
    return entries


def chunk_count(tl: Timeline, least: str | None = None) -> tuple[int, float]:
    """Chunks of the longest key and the least value of a column, from one aggregate row."""
    low = F.min(least) if least else F.lit(0.0)
    row = tl.df.agg(F.max("rn").alias("n"), low.alias("low")).first()
    return -(-int(row["n"] or 0) // tl.chunk_rows), float(row["low"] or 0.0)


def task_chunks(tl: Timeline) -> Timeline:
    """The series in tasks of whole chunks of about ``TASK_ROWS`` rows: small chunks would cost a Python call each and a
    round of border checks per run of chunks that differ."""
    return replace(tl, chunk_rows=tl.chunk_rows * max(1, TASK_ROWS // tl.chunk_rows))


# ----------------------------------------------------------------- affine scan
def affine(tl: Timeline, m: str, b: str, out: str, keep: Sequence[str] | None = None) -> Timeline:
    """y[t] = m[t] * y[t-1] + b[t], started at 0; ``m`` and ``b`` must not be null."""
    keep = list(tl.df.columns) if keep is None else list(keep)
    by = tl.by
    tl = tl.settle([*keep, m, b])
    base = tl.chunked([m, b])
    schema = T.StructType(
        [
            *_key_fields(base, by),
            T.StructField("_t", T.LongType()),
            T.StructField("m", T.DoubleType()),
            T.StructField("b", T.DoubleType()),
        ]
    )

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        ms, y = 1.0, 0.0
        for mi, bi in zip(pdf[m].tolist(), pdf[b].tolist()):
            y = mi * y + bi
            ms *= mi
        return pd.DataFrame([{**_key_values(pdf, by), "_t": int(pdf["_t"].iloc[0]), "m": ms, "b": y}])

    def compose(fs: list[dict]) -> dict:
        ms, y = 1.0, 0.0
        for f in fs:
            ms, y = ms * f["m"], f["m"] * y + f["b"]
        return {"m": ms, "b": y}

    def walk(fs: list[dict], start: Sequence[float]) -> list[list[float]]:
        states, y = [], start[0]
        for f in fs:
            states.append([y])
            y = f["m"] * y + f["b"]
        return states

    summaries = materialize(base.groupBy(*by, "_t").applyInPandas(summarise, schema), "affine")
    entries = tree_prefix(
        summaries, by, chunk_count(tl)[0], {"m": "double", "b": "double"}, compose, walk, [0.0]
    )
    rows = tl.chunked([*keep, m, b]).join(entries, [*by, "_t"])
    cols = list(dict.fromkeys([*by, "rn", *keep]))
    final = T.StructType([*(rows.schema[c] for c in cols), T.StructField(out, T.DoubleType())])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        y = float(pdf["entry"].iloc[0][0])
        ys = []
        for mi, bi in zip(pdf[m].tolist(), pdf[b].tolist()):
            y = mi * y + bi
            ys.append(y)
        res = pdf[cols].copy()
        res[out] = ys
        return res

    return tl.with_df(rows.groupBy(*by, "_t").applyInPandas(finish, final))


# ------------------------------------------------------------------ first hits
def first_hit(
    up: np.ndarray | None, down: np.ndarray | None, base_up: np.ndarray, base_down: np.ndarray, start: np.ndarray
) -> np.ndarray:
    """For every query the first index >= ``start`` with ``up >= base_up`` or ``down <= base_down``.

    Binary descent over block maxima/minima: O(log n) per query, vectorised.
    Returns ``len(array)`` when nothing is hit.
    """
    n = len(up if up is not None else down)
    levels = [(up, down)]
    size = 1
    while size < n:
        prev_up, prev_dn = levels[-1]
        a = None if prev_up is None else np.maximum(prev_up, _shift(prev_up, size, -np.inf))
        d = None if prev_dn is None else np.minimum(prev_dn, _shift(prev_dn, size, np.inf))
        levels.append((a, d))
        size *= 2
    pos = start.astype(np.int64).copy()
    for k in range(len(levels) - 1, -1, -1):
        a, d = levels[k]
        at = np.minimum(pos, n - 1)
        hit = np.zeros(len(pos), dtype=bool)
        if a is not None:
            hit |= a[at] >= base_up
        if d is not None:
            hit |= d[at] <= base_down
        pos = np.where((pos < n) & ~hit, pos + (1 << k), pos)
    return np.minimum(pos, n)


def _shift(x: np.ndarray, by: int, fill: float) -> np.ndarray:
    out = np.full(len(x), fill)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


# ------------------------------------------------------------------ reset scan
FN_COLS = {
    "theta_u": "array<double>",
    "theta_v": "array<double>",
    "exit_u": "array<double>",
    "exit_v": "array<double>",
    "exit_open": "array<double>",
    "exit_n": "array<double>",
    "through": "array<double>",
}


def _prune(fn: dict, floor: float) -> dict:
    """Drop rows no entry value reaches first and merge neighbours with equal ends.

    ``floor`` is the least upper-side value an entry can have: once it fires, no
    later row is first.  With short bars a few steps per chunk are left.
    """
    tu, tv = np.minimum.accumulate(fn["theta_u"]), np.maximum.accumulate(fn["theta_v"])
    if len(tu) == 0:
        return fn
    best_u, best_v = np.concatenate(([np.inf], tu[:-1])), np.concatenate(([-np.inf], tv[:-1]))
    live = ((tu < best_u) | (tv > best_v)) & (best_u > floor) & (best_v < np.inf)
    ends = ("exit_u", "exit_v", "exit_open", "exit_n")
    kept = {c: np.asarray(fn[c])[live] for c in ends}
    last = np.ones(int(live.sum()), dtype=bool)
    last[:-1] = np.any([kept[c][1:] != kept[c][:-1] for c in ends], axis=0)
    return {
        "theta_u": tu[live][last],
        "theta_v": tv[live][last],
        **{c: kept[c][last] for c in ends},
        "through": fn["through"],
    }


def _evaluate(fn: dict, u, v, opened, count):
    """Apply a transfer function to arrays of states."""
    u, v = np.asarray(u, float), np.asarray(v, float)
    tu, tv = np.asarray(fn["theta_u"], float), np.asarray(fn["theta_v"], float)
    n = len(tu)
    lo, p, hi, q = fn["through"]
    out_u, out_v = np.maximum(lo, u + p), np.minimum(hi, v + q)
    out_o, out_n = np.array(opened, float), np.array(count, float)
    if n:
        run_u, run_v = np.minimum.accumulate(tu), np.maximum.accumulate(tv)
        ku = n - np.searchsorted(run_u[::-1], u, side="right")
        kv = n - np.searchsorted(-run_v[::-1], -v, side="right")
        k = np.minimum(ku, kv)
        hit = k < n
        at = k[hit]
        out_u[hit] = np.asarray(fn["exit_u"], float)[at]
        out_v[hit] = np.asarray(fn["exit_v"], float)[at]
        out_o[hit] = np.asarray(fn["exit_open"], float)[at]
        out_n[hit] += np.asarray(fn["exit_n"], float)[at]
    return out_u, out_v, out_o, out_n


def _compose_two(f: dict, g: dict, floor: float) -> dict:
    """First ``f``, then ``g``."""
    eu, ev, eo, en = _evaluate(g, f["exit_u"], f["exit_v"], f["exit_open"], f["exit_n"])
    lo, p, hi, q = f["through"]
    gu, gv = np.asarray(g["theta_u"], float), np.asarray(g["theta_v"], float)
    tu = np.concatenate([np.asarray(f["theta_u"], float), np.where(lo >= gu, -np.inf, gu - p)])
    tv = np.concatenate([np.asarray(f["theta_v"], float), np.where(hi <= gv, np.inf, gv - q)])
    cat = lambda a, c: np.concatenate([a, np.asarray(g[c], float)])
    eu, ev, eo, en = cat(eu, "exit_u"), cat(ev, "exit_v"), cat(eo, "exit_open"), cat(en, "exit_n")
    glo, gp, ghi, gq = g["through"]
    both = {
        "theta_u": tu,
        "theta_v": tv,
        "exit_u": eu,
        "exit_v": ev,
        "exit_open": eo,
        "exit_n": en,
        "through": [max(glo, lo + gp), p + gp, min(ghi, hi + gq), q + gq],
    }
    return _prune(both, floor)


def _chunk_function(step: np.ndarray, limit: np.ndarray, rn: np.ndarray, two_sided: bool, clamp: bool, floor: float) -> dict:
    """Transfer function of one chunk for increments ``step`` and per-row thresholds ``limit``."""
    n = len(step)
    limit = np.where(limit > 0, limit, np.inf) if two_sided and not clamp else limit
    cum = np.cumsum(step)
    before = np.concatenate(([0.0], cum[:-1]))
    rows = np.arange(n)
    if clamp:
        low = np.minimum.accumulate(np.concatenate(([0.0], cum)))[1:]
        top = np.maximum.accumulate(np.concatenate(([0.0], cum)))[1:]
        fresh_u, fresh_v = cum - low, cum - top
        tu = np.where(fresh_u >= limit, -np.inf, limit - cum)
        tv = np.where(fresh_v <= -limit, np.inf, -limit - cum)
        # last earlier row from which the climb (or fall) to this row reaches the limit
        path = np.concatenate(([0.0], cum))
        back = path[::-1]
        begin = n - rows  # reversed position of the row just before this one
        climb = first_hit(-back, None, limit - cum, limit - cum, begin)
        fall = first_hit(back, None, limit + cum, limit + cum, begin)
        origin = n - np.minimum(climb, fall)  # n+1 (not found) becomes -1
        nxt = first_hit(origin.astype(float), None, rows.astype(float), rows.astype(float), rows)
        through = [fresh_u[-1], cum[-1], fresh_v[-1], cum[-1]]
        end_u = _drift_end(cum, before, np.minimum)
        end_v = _drift_end(cum, before, np.maximum)
    else:
        tu = limit - cum
        tv = -limit - cum if two_sided else np.full(n, -np.inf)
        up = cum - limit
        down = cum + limit if two_sided else None
        nxt = first_hit(up, down, before, before, rows)
        through = [-np.inf, cum[-1], np.inf, cum[-1]]
        end_u = end_v = cum[-1] - before
    # chain of restarts from every row, last row first: state at the chunk end
    ex_u, ex_v = [0.0] * (n + 1), [0.0] * (n + 1)
    ex_o, ex_n = [rn[-1] + 1.0] * (n + 1), [0.0] * (n + 1)
    ends_u, ends_v, opens, nxt = end_u.tolist(), end_v.tolist(), rn.tolist(), nxt.tolist()
    for i in range(n - 1, -1, -1):
        j = nxt[i] + 1
        if j <= n:
            ex_u[i], ex_v[i], ex_o[i], ex_n[i] = ex_u[j], ex_v[j], ex_o[j], ex_n[j] + 1
        else:
            ex_u[i], ex_v[i], ex_o[i] = ends_u[i], ends_v[i], opens[i]
    ex_u, ex_v, ex_o, ex_n = (np.asarray(x, float) for x in (ex_u, ex_v, ex_o, ex_n))
    whole = {
        "theta_u": tu,
        "theta_v": tv,
        "exit_u": ex_u[1:],
        "exit_v": ex_v[1:],
        "exit_open": ex_o[1:],
        "exit_n": ex_n[1:] + 1,
        "through": through,
    }
    return _prune(whole, floor)


def _drift_end(cum: np.ndarray, before: np.ndarray, extreme) -> np.ndarray:
    """End value of the clamped sum when it starts at 0 before every row."""
    tail = extreme.accumulate(cum[::-1])[::-1]
    return cum[-1] - extreme(before, tail)


def _replay(step, limit, rn, entry, two_sided: bool, clamp: bool):
    """Sequential pass of one chunk from an entry state: arrays per row and the state (u, v, opened, count) at the end.

    Sums are added row by row in order, so a chunk border changes no digit.
    """
    u, v, opened, count = entry
    n = len(step)
    bar, first, level, fired = np.empty(n), np.empty(n), np.empty(n), np.zeros(n, dtype=bool)
    if clamp:
        for i, (x, lim) in enumerate(zip(step.tolist(), limit.tolist())):
            u, v = max(0.0, u + x), min(0.0, v + x)
            bar[i], first[i], level[i] = count, opened, u
            if u >= lim or v <= -lim:
                fired[i] = True
                u = v = 0.0
                count += 1
                opened = rn[i] + 1
        return bar, first, level, fired, (u, v, opened, count)
    levels, closes = [], []
    for i, (x, lim) in enumerate(zip(step.tolist(), limit.tolist())):
        u += x
        levels.append(u)
        if (abs(u) >= lim > 0) if two_sided else u >= lim:
            closes.append(i)
            u = 0.0
    fired[closes], level[:] = True, levels
    closed = np.cumsum(fired) - fired
    opens = np.concatenate(([opened], rn[closes] + 1.0))
    bar, first, opened, count = count + closed.astype(float), opens[closed], opens[-1], count + len(closes)
    return bar, first, level, fired, (u, u, opened, count)


def _until_borders_agree(states: DataFrame, again: Callable[[DataFrame], DataFrame], by: Sequence[str]) -> DataFrame:
    """Run chunks again from the end of the chunk before until no entry differs from it.

    ``states`` has ``entry`` and ``exit`` per chunk and may have more columns; ``again`` gets the chunks that differ
    with ``_want``, the entry to use, and returns their states.  At least one more chunk per key is right after every
    round.
    """
    keys = [*by, "_t"]
    order = Window.partitionBy(*by).orderBy("_t")
    values = [c for c in states.columns if c not in keys]
    while True:
        want = states.select(*keys, "entry", F.lag("exit").over(order).alias("_want")).where(
            F.col("_want").isNotNull() & ~F.col("_want").eqNullSafe(F.col("entry"))
        )
        if want.isEmpty():
            return states
        fixed = again(want.select(*keys, "_want"))
        merged = states.join(fixed.select(*keys, F.struct(*values).alias("_new")), keys, "left")
        states = materialize(merged.select(*keys, *(F.coalesce(f"_new.{c}", c).alias(c) for c in values)), "states")


PACKED = {"_steps": "array<double>", "_limits": "array<double>", "_rns": "array<bigint>"}


def _pack(step: np.ndarray, limit: np.ndarray, rn: np.ndarray) -> dict:
    """A chunk as arrays; equal limits are one number, gapless row numbers the first one."""
    return {
        "_steps": step,
        "_limits": limit[:1] if (limit == limit[0]).all() else limit,
        "_rns": rn[:1] if rn[-1] - rn[0] == len(rn) - 1 else rn,
    }


def _unpack(steps, limits, rns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step, limit, rn = np.asarray(steps, float), np.asarray(limits, float), np.asarray(rns, np.int64)
    n = len(step)
    return step, np.broadcast_to(limit, n), rn if len(rn) == n else rn[0] + np.arange(n)


def reset_scan(
    tl: Timeline,
    step: str,
    limit: str,
    keep: Sequence[str],
    two_sided: bool = False,
    clamp: bool = False,
) -> Timeline:
    """Accumulate ``step``, fire when the sum passes ``limit``, restart at zero.

    Adds ``bar_id`` (0-based number of the open accumulation), ``bar_open`` (its
    first ``rn``), ``level`` (sum after the row) and ``closes``.  One-sided fires
    at sum >= limit; ``two_sided`` at abs(sum) >= limit > 0; ``clamp`` keeps an
    upper sum above and a lower sum below zero (CUSUM).  A null step counts as 0,
    a null limit never fires.

    Steps are shuffled once and written as arrays, a row per chunk; the passes that settle the borders read these, and
    only the last pass shuffles rows again.
    """
    by, given, keys = tl.by, tl.chunk_rows, [*tl.by, "_t"]
    tl = task_chunks(tl.settle([*keep, step, limit]))
    n_chunks, low = chunk_count(tl, step)
    # a sum of non-negative steps, or one clamped at zero, never enters a chunk below zero
    floor = 0.0 if clamp or (low >= 0 and not two_sided) else -np.inf
    base = tl.chunked([step, limit])
    head = [*_key_fields(base, by), T.StructField("_t", T.LongType())]

    def schema(cols: dict[str, str]) -> T.StructType:
        return T.StructType([*head, *(T.StructField(c, T._parse_datatype_string(t)) for c, t in cols.items())])

    def arrays(pdf):
        lim = pdf[limit].to_numpy(dtype=float)
        return (
            np.nan_to_num(pdf[step].to_numpy(dtype=float)),
            np.where(np.isnan(lim), np.inf, lim),
            pdf["rn"].to_numpy(),
        )

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        fn = _chunk_function(*arrays(pdf), two_sided, clamp, floor)
        return pd.DataFrame([{**_key_values(pdf, by), "_t": int(pdf["_t"].iloc[0]), **fn, **_pack(*arrays(pdf))}])

    def compose(fs: list[dict]) -> dict:
        whole = fs[0]
        for f in fs[1:]:
            whole = _compose_two(whole, f, floor)
        return whole

    def walk(fs: list[dict], start: Sequence[float]) -> list[list[float]]:
        states, state = [], list(start)
        for f in fs:
            states.append([float(x) for x in state])
            state = [x[0] for x in _evaluate(f, *([s] for s in state))]
        return states

    made = materialize(base.groupBy(*keys).applyInPandas(summarise, schema(FN_COLS | PACKED)), "steps")
    entries = tree_prefix(
        made.select(*keys, *FN_COLS), by, n_chunks, FN_COLS, compose, walk, [0.0, 0.0, 1.0, 0.0]
    )
    # the tree adds in another order than a row-by-row sum, so its entries may be off by a last digit: the real
    # end of every chunk is compared with the entry of the next, and bar numbers are counted, not carried as sums
    chunks = made.select(*keys, *PACKED)

    def run(batches):
        for pdf in batches:
            out = pdf[keys].copy()
            out["entry"] = [[float(x) for x in e[:3]] for e in pdf["_want"]]
            ends = [
                _replay(*_unpack(*packed), [*entry, 0], two_sided, clamp)[-1]
                for entry, *packed in zip(out["entry"], *(pdf[c] for c in PACKED))
            ]
            out["exit"] = [[float(u), float(v), float(opened)] for u, v, opened, _ in ends]
            out["fires"] = [int(count) for *_, count in ends]
            yield out

    def again(want: DataFrame) -> DataFrame:
        # arrays stay in the tasks that read them: equal steps compress to nothing, a shuffle would put all into one task
        return attach(chunks, want, keys).mapInPandas(run, schema({"entry": "array<double>", "exit": "array<double>", "fires": "bigint"}))

    exact = _until_borders_agree(materialize(again(entries.withColumnRenamed("entry", "_want")), "states"), again, by)
    earlier = Window.partitionBy(*by).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    exact = exact.select(*keys, "entry", F.coalesce(F.sum("fires").over(earlier), F.lit(0)).alias("_bars"))
    rows = tl.chunked([*keep, step, limit]).join(exact, keys)
    cols = list(dict.fromkeys([*by, "rn", *keep]))
    final = T.StructType(
        [
            *(rows.schema[c] for c in cols),
            T.StructField("bar_id", T.LongType()),
            T.StructField("bar_open", T.LongType()),
            T.StructField("level", T.DoubleType()),
            T.StructField("closes", T.BooleanType()),
        ]
    )

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        bar, first, level, fired, _ = _replay(*arrays(pdf), [*pdf["entry"].iloc[0], 0], two_sided, clamp)
        res = pdf[cols].copy()
        res["bar_id"], res["bar_open"] = bar.astype("int64") + int(pdf["_bars"].iloc[0]), first.astype("int64")
        res["level"], res["closes"] = level, fired
        return res

    done = rows.groupBy(*keys).applyInPandas(finish, final)
    return replace(tl, df=done, chunk_rows=given, settled=False)


# ------------------------------------------------------------ guess and verify
def guess_and_verify(
    tl: Timeline,
    cols: Sequence[str],
    run: Callable[[pd.DataFrame, list[float]], tuple[dict, list[float]]],
    initial: Sequence[float],
    out: dict[str, str],
    keep: Sequence[str],
    warm_up: int,
    key_state: Callable[[pd.DataFrame], list[float]] | None = None,
) -> Timeline:
    """Sequential scan with floating memory, run per chunk and verified at every border.

    ``run(rows, state)`` returns (output arrays, end state).  A state is a list
    of doubles.  First all chunks start after ``warm_up`` rows of the chunk
    before; then the chunks whose start differs from the end of the chunk before
    are run again from that end, until none differs.  At least one more chunk
    per key is right after every round, and in practice the scans forget, so a
    few rounds over few chunks suffice.  Only a count reaches the driver.
    """
    by = tl.by
    tl = tl.settle([*cols, *keep])
    keys = [*by, "_t"]
    begin = list(initial)
    halo = tl.halo(cols, back=warm_up)
    state_fields = [
        T.StructField("entry", T.ArrayType(T.DoubleType())),
        T.StructField("exit", T.ArrayType(T.DoubleType())),
    ]
    schema = T.StructType([*_key_fields(halo, by), T.StructField("_t", T.LongType()), *state_fields])

    def first_state(pdf: pd.DataFrame) -> list[float]:
        return begin + (key_state(pdf) if key_state else [])

    def guess(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        core = pdf["_core"].to_numpy()
        state = first_state(pdf)
        if not core.any():
            return pd.DataFrame(columns=schema.names)
        if not core[0]:
            _, state = run(pdf.loc[~core].reset_index(drop=True), state)
        _, end = run(pdf.loc[core].reset_index(drop=True), list(state))
        return pd.DataFrame(
            [{**_key_values(pdf, by), "_t": int(pdf["_t"].iloc[0]), "entry": state, "exit": end}]
        )

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        state = [float(x) for x in pdf["_want"].iloc[0]]
        _, end = run(pdf, list(state))
        return pd.DataFrame(
            [{**_key_values(pdf, by), "_t": int(pdf["_t"].iloc[0]), "entry": state, "exit": end}]
        )

    states = materialize(halo.groupBy(*keys).applyInPandas(guess, schema), "states")
    chunks = tl.chunked(cols)
    states = _until_borders_agree(states, lambda want: chunks.join(want, keys).groupBy(*keys).applyInPandas(again, schema), by)
    full = tl.chunked([*cols, *keep]).join(states.select(*keys, "entry"), keys)
    names = list(dict.fromkeys([*by, "rn", *keep]))
    final = T.StructType(
        [
            *(full.schema[c] for c in names),
            *(T.StructField(n, T._parse_datatype_string(t)) for n, t in out.items()),
        ]
    )

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        res, _ = run(pdf, [float(x) for x in pdf["entry"].iloc[0]])
        block = pdf[names].copy()
        for n in out:
            block[n] = res[n]
        return block

    return tl.with_df(full.groupBy(*keys).applyInPandas(finish, final))
