"""Purged, combinatorial and walk-forward splits.

A split is never a list of positions.  Every row has a group (a fold or a time
slice) and the groups that purge it: those whose interval, with its embargo, the
row's own interval meets.  Whether a row trains follows from these two for any
choice of test groups, so rows are written once (:class:`SplitRows`) and a split
is a filter on them, of which the group prunes folders.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.lookup import attach
from tidewheel.storage import materialize
from tidewheel.timeline import Timeline

C = F.col


def fold_number(n_splits: int, rn: str = "rn", n: str = "n_rows") -> Column:
    """0-based fold of a 1-based row when ``n`` rows are cut into near-equal runs, longer ones first."""
    size, extra = F.expr(f"{n} div {n_splits}"), F.expr(f"{n} % {n_splits}")
    i = C(rn) - 1
    head = extra * (size + 1)
    tail = F.when(size > 0, extra + F.floor((i - head) / F.greatest(size, F.lit(1))))
    return F.when(i < head, F.floor(i / (size + 1))).otherwise(tail).cast("int")


def purged_folds(tl: Timeline, n_splits: int, t1: str = "t1", embargo: float = 0.0, inclusive: bool = False, ts: str = "ts") -> DataFrame:
    """(fold, role) for every row: test runs, and train rows that end before or start after them.

    ``inclusive`` also trains on rows ending exactly at the first test time.
    After the test fold training resumes at the first row not before the latest
    test end, plus the embargo rows.
    """
    by = list(tl.by)
    tl = tl.settle()
    n = tl.rows_per_key()
    rows = attach(tl.df, n, by).withColumn("_f", fold_number(n_splits))
    per = rows.groupBy(*by, C("_f").alias("fold")).agg(
        F.min("rn").alias("_lo"), F.max("rn").alias("_hi"),
        F.min(ts).alias("_start"), F.max(t1).alias("_latest"), F.first("n_rows").alias("_n"),
    )
    per = materialize(per, "folds")
    after = (
        attach(tl.df.select(*by, ts), per, by)
        .groupBy(*by, "fold").agg((F.count_if(C(ts) < C("_latest")) + 1).alias("_after"))
    )
    table = per.join(after, [*by, "fold"])
    skip = F.floor(C("_n") * F.lit(float(embargo)))
    ends_before = C(t1) <= C("_start") if inclusive else C(t1) < C("_start")
    role = F.when(C("rn").between(C("_lo"), C("_hi")), "test").when(
        ends_before | (C("rn") >= C("_after") + skip), "train"
    )
    both = ends_before & C("rn").between(C("_lo"), C("_hi"))
    roles = F.array_compact(F.array(role, F.when(both, "train")))
    out = attach(tl.df, table, by).withColumn("role", F.explode(roles))
    return out.drop("_lo", "_hi", "_start", "_latest", "_n", "_after")


@dataclass(frozen=True)
class SplitRows:
    """Rows written once with their group ``grp`` and the groups ``purged_by``; split ``s`` tests the groups ``plan[s]``."""

    rows: DataFrame
    plan: tuple[tuple[int, ...], ...]
    split: str = "split"

    @staticmethod
    def write(rows: DataFrame, plan: Sequence[Sequence[int]], split: str = "split") -> "SplitRows":
        return SplitRows(materialize(rows, "split-rows", ("grp",)), tuple(map(tuple, plan)), split)

    def with_rows(self, rows: DataFrame) -> "SplitRows":
        """Same splits over other columns (``rows`` keeps ``grp`` and ``purged_by``)."""
        return replace(self, rows=rows)

    def test(self, s: int) -> DataFrame:
        return self.rows.where(C("grp").isin(*self.plan[s])).drop("purged_by").withColumn(self.split, F.lit(s))

    def train(self, s: int) -> DataFrame:
        tested = F.array(*map(F.lit, self.plan[s]))
        return self.rows.where(~C("grp").isin(*self.plan[s]) & ~F.arrays_overlap("purged_by", tested)).drop("purged_by")

    def sizes(self) -> DataFrame:
        """(split, n_train, n_test) of every split from one pass over the written rows."""
        plan = F.array(*(F.struct(F.lit(i).alias(self.split), F.array(*map(F.lit, t)).alias("_test")) for i, t in enumerate(self.plan)))
        # rows of equal group and purging groups go the same way in every split
        kinds = self.rows.groupBy("grp", "purged_by").agg(F.count(F.lit(1)).alias("_n"))
        each = kinds.select("*", F.inline(plan))
        tested, purged = F.array_contains("_test", C("grp")), F.arrays_overlap("purged_by", C("_test"))
        return each.groupBy(self.split).agg(
            F.sum(F.when(~tested & ~purged, C("_n")).otherwise(0)).alias("n_train"), F.sum(F.when(tested, C("_n")).otherwise(0)).alias("n_test")
        )


def _meets(ranges: Column, purges, own: Column) -> Column:
    """Sorted groups of ``ranges`` other than ``own`` for which ``purges(range)`` holds."""
    hit = F.filter(ranges, lambda r: (r["grp"] != own) & F.coalesce(purges(r), F.lit(True)))
    return F.array_sort(F.transform(hit, lambda r: r["grp"]))


def fold_set(tl: Timeline, n_splits: int, t1: str = "t1", embargo: float = 0.0, ts: str = "ts") -> SplitRows:
    """The folds of :func:`purged_folds` as rows written once: a row is purged by the folds it neither ends before nor starts after."""
    by = list(tl.by)
    tl = tl.settle()
    rows = attach(tl.df, tl.rows_per_key(), by).withColumn("grp", fold_number(n_splits))
    per = rows.groupBy(*by, "grp").agg(F.min(ts).alias("start"), F.max(t1).alias("latest"), F.first("n_rows").alias("n"))
    per = materialize(per.groupBy(*by).agg(F.first("n").alias("_n"), F.array_sort(F.collect_list(F.struct("grp", "start", "latest"))).alias("_f")), "folds")
    # rows before each fold's latest end: one count per fold and key, no copies of rows
    counts = attach(rows.select(*by, ts), per, by).groupBy(*by).agg(
        F.array(*(F.count_if(C(ts) < F.get("_f", F.lit(i))["latest"]) for i in range(n_splits))).alias("_before")
    )
    table = per.join(counts, by)
    skip = F.floor(C("_n") * F.lit(float(embargo)))
    ranges = F.transform("_f", lambda f, i: F.struct(f["grp"].alias("grp"), f["start"].alias("start"), (F.get("_before", i) + 1 + skip).alias("resume")))
    got = attach(rows.drop("n_rows"), table.select(*by, ranges.alias("_ranges")), by)
    purged = _meets(C("_ranges"), lambda r: ~(F.coalesce(C(t1) < r["start"], F.lit(False)) | (C("rn") >= r["resume"])), C("grp"))
    return SplitRows.write(got.withColumn("purged_by", purged).drop("_ranges"), [[f] for f in range(n_splits)], "fold")


def combinatorial_set(
    df: DataFrame, n_groups: int, k: int, by: Sequence[str] = ("symbol",), ts: str = "ts", t1: str = "t1", embargo: float = 0.0, strict: bool = True,
) -> SplitRows:
    """All choices of ``k`` of ``n_groups`` time groups over rows written once; the purge is that of :func:`purged_splits`."""
    if k >= n_groups:
        raise ValueError("k must be smaller than n_groups")
    rows = purged_by(time_groups(df, n_groups, by, ts), by, ts, t1, "grp", embargo, strict)
    return SplitRows.write(rows, list(combinations(range(n_groups), k)))


def purged_by(df: DataFrame, by: Sequence[str], ts: str, t1: str, grp: str, embargo: float, strict: bool) -> DataFrame:
    """Rows with the sorted groups whose time range purges them from training.

    That is a group in whose range the row starts or ends (with ``strict`` also one
    that it encloses), or after which it starts within the embargo.  The ranges of a
    key are one small array, tested inside the row.
    """
    by = list(by)
    # one row per key and group: bounded by the number of groups
    ranges = df.groupBy(*by, grp).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    table = ranges.groupBy(*by).agg(
        F.collect_list(F.struct(C(grp).alias("grp"), "lo", "hi")).alias("_ranges"),
        (F.timestamp_diff("MICROSECOND", F.min("lo"), F.max("hi")) * F.lit(float(embargo))).alias("_pause"),
    )
    start, end = C(ts), C(t1)

    def hit(r):
        inside = lambda x: (x >= r["lo"]) & (x <= r["hi"])
        out = inside(start) | F.coalesce(inside(end), F.lit(False))
        if strict:
            out = out | F.coalesce((start < r["lo"]) & (end > r["hi"]), F.lit(False))
        late = F.timestamp_diff("MICROSECOND", r["hi"], start)
        return out | ((C("_pause") > 0) & (late > 0) & (late <= C("_pause")))

    return attach(df, table, by).withColumn("purged_by", _meets(C("_ranges"), hit, C(grp))).drop("_ranges", "_pause")


def time_groups(df: DataFrame, n_groups: int, by: Sequence[str] = ("symbol",), ts: str = "ts", out: str = "grp") -> DataFrame:
    """Equal time slices per key; the last one is closed on the right; slices may be empty."""
    us = F.unix_micros(C(ts).cast("timestamp"))
    span = df.groupBy(*by).agg(F.min(us).alias("_a"), F.max(us).alias("_b"))
    got = attach(df, span, by).withColumn("_u", us)
    g = F.when(C("_b") == C("_a"), F.lit(0)).otherwise(
        F.expr(f"least((_u - _a) * {n_groups} div greatest(_b - _a, 1L), {n_groups - 1}L)")
    )
    return got.withColumn(out, g.cast("int")).drop("_a", "_b", "_u")


def combinatorial_splits(spark: SparkSession, n_groups: int, k: int) -> DataFrame:
    """All choices of ``k`` test groups: (split, test, train)."""
    if k >= n_groups:
        raise ValueError("k must be smaller than n_groups")
    rows = [
        (i, list(t), [g for g in range(n_groups) if g not in t])
        for i, t in enumerate(combinations(range(n_groups), k))
    ]
    return spark.createDataFrame(rows, "split int, test array<int>, train array<int>")


def purged_splits(
    df: DataFrame, splits: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "ts", t1: str = "t1",
    grp: str = "grp", embargo: float = 0.0, strict: bool = True,
) -> DataFrame:
    """(split, role) for every row after purge and embargo, as a long table; models use :func:`combinatorial_set` instead.

    A row tests in the splits that test its group and trains in those of whose test
    groups none purges it (:func:`purged_by`).
    """
    plan = splits.select("split", "test").collect()  # C(n, k) choices, a parameter
    choices = F.array(*(F.struct(F.lit(p["split"]).alias("split"), F.array(*map(F.lit, p["test"])).alias("_test")) for p in plan))
    got = purged_by(df, by, ts, t1, grp, embargo, strict).select("*", F.inline(choices))
    is_test, purged = F.array_contains("_test", C(grp)), F.arrays_overlap("purged_by", C("_test"))
    role = F.when(is_test, "test").when(~purged, "train")
    return got.withColumn("role", role).where(C("role").isNotNull()).drop("_test", "purged_by")


def backtest_paths(spark: SparkSession, n_groups: int, k: int, mode: str = "all", seed: int = 0) -> DataFrame:
    """(path, grp, split): which split predicts which group on which path.

    ``all`` uses every prediction: the i-th split that tests a group serves path
    i, giving C(n-1, k-1) complete paths.  ``partition`` uses each split once:
    seeded random packings of disjoint test sets that cover all groups.
    """
    sets = list(combinations(range(n_groups), k))
    rows: list[tuple[int, int, int]] = []
    if mode == "all":
        for g in range(n_groups):
            mine = [s for s, t in enumerate(sets) if g in t]
            rows += [(p, g, s) for p, s in enumerate(mine)]
    elif mode == "partition":
        index = {t: i for i, t in enumerate(sets)}
        rng = random.Random(seed)
        best: list[list[tuple[int, ...]]] = []
        for _ in range(20):
            paths = _packing(set(sets), n_groups, rng)
            best = max(best, paths, key=len)
        rows = [(p, g, index[t]) for p, path in enumerate(best) for t in path for g in t]
    else:
        raise ValueError(f"unknown mode: {mode}")
    return spark.createDataFrame(rows, "path int, grp int, split int")


def _packing(free: set, n_groups: int, rng: random.Random) -> list[list[tuple[int, ...]]]:
    """Draw complete partitions from the unused test sets until none is left."""
    paths = []
    while True:
        path = _cover(frozenset(range(n_groups)), sorted(free), rng)
        if path is None:
            return paths
        free -= set(path)
        paths.append(path)


def _cover(groups: frozenset, sets: list, rng: random.Random) -> list | None:
    if not groups:
        return []
    lead = min(groups)
    options = [t for t in sets if t[0] == lead and groups.issuperset(t)]
    rng.shuffle(options)
    for t in options:
        rest = _cover(groups - set(t), sets, rng)
        if rest is not None:
            return [t, *rest]
    return None


def walk_forward_blocks(tl: Timeline, test_share: float, refit_every: int, window: int | None = None) -> DataFrame:
    """Test rows with their refit block and the row range each block trains on."""
    tl = tl.settle()
    n = tl.rows_per_key()
    cut = F.floor(C("n_rows") * F.lit(1.0 - test_share))
    got = attach(tl.df, n, tl.by).withColumn("_cut", cut).where(C("rn") > C("_cut"))
    block = F.floor((C("rn") - C("_cut") - 1) / refit_every)
    end = C("_cut") + C("block") * refit_every
    low = F.lit(1).cast("bigint") if window is None else F.greatest(F.lit(1), end - window + 1)
    return (
        got.withColumn("block", block).withColumn("train_from", low).withColumn("train_to", end)
        .drop("_cut", "n_rows")
    )


def training_segments(df: DataFrame, by: Sequence[str], rn: str = "rn", ts: str = "clock", chunk_rows: int | None = None) -> DataFrame:
    """Contiguous runs of row numbers as segments, each with a minute clock from 2000-01-01."""
    kw = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    tl = Timeline.build(df.withColumnRenamed(rn, "_pos"), by, ("_pos",), **kw)
    isle = C("_pos") - C("rn")
    firsts = tl.df.withColumn("_isle", isle).groupBy(*by, "_isle").agg(F.min("_pos").alias("_from"))
    # islands are far fewer than rows; numbering them uses the same balanced layout
    numbered = Timeline.build(firsts, by, ("_isle",)).df.select(*by, "_isle", "_from", (C("rn") - 1).alias("segment"))
    got = tl.df.withColumn("_isle", isle).join(numbered, [*by, "_isle"])
    clock = F.timestamp_add("MINUTE", (C("_pos") - C("_from")).cast("int"), F.lit("2000-01-01").cast("timestamp_ntz"))
    return got.withColumn(ts, clock).drop("rn", "_isle", "_from").withColumnRenamed("_pos", rn)
