"""Alignment of series: as-of, equi, semi/anti and bounded range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.lookup import attach, bounded
from tidewheel.timeline import DEFAULT_CHUNK_ROWS, Timeline


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str] = ("symbol",),
    left_on: str = "ts",
    right_on: str = "ts",
    right_cols: Sequence[str] = (),
    direction: str = "backward",
    strict: bool = False,
    right_tie: Sequence[str] = (),
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """For each left row the last right row at or before it (or first at or after it).

    Both sides are laid out as one series, so the work is balanced by row count
    whatever the key skew, and the match is a running last / next non-null value
    carried across chunks.  ``strict`` excludes equal times; ``right_tie`` orders
    right rows of equal time.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction: {direction}")
    right_first = (direction == "backward") != strict
    payload = F.struct(*right_cols)
    none = F.lit(None)
    lrow = F.struct(*left.columns)
    tie = F.struct(*(F.col(c) for c in right_tie)) if right_tie else F.struct(F.lit(0).alias("z"))
    lefts = left.select(
        *by,
        F.col(left_on).alias("_at"),
        F.lit(1 if right_first else 0).alias("_side"),
        none.cast(right.select(tie.alias("x")).schema["x"].dataType).alias("_tie"),
        lrow.alias("_left"),
        none.cast(right.select(payload.alias("x")).schema["x"].dataType).alias("_right"),
    )
    rights = right.select(
        *by,
        F.col(right_on).alias("_at"),
        F.lit(0 if right_first else 1).alias("_side"),
        tie.alias("_tie"),
        none.cast(left.select(lrow.alias("x")).schema["x"].dataType).alias("_left"),
        payload.alias("_right"),
    )
    tl = Timeline.build(lefts.unionByName(rights), by, ("_at", "_side", "_tie"), chunk_rows)
    kind = "last" if direction == "backward" else "first_after"
    done = tl.running(keep=["_left"], _hit=(kind, "_right")).df.where(F.col("_left").isNotNull())
    return done.select("_left.*", *(F.col("_hit")[c].alias(c) for c in right_cols))


def inner_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")


def left_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left")


def outer_on(left: DataFrame, right: DataFrame, keys: Sequence[str], drop_incomplete: bool = False) -> DataFrame:
    """Full alignment; dropping incomplete rows afterwards is an inner join with a null filter."""
    if drop_incomplete:
        return left.join(right, list(keys), "inner").na.drop()
    return left.join(right, list(keys), "full")


def semi_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")


def anti_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")


def overlaps(start: Column, end: Column, lo: Column, hi: Column, enclosing: bool = True) -> Column:
    """Interval [start, end] touches [lo, hi]; without ``enclosing`` only an end point inside counts."""
    if enclosing:
        return (start <= hi) & (end >= lo)
    return ((start >= lo) & (start <= hi)) | ((end >= lo) & (end <= hi))


def filter_by_overlap(
    rows: DataFrame, ranges: DataFrame, by: Sequence[str] = ("symbol",), start: str = "ts", end: str = "t1",
    lo: str = "lo", hi: str = "hi", keep: str = "outside", chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Rows whose [start, end] touches no range of their key (or only those that touch one).

    A row touches a range exactly when, of the ranges that begin by its end, the
    latest end is not before its start.  That is a running maximum over both
    sides laid out by time: no pairs are formed, however many ranges overlap.
    """
    if keep not in ("outside", "inside"):
        raise ValueError(f"unknown side: {keep}")
    none = F.lit(None)
    lrow = F.struct(*rows.columns)
    a = rows.select(
        *by, F.col(end).alias("_at"), F.lit(1).alias("_side"), lrow.alias("_row"), none.cast(ranges.schema[hi].dataType).alias("_hi")
    )
    b = ranges.select(
        *by, F.col(lo).alias("_at"), F.lit(0).alias("_side"), none.cast(rows.select(lrow.alias("x")).schema["x"].dataType).alias("_row"), F.col(hi).alias("_hi")
    )
    tl = Timeline.build(a.unionByName(b), by, ("_at", "_side"), chunk_rows)
    done = tl.running(keep=["_row"], _top=("max", "_hi")).df.where(F.col("_row").isNotNull())
    touches = F.coalesce(F.col("_top") >= F.col("_row")[start], F.lit(False))
    return done.where(touches if keep == "inside" else ~touches).select("_row.*")


def with_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row for every entry of a counted parameter grid."""
    return df.join(bounded(grid, 10_000), how="cross")
