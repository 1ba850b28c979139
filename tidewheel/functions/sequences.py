"""Model-input windows as array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.timeline import Recipe, Timeline

C = F.col


def sliding(tl: Timeline, x: str, size: int, stride: int = 1, out: str = "sequence") -> DataFrame:
    """Last ``size`` values of every ``stride``-th full window, keyed by its last row."""
    def s(w):
        f = w.rowsBetween(-(size - 1), 0)
        take = (F.count(F.lit(1)).over(f) == size) & ((C("rn") - size) % stride == 0)
        return {out: F.when(take, F.collect_list(x).over(f))}

    return tl.apply(Recipe((out,), (s,), (x,), size)).df.where(C(out).isNotNull())


def context_and_horizon(tl: Timeline, cols: Sequence[str], context: int, horizon: int) -> DataFrame:
    """Rows before each row and the ``horizon`` rows from it on, padded with the last known row."""
    row = F.struct(*cols)

    def s(w):
        return {
            "context": F.collect_list(row).over(w.rowsBetween(-context, -1)),
            "_next": F.collect_list(row).over(w.rowsBetween(0, horizon - 1)),
        }

    def pad(w):
        last = F.element_at("_next", -1)
        return {"future": F.slice(F.concat("_next", F.array_repeat(last, horizon)), 1, horizon)}

    rec = Recipe(("context", "future"), (s, pad), tuple(cols), context, horizon)
    return tl.apply(rec, keep=list(tl.order)).df.where(F.size("context") > 0)
