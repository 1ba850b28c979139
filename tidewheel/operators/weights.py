"""Concurrency of labelled intervals and sample weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import rolling as R
from tidewheel.lookup import attach
from tidewheel.storage import materialize
from tidewheel.timeline import Recipe, Timeline

C = F.col


def concurrent_labels(
    events: DataFrame, index: DataFrame, by: Sequence[str] = ("symbol",),
    start: str = "ts", end: str = "event_end_time", chunk_rows: int | None = None,
) -> DataFrame:
    """Open labels at each index time, the end exclusive.

    Counts are made at event times; an index row shows the count of the last
    event time that is itself on the index.  Index rows of equal time are counted
    per time and come back as so many rows.
    """
    ok = events.where(C(end).isNotNull())
    marks = (
        ok.select(*by, C(start).alias("ts"), F.lit(1).alias("d"))
        .unionByName(ok.select(*by, C(end).alias("ts"), F.lit(-1).alias("d")))
        .withColumn("g", F.lit(0))
    )
    grid = index.select(*by, "ts", F.lit(None).cast("int").alias("d"), F.lit(1).alias("g"))
    merged = marks.unionByName(grid).groupBy(*by, "ts").agg(F.sum("d").alias("d"), F.sum("g").alias("g"))
    kw = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    tl = Timeline.build(merged, by, ("ts",), **kw)
    summed = tl.running(keep=["ts", "d", "g"], _cum=("sum", "d"))
    seen = summed.extend(_at=F.when(C("d").isNotNull() & (C("g") > 0), C("_cum")))
    done = seen.running(keep=["ts", "g"], _n=("last", "_at")).df.where(C("g") > 0)
    found = done.select(*by, "ts", "g", F.coalesce("_n", F.lit(0)).cast("bigint").alias("concurrency"))
    return found.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), C("g")))).drop("g", "_i")


def co_events(tl: Timeline, events: DataFrame, out: str = "n_co") -> Timeline:
    """Open events at each row of the series, both ends inclusive (``start_rn``, ``end_rn``).

    Adds ``is_start`` for rows that start an event.  A null end means the end of
    the series.
    """
    by = tl.by
    marks = (
        events.select(*by, C("start_rn").alias("rn"), F.lit(1).alias("d"), F.lit(1).alias("s"))
        .unionByName(
            events.where(C("end_rn").isNotNull()).select(
                *by, (C("end_rn") + 1).alias("rn"), F.lit(-1).alias("d"), F.lit(0).alias("s")
            )
        )
        .groupBy(*by, "rn")
        .agg(F.sum("d").alias("_d"), F.max("s").alias("_s"))
    )
    grid = tl.with_df(tl.df.join(marks, [*by, "rn"], "left"))
    done = grid.running(_n=("sum", "_d"))
    df = done.df.withColumns(
        {out: F.coalesce("_n", F.lit(0)), "is_start": F.coalesce("_s", F.lit(0)) == 1}
    )
    return tl.with_df(df.drop("_n", "_d", "_s"))


def average_uniqueness(tl: Timeline, events: DataFrame, out: str = "uniqueness") -> DataFrame:
    """Mean of 1 / concurrency over the event-start rows inside each event.

    Two prefix sums and two equi-joins on row numbers replace the loop over each
    interval, so the cost does not depend on interval length.
    """
    by = tl.by
    slim = tl.with_df(tl.df.select(*by, "rn"))
    counted = co_events(slim, events)
    prefix = counted.extend(
        _inv=F.when(C("is_start"), 1.0 / C("n_co")), _one=F.when(C("is_start"), 1)
    ).running(keep=["_inv"], _p=("sum", "_inv"), _c=("count", "_one"))
    at_end = prefix.df.select(*by, C("rn").alias("end_rn"), C("_p").alias("_pe"), C("_c").alias("_ce"))
    at_start = prefix.df.select(
        *by, C("rn").alias("start_rn"), (C("_p") - C("_inv")).alias("_ps"), (C("_c") - 1).alias("_cs")
    )
    got = events.where(C("end_rn").isNotNull()).join(at_start, [*by, "start_rn"]).join(at_end, [*by, "end_rn"])
    value = (C("_pe") - C("_ps")) / (C("_ce") - C("_cs"))
    return got.withColumn(out, value).drop("_pe", "_ce", "_ps", "_cs")


def sample_weights(tl: Timeline, events: DataFrame, price: str = "Close", out: str = "sample_weight") -> DataFrame:
    """Uniqueness times absolute log return at the start, summing to 1 per key.

    The total is one aggregate row per key joined back, not a window per key.
    """
    by = tl.by

    def s(w):
        return {"_lr": F.abs(F.log(C(price)) - F.log(R.prev(C(price), w)))}

    moves = tl.apply(Recipe(("_lr",), (s,), (price,), 1), keep=[]).df
    moves = moves.select(*by, C("rn").alias("start_rn"), "_lr")
    raw = average_uniqueness(tl, events).join(moves, [*by, "start_rn"])
    raw = materialize(raw.withColumn("_w", C("uniqueness") * C("_lr")), "weights")
    totals = raw.groupBy(*by).agg(F.sum("_w").alias("_sum"))
    return attach(raw, totals, by).withColumn(out, F.try_divide(C("_w"), C("_sum"))).drop("_lr", "_w", "_sum")


def concurrency_summary(df: DataFrame, group: Sequence[str], x: str = "concurrency") -> DataFrame:
    from tidewheel.operators.stats import describe

    return describe(df, group, x)


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (classes * class count) per row."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    whole = per.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    # one row broadcast against the class counts
    table = per.join(F.broadcast(whole)).select(label, (C("_n") / (C("_k") * C("_nc"))).alias(out))
    return attach(df, table, [label])


def positive_weight(label: Column) -> Column:
    """Negatives per positive, as one aggregate expression."""
    return F.try_divide(F.count_if(label == 0), F.count_if(label == 1))
