"""Row filters, fills and column selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.rolling import clean
from tidewheel.lookup import attach
from tidewheel.timeline import Timeline

C = F.col


def time_range(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Inclusive bounds; a zone on a bound is dropped.  A plain filter, so it reaches the scan."""
    for bound, keep in ((start, lambda b: C(ts) >= b), (end, lambda b: C(ts) <= b)):
        if bound is not None:
            df = df.where(keep(F.lit(str(bound)).cast("timestamp_ntz")))
    return df


def to_micro_units(df: DataFrame, cols=("Open", "High", "Low", "Close"), unit: float = 1_000_000.0) -> DataFrame:
    return df.withColumns({c: C(c) / unit for c in cols if c in df.columns})


def keep_listed(df: DataFrame, wanted: Sequence[str], keys: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Listed columns that exist (with the keys) and the names that are missing."""
    have = [c for c in wanted if c in df.columns]
    return df.select(*keys, *have), [c for c in wanted if c not in df.columns]


def drop_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop named level (non-stationary) columns."""
    return df.drop(*cols)


def drop_constant(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Drop columns with one value (one min/max pass; only the result row reaches the driver)."""
    cols = [c for c in df.columns if c not in keys]
    row = df.agg(
        *(F.min(c).eqNullSafe(F.max(c)).alias(c) for c in cols)
    ).first()
    return df.select(*keys, *(c for c in cols if not row[c]))


def fill(tl: Timeline, cols: Sequence[str], order: Sequence[str] = ("ffill", "bfill"), zero: bool = True) -> Timeline:
    """Infinities to null, then the fills in the given order, then 0.

    A backward fill shows future values to the first rows; leave it out
    (``order=("ffill",)``) for a causal table.  Wide tables would need two window
    expressions per column; here each chunk reports its first and last known
    values, those small rows are carried per column, and a second pass fills.
    """
    cols, by = list(cols), list(tl.by)
    keys = [*by, "_t"]
    types = {c: tl.df.schema[c].dataType for c in cols}
    rest = [c for c in tl.df.columns if c not in cols]
    base = tl.with_df(
        tl.df.select(*rest, *(clean(C(c).cast("double")).alias(c) for c in cols))
    ).chunked()
    edge = T.StructType(
        [base.schema[k] for k in keys] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("lo", "hi")]
    )

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("rn")[cols]
        row = {k: pdf[k].iloc[0] for k in keys}
        pick = lambda f: [None if np.isnan(x) else float(x) for x in f.to_numpy(dtype=float)]
        return pd.DataFrame([{**row, "lo": pick(v.bfill().iloc[0]), "hi": pick(v.ffill().iloc[-1])}])

    per = base.select(*keys, "rn", *cols).groupBy(*keys).applyInPandas(edges, edge)
    long = per.select(*keys, F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "e"))
    w = Window.partitionBy(*by, "pos").orderBy("_t")
    before = F.last("e.hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    down = Window.partitionBy(*by, "pos").orderBy(F.desc("_t"))
    after = F.last("e.lo", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    carry = (
        long.select(*keys, "pos", before.alias("b"), after.alias("a"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "b", "a"))).alias("_c"))
        .select(*keys, C("_c.b").alias("_before"), C("_c.a").alias("_after"))
    )
    full = base.join(carry, keys)
    out = T.StructType([base.schema[c] for c in [*rest, *cols]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        v = pdf[cols]
        edge_of = {
            "ffill": dict(zip(cols, np.array(pdf["_before"].iloc[0], dtype=float))),
            "bfill": dict(zip(cols, np.array(pdf["_after"].iloc[0], dtype=float))),
        }
        for o in order:
            v = getattr(v, o)().fillna({c: x for c, x in edge_of[o].items() if not np.isnan(x)})
        return pd.concat([pdf[rest], v.fillna(0.0) if zero else v], axis=1)

    filled = full.groupBy(*keys).applyInPandas(run, out)
    restored = [F.nanvl(C(c), F.lit(None)).cast(types[c]).alias(c) for c in cols]
    return tl.with_df(filled.select(*rest, *restored))


def recode(label: str, mapping: dict[int, int]) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(C(label) == k, v) if out is None else out.when(C(label) == k, v)
    return out


def binarize(x: str, threshold: float) -> Column:
    """1 above, -1 below minus the threshold, else 0."""
    return F.when(C(x) > threshold, 1).when(C(x) < -threshold, -1).otherwise(0)


def zoom(df: DataFrame, x: str, low: float = -0.1, high: float = 0.1) -> DataFrame:
    return df.where(C(x).between(low, high))


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, weekday (Monday 0) and month."""
    return df.withColumns(
        {"hour": F.hour(ts), "weekday": F.weekday(ts), "month": F.month(ts)}
    )


def cap_outliers(df: DataFrame, by: Sequence[str], x: str, low: float = 0.01, high: float = 0.99, accuracy: int = 10_000) -> DataFrame:
    """Clip to approximate quantiles per key (sketch aggregate, joined back)."""
    q = df.groupBy(*by).agg(F.percentile_approx(x, [low, high], accuracy).alias("_q"))
    return attach(df, q, by).withColumn(
        x, F.least(F.greatest(C(x), C("_q")[0]), C("_q")[1])
    ).drop("_q")


def scale(df: DataFrame, by: Sequence[str], cols: Sequence[str], kind: str = "standard") -> DataFrame:
    """Standard (population deviation) or min-max scaling per key; constants become 0."""
    aggs = []
    for c in cols:
        if kind == "standard":
            aggs += [F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_b_{c}")]
        else:
            aggs += [F.min(c).alias(f"_a_{c}"), (F.max(c) - F.min(c)).alias(f"_b_{c}")]
    stats = df.groupBy(*by).agg(*aggs)
    got = attach(df, stats, by) if by else df.join(F.broadcast(stats))
    done = got.withColumns(
        {c: (C(c) - C(f"_a_{c}")) / F.when(C(f"_b_{c}") == 0, F.lit(1.0)).otherwise(C(f"_b_{c}")) for c in cols}
    )
    return done.drop(*(f"_{p}_{c}" for p in "ab" for c in cols))


def head_tail(tl: Timeline, tail_share: float) -> DataFrame:
    """Positional split: the last ``tail_share`` of every key is ``test``, the rest ``train``."""
    tl = tl.settle()
    n = tl.rows_per_key()
    cut = F.floor(C("n_rows") * F.lit(1.0 - tail_share))
    role = F.when(C("rn") <= cut, "train").otherwise("test")
    return attach(tl.df, n, tl.by).withColumn("role", role).drop("n_rows")


def three_way(tl: Timeline, train: float, validation: float) -> DataFrame:
    """Chronological train / validation / test roles."""
    tl = tl.settle()
    n = tl.rows_per_key()
    a, b = F.floor(C("n_rows") * F.lit(train)), F.floor(C("n_rows") * F.lit(train + validation))
    role = F.when(C("rn") <= a, "train").when(C("rn") <= b, "validation").otherwise("test")
    return attach(tl.df, n, tl.by).withColumn("role", role).drop("n_rows")


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Last row of each key as a partial aggregate."""
    top = df.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return top.select(*by, "_r.*")


def top_k(df: DataFrame, x: str, k: int, largest: bool = True) -> DataFrame:
    return df.orderBy(F.desc(x) if largest else F.asc(x)).limit(k)
