"""Probability of backtest overfitting by combinatorially symmetric cross-validation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.lookup import attach
from tidewheel.timeline import Timeline

C = F.col


SLICES = 64


def _in_order(position: str, *cols: str) -> list[Column]:
    """Sums of a small group, added in the order of ``position``; nulls count as nothing."""
    rows = F.array_sort(F.collect_list(F.struct(position, *cols)))
    total = lambda c: F.aggregate(rows, F.lit(0.0), lambda t, row: t + F.coalesce(row[c], F.lit(0.0)))
    return [total(c).alias(c) for c in cols]


def block_moments(tl: Timeline, blocks: int, ret: str = "ret", config: str = "config") -> DataFrame:
    """n, sum and sum of squares per block of every series of ``tl``; rows beyond equal blocks are cut off.

    ``tl`` is numbered per config (and further keys).  After this no step touches the raw returns.
    Rows are added in order within a chunk, then chunks in order: configs with the same returns get the same bits
    however the rows lie in partitions, so that they tie.
    """
    if blocks % 2:
        raise ValueError("the number of blocks must be even")
    by = list(tl.by)
    tl = tl.settle()
    n = tl.df.groupBy(*by).agg(F.max("rn").alias("_n"))
    shortest = n.agg(F.min("_n")).first()[0] or 0
    if shortest < blocks:
        raise ValueError(f"{shortest} periods are fewer than {blocks} blocks")
    got = attach(tl.df, n, by).withColumn("block", F.expr(f"(rn - 1) div (_n div {blocks})").cast("int"))
    got = got.where(C("block") < blocks).select(*by, "block", "rn", tl.chunk.alias("_t"), C(ret).cast("double").alias("s"))
    got = got.withColumn("q", C("s") * C("s"))
    per = got.groupBy(*by, "block", "_t").agg(F.count("s").alias("n"), *_in_order("rn", "s", "q"))
    return per.groupBy(*by, "block").agg(F.sum("n").cast("double").alias("n"), *_in_order("_t", "s", "q"))


def _sharpe(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Mean over deviation to 12 places: the order of summation must not decide ties."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = s / n
        sd = np.sqrt(np.maximum((q - s * s / n) / (n - 1), 0.0))
        ratio = np.round(mean / sd, 12)
        flat = np.where(mean == 0, 0.0, np.sign(mean) * np.inf)
    return np.nan_to_num(np.where(sd == 0, flat, ratio), nan=0.0, posinf=np.inf, neginf=-np.inf)


def _chosen(inside: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sum of the chosen blocks (choices x configs), block by block: a matrix product may add equal columns in unequal ways."""
    total = np.zeros((len(inside), m.shape[1]))
    for b, row in enumerate(m):
        total += np.where(inside[:, b, None], row, 0.0)
    return total


def _choices(first: int, end: int, blocks: int) -> np.ndarray:
    """Bit sets from ``first`` up to ``end`` that hold half of the blocks."""
    ids = np.arange(first, end, dtype=np.int64)
    return ids[np.bitwise_count(ids) == blocks // 2]


def symmetric_cv(tl: Timeline, blocks: int = 16, ret: str = "ret", config: str = "config", convention: str = "paper") -> DataFrame:
    """Relative out-of-sample rank of the in-sample best config for every half/half choice of blocks.

    Keys of ``tl`` other than ``config`` are judged each by itself.  Choices are bit sets; a task takes a slice of them
    and adds the block moments of a key (configs x blocks numbers) for all its choices at once.  The work is choices x configs, whatever the length of the return series, and nothing is joined on a block.
    ``paper`` ranks 1 = worst, ``reference`` ranks 1 = best.
    """
    by = [k for k in tl.by if k != config]
    moments = block_moments(tl, blocks, ret, config)
    per = moments.groupBy(*by, config).agg(F.array_sort(F.collect_list(F.struct("block", "n", "s", "q"))).alias("m"))
    per = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(C(config).alias("config"), C("m.n").alias("n"), C("m.s").alias("s"), C("m.q").alias("q")))).alias("m"))
    slices = min(SLICES, 1 << blocks)
    width = (1 << blocks) // slices
    tasks = per.select(*by, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"), C("m.config").alias("c"), *(C(f"m.{x}").alias(x) for x in "nsq"))

    def judge(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                configs = list(row["c"])
                whole = [np.stack([np.asarray(x, float) for x in row[k]], axis=1) for k in "nsq"]  # blocks x configs
                for first in range(row["_slice"] * width, (row["_slice"] + 1) * width, 1 << 14):
                    ids = _choices(first, min(first + (1 << 14), (row["_slice"] + 1) * width), blocks)
                    if not len(ids):
                        continue
                    inside = ((ids[:, None] >> np.arange(blocks)) & 1).astype(bool)
                    inner, outer = (_sharpe(*(_chosen(side, m) for m in whole)) for side in (inside, ~inside))
                    best = inner.argmax(axis=1)  # the first of equals
                    mine = np.take_along_axis(outer, best[:, None], 1)
                    rank = 1 + (outer > mine).sum(1) + ((outer == mine) & (np.arange(len(configs)) < best[:, None])).sum(1)
                    if convention != "reference":
                        rank = len(configs) + 1 - rank
                    out = pd.DataFrame({"choice": ids, "best": [configs[b] for b in best], "omega": rank / (len(configs) + 1)})
                    for k in by:
                        out[k] = row[k]
                    yield out[[*by, "choice", "best", "omega"]]

    fields = [tl.df.schema[k] for k in by]
    best = T.StructField("best", tl.df.schema[config].dataType)
    schema = T.StructType([*fields, T.StructField("choice", T.LongType()), best, T.StructField("omega", T.DoubleType())])
    return tasks.repartition("_slice", *by).mapInPandas(judge, schema)


def overfitting_probability(omega: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of choices whose best config ranks in the lower half, per key."""
    return omega.groupBy(*by).agg(
        F.avg((C("omega") < 0.5).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("choices")
    )


def best_config(scores: DataFrame, score: str, config: str = "config", by: Sequence[str] = ()) -> DataFrame:
    """Highest score per key; the first config wins ties."""
    return scores.groupBy(*by).agg(F.min_by(config, F.struct((-C(score)).alias("k"), C(config))).alias("best"))
