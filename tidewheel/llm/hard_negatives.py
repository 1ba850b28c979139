"""Hard negatives: for each anchor and each of its positives the best rows of other labels inside a score window.

Vectors become integers, so scores are exact.  Rows stay where they are scanned: a task turns them into blocks and
takes the written anchors in blocks against each, so neither side is collected or multiplied out as rows.

The windows of an anchor's positives overlap.  Their upper limits cut the score axis into disjoint slots, every block
keeps the best k rows per slot (a combiner), a ranked shuffle merges the blocks, and going down from the highest limit
the k best below a limit are those of its slot followed by those below the next limit.  One list per slot thus answers
all windows, and a lower limit cuts the tail.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm import shared_files

ROWS = 16_384
ANCHORS = 128
TASK_SCORES = 1 << 32
_NONE = np.iinfo(np.int64).min


# ------------------------------------------------------------------ blocks of vectors
def _vectors(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) per length of the integer vectors in column ``q``."""
    q = batch.column("q")
    offsets = np.frombuffer(q.buffers()[1], np.int32)[q.offset : q.offset + len(q) + 1]
    values = q.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = []
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        out.append((at, values[offsets[at][:, None] + np.arange(d)]))
    return out


def _row_blocks(batches):
    """(ids, labels, matrix) of at most ROWS rows of one vector length with distinct ids; rows that repeat another count once."""
    held: dict[int, list] = {}

    def closed(parts):
        ids, labels, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(ids, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
            once = ~pd.DataFrame({"i": ids, "l": labels, "x": [r.tobytes() for r in x]}).duplicated().to_numpy()
            ids, labels, x = ids[once], labels[once], x[once]
            turn = pd.Series(ids).groupby(ids).cumcount().to_numpy()
            for t in range(int(turn.max()) + 1):
                yield ids[turn == t], labels[turn == t], x[turn == t]
        else:
            yield ids, labels, x

    for batch in batches:
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        for at, x in _vectors(batch):
            for i in range(0, len(at), ROWS):
                part = at[i : i + ROWS]
                parts = held.setdefault(x.shape[1], [])
                if parts and sum(len(p[0]) for p in parts) + len(part) > ROWS:
                    yield from closed(parts)
                    parts.clear()
                parts.append((ids[part], labels[part], x[i : i + ROWS]))
    for parts in held.values():
        if parts:
            yield from closed(parts)


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, as int64."""
    bound = max(1, a.shape[1]) * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0))
    if bound < 2**47:  # exact in doubles, and with room for a place in a block beside it
        return (a.astype(float) @ x.T.astype(float)).astype(np.int64)
    exact = a.astype(object) @ x.T.astype(object)
    if exact.size and max(abs(int(v)) for v in exact.ravel()) >= 2**47:
        raise OverflowError("a score has more than 47 bits; use a smaller scale")
    return exact.astype(np.int64)


def _best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best per row of ``score`` among those that fit: higher scores first, then lower columns."""
    n = score.shape[1]
    ranked = np.where(fits, score * ROWS + (ROWS - 1 - np.arange(n)), _NONE)
    if n > k:
        at = np.argpartition(ranked, n - k, axis=1)[:, n - k :]
    else:
        at = np.broadcast_to(np.arange(n), score.shape)
    row, place = np.nonzero(np.take_along_axis(ranked, at, 1) != _NONE)
    return row, at[row, place]


def _anchor_batches(folder: str):
    """Batches of the written anchors; one batch of one file is in memory at a time."""
    from pyarrow import fs
    from pyarrow import parquet

    files, path = shared_files.file_system(folder)
    for info in sorted(files.get_file_info(fs.FileSelector(path)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                yield from parquet.ParquetFile(f).iter_batches(ANCHORS)


def _written(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    """A table in the shared folder and a scan of it."""
    folder = shared_files.folder(df.sparkSession, label)
    df.write.parquet(folder)
    return folder, df.sparkSession.read.schema(df.schema).parquet(folder)


def _combine(rows: DataFrame, anchors_at: str, k: int, slots_of) -> DataFrame:
    """Best k rows per block, anchor and slot; ``slots_of(same label, score, anchor batch, numbers)`` yields (slot, fits)."""

    def task(batches):
        for ids, labels, x in _row_blocks(batches):
            for anchors in _anchor_batches(anchors_at):
                number, own, label = (anchors.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "id", "label"))
                for at, a in _vectors(anchors):
                    if a.shape[1] != x.shape[1]:
                        continue
                    score = _scores(a, x)
                    other = ids[None, :] != own[at][:, None]
                    same = labels[None, :] == label[at][:, None]
                    for slot, fits in slots_of(same, score, anchors, at):
                        i, j = _best(score, fits & other, k)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(number[at][i], pa.int64()), pa.array(np.full(len(i), slot, np.int32)), pa.array(score[i, j]), pa.array(ids[j], pa.int64())],
                            ["anchor", "slot", "score", "id"])

    best = rows.mapInArrow(task, "anchor long, slot int, score long, id long")
    # ranks up to k are cut on both sides of the shuffle, so a task sends at most k rows per anchor and slot
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return best.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k).drop("place")


def mine(
    df: DataFrame, anchors: Column, label: Column | str = "label", id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, of: int = 100, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    ``anchors`` is a condition on rows of ``df``.  Components become floor(scale * x).  An anchor's positives are its best
    ``positives`` other rows of its label; the negatives of a positive are the best ``negatives`` rows of other labels with
    low * positive score <= of * score <= high * positive score.  Higher scores are better, ties go to the smaller id.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part.  Vectors of another length than
    the anchor's are not compared with it; empty vectors score 0 among each other.  Rows with an anchor's id are never
    its positives or negatives.  Rows equal in id and score count once for an anchor, and equal anchors count once; rows
    that share only an id are rows of their own.  Scores of more than 47 bits raise.  No anchor, or an empty table, gives no row.
    Other columns of ``df`` are not read.
    """
    if not (0 < of < 1 << 15 and 0 <= low < 1 << 15 and 0 <= high < 1 << 15):
        raise ValueError("low, high and of are small whole numbers")
    spark = df.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    vector = F.col(vector_col)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
        F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale))).alias("q"),
    ).dropna()
    anchors_at, picked = _written(rows.where("is_anchor").select("id", "label", "q").distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    tasks = picked.count() * df.count() // TASK_SCORES
    rows = rows.select("id", "label", "q")
    if tasks > spark.sparkContext.defaultParallelism:
        rows = rows.repartition(tasks)

    def same_label(same, score, batch, at):
        yield 0, same

    best = _combine(rows, anchors_at, positives, same_label)
    most = F.col("score") * high
    limit = F.call_function("div", most - F.pmod(most, F.lit(of)), F.lit(of))
    tops = best.groupBy("anchor").agg(F.collect_set(F.struct((-F.col("score")).alias("down"), "id", "score", limit.alias("limit"))).alias("p"))
    tops = tops.select("anchor", F.array_sort("p").alias("p"))
    limits_at, ready = _written(picked.join(tops, "anchor").withColumn("limits", F.col("p.limit")), "anchors-with-limits")

    def slots(same, score, batch, at):
        limits = batch.column("limits")
        offsets = np.frombuffer(limits.buffers()[1], np.int32)[limits.offset : limits.offset + len(limits) + 1]
        values = limits.values.to_numpy(zero_copy_only=False)
        n = np.diff(offsets)[at]
        for s in range(int(n.max(initial=0))):
            has, deeper = n > s, n > s + 1
            top = np.where(has, values[np.minimum(offsets[at] + s, len(values) - 1)], 0)
            under = np.where(deeper, values[np.minimum(offsets[at] + s + 1, len(values) - 1)], 0)
            yield s, ~same & has[:, None] & (score <= top[:, None]) & (~deeper[:, None] | (score > under[:, None]))

    found = _combine(rows, limits_at, negatives, slots)
    entry = F.struct("slot", (-F.col("score")).alias("down"), "id", "score")
    lists = found.groupBy("anchor").agg(F.array_sort(F.collect_set(entry)).alias("found"))
    held = ready.select("anchor", F.col("id").alias("anchor_id"), "p").join(lists, "anchor")
    kind = "array<struct<slot:int,down:bigint,id:bigint,score:bigint>>"

    def merge(lower: Column, slot: Column) -> Column:
        mine = F.filter("found", lambda e: e["slot"] == slot)
        below = F.coalesce(F.get(lower, F.lit(0)), F.array().cast(kind))
        return F.concat(F.array(F.slice(F.concat(mine, below), 1, negatives)), lower)

    deepest_first = F.sequence(F.size("p") - 1, F.lit(0), F.lit(-1))
    windows = F.aggregate(deepest_first, F.array().cast(f"array<{kind}>"), merge)
    each = held.select("anchor_id", F.posexplode(F.arrays_zip(F.col("p").alias("p"), windows.alias("w"))).alias("slot", "z"))
    kept = F.filter("z.w", lambda e: e["score"] * of >= F.col("z.p.score") * low)
    out = each.select("anchor_id", F.col("z.p").alias("p"), F.posexplode(kept).alias("rank", "n"))
    return out.select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))
