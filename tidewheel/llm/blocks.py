"""Rows of a file-based table by stable address, and answers that travel back to them.

A block is a run of rows of one input file.  A round asks about values (hashes) of the whole corpus: tasks send the
sorted distinct values of their block, tasks per value range find which occur elsewhere too, and the answer is written
to one folder per block.  The next scan opens only the answers of its own block, so texts are read where they lie and
never shuffled.  What a hot value costs is bounded: a block sends it once, however often it has it.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import storage
from tidewheel.llm import shared_files

BLOCK_ROWS = 4096
GROUP_BYTES = 2 << 20


def addressed(df: DataFrame, columns: list[Column], block_rows: int = BLOCK_ROWS, more: list[Column] | None = None) -> DataFrame:
    """``columns``, the row's ``block`` and ``more`` columns of ``_metadata``; a table that is no plain file scan is written first.

    Joins, unions and generators give several rows of one file row: only selections and filters over one scan are plain.
    """
    address = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / block_rows)).alias("block")
    try:
        if not _one_scan(df):
            df = storage.materialize(df, "rows")
        out = df.select(*columns, address, *(more or []))
        out.schema  # noqa: B018  analysed now
        return out
    except AnalysisException:
        return storage.materialize(df.select(*columns), "rows").select("*", address, *(more or []))


def _one_scan(df: DataFrame) -> bool:
    """Whether every row of ``df`` is a row of one scan of its own."""
    node = df._jdf.queryExecution().analyzed()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.children().size() == 0


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def forgetting(spark: SparkSession):
    """Jobs that end in a written table leave no shuffle files behind; the session's own setting comes back."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def planes(values: np.ndarray) -> bytes:
    """Bytes of sorted integers, all first bytes first: the high ones repeat and compress well."""
    if not len(values):
        return b""
    return np.ascontiguousarray(values[:, None].view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


QUESTION = "bucket int, block long, ask1 binary, ask2 binary, tell1 binary, tell2 binary"


def questions(block: int, first: np.ndarray, second: np.ndarray, asks: np.ndarray, buckets: int):
    """Batches for one block: its distinct values (first, second) by bucket.

    ``asks`` marks values whose answer is wanted; the others are only told.  A value that the block has twice counts as
    two tellings, so that it finds itself.
    """
    if not len(first):
        return
    order = np.lexsort((second, first))
    first, second, asks = first[order], second[order], asks[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    wanted = np.maximum.reduceat(asks, at)
    twice = np.diff(np.append(at, len(first))) > 1
    first, second = first[at], second[at]
    edges = np.searchsorted(((first >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for bucket in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[bucket], edges[bucket + 1])
        ask, tell = wanted[part], ~wanted[part] | twice[part]
        rows.append((bucket, block, planes(first[part][ask]), planes(second[part][ask]), planes(first[part][tell]), planes(second[part][tell])))
    names = ["bucket", "block", "ask1", "ask2", "tell1", "tell2"]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], names)


def answers(asked: DataFrame, buckets: int, label: str) -> str:
    """Folder with, per block, the asked values that occur at least twice in the corpus."""
    spark = asked.sparkSession

    def find(batches):
        blocks, first, second, source, wanted = [], [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                for kind in ("ask", "tell"):
                    values = from_planes(row[kind + "1"], np.uint64)
                    first.append(values)
                    second.append(from_planes(row[kind + "2"], np.uint32))
                    source.append(np.full(len(values), len(blocks), np.int32))
                    wanted.append(np.full(len(values), kind == "ask"))
                blocks.append(row["block"])
        if not blocks:
            return
        first, second, source, wanted = (np.concatenate(x) for x in (first, second, source, wanted))
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        again = np.zeros(len(first), bool)
        again[1:] |= same
        again[:-1] |= same
        again &= wanted[order]
        found, where = first[again], source[order][again]
        by = np.argsort(where, kind="stable")
        found, where = found[by], where[by]
        edges = np.searchsorted(where, np.arange(len(blocks) + 1))
        rows = [(b, planes(found[edges[i] : edges[i + 1]])) for i, b in enumerate(blocks) if edges[i] < edges[i + 1]]
        for i in range(0, len(rows), 64):
            b, v = zip(*rows[i : i + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(v, pa.binary())], ["block", "found"])

    folder = shared_files.folder(spark, label)
    found = asked.repartition(buckets, "bucket").mapInArrow(find, "block long, found binary")
    with forgetting(spark):
        found.repartition("block").write.partitionBy("block").parquet(folder)
    return folder


def answer_rows(folder: str, block: int, columns: list[str]) -> list[dict]:
    """Rows of one block's answers."""
    from pyarrow import fs
    from pyarrow import parquet

    files, path = shared_files.file_system(folder)
    place = f"{path}/block={block}"
    if files.get_file_info(place).type == fs.FileType.NotFound:
        return []
    out = []
    for info in files.get_file_info(fs.FileSelector(place)):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                out += parquet.ParquetFile(f).read(columns=columns).to_pylist()
    return out


def answer(folder: str, block: int) -> np.ndarray:
    """Sorted distinct values found for one block."""
    parts = [from_planes(r["found"], np.uint64) for r in answer_rows(folder, block, ["found"])]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


class Answers:
    """The answers of the block that is read just now."""

    def __init__(self, *folders: str):
        self.folders, self.block, self.held = folders, None, []

    def of(self, block: int) -> list[np.ndarray]:
        if block != self.block:
            self.block, self.held = block, [answer(f, block) for f in self.folders]
        return self.held


def text_groups(batches, most: int = GROUP_BYTES):
    """(block, (batch, first row, end row), bytes, offsets) for runs of rows of one block; texts stay whole.

    The first two columns of the batches are block and text.
    """
    for batch in batches:
        block = batch.column(0).to_numpy(zero_copy_only=False)
        text = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        row = 0
        while row < len(block):
            end = row + 1
            while end < len(block) and block[end] == block[row] and offsets[end + 1] - offsets[row] <= most:
                end += 1
            yield int(block[row]), (batch, row, end), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def member(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == values
