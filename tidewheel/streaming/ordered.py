"""Ordered folds over unordered streams.

Rows wait in state until the watermark has passed them and are then folded in (ts, seq) order, so rows that arrive out
of order inside the delay count as if they had come in order.  Only rows behind the watermark are late: Spark drops
them and counts them in the query's progress (``numRowsDroppedByWatermark``).

Waiting rows are packed per time bucket in RocksDB map state, one entry per bucket and arrival; an event-time timer per bucket
folds it.  A task holds one Arrow batch or one bucket of one symbol at a time, however large the micro-batch is.  A
heartbeat (a row without a symbol) takes no part but moves the watermark, so a quiet or ending stream can be closed.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KINDS = {"bigint": "<i8", "int": "<i8", "double": "<f8", "float": "<f8"}


def keep_state_on_disk(spark: SparkSession) -> None:
    """Map state and timers need the RocksDB store; an own choice of the session stays."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(_PROVIDER, "HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)


class OrderedFold(StatefulProcessor):
    """``step(row, values) -> (values, made)`` over the rows of a key in order; ``made`` are dicts of output columns."""

    def __init__(self, fields: list[tuple[str, str]], start: tuple, state_schema: str, out: list[str], step: Callable, bucket_ms: int):
        self.kind = np.dtype([("us", "<i8"), ("seq", "<i8"), *fields])
        self.start, self.state_schema, self.out, self.step, self.bucket_ms = start, state_schema, out, step, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint, part bigint", "data binary")
        self.values = handle.getValueState("values", f"parts bigint, {self.state_schema}")
        self.row = namedtuple("row", self.kind.names)

    def _state(self) -> list:
        return list(self.values.get()) if self.values.exists() else [0, *self.start]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # heartbeats
            for _ in rows:
                pass
            return iter(())
        state, seen = self._state(), set(self.handle.listTimers())
        for frame in rows:
            packed = np.empty(len(frame), self.kind)
            for name in self.kind.names:
                packed[name] = frame[name].to_numpy()
            bucket = packed["us"] // (self.bucket_ms * 1000)
            order = np.argsort(bucket, kind="stable")
            found, at = np.unique(bucket[order], return_index=True)
            for b, part in zip(found.tolist(), np.split(packed[order], at[1:]), strict=True):
                state[0] += 1
                self.waiting.updateValue((b, state[0]), (part.tobytes(),))
                expiry = (b + 1) * self.bucket_ms
                if expiry not in seen:
                    self.handle.registerTimer(expiry)
                    seen.add(expiry)
        self.values.update(tuple(state))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // self.bucket_ms
        due: dict[int, list[int]] = {}
        for b, part in self.waiting.keys():
            if b < passed:
                due.setdefault(b, []).append(part)
        if not due:  # an earlier timer of this round has folded the bucket
            return
        parts, *values = self._state()
        for b in sorted(due):
            data = np.concatenate([np.frombuffer(bytes(self.waiting.getValue((b, p))[0]), self.kind) for p in due[b]])
            data = data[np.lexsort((data["seq"], data["us"]))]
            made: list[dict] = []
            for row in data.tolist():
                values, new = self.step(self.row(*row), list(values))
                made += new
            for p in due[b]:
                self.waiting.removeKey((b, p))
            if made:
                frame = pd.DataFrame(made)
                frame["symbol"] = key[0]
                yield frame.reindex(columns=self.out)
        self.values.update((parts, *values))

    def close(self) -> None:
        pass


def ordered_fold(stream: DataFrame, start: tuple, state_schema: str, out_schema: str, step: Callable, bucket: str = "1 minute") -> DataFrame:
    """Fold a watermarked stream per symbol; ``out_schema`` names symbol, us and the columns that ``step`` makes.

    The result has ``ts`` (from ``us``) first and then the other columns.  ``bucket`` is how finely rows wait: it delays a
    result by at most that much beyond the watermark.
    """
    keep_state_on_disk(stream.sparkSession)
    numbers = [(n, _KINDS[t]) for n, t in stream.dtypes if t in _KINDS and n != "seq"]
    rows = stream.select("symbol", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("bigint").alias("seq"), *(n for n, _ in numbers))
    names = [f.split()[0] for f in out_schema.split(", ")]
    width = int(pd.Timedelta(bucket).total_seconds() * 1000)
    fold = OrderedFold(numbers, start, state_schema, names, step, width)
    made = rows.groupBy("symbol").transformWithStateInPandas(fold, out_schema, "Append", "eventTime")
    return made.select(F.timestamp_micros("us").alias("ts"), *(n for n in names if n != "us"))
