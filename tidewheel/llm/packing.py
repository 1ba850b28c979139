"""Best-fit packing of token pieces into sequences by a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits a sequence.  Multiplicative weights price the lengths, a
knapsack dynamic program finds the best configurations at those prices, and every configuration found gets a share of
the demand.  Shares are rounded to whole sequences, what is left is solved again, and the last few pieces are placed
best fit first.  All of this sees only counts per length, at most ``capacity`` numbers however large the corpus is;
pieces find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel import storage
from tidewheel.llm import tokens, worker

Bin = tuple[tuple[int, ...], int]  # lengths in one sequence, number of such sequences


# ------------------------------------------------------------------ plan over the histogram
def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price for each room 0..capacity with repeats allowed, and the length taken there (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gain = price[1 : room + 1] + best[room - 1 :: -1][:room]
        at = int(gain.argmax())
        if gain[at] > best[room - 1]:
            best[room], take[room] = gain[at], at + 1
        else:
            best[room], take[room] = best[room - 1], 0
    return best, take


def _trace(take: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if take[room]:
            out.append(int(take[room]))
            room -= int(take[room])
        else:
            room -= 1
    return out


def _fractional(demand: np.ndarray, capacity: int, rounds: int, rate: float, slack: float) -> dict[tuple[int, ...], float]:
    """Configurations and how many of each: a covering program by multiplicative weights."""
    lengths = np.flatnonzero(demand)
    price = np.zeros(capacity + 1)
    price[lengths] = lengths / capacity  # what full sequences of any make-up are worth alike
    amount: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        best, take = _knapsack(price, capacity)
        worth = price[lengths] + best[capacity - lengths]
        room = demand / rounds  # a round may cover this much of each length
        for length in lengths[worth >= (1 - slack) * worth.max()][::-1].tolist():
            if room[length] <= 0:
                continue
            config = tuple(sorted([length, *_trace(take, capacity - length)], reverse=True))
            parts = Counter(config)
            if any(n > demand[x] for x, n in parts.items()):
                continue
            step = min(room[x] / n for x, n in parts.items())
            if step > 0:
                amount[config] = amount.get(config, 0.0) + step
                for x, n in parts.items():
                    room[x] -= step * n
        missed = room[lengths] * rounds / demand[lengths]  # 1: not covered at all in this round
        price[lengths] *= np.exp(rate * (missed - missed.mean()))
    return amount


def _best_fit(left: np.ndarray, capacity: int) -> list[Bin]:
    """Longest pieces first into the fullest sequence that has room; equal sequences are handled together."""
    room: dict[int, Counter] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                count = capacity // length
                whole, n_rest = divmod(n, count)
                if whole:
                    room.setdefault(capacity - count * length, Counter())[(length,) * count] += whole
                if n_rest:
                    room.setdefault(capacity - n_rest * length, Counter())[(length,) * n_rest] += 1
                n = 0
                continue
            parts, count = next(iter(room[fit].items()))
            each = min(fit // length, n)
            many = min(count, n // each)
            room[fit][parts] -= many
            if not room[fit][parts]:
                del room[fit][parts]
            if not room[fit]:
                del room[fit]
            room.setdefault(fit - each * length, Counter())[parts + (length,) * each] += many
            n -= many * each
    return [(parts, count) for group in room.values() for parts, count in group.items()]


def plan(histogram: dict[int, int], capacity: int, rounds: int = 4, rate: float = 0.5, slack: float = 0.02, solves: int = 4) -> list[Bin]:
    """Sequences for ``histogram`` (count per length, lengths 1..capacity): (lengths, number of such sequences)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    bins: Counter = Counter()
    bins[(capacity,)] += int(left[capacity])
    left[capacity] = 0
    for _ in range(solves):
        total = int((left * np.arange(capacity + 1)).sum())
        if total <= 4 * capacity:
            break
        amount = _fractional(left.astype(float), capacity, rounds, rate, slack)
        placed = 0
        full = sorted(amount.items(), key=lambda x: (-sum(x[0]), -x[1], x[0]))
        for config, share in full:
            parts = Counter(config)
            n = min(min(int(left[x]) // k for x, k in parts.items()), int(share))
            if n > 0 and sum(config) >= capacity * 0.995:
                bins[config] += n
                placed += n
                for x, k in parts.items():
                    left[x] -= n * k
        if not placed:
            break
    for config, n in _best_fit(left, capacity):
        bins[config] += n
    return sorted((b for b in bins.items() if b[1]), key=lambda b: (-sum(b[0]), b[0]))


class Places:
    """Where the r-th piece of a length goes: arrays by length, built from a plan."""

    def __init__(self, bins: list[Bin]):
        first, rows = 0, []
        for config, n in bins:
            at = 0
            for length in config:
                rows.append((length, first, at, n))
                at += length
            first += n
        rows.sort(key=lambda r: r[:3])
        self.sequences = first
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        table = np.array(rows, np.int64).reshape(-1, 4)
        for length in np.unique(table[:, 0]):
            part = table[table[:, 0] == length]
            self.by_length[int(length)] = (np.cumsum(part[:, 3]) - part[:, 3], part[:, 1], part[:, 2])

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, first, at = self.by_length[length]
        i = np.searchsorted(start, rank, side="right") - 1
        return first[i] + rank - start[i], at[i]


# ------------------------------------------------------------------ pieces
def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_words: bool = True) -> DataFrame:
    """Pieces of every text: id, piece, start, length, ids_crc32, and their rank among equal lengths of the same task."""
    path = vocabulary or tokens.vocabulary_path(tokens.WORD_VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        ids, seen, part = tokens.word_ids(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for low in range(0, len(batch), worker.SLICE):
                keys, texts = (c.slice(low, worker.SLICE) for c in batch.columns)
                rows = []
                for i, text in enumerate(texts.to_pylist()):
                    data = ids.encode(text) + end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        chunk = data[at : at + 4 * capacity]
                        n = len(chunk) // 4
                        rows.append((i, piece, at // 4, n, zlib.crc32(chunk), part, int(seen[n])))
                        seen[n] += 1
                owner, *made = zip(*rows, strict=True)
                kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()
                columns = [pa.array(c, k) for c, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), *columns], ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut if keep_words else worker.tidy(cut, last=True), f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_words: bool = True) -> DataFrame:
    """Every piece with its sequence and offset: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds only the end id.  Repeated rows are packed one by one.  An empty
    table has no pieces.  Workers keep the ids of words for their next task; without ``keep_words`` they let go of them
    after each, for jobs whose earlier stages have left more workers than tasks run at a time.
    """
    cut = storage.materialize(pieces(docs, capacity, vocabulary, end_id, id_col, text_col, keep_words), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    places = Places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"])
    kind = docs.schema[id_col].dataType.simpleString()

    def place(batches):
        for batch in batches:
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            length, rank = batch["length"].to_numpy(), (batch["base"] + batch["nth"]).to_numpy()
            for n in np.unique(length):
                here = length == n
                sequence[here], offset[here] = places.find(int(n), rank[here])
            yield batch[["id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    out = ranked.mapInPandas(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
