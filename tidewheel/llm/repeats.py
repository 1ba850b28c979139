"""Removal of byte strings that repeat anywhere in the corpus, by a difference-cover sample of suffixes.

The sample holds the positions of a text whose number modulo 307 lies in a perfect difference set of 18 residues (the
generalised form of the two residues modulo 3 of the triple algorithm).  Any two positions have a common shift below
307 that brings both into the sample, so two equal strings of ``length`` bytes share a sampled position at the same
distance from their starts, with at least ``length - 306`` equal bytes after it.  Three rounds follow:

1. sampled tuples: the first ``length - 306`` bytes after each sampled position are named and the names sorted;
   a position whose name occurs once can lie in no repeat;
2. recursion on names: sampled positions that are left are named by ``length`` bytes; equal neighbours are repeats;
3. remaining suffixes: positions up to 306 bytes before a left sample are merged in by their own ``length`` bytes,
   unless their bytes are known to go; equal neighbours are repeats.

Names are hashes: 64 bits in round 1, whose errors only add candidates, and 96 bits where a name decides.  Names are
dealt out by range, sorted in tasks, and compared with their neighbours; answers go back to blocks of rows, so texts
stay where they are.  ``passes`` splits round 3 by hash so that its exchange stays within a fraction of the input.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import blocks
from tidewheel.llm.hashing import namer

#: fixed: a perfect difference set modulo 307; every non-zero residue is exactly one difference
MODULUS = 307
COVER = (0, 1, 3, 44, 56, 61, 67, 75, 82, 91, 95, 124, 160, 178, 200, 210, 237, 262)
FLUSH = 1 << 20


@functools.cache
def _sampled(upto: int) -> np.ndarray:
    residues = np.array(COVER, np.int64)
    return (np.arange(upto // MODULUS + 1, dtype=np.int64)[:, None] * MODULUS + residues).reshape(-1)


def sampled_positions(sizes: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Sampled positions of all texts of a group with at least ``least`` bytes after them."""
    cover = _sampled(1 << int(max(sizes.max(initial=0), 1)).bit_length())
    counts = np.searchsorted(cover, sizes - least, side="right")
    return np.concatenate([cover[:n] + s for n, s in zip(counts.tolist(), starts.tolist(), strict=True)]) if len(sizes) else np.empty(0, np.int64)


class Group:
    """Some whole texts of one block as one byte array."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
        self.data, self.starts, self.ends, self.length = data, starts, ends, length
        self.sums = namer(0).sums(data)

    def end_of(self, at: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.starts, at, side="right") - 1]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions and their short names."""
        short = self.length - MODULUS + 1
        at = sampled_positions(self.ends - self.starts, self.starts, short)
        return at, namer(0).names(self.sums, at, short)

    def left(self, known: np.ndarray) -> np.ndarray:
        """Sampled positions whose short name occurs elsewhere."""
        at, names = self.anchors()
        return at[blocks.member(known, names)]

    def sampled_windows(self, left: np.ndarray) -> np.ndarray:
        """Whole strings at sampled positions that are left, and at the end of the texts that have any."""
        at = left[left + self.length <= self.end_of(left)]
        last = np.unique(self.end_of(left)) - self.length
        last = last[last >= self.starts[np.searchsorted(self.ends, last + self.length)]] if len(last) else last
        return np.unique(np.concatenate([at, last]))

    def names(self, at: np.ndarray) -> np.ndarray:
        return namer(0).names(self.sums, at, self.length)

    def second(self, at: np.ndarray) -> np.ndarray:
        sums = namer(1).sums(self.data)
        return (namer(1).names(sums, at, self.length) >> np.uint64(32)).astype(np.uint32)

    def covered(self, at: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.length, -1)
        return np.cumsum(edge[:-1]) > 0

    def candidates(self, left: np.ndarray) -> np.ndarray:
        """All positions up to 306 bytes before a sample that is left, with a whole string after them."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        first = np.maximum(left - MODULUS + 1, self.starts[np.searchsorted(self.starts, left, side="right") - 1])
        np.add.at(edge, first, 1)
        np.add.at(edge, left + 1, -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        return at[at + self.length <= self.end_of(at)]

    def open(self, at: np.ndarray, covered: np.ndarray) -> np.ndarray:
        """Which strings have a byte that is not covered yet."""
        before = np.zeros(len(covered) + 1, np.int64)
        np.cumsum(covered, out=before[1:])
        return before[at + self.length] - before[at] < self.length


def _groups(batches, length: int):
    """(block, rows of the batch, Group, byte offsets) for runs of whole texts of one block."""
    for block, place, data, at in blocks.text_groups(batches):
        full = np.flatnonzero(np.diff(at) > 0)  # texts without bytes would share a start with the next one
        yield block, place, Group(data, at[:-1][full], at[1:][full], length), at


def _asking(produce, folders: list[str], length: int, buckets: int):
    """A task that sends what ``produce(group, *answers)`` gives: (names, second names, which are asked)."""

    def task(batches):
        known, held, block, size = blocks.Answers(*folders), [], None, 0
        for at, _, group, _ in _groups(batches, length):
            if held and (at != block or size > FLUSH):
                yield from blocks.questions(block, *(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
                held, size = [], 0
            block = at
            made = produce(group, *known.of(block))
            if made is not None and len(made[0]):
                held.append(made)
                size += len(made[0])
        if held:
            yield from blocks.questions(block, *(np.concatenate(x) for x in zip(*held, strict=True)), buckets)

    return task


def remove(docs: DataFrame, length: int = 400, passes: int = 2, id_col: str = "doc_id", text_col: str = "text", block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """One row per document: id, kept (the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``length`` bytes over it also starts at another place of the corpus.  Null texts are
    empty; repeated rows are places of their own, so both go.  An empty table has no rows.
    """
    if length < MODULUS + 15:
        raise ValueError(f"length must be at least {MODULUS + 15}")
    rows = blocks.addressed(docs, [F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")], block_rows)
    bare = rows.select("block", "text")
    total = bare.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    few = max(24, total // (17 << 20))
    many = max(24, total // (passes * (2 << 20)))

    def first(group):
        at, names = group.anchors()
        return names, np.zeros(len(at), np.uint32), np.ones(len(at), bool)

    one = blocks.answers(bare.mapInArrow(_asking(first, [], length, few), blocks.QUESTION), few, "tuples")

    def second(group, known):
        left = group.left(known)
        if len(left):
            at = group.sampled_windows(left)
            return group.names(at), group.second(at), np.ones(len(at), bool)

    two = blocks.answers(bare.mapInArrow(_asking(second, [one], length, few), blocks.QUESTION), few, "names")

    def merged(number):
        def third(group, known, sampled):
            left = group.left(known)
            if len(left):
                at = group.sampled_windows(left)
                covered = group.covered(at[blocks.member(sampled, group.names(at))])
                at = group.candidates(left)
                names = group.names(at)
                mine = names % np.uint64(passes) == number
                at, names = at[mine], names[mine]
                return names, group.second(at), group.open(at, covered)

        return third

    rest = [blocks.answers(bare.mapInArrow(_asking(merged(n), [one, two], length, many), blocks.QUESTION), many, "suffixes") for n in range(passes)]

    def cut(batches):
        known = blocks.Answers(one, two, *rest)
        for block, (batch, row, end), group, at in _groups(batches, length):
            ones, twos, *others = known.of(block)
            gone = np.zeros(len(group.data), bool)
            left = group.left(ones)
            if len(left):
                place = group.sampled_windows(left)
                place = place[blocks.member(twos, group.names(place))]
                more = group.candidates(left)
                names = group.names(more)
                more = more[np.logical_or.reduce([blocks.member(x, names) for x in others])]
                gone = group.covered(np.concatenate([place, more]))
            out = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                cover = gone[a:b]
                kept = group.data[a:b][~cover].tobytes()
                begins = int(cover[:1].sum()) + int((cover[1:] & ~cover[:-1]).sum())
                out.append((kept, b - a, int(cover.sum()), begins, hashlib.sha256(kept).hexdigest()))
            columns = [batch.column(2).slice(row, end - row), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), *[pa.int64()] * 3, pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.select("block", "text", "id").mapInArrow(cut, f"id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
