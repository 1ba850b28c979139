"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes.

A text is cut before single spaces between words, where neither vocabulary ever joins tokens, so the parts are encoded
once per worker (a cache bounded by bytes), new ones together.  The decoded bytes of the tokens, put together, must be the
text; their lengths then add up to the byte offsets where tokens end, inside characters too.  Byte offsets where both have
a cut close a group; all tokens of a group are linked.

Links per document are written once, as sorted id pairs with multiplicity.  Documents per pair are counted over
blocks of rows: a block tells each distinct pair once, the totals come back to the block's own folder, and
the last scan reads the links of a block beside its totals.  No pair is a row per document in any shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel import storage
from tidewheel.llm import blocks, shared_files, tokens, worker

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
BLOCK_ROWS = 65_536
CACHE_BYTES = 160 << 20
PART_CHARS = 1 << 19
MOST_LINKS = 64
#: a single space between two characters that are no white space
CUT = re.compile(r" (?<=\S )(?=\S)")


class Aligner:
    """``now``: part -> (n_a, groups as text, linked pairs, multiplicities), None where the bytes of a vocabulary's tokens
    are not those of the text.  A group's text ends in ";".  Multiplicities are None where every pair stands for one link."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.now: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # names of special tokens inside texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet, special = tokens.byte_alphabet(), {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [n.encode() if i in special else bytes(alphabet[c] for c in n) for i, n in enumerate(names)]
        self.width = self.b.vocab_size()
        names = [self.b.id_to_piece(i) for i in range(self.width)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece joins words; texts cannot be cut between words")
        self.a_lengths, self.b_lengths = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        a_names, b_names = ([b"%d" % i for i in range(n)] for n in (len(self.a_bytes), self.width))
        self.marked = [n + mark for names, mark in ((a_names, b","), (a_names, b"|"), (b_names, b","), (b_names, b";")) for n in names]
        self.marked_lengths = np.array(list(map(len, self.marked)), np.int64)
        self.counted = False  # whether any part has multiplicities
        self.kind = "<u4" if self.width * len(self.a_bytes) < 1 << 32 else "<u8"
        self.held = 0

    def _encode(self, text: str):
        """(ids, byte ends) of either vocabulary over a space and the text, None if a decoded byte differs."""
        data = b" " + text.encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return a, np.cumsum(self.a_lengths[a]), b, np.cumsum(self.b_lengths[b])

    def _align(self, parts: list[str]) -> None:
        """Align parts as one text; a part whose bytes differ is found by halving."""
        data = " ".join(parts)
        made = self._encode(data)
        stops = np.cumsum(np.fromiter(map(len, map(str.encode, parts)), np.int64, len(parts)) + 1)
        if made is None:
            if len(parts) == 1:
                self._hold(parts[0], None)
            else:
                self._align(parts[: len(parts) // 2])
                self._align(parts[len(parts) // 2 :])
            return
        a, a_ends, b, b_ends = made
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not np.isin(stops, cuts, assume_unique=True).all():
            raise ValueError("a token reaches over a cut between words")
        # groups as ranges of tokens, parts as ranges of groups and of tokens
        a_to, b_to = np.searchsorted(a_ends, cuts, "right"), np.searchsorted(b_ends, cuts, "right")
        a_n, b_n = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        last = np.searchsorted(cuts, stops)
        # ids with the mark that follows each, in order of groups: first ids, then second ids
        n, m = len(self.a_bytes), self.width
        codes = np.empty(len(a) + len(b), np.int64)
        a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_mark[a_to - 1], b_mark[b_to - 1] = n, m
        codes[np.arange(len(a)) + np.repeat(b_to - b_n, a_n)] = a + a_mark
        codes[np.arange(len(b)) + np.repeat(a_to, b_n)] = b + b_mark + 2 * n
        names = b"".join(map(self.marked.__getitem__, codes.tolist()))
        names_to = np.cumsum(self.marked_lengths[codes])
        # pairs of a group: each first id beside all second ids; groups that would multiply out are counted by distinct ids
        n_links = a_n * b_n
        plain = np.where(n_links <= MOST_LINKS, b_n, 0)
        each = np.repeat(plain, a_n)
        start = np.repeat(b_to - b_n, a_n)
        to = np.cumsum(each)
        second = np.arange(to[-1]) - np.repeat(to - each, each) + np.repeat(start, each)
        pairs = (np.repeat(a, each) * self.width + b[second]).astype(self.kind).tobytes()
        size = np.dtype(self.kind).itemsize
        a_at, p_at = a_to[last], np.cumsum(a_n * plain)[last] * size
        large: dict[int, list[int]] = {}
        for g in np.flatnonzero(plain < b_n).tolist():
            large.setdefault(int(np.searchsorted(last, g)), []).append(g)
            self.counted = True

        def cut(whole: bytes, to: np.ndarray):
            return map(whole.__getitem__, map(slice, [0, *to[:-1].tolist()], to.tolist()))

        linked = list(cut(pairs, p_at))
        times: list[bytes | None] = [None] * len(parts)
        for k, groups in large.items():
            counted: dict[int, int] = dict(Counter(np.frombuffer(linked[k], self.kind).tolist()))
            for q in groups:
                often = Counter(b[b_to[q] - b_n[q] : b_to[q]].tolist())
                for x, m in Counter(a[a_to[q] - a_n[q] : a_to[q]].tolist()).items():
                    for y, o in often.items():
                        counted[x * self.width + y] = counted.get(x * self.width + y, 0) + m * o
            linked[k], times[k] = np.array(list(counted), self.kind).tobytes(), np.array(list(counted.values()), "<i8").tobytes()
        n_as = np.diff(a_at, prepend=0).tolist()
        self.now.update(zip(parts, zip(n_as, cut(names, names_to[a_at + b_to[last] - 1]), linked, times, strict=True), strict=True))
        self.held += 300 * len(parts) + len(data) + 6 * len(codes) + len(pairs)

    def _hold(self, part: str, made: tuple | None) -> None:
        self.now[part] = made
        self.held += 300 + len(part) + (len(made[1]) + len(made[2]) if made else 0)

    def learn(self, parts) -> None:
        """Put parts into ``now``; those not known are aligned as one text for either library.

        When ``now`` is full it becomes ``old``, from where parts that come again move back: frequent ones stay.
        """
        if self.held > CACHE_BYTES // 2:
            self.now, self.old, self.held = {}, self.now, 0
        now, old = self.now, self.old
        new = {p for p in parts if p not in now}
        again = [p for p in new if p in old]
        for p in again:
            self._hold(p, old[p])
        new.difference_update(again)
        joined = [p for p in new if p.strip() == p]  # a space beside white space is no cut
        if joined:
            self._align(joined)
        if len(joined) < len(new):
            for p in new.difference(joined):
                self._align([p])


def aligner(byte_level: str, pieces: str) -> Aligner:
    """The cache of this worker process."""
    return worker.keep(("aligner", byte_level, pieces), lambda: Aligner(byte_level, pieces))


def stretches(text: str, size: int = PART_CHARS):
    """A long text in runs of about ``size`` characters that end where a text may be cut."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def merged(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, with summed multiplicities."""
    if not len(pairs):
        return pairs, times
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[first], np.add.reduceat(times, first)


def links(runs, known: Aligner) -> tuple | None:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of a whole text, None if it has no tokens.

    ``runs`` are the parts of one stretch after the other, known when they come.
    """
    n_a = n_groups = n_commas = 0
    digest, before = hashlib.sha256(), b""
    pairs, times = np.empty(0, "<u8"), np.empty(0, "<i8")
    size = np.dtype(known.kind).itemsize
    for words in runs:
        often = Counter(words)
        parts = list(map(known.now.__getitem__, often))
        if None in parts:
            return None
        n = np.fromiter(often.values(), np.int64, len(often))
        each_a, texts, linked, multiple = zip(*parts, strict=True)
        n_a += int(n @ np.array(each_a, np.int64))
        text = b"".join(map(dict(zip(often, texts, strict=True)).__getitem__, words))
        n_groups, n_commas = n_groups + text.count(b"|"), n_commas + text.count(b",")
        digest.update(before)
        digest.update(memoryview(text)[:-1])
        before = b";"
        here = np.frombuffer(b"".join(linked), known.kind).astype("<u8")
        each = np.repeat(n, np.fromiter(map(len, linked), np.int64, len(linked)) // size)
        if known.counted and any(multiple):
            each = each * np.concatenate([np.frombuffer(m, "<i8") if m else np.ones(len(p) // size, np.int64) for p, m in zip(linked, multiple, strict=True)])
        if len(pairs):
            here, each = np.concatenate([pairs, here]), np.concatenate([times, each])
        pairs, times = merged(here, each)
    # a group has one id more than commas on either side
    return n_a, n_commas + 2 * n_groups - n_a, n_groups, int(times.sum()), digest.hexdigest(), pairs, times


def text_links(text: str, known: Aligner) -> tuple | None:
    """:func:`links` of a text of any length; its stretches are learned one by one."""

    def runs():
        for run in stretches(text):
            words = CUT.split(run)
            known.learn(set(words))
            yield words

    return links(runs(), known)


def alignments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """Per row of ``df``: id, n_a, n_b, n_groups, n_links, groups_sha256 and the linked pairs with multiplicity, packed.

    A pair is a * (size of the second vocabulary) + b.  Null and empty texts, texts that are no UTF-8, and texts that a
    vocabulary does not give back byte by byte have no tokens: zeros, and '' as digest.
    """
    first, second = byte_level or tokens.vocabulary_path(BYTE_LEVEL), pieces or tokens.vocabulary_path(PIECES)
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def task(batches):
        known = aligner(first, second)
        for batch in batches:
            texts = []
            for data in batch.column(1).to_pylist():
                try:
                    texts.append((data or b"").decode())
                except UnicodeDecodeError:
                    texts.append("")
            rows, start = [], 0
            while start < len(texts):  # one text for the libraries over a run of short texts
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= PART_CHARS):
                    size += len(texts[end])
                    end += 1
                if size > PART_CHARS:
                    made = [text_links(t, known) for t in texts[start:end]]
                else:
                    split = [CUT.split(t) if t else None for t in texts[start:end]]
                    known.learn(set().union(*filter(None, split)))
                    made = [words and links([words], known) for words in split]
                rows += [m or (0, 0, 0, 0, "", np.empty(0, "<u8"), np.empty(0, "<i8")) for m in made]
                start = end
                if size > PART_CHARS or len(rows) >= 512 or start == len(texts):
                    done = start - len(rows)
                    columns = list(zip(*rows, strict=True))
                    out = [batch.column(0).slice(done, len(rows)), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()),
                           *(pa.array([blocks.planes(x) for x in c], pa.binary()) for c in columns[5:])]
                    yield pa.RecordBatch.from_arrays(out, names)
                    rows = []

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(task, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def _told(batches):
    """Distinct pairs per block with the number of its documents that link them; at most a few million are held."""

    def counted(parts, weights):
        return merged(np.concatenate(parts), np.concatenate(weights))

    def out(block, parts, weights):
        pairs, n = counted(parts, weights)
        for i in range(0, len(pairs), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs[part]), block)), pa.array(pairs[part].view("<i8")), pa.array(n[part])], ["block", "pair", "n"])

    block, parts, weights, held = None, [], [], 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if row[0] != block:
                if parts:
                    yield from out(block, parts, weights)
                block, parts, weights, held = row[0], [], [], 0
            pairs = blocks.from_planes(row[1], "<u8")
            parts.append(pairs)
            weights.append(np.ones(len(pairs), "<i8"))
            held += len(pairs)
            if held > 1 << 21:
                pairs, n = counted(parts, weights)
                parts, weights, held = [pairs], [n], 0
    if parts:
        yield from out(block, parts, weights)


def _totals(folder: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, documents, whether best of its first id) of one block, by pair."""
    from pyarrow import fs
    from pyarrow import parquet

    files, path = shared_files.file_system(folder)
    place, found = f"{path}/block={block}", []
    if files.get_file_info(place).type != fs.FileType.NotFound:
        for info in files.get_file_info(fs.FileSelector(place)):
            if info.path.endswith(".parquet"):
                with files.open_input_file(info.path) as f:
                    found.append(parquet.ParquetFile(f).read(columns=["pair", "total", "best"]))
    if not found:
        return np.empty(0, "<i8"), np.empty(0, "<i8"), np.empty(0, bool)
    table = pa.concat_tables(found)
    pair, at = np.unique(table["pair"].to_numpy(), return_index=True)  # a block that two tasks have read asks twice
    return pair, table["total"].to_numpy()[at], table["best"].to_numpy()[at]


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """Per row of ``df``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The count of an id pair is the number of rows that hold it linked.  ``n_best`` counts links whose pair has its
    first id's highest count (ties too), ``count_sum`` adds the counts over all links.  Rows that repeat an id or
    a text are rows of their own.  Null, empty and undecodable texts have zeros; texts of any length are read in stretches, so memory is
    bounded but for single parts without a space.  An empty table gives an empty table; other columns are not read.
    """
    spark = df.sparkSession
    width = _vocabulary_size(pieces or tokens.vocabulary_path(PIECES))
    made = storage.materialize(alignments(df, id_col, text_col, byte_level, pieces), "alignments")
    told = blocks.addressed(made, [F.col("pairs")], BLOCK_ROWS).select("block", "pairs").mapInArrow(_told, "block long, pair long, n long")
    told = storage.materialize(told, "pairs")
    totals = told.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("a", F.call_function("div", "pair", F.lit(width)))
    totals = storage.materialize(totals, "pair-totals")
    # at most one row per id of the first vocabulary
    highest = totals.groupBy("a").agg(F.max("total").alias("highest"))
    known = totals.join(F.broadcast(highest), "a").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    folder = shared_files.folder(spark, "pair-answers")
    told.select("block", "pair").join(known, "pair").repartition("block").sortWithinPartitions("block", "pair").write.partitionBy("block").parquet(folder)
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def task(batches):
        block, answer = None, None
        for batch in batches:
            best, total = [], []
            for here, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "times")), strict=True):
                if here != block:
                    block, answer = here, _totals(folder, here)
                at = np.searchsorted(answer[0], blocks.from_planes(pairs, "<i8"))
                times = blocks.from_planes(times, "<i8")
                best.append(int(times[answer[2][at]].sum()))
                total.append(int(times @ answer[1][at]))
            columns = {n: batch.column(n) for n in names if n not in ("n_best", "count_sum")}
            columns |= {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    kind = df.schema[id_col].dataType.simpleString()
    rows = blocks.addressed(made, [F.col(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")], BLOCK_ROWS)
    schema = f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", groups_sha256 string"
    return rows.mapInArrow(task, schema).withColumnRenamed("id", id_col)


def _vocabulary_size(pieces: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces).vocab_size()
