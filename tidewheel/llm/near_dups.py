"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all shingles, counted per block of rows first and then over the corpus; only frequencies of
   two or more travel back to the blocks.
2. A text whose shingles are not, for the threshold's share, in other texts too has no partner and is settled.  The rest
   get ``bands`` x ``rows`` consistent weighted samples: for each shingle with weight w, Gamma(2, 1) variates r and c and
   a uniform b give t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the sample is (shingle, t) at the least a.
   As many bands of plain samples (the shingle of the least hash) stand beside them, as those collide with the plain
   similarity and the weighted ones only with the weighted.
3. Equal texts become one node.  Every node is paired with a hub of each band bucket; pairs are verified by weighted
   Jaccard similarity of the whole shingle sets, or the plain one, so that weights never lose a near copy.  Further rounds
   take other hubs in buckets that still hold more than one class.  Then every pair of one bucket and of different classes
   is settled in cells: a task compares the texts of a cell as matrices and gives a spanning forest of what is similar.
   Members of large buckets take part if another class has one of their rare shingles, of which similar texts must share
   one (prefix filter, exact).
4. Classes are the connected components, found by label passing over written tables.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import storage
from tidewheel.llm import blocks, shared_files, worker
from tidewheel.llm.hashing import mix, namer

SALTS = 8
BROADCAST_ROWS = 100_000
#: members of a bucket that are compared without a look at their rare shingles
FEW = 16
#: members, and bytes of shingles, of one side of a compared cell
CELL = 256
CELL_BYTES = 8 << 20
#: shingles that a cell compares at once
COLUMNS = 2048
#: bytes of text that a task cuts into shingles at once
GROUP_BYTES = 1 << 19
#: shingle hashes keep 48 bits
SHORT = np.uint64(16)
#: share of the weight that the inverse document frequency decides
IDF_SHARE = 0.2
_TABLE_BITS = 16
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


# ------------------------------------------------------------------ shingles
def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a group: (text number, 48-bit hash, times), sorted; a text of fewer words is one shingle."""
    clean = data.tobytes().translate(_WORDS)
    texts = [b" ".join(clean[a:b].split()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = np.flatnonzero(joined == 32)
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    # an empty text leaves a blank of its own: drop those, so that the n-th end belongs to the n-th word
    lengths = np.array([len(t) for t in texts], np.int64)
    text_end = np.cumsum(lengths + 1) - 1
    word_end = np.setdiff1d(space, text_end[lengths == 0], assume_unique=True)
    previous = np.empty(len(word_end), np.int64)
    first_word = np.cumsum(counts) - counts
    previous[1:] = word_end[:-1] + 1
    has = np.flatnonzero(counts)
    previous[first_word[has]] = (text_end - lengths)[has]
    n = np.maximum(counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first_word[owner]
    end = np.minimum(begin + size - 1, first_word[owner] + counts[owner] - 1)
    start, stop = previous[begin], word_end[end]
    names = namer(0).names(namer(0).sums(joined), start, stop - start) >> SHORT
    order = np.lexsort((names, owner))
    owner, names = owner[order], names[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (names[1:] != names[:-1])
    where = np.flatnonzero(new)
    return owner[where], names[where], np.diff(np.append(where, len(owner)))


# ------------------------------------------------------------------ document frequencies
_COUNTS = "bucket int, block long, names binary, times binary"


def _count_task(size: int, buckets: int):
    def emit(block, held):
        names, times = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted((names * np.uint64(buckets)) >> np.uint64(48), np.arange(buckets + 1, dtype=np.uint64))
        rows = [(b, block, blocks.planes(names[edges[b] : edges[b + 1]]), blocks.planes(times[edges[b] : edges[b + 1]].astype(np.uint32))) for b in np.flatnonzero(np.diff(edges)).tolist()]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64], strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "names", "times"])

    def task(batches):
        held, n, last = [], 0, None
        for block, _, data, at in blocks.text_groups(batches, GROUP_BYTES):
            if held and (block != last or n > 1 << 20):
                yield from emit(last, held)
                held, n = [], 0
            last = block
            held.append(shingles(data, at, size)[1])
            n += len(held[-1])
        if held:
            yield from emit(last, held)

    return task


def level(frequency: np.ndarray) -> np.ndarray:
    """Eighths of the binary logarithm, in a byte."""
    return np.minimum(np.rint(8 * np.log2(frequency)), 255).astype(np.uint8)


def frequencies(bare: DataFrame, size: int, buckets: int) -> str:
    """Folder with, per block, its shingles that occur in two or more texts and the level of their frequency."""

    def add(batches):
        held, names, times, source = [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                names.append(blocks.from_planes(row["names"], np.uint64))
                times.append(blocks.from_planes(row["times"], np.uint32))
                source.append(np.full(len(names[-1]), len(held), np.int32))
                held.append(row["block"])
        if not held:
            return
        names, times, source = (np.concatenate(x) for x in (names, times, source))
        order = np.argsort(names, kind="stable")
        names, times, source = names[order], times[order].astype(np.int64), source[order]
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        total = np.repeat(np.add.reduceat(times, first), np.diff(np.append(first, len(names))))
        more = total > 1
        names, total, source = names[more], level(total[more]), source[more]
        by = np.argsort(source, kind="stable")
        names, total, edges = names[by], total[by], np.searchsorted(source[by], np.arange(len(held) + 1))
        rows = [(b, blocks.planes(names[i:j]), total[i:j].tobytes()) for b, i, j in zip(held, edges[:-1].tolist(), edges[1:].tolist(), strict=True) if i < j]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64], strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "found", "levels"])

    spark = bare.sparkSession
    folder = shared_files.folder(spark, "frequencies")
    counted = bare.mapInArrow(worker.tidy(_count_task(size, buckets)), _COUNTS).repartition(buckets, "bucket").mapInArrow(worker.tidy(add), "block long, found binary, levels binary")
    with blocks.forgetting(spark):
        counted.repartition("block").write.partitionBy("block").parquet(folder)
    return folder


def _known(folder: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    rows = blocks.answer_rows(folder, block, ["found", "levels"])
    if not rows:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    names = np.concatenate([blocks.from_planes(r["found"], np.uint64) for r in rows])
    levels = np.concatenate([np.frombuffer(r["levels"], np.uint8) for r in rows])
    names, first = np.unique(names, return_index=True)
    return names, levels[first]


# ------------------------------------------------------------------ samples
def weights(times: np.ndarray, levels: np.ndarray, documents: int) -> np.ndarray:
    """Term frequency times damped inverse document frequency; rare shingles weigh 1, those in every text 1 - IDF_SHARE."""
    spread = np.log2(max(documents, 2))
    return times * (1 - IDF_SHARE * np.minimum(levels / 8.0 / spread, 1.0))


@functools.cache
def _variates() -> tuple[np.ndarray, ...]:
    """Tables of r, ln c and b by 16 random bits each; a shingle's bits pick the same entries everywhere."""
    rng = np.random.default_rng(5)
    n = 1 << _TABLE_BITS
    return tuple(x.astype(np.float32) for x in (np.maximum(rng.gamma(2, 1, n), 1e-3), np.log(np.maximum(rng.gamma(2, 1, n), 1e-9)), rng.random(n)))


def samples(owner_start: np.ndarray, names: np.ndarray, weight: np.ndarray, hashes: int) -> np.ndarray:
    """Consistent weighted samples: one 64-bit value per text (rows) and hash (columns)."""
    r_table, c_table, b_table = _variates()
    mask = np.uint64((1 << _TABLE_BITS) - 1)
    log_weight = np.log(weight).astype(np.float32)
    counts = np.diff(np.append(owner_start, len(names)))
    out = np.empty((len(owner_start), hashes), np.uint64)
    for k in range(hashes):
        bits = mix(names + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF))
        r = r_table[bits & mask]
        b = b_table[(bits >> np.uint64(_TABLE_BITS)) & mask]
        t = np.floor(log_weight / r + b)
        a = c_table[(bits >> np.uint64(2 * _TABLE_BITS)) & mask] - r * (t - b + 1)
        least = np.minimum.reduceat(a, owner_start)
        # ties by the shingle's own bits, so that the choice does not depend on the other shingles
        tied = np.where(a == np.repeat(least, counts), bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        chosen = np.minimum.reduceat(tied, owner_start)
        at = np.flatnonzero(tied == np.repeat(chosen, counts))
        at = at[np.searchsorted(at, owner_start)]
        out[:, k] = mix(names[at] ^ (t[at].astype(np.int64).view(np.uint64) << np.uint64(48)))
    return out


def plain_samples(owner_start: np.ndarray, names: np.ndarray, hashes: int, skip: int) -> np.ndarray:
    """Samples with all weights equal, by other hashes than the first ``skip``: the least hash of each text's shingles."""
    out = np.empty((len(owner_start), hashes), np.uint64)
    for k in range(hashes):
        out[:, k] = np.minimum.reduceat(mix(names + np.uint64((0x9E3779B97F4A7C15 * (skip + k + 1)) & 0xFFFFFFFFFFFFFFFF)), owner_start)
    return out


def _feature_task(folder: str, size: int, bands: int, rows: int, threshold: float, documents: int):
    def task(batches):
        block_known, last = None, None
        for block, (batch, row, end), data, at in blocks.text_groups(batches, GROUP_BYTES):
            if block != last:
                block_known, last = _known(folder, block), block
            owner, names, times = shingles(data, at, size)
            n = end - row
            found, levels = block_known
            where = np.searchsorted(found, names)
            where[where == len(found)] = 0
            shared = found[where] == names if len(found) else np.zeros(len(names), bool)
            lev = np.where(shared, levels[where], 0).astype(np.uint8) if len(found) else np.zeros(len(names), np.uint8)
            weight = weights(times, lev, documents)
            count = lambda x: np.bincount(owner, x, n)
            some = np.bincount(owner, minlength=n) > 0
            likely = some & ((count(weight * shared) >= threshold * count(weight) - 1e-9) | (count(shared.astype(float)) >= threshold * np.bincount(owner, minlength=n) - 1e-9))
            mine = likely[owner]
            owner, names, times, lev, weight = owner[mine], names[mine], times[mine], lev[mine], weight[mine]
            texts = np.flatnonzero(likely)
            start = np.searchsorted(owner, texts)
            stop = np.append(start[1:], len(owner))
            key, band, blob, extra = [None] * n, [None] * n, [None] * n, [None] * n
            if len(texts):
                values = np.hstack([samples(start, names, weight, bands * rows), plain_samples(start, names, bands * rows, bands * rows)]).reshape(len(texts), 2 * bands, rows)
                merged = np.zeros((len(texts), 2 * bands), np.uint64)
                for k in range(rows):
                    merged = mix(merged * np.uint64(31) + values[:, :, k])
                merged = merged.view(np.int64)
                for i, (t, a, b) in enumerate(zip(texts.tolist(), start.tolist(), stop.tolist(), strict=True)):
                    key[t] = hashlib.blake2b(data[at[t] : at[t + 1]].tobytes(), digest_size=16).digest()
                    band[t] = merged[i].tolist()
                    blob[t] = blocks.planes(names[a:b])
                    extra[t] = np.minimum(times[a:b], 65535).astype("<u2").tobytes() + lev[a:b].tobytes()
            out = [batch.column(2).slice(row, n), batch.column(3).slice(row, n), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(blob, pa.binary()), pa.array(extra, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["tag", "id", "key", "bands", "names", "extra"])

    return task


# ------------------------------------------------------------------ pairs
def similarity(names1: bytes, extra1: bytes, names2: bytes, extra2: bytes, documents: int) -> float:
    """The larger of the weighted and the plain Jaccard similarity of two texts."""
    a, b = blocks.from_planes(names1, np.uint64), blocks.from_planes(names2, np.uint64)
    parts = []
    for names, extra in ((a, extra1), (b, extra2)):
        parts.append(weights(np.frombuffer(extra[: 2 * len(names)], "<u2"), np.frombuffer(extra[2 * len(names) :], np.uint8), documents))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = np.minimum(parts[0][i], parts[1][j]).sum()
    weighted = common / (parts[0].sum() + parts[1].sum() - common)
    return float(max(weighted, len(i) / (len(a) + len(b) - len(i))))


def _verify(pairs: DataFrame, features: DataFrame, threshold: float, documents: int) -> DataFrame:
    """Pairs (a, b) of nodes that are similar enough."""
    body = features.select("tag", "names", "extra")

    def check(batches):
        for p in batches:
            ok = [similarity(*x, documents) >= threshold - 1e-9 for x in zip(p["n1"], p["e1"], p["n2"], p["e2"], strict=True)]
            yield p.loc[ok, ["a", "b"]]

    left = pairs.join(body.toDF("a", "n1", "e1"), "a")
    both = left.join(body.toDF("b", "n2", "e2"), "b")
    return storage.materialize(both.select("a", "b", "n1", "e1", "n2", "e2").mapInPandas(worker.tidy(check), "a string, b string"), "links")


def _light(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table marked for broadcast if it has at most ``rows`` rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stars(batches, most: int = 200_000):
    """Links of a task, some at a time, as links (a, b) of every node to the least node of its component among them."""

    def settle(held):
        names, code = np.unique(np.concatenate(held), return_inverse=True)
        parent = list(range(len(names)))
        for x, y in code.reshape(-1, 2).tolist():
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            parent[max(x, y)] = min(x, y)
        for x in range(len(parent)):  # a parent is never larger than its node
            parent[x] = parent[parent[x]]
        root = np.array(parent)
        inner = root != np.arange(len(root))
        return pd.DataFrame({"a": names[root[inner]], "b": names[inner]}, dtype=object)

    held, n = [], 0
    for p in batches:
        held.append(p[["a", "b"]].to_numpy(dtype=object).reshape(-1))
        n += len(p)
        if n >= most:
            yield settle(held)
            held, n = [], 0
    if n:
        yield settle(held)


def components(links: DataFrame, passes: int | None = None) -> DataFrame:
    """(node, label) of all nodes in ``links`` (a, b); the label is the least node of the component.

    Tasks shorten their own links to stars.  Each pass then takes the least label of the neighbours and the label's own
    label, so long chains halve.  Labels only fall, so the passes end.  After a given number of ``passes`` equal labels
    still mean one component, but a component may have several.
    """
    short = storage.materialize(links.select("a", "b").mapInPandas(worker.tidy(stars), "a string, b string"), "stars")
    edges = short.union(short.select("b", "a"))
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    labels = storage.materialize(labels, "labels")
    done = 0
    while passes is None or done < passes:
        known = _light(labels)
        seen = edges.join(known.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = near.join(known, "node").select("node", "label", F.least("label", "near").alias("new"))
        step = step.join(known.select(F.col("node").alias("new"), F.col("label").alias("far")), "new")
        step = step.select("node", F.least("new", "far").alias("label"), (F.least("new", "far") != F.col("label")).alias("moved"))
        step = storage.materialize(step, "labels")
        labels = step.select("node", "label")
        done += 1
        if not step.where("moved").limit(1).count():
            break
    return labels


def _meet(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined with their group; a long list of groups is joined with salt, as one group may hold most rows."""
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), keys)
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(groups, [*keys, "salt"]).drop("salt")


def _hubs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of every node with the hub of each bucket that holds more than one class.

    The order of hubs is the same in all bands, so texts that share many buckets are paired once; whom a hub misses, later
    rounds and the cells settle.
    """
    pick = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "label"))
    hubs = members.groupBy("band", "value").agg(pick.alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    hubs = storage.materialize(hubs.select("band", "value", F.col("hub.node").alias("hub"), F.col("hub.label").alias("hub_label")), "hubs")
    met = _meet(members, hubs, ["band", "value"])
    met = met.where("label <> hub_label").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return met.distinct()


def _mixed(members: DataFrame) -> DataFrame:
    """Buckets of three or more members and more than one class; of buckets with the same members only one.

    The two members of a bucket of two have met through its hub.
    """
    sizes = members.groupBy("band", "value").agg(
        F.count("*").alias("n"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("mark1"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mark2"),
    )
    one = sizes.where("low <> high AND n > 2").groupBy("n", "mark1", "mark2").agg(F.min(F.struct("band", "value")).alias("is"))
    return storage.materialize(one.select("is.band", "is.value", "n"), "mixed")


def prefix(names: np.ndarray, weight: np.ndarray, levels: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest shingles of a text; two texts that are similar by either measure share one of them.

    What follows the prefix weighs less than the threshold's share of the text, which a similar text would have to share.
    Shingles of one text only are left out: nothing can share them.
    """
    order = np.lexsort((names, levels))
    n = 0
    for w in (weight[order], np.ones(len(order))):
        rest = w.sum() - np.cumsum(w)
        n = max(n, int(np.count_nonzero(rest >= (threshold - 1e-6) * w.sum())) + 1)
    chosen = order[:n]
    return names[chosen[levels[chosen] > 0]]


def _rare(members: DataFrame, features: DataFrame, threshold: float, documents: int) -> DataFrame:
    """(token, node, label): the prefix of each member."""

    def emit(batches):
        for p in batches:
            out = []
            for blob, extra in zip(p["names"], p["extra"], strict=True):
                names = blocks.from_planes(blob, np.uint64)
                levels = np.frombuffer(extra[2 * len(names) :], np.uint8)
                out.append(prefix(names, weights(np.frombuffer(extra[: 2 * len(names)], "<u2"), levels, documents), levels, threshold).view(np.int64))
            counts = [len(x) for x in out]
            yield pd.DataFrame({"token": np.concatenate(out), "node": np.repeat(p["node"].to_numpy(), counts), "label": np.repeat(p["label"].to_numpy(), counts)})

    both = members.join(features.select(F.col("tag").alias("node"), "names", "extra"), "node")
    return storage.materialize(both.select("node", "label", "names", "extra").mapInPandas(worker.tidy(emit), "token long, node string, label string"), "prefixes")


def _shared(owner: np.ndarray, names: np.ndarray, worth: np.ndarray, n: int, split: int) -> np.ndarray:
    """What each of the first ``split`` texts shares with each of the others (with ``split`` 0: all with all)."""
    out = np.zeros((split or n, n - split))
    _, column, held = np.unique(names, return_inverse=True, return_counts=True)
    more = held[column] > 1
    owner, worth = owner[more], worth[more]
    _, column = np.unique(column[more], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column, worth = owner[order], column[order], worth[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        holds, value = np.zeros((n, COLUMNS)), np.zeros(COLUMNS)
        holds[owner[i:j], column[i:j] - low] = 1
        value[column[i:j] - low] = worth[i:j]
        out += (holds[: split or n] * value) @ holds[split:].T
    return out


def similarities(texts: list[tuple[bytes, bytes]], split: int, documents: int) -> np.ndarray:
    """``similarity`` of the first ``split`` texts with the others (with ``split`` 0: all with all, but for the diagonal), as a matrix."""
    names = [blocks.from_planes(x, np.uint64) for x, _ in texts]
    counts = [len(x) for x in names]
    owner, names = np.repeat(np.arange(len(texts)), counts), np.concatenate(names)
    times = np.concatenate([np.frombuffer(e[: 2 * k], "<u2") for (_, e), k in zip(texts, counts, strict=True)]).astype(np.int64)
    levels = np.concatenate([np.frombuffer(e[2 * k :], np.uint8) for (_, e), k in zip(texts, counts, strict=True)])
    rare = weights(np.ones(len(names)), levels, documents)
    result = []
    for each, count in ((np.ones(len(names)), np.ones(len(names), np.int64)), (rare, times)):
        common, before = 0.0, 0
        for most in np.unique(count).tolist():  # the lesser of two counts, as a sum over the counts that both reach
            here = count >= most
            common = common + _shared(owner[here], names[here], each[here] * (most - before), len(texts), split)
            before = most
        total = np.bincount(owner, each * count, len(texts))
        result.append(common / (total[: split or len(texts), None] + total[None, split:] - common))
    return np.maximum(*result)


def forest(labels: list[str], left: np.ndarray, right: np.ndarray) -> list[int]:
    """Which of the pairs (left, right) join classes that the pairs before them have not joined yet."""
    parent = {x: x for x in labels}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = root(labels[i]), root(labels[j])
        if a != b:
            parent[a] = b
            kept.append(k)
    return kept


def _cells(members: DataFrame, features: DataFrame, threshold: float, documents: int) -> DataFrame:
    """Links that join the classes of each bucket, from all its pairs of different classes, compared block by block.

    A bucket of few members and bytes is one cell.  The most common class of a larger one is dealt over blocks of its own,
    which are never compared with each other.  A cell gives links that connect what is similar in it, fewer than members.
    """
    sizes = members.groupBy("band", "value", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = sizes.groupBy("band", "value").agg(F.max(F.struct("n", "label", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    whole = (F.col("n") <= CELL) & (F.col("size") <= CELL_BYTES)
    of = lambda n, size: F.greatest(F.ceil(n / CELL), F.ceil(size / CELL_BYTES), F.lit(1)).cast("int")
    g = F.when(whole, 0).otherwise(of(F.col("main.n"), F.col("main.size")))
    h = F.when(whole, 1).otherwise(of(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")))
    parts = storage.materialize(parts.where("n > main.n").select("band", "value", F.when(~whole, F.col("main.label")).alias("main"), g.alias("g"), h.alias("h")), "parts")
    met = _meet(members, parts, ["band", "value"])
    block = F.when(F.col("label") == F.col("main"), F.pmod(F.xxhash64("node"), F.col("g"))).otherwise(F.col("g") + F.pmod(F.xxhash64("node"), F.col("h"))).cast("int")
    met = met.withColumn("block", block)
    other = F.when(F.col("block") < F.col("g"), F.sequence("g", F.expr("g + h - 1"))).otherwise(F.sequence(F.lit(0), F.expr("g + h - 1")))
    met = met.withColumn("other", F.explode(other)).select("node", "label", "block", F.xxhash64("band", "value", F.least("block", "other"), F.greatest("block", "other")).alias("cell"))

    def check(p):
        p = p.sort_values(["block", "node"], kind="stable")
        node, label, block = p["node"].tolist(), p["label"].tolist(), p["block"].to_numpy()
        split = int(np.searchsorted(block, block[0], side="right")) % len(block)
        texts = list(zip(p["names"], p["extra"], strict=True))
        code = np.unique(p["label"].to_numpy(dtype=object), return_inverse=True)[1]
        near = (similarities(texts, split, documents) >= threshold - 1e-9) & (code[: split or len(code), None] != code[None, split:])
        left, right = np.nonzero(near)
        right = right + split
        kept = forest(label, left, right)
        pairs = [sorted((node[left[k]], node[right[k]])) for k in kept]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype=object)

    body = features.select(F.col("tag").alias("node"), "names", "extra")
    return storage.materialize(met.join(body, "node").groupBy("cell").applyInPandas(check, "a string, b string"), "links")


def _rest(members: DataFrame, features: DataFrame, threshold: float, documents: int) -> DataFrame:
    """Links among all pairs that share a bucket, are of different classes and have not met through a hub."""
    members = storage.materialize(members, "members")
    mixed = _mixed(members)
    inside = _meet(members, mixed, ["band", "value"])
    if mixed.where(F.col("n") > FEW).limit(1).count():
        inside = storage.materialize(inside, "inside")
        # members of large buckets stay if another class has one of their rare shingles, as every similar text would
        rare = _rare(inside.where(F.col("n") > FEW).select("node", "label").distinct(), features, threshold, documents)
        shared = rare.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
        hopeful = storage.materialize(rare.join(_light(storage.materialize(shared, "shared")), "token").select("node").distinct(), "hopeful")
        inside = inside.where(F.col("n") <= FEW).unionByName(inside.where(F.col("n") > FEW).join(_light(hopeful), "node", "left_semi").select(*inside.columns))
    return _cells(storage.materialize(inside.drop("n"), "inside"), features, threshold, documents)


def classes(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 10, rows: int = 3, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (the class's least id) and kept (true for one row of each class).

    Null texts and texts without words are in a class of their own and kept.  A text of fewer than ``size`` words is one
    shingle.  Rows that repeat an id are told apart; of equal ids the first in the file stays.  An empty table has no rows.
    """
    spark = docs.sparkSession
    addressed = _addressed(docs, [F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")])
    out = _classes(spark, addressed, size, threshold, bands, rows, rounds)
    return out.select(F.col("id").alias(id_col), "class_id", "kept")


def _addressed(docs: DataFrame, columns: list) -> DataFrame:
    row = F.col("_metadata.row_index")
    tag = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.lpad(F.hex(row), 12, "0")).alias("tag")
    return blocks.addressed(docs, columns, more=[tag])


def _classes(spark: SparkSession, addressed: DataFrame, size, threshold, bands, rows, rounds) -> DataFrame:
    kind = addressed.schema["id"].dataType.simpleString()
    total = addressed.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).head()
    documents = total["n"]
    buckets = max(24, (total["bytes"] or 0) // (6 << 20))
    folder = frequencies(addressed.select("block", "text"), size, buckets)
    made = addressed.select("block", "text", "tag", "id").mapInArrow(worker.tidy(_feature_task(folder, size, bands, rows, threshold, documents)), f"tag string, id {kind}, key binary, bands array<long>, names binary, extra binary")
    features = storage.materialize(made, "features")
    likely = features.where("key is not null")
    # one node per distinct text
    nodes = likely.groupBy("key").agg(F.min("tag").alias("node"), F.min(F.struct("id", "tag")).alias("first"), F.first("bands").alias("bands"), F.first(F.octet_length("names")).alias("size"))
    nodes = storage.materialize(nodes, "nodes")
    members = nodes.select("node", "size", F.posexplode("bands").alias("band", "value"))
    labels, links, tried, settled = None, None, None, True

    def labelled():
        return members.withColumn("label", F.col("node")) if labels is None else members.join(_light(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))

    for turn in range(rounds):
        pairs = _hubs(labelled(), turn)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = storage.materialize(pairs, "pairs")
        if not pairs.limit(1).count():
            break
        tried = pairs if tried is None else tried.union(pairs)
        found = _verify(pairs, likely, threshold, documents)
        if not found.limit(1).count():
            continue
        links = found if links is None else links.union(found)
        labels, settled = components(links, None if turn == rounds - 1 else 2), turn == rounds - 1
    if links is not None and not settled:
        labels = components(links)
    if tried is not None:
        found = _rest(labelled(), likely, threshold, documents)
        if found.limit(1).count():
            links = found if links is None else links.union(found)
            labels = components(links)
    if labels is None:
        labels = nodes.select("node", F.col("node").alias("label")).limit(0)
    named = nodes.select("key", "node", "first").join(_light(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("first").alias("stays"))
    by_key = storage.materialize(named.select("key", "label").join(_light(least), "label").select("key", "stays"), "classes")
    # equal texts may be a third of all rows: the join is salted, and rows without a key never meet in one task
    slim = features.select("tag", "id", F.coalesce("key", F.encode("tag", "utf-8")).alias("key"), F.pmod(F.xxhash64("tag"), F.lit(SALTS)).cast("int").alias("salt"))
    if by_key.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = slim.join(F.broadcast(by_key), "key", "left")
    else:
        joined = slim.join(by_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"], "left")
    return joined.select("tag", "id", F.when(F.col("stays").isNull(), F.col("id")).otherwise(F.col("stays.id")).alias("class_id"), F.coalesce(F.col("stays.tag") == F.col("tag"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 10, rows: int = 3, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """The rows of ``docs`` without all but one of each class, columns unchanged."""
    addressed = _addressed(docs, [F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")])
    gone = storage.materialize(_classes(docs.sparkSession, addressed.drop("row"), size, threshold, bands, rows, rounds).where("not kept").select("tag"), "copies")
    if gone.limit(broadcast_rows + 1).count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return addressed.join(gone, "tag", "left_anti").select("row.*")
