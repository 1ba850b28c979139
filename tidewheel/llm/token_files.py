"""Token ids as raw binary shards with a minimal perfect hash index from document keys to places.

Documents are laid out by range of their key and written in that order, one shard of raw ids per task.  The index is
cut into buckets by key hash.  In a bucket, levels of bit arrays give every key a slot of its own: a key whose bit is
hit by no other key stops at that level, the rest go on to the next; the slot is the number of bits set before it.
A slot keeps a fingerprint, shard, offset and length, so a look-up takes constant time and an unknown key is refused.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel import storage
from tidewheel.llm import shared_files, tokens

BUCKET_KEYS = 50_000
READ_IDS = 1 << 20
#: of at most 64 bytes each; only one encoding step runs in a worker, so it may keep more than the pipeline
CACHED_WORDS = 800_000


# ------------------------------------------------------------------ minimal perfect hash
def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A new 64-bit hash of the keys for every level."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray, spare: float = 2.0) -> list[np.ndarray]:
    """Levels of bits for distinct unsigned 64-bit keys."""
    levels, left = [], keys
    while len(left):
        size = max(8, int(len(left) * spare))
        at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
        if len(levels) > 60:
            raise ValueError("equal keys in a minimal perfect hash")
    return levels


def slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level knows it."""
    out, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        rank = np.cumsum(bits) - bits
        at = (_mix(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
        here = bits[at]
        out[left[here]] = before + rank[at[here]]
        left, before = left[~here], before + int(bits.sum())
    return out


def _pack_index(levels, **columns) -> bytes:
    out = io.BytesIO()
    np.savez(out, sizes=np.array([len(x) for x in levels], np.int64), bits=np.packbits(np.concatenate(levels)) if levels else np.empty(0, np.uint8), **columns)
    return out.getvalue()


def _load_index(uri: str) -> dict:
    files, path = shared_files.file_system(uri)
    with files.open_input_file(path) as f:
        data = dict(np.load(io.BytesIO(f.read()), allow_pickle=False))
    bits = np.unpackbits(data["bits"])[: data["sizes"].sum()].astype(bool)
    data["levels"] = np.split(bits, np.cumsum(data["sizes"])[:-1])
    return data


# ------------------------------------------------------------------ write
def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards in ascending id order and return the catalog: id, copy, shard, file, at, n_tokens.

    ``at`` counts ids from the shard's start.  Null texts are empty (only the end id); null ids come first.  Rows that
    repeat an id are ``copy`` 0, 1, … in file order, with equal texts next to each other.  An empty table writes no shard.
    """
    path = vocabulary or tokens.vocabulary_path(tokens.WORD_VOCABULARY)

    def shards(batches):
        ids, shard, out, at, last, copy = tokens.word_ids(path, CACHED_WORDS), TaskContext.get().partitionId(), None, 0, object(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names, ns, ats, copies = [], [], [], []
            for key, text in zip(batch["id"].tolist(), batch["text"], strict=True):
                if out is None:
                    name, out = shared_files.create(folder, f"shard-{shard:06d}")
                data = ids.encode(text) + end
                out.write(data if wide else np.frombuffer(data, "<u4").astype("<u2").tobytes())
                copy = copy + 1 if key == last or (key != key and last != last) else 0
                last = key
                names.append(name)
                ns.append(len(data) // 4)
                ats.append(at)
                copies.append(copy)
                at += len(data) // 4
            yield pd.DataFrame({"id": batch["id"], "copy": copies, "shard": shard, "file": names, "at": ats, "n_tokens": ns})
        if out is not None:
            out.close()

    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) > 1 << 16
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    made = storage.materialize(rows.mapInPandas(shards, f"id {kind}, copy long, shard int, file string, at long, n_tokens long"), "shards")
    # copies of one id may go on in the next shard
    each = made.groupBy("id", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spread = each.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select(F.col("id").alias("id2"), F.col("shard").alias("shard2"), "before")
    made = made.join(spread, F.col("id").eqNullSafe(F.col("id2")) & (F.col("shard") == F.col("shard2")), "left")
    return made.select("id", (F.col("copy") + F.coalesce("before", F.lit(0))).alias("copy"), "shard", "file", "at", "n_tokens", F.lit(4 if wide else 2).alias("width"))


def write_index(catalog: DataFrame, folder: str) -> DataFrame:
    """Write one index file per bucket of keys (id, copy); returns bucket, index_file."""
    n = catalog.count()
    buckets = max(1, -(-n // BUCKET_KEYS))

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        keys = batch["key"].to_numpy().view(np.uint64)
        levels = build_hash(keys)
        order = np.argsort(slots(levels, keys))
        b = batch.iloc[order]
        files = sorted(set(b["file"]))
        place = {f: i for i, f in enumerate(files)}
        data = _pack_index(
            levels, files=np.array(files), shard=b["shard"].to_numpy(np.int32), in_file=b["file"].map(place).to_numpy(np.int32),
            fingerprint=b["fingerprint"].to_numpy(np.int64).astype(np.uint32), at=b["at"].to_numpy(np.int64), n=b["n_tokens"].to_numpy(np.int64), width=np.array(int(b["width"].iloc[0])))
        uri, out = shared_files.create(folder, f"index-{int(b['bucket'].iloc[0]):06d}")
        with out:
            out.write(data)
        return pd.DataFrame({"bucket": [int(b["bucket"].iloc[0])], "buckets": [buckets], "index_file": [uri]})

    rows = catalog.select(*_hashed(buckets), "shard", "file", "at", "n_tokens", "width")
    return storage.materialize(rows.groupBy("bucket").applyInPandas(build, "bucket long, buckets long, index_file string"), "index")


def _hashed(buckets: int):
    key = F.xxhash64("id", "copy")
    return [key.alias("key"), F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("id"), F.col("copy")), 32).alias("fingerprint"), F.pmod(F.xxhash64(F.lit(11), key), F.lit(buckets)).alias("bucket")]


# ------------------------------------------------------------------ read
def look_up(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Places of the keys (id, copy) that the index knows: id, copy, shard, file, at, n_tokens, width."""
    head = index.select("buckets").head()
    kind = keys.schema["id"].dataType.simpleString()
    schema = f"id {kind}, copy long, shard int, file string, at long, n_tokens long, width int"
    if head is None:
        return keys.sparkSession.createDataFrame([], schema)

    def find(batches):
        uri, held = None, None
        for batch in batches:
            for name, part in batch.groupby("index_file", sort=False):
                if name != uri:
                    uri, held = name, _load_index(name)
                slot = slots(held["levels"], part["key"].to_numpy().view(np.uint64))
                known = slot >= 0
                known[known] = held["fingerprint"][slot[known]] == part["fingerprint"].to_numpy(np.int64).astype(np.uint32)[known]
                slot = slot[known]
                yield pd.DataFrame({"id": part["id"][known], "copy": part["copy"][known], "shard": held["shard"][slot], "file": held["files"][held["in_file"][slot]], "at": held["at"][slot], "n_tokens": held["n"][slot], "width": int(held["width"])})

    asked = keys.select("id", "copy", *_hashed(head["buckets"])).join(index.select("bucket", "index_file"), "bucket")
    return asked.repartition("bucket").sortWithinPartitions("index_file").mapInPandas(find, schema)


def read(places: DataFrame, ids: int, reduce, schema: str) -> DataFrame:
    """Read the ids at the places and return ``reduce(place columns, list of uint32 arrays)`` as a table.

    Places are dealt out by file and region and sorted, so each task makes a few sequential range reads; ``ids`` tells
    how many ids they have in all.
    """

    def task(batches):
        for batch in batches:
            for (uri, width), part in batch.groupby(["file", "width"], sort=False):
                spots = [(int(a) * int(width), int(n) * int(width)) for a, n in zip(part["at"], part["n_tokens"], strict=True)]
                arrays = [np.frombuffer(x, f"<u{width}").astype("<u4") for x in shared_files.read_places(uri, spots)]
                yield reduce(part, arrays)

    region = F.floor(F.col("at") / READ_IDS)
    # rows of places are small and what they stand for is not: the number of tasks follows the ids to read
    tasks = shared_files.tasks(places.sparkSession, ids, READ_IDS)
    return places.withColumn("region", region).repartition(tasks, "file", "region").sortWithinPartitions("file", "at").drop("region").mapInPandas(task, schema)


def shard_starts(catalog: DataFrame) -> DataFrame:
    """Ids before each shard; one row per shard, so the running sum stays small."""
    each = catalog.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def digest(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write, index, look every key up and read it back: id, start, n_tokens, ids_crc32."""
    import zlib

    folder = shared_files.folder(docs.sparkSession, "tokens")
    catalog = write(docs, folder, vocabulary, end_id, id_col, text_col)
    index = write_index(catalog, folder)
    places = look_up(catalog.select("id", "copy"), index).join(shard_starts(catalog), "shard")

    def crc(part, arrays):
        return pd.DataFrame({"id": part["id"], "start": part["base"] + part["at"], "n_tokens": [len(a) for a in arrays], "ids_crc32": [zlib.crc32(a.tobytes()) for a in arrays]})

    kind = docs.schema[id_col].dataType.simpleString()
    ids = catalog.agg(F.sum("n_tokens")).head()[0]
    return read(places, ids, crc, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
