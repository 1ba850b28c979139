"""Benchmark decontamination: hash every window of training words and look it up in the set of benchmark windows.

The benchmark is cut into windows of ``width`` words.  Up to ``broadcast_windows`` of them travel to the tasks as a
hash set inside the plan, so documents are read once and no text is shuffled; a hit by hash counts only if the words
are equal.  A larger benchmark is joined by window hash, with its side repeated ``SALTS`` times against hot windows.
Everything runs on built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import native

SALTS = 16
_HITS = "array<struct<at:int,size:int,words:string>>"
#: a word in either case with the separators before it, or the separators at the end
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$"


def benchmark_windows(benchmark: DataFrame, width: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows as (hash, size, words, items).  An item of fewer words is one window; without words it has none."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), native.words(F.col(text_col)).alias("w"))
    size = F.least(F.size("w"), F.lit(width))
    at = F.when(size > 0, F.sequence(F.lit(1), F.size("w") - size + 1)).otherwise(F.array().cast("array<int>"))
    rows = items.withColumn("size", size).select("item", "size", F.explode(F.transform(at, lambda i: F.slice("w", i, F.col("size")))).alias("w"))
    return rows.groupBy(F.xxhash64("w").alias("hash"), "size", F.array_join("w", " ").alias("words")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def _hits_in_row(hashes: dict[int, list[int]], windows: dict[int, list[str]], w: str) -> Column:
    """Verified places as array<struct<at, size, words>>, sorted by place."""
    parts = []
    for size in sorted(hashes):
        def cut(i, size=size):
            return F.slice(F.col(w), i, size)

        likely = F.filter(native.starts(F.size(w), size), lambda i: F.xxhash64(cut(i)).isin(hashes[size]))
        exact = F.filter(likely, lambda i: F.array_join(cut(i), " ").isin(windows[size]))
        parts.append(F.transform(exact, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.array_join(cut(i), " ").alias("words"))))
    return F.array_sort(F.concat(*parts))


def _hits_by_join(docs: DataFrame, found: DataFrame, sizes: list[int], tag: str, w: str, hits: str) -> DataFrame:
    """The same places for a benchmark of any size: (tag, hits) of documents that have some."""
    def at(size: int) -> Column:
        return F.transform(native.starts(F.size(w), size), lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.xxhash64(F.slice(F.col(w), i, size)).alias("hash")))

    places = F.concat(*(at(k) for k in sizes))
    rows = docs.select(tag, F.explode(places).alias("p")).select(tag, "p.*", F.pmod("p.at", F.lit(SALTS)).alias("salt"))
    salted = found.select("hash", "size", "words", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hit = rows.join(salted, ["hash", "size", "salt"]).groupBy(tag).agg(F.collect_list(F.struct("at", "size", "words")).alias(hits))
    exact = F.filter(hits, lambda h: F.array_join(F.slice(F.col(w), h["at"], h["size"]), " ") == h["words"])
    return docs.join(hit, tag, "left").withColumn(hits, F.array_sort(F.coalesce(exact, F.array().cast(_HITS))))


def _union(hits: Column) -> Column:
    """Number of words under at least one hit."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))

    def step(acc, h):
        end = h["at"] + h["size"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(h["at"], acc["reach"]))).alias("n"), F.greatest(end, acc["reach"]).alias("reach"))

    return F.aggregate(hits, zero, step, lambda acc: acc["n"])


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", broadcast_windows: int = 50_000) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit and hits: array<struct<at, size, words>>, places counted from 1.

    Null and empty texts have no words and no hits, as have all rows if the benchmark is empty.  Repeated rows are
    judged one by one.  Columns of ``docs`` keep their names; a result column that would clash gets leading underscores.
    """
    tag, w, hits, n_words, n_hit = native.fresh(docs, "row_tag", "row_words", "hits", "n_words", "n_hit")
    found = benchmark_windows(benchmark, width)
    few = found.select("hash", "size", "words").limit(broadcast_windows + 1).collect()
    rows = docs.withColumn(w, native.words(F.col(text_col)))
    sizes = sorted({r["size"] for r in few})
    if not few:
        rows = rows.withColumn(hits, F.array().cast(_HITS))
    elif len(few) <= broadcast_windows:
        hashes = {k: [r["hash"] for r in few if r["size"] == k] for k in sizes}
        windows = {k: [r["words"] for r in few if r["size"] == k] for k in sizes}
        rows = rows.withColumn(hits, _hits_in_row(hashes, windows, w))
    else:
        sizes = sorted(r["size"] for r in found.select("size").distinct().collect())
        rows = _hits_by_join(rows.withColumn(tag, F.monotonically_increasing_id()), found, sizes, tag, w, hits)
    # one value per row: a later filter on n_hit must not be pushed below and repeat the scan inside its lambdas
    found = F.struct(F.size(w).cast("long").alias("n_words"), _union(F.col(hits)).cast("long").alias("n_hit"), F.col(hits).alias("hits"))
    out = native.once(rows.select(*docs.columns, found.alias(tag)), tag, w)
    return out.select(*docs.columns, F.col(w)["n_words"].alias(n_words), F.col(w)["n_hit"].alias(n_hit), F.col(w)["hits"].alias(hits))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = 50_000) -> DataFrame:
    """One row per document: id, n_words, n_hit and items, the sorted ids of the benchmark items of which a window occurs."""
    found = benchmark_windows(benchmark, width).select("words", "items")
    if found.limit(broadcast_windows + 1).count() <= broadcast_windows:
        found = F.broadcast(found)
    rows = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, width, "text", broadcast_windows)
    seen = F.array_distinct(F.transform("hits", lambda h: h["words"]))
    rows = rows.select(F.monotonically_increasing_id().alias("tag"), "id", "n_words", "n_hit", seen.alias("seen"))
    rows = rows.select("tag", "id", "n_words", "n_hit", F.explode_outer("seen").alias("words"))
    named = rows.join(found, "words", "left").groupBy("tag", "id", "n_words", "n_hit").agg(F.collect_set("items").alias("items"))
    items = F.sort_array(F.array_distinct(F.flatten("items")))
    return named.select(F.col("id").alias(id_col), "n_words", "n_hit", items.alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", drop_share: float = 0.5) -> DataFrame:
    """Remove hit words from the texts, and documents of which more than ``drop_share`` of the words are hit.

    A text without hits stays as it is.  In a text with hits the lower-case words of the rest are not used: the text is
    split at its own word borders, and the pieces of hit words become one blank.
    """
    marked = scan(docs, benchmark, width, text_col)
    n_words, n_hit, hits = marked.columns[-3:]
    places, piece, under = native.fresh(marked, "places", "pieces", "under")
    kept = native.once(marked, hits, places).where(F.col(n_hit) <= F.col(n_words) * F.lit(drop_share))
    # every word with the separators before it; what follows the last word is the final piece
    own = F.when(F.col(n_hit) > 0, F.regexp_extract_all(text_col, F.lit(PIECE), F.lit(0)))
    gone = F.array_distinct(F.flatten(F.transform(places, lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))
    kept = native.once(native.once(kept, own, piece), F.map_from_arrays(gone, gone), under)
    kept = kept.withColumn(piece, F.filter(piece, lambda p, i: ~F.map_contains_key(F.col(under), i + 1)))
    rest = F.array_join(piece, "")
    return kept.withColumn(text_col, F.when(F.col(n_hit) > 0, rest).otherwise(F.col(text_col))).select(*docs.columns)
