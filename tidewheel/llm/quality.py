"""Quality rules: tokeniser fertility beside plain text statistics.

A byte-fallback vocabulary and a byte-level one encode every white-space separated word.  Characters per token, the
share of byte-fallback tokens and the entropy of the tokens tell prose from junk; the bands depend on the language, or
on the script of the text where no language is named.  Words are encoded once per worker and kept (a bounded cache).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import worker

WINDOW = 8
PIECES = "piece_bpe_32k.model"
#: fixed: characters that count as symbols
SYMBOLS = "#*$%&|<>"
#: bands: characters per token (low, high), most byte-fallback tokens, bits of token entropy per doubling of length (low)
BANDS = {
    "latin": (1.3, 9.0, 0.10, 0.25),
    "cjk": (0.4, 3.0, 0.60, 0.25),
    "other": (0.5, 9.0, 0.60, 0.25),
}
LANGUAGE_BANDS = {"en": "latin", "de": "latin", "fr": "latin", "es": "latin", "it": "latin", "pt": "latin", "nl": "latin", "zh": "cjk", "ja": "cjk", "ko": "cjk"}


class Fertility(dict):
    """word bytes -> (its number, …); token ids and counts lie in lists by number."""

    def __init__(self, path: str, limit: int = 240_000):
        import sentencepiece

        super().__init__()
        self.limit = limit
        self.old: dict[bytes, bytes] = {}
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {i for i in range(self.library.vocab_size()) if self.library.is_byte(i)}
        self.low, self.high = (min(self.bytes), max(self.bytes)) if self.bytes else (1, 0)

    def __missing__(self, word: bytes) -> bytes:
        if word in self.old:
            ids = self[word] = self.old[word]
            return ids
        ids = np.array(self.library.encode(word.decode("utf-8", "replace"), num_threads=1), "<i4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def measure(self, words: list[bytes]) -> tuple[int, int, float]:
        """(tokens, byte-fallback tokens, entropy in bits) of a text's words."""
        if len(self) > self.limit // 2:
            self.old = dict(self)  # words that come again move back
            self.clear()
        ids = np.frombuffer(b"".join(map(self.__getitem__, words)), "<i4")
        if not len(ids):
            return 0, 0, 0.0
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        return len(ids), int(((ids >= self.low) & (ids <= self.high)).sum()), float(-(share * np.log2(share)).sum())


def fertility(path: str) -> Fertility:
    return worker.keep(("fertility", path), lambda: Fertility(path))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    name = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) > len(words) - width:  # a repeated window repeats each of its words
        return 0
    span = 1
    while span < width:  # names of windows twice as wide from pairs of names
        again = np.bincount(name)[name] > 1
        if not again.any():
            return 0
        pair = name[:-span] * (int(name.max()) + 1) + name[span:]
        name = np.unique(pair, return_inverse=True)[1]
        span *= 2
    hit = np.bincount(name)[name] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """Script of most letters of a text: latin, cjk or other."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    latin = int((((codes | 32) >= 97) & ((codes | 32) <= 122) | (codes >= 0xC0) & (codes < 0x250)).sum())
    cjk = int(((codes >= 0x3040) & (codes < 0x30000)).sum())
    other = int((codes >= 0x250).sum()) - cjk
    return "latin" if latin >= max(cjk, other) else "cjk" if cjk >= other else "other"


def measure(text: str | None, lang: str | None, ids: Fertility) -> tuple:
    """Statistics and verdict of one whole text; null has no words."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n_words = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines, repeated = repeated_lines(text), repeated_words(words)
    tokens, fallback, entropy = ids.measure(words)
    low, high, most_bytes, least_bits = BANDS[LANGUAGE_BANDS.get(lang or "") or script(text)]
    per_token = chars / tokens if tokens else 0.0
    share = fallback / tokens if tokens else 0.0
    base_failed = n_words < 20 or 100 * repeated > 30 * n_words
    inside = low <= per_token <= high and share <= most_bytes and entropy >= least_bits * np.log2(max(tokens, 2))
    return n_words, chars, symbols, lines, repeated, per_token, share, entropy, base_failed, bool(inside and not base_failed)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_per_token", "byte_share", "token_entropy", "base_failed", "kept"]
_TYPES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, byte_share double, token_entropy double, base_failed boolean, kept boolean"


def _path(vocabulary: str | None) -> str:
    from tidewheel.llm import tokens

    return vocabulary or tokens.vocabulary_path(PIECES)


def judge(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, statistics, fertility, base_failed and kept.

    Null and empty texts have no words and fail.  An unknown or null language is judged by script, as are all texts if
    the table has no language column.  Repeated rows are judged one by one.
    """
    path = _path(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)

    def each(batches):
        ids = fertility(path)
        for batch in batches:
            rows = [measure(t, x, ids) for t, x in zip(batch["text"], batch["lang"], strict=True)]
            out = pd.DataFrame(rows, columns=COLUMNS)
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.cast("string").alias("lang"))
    return rows.mapInPandas(each, f"id {kind}, {_TYPES}").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text passes, unchanged."""
    path = _path(vocabulary)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")

    def passes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ids = fertility(path)
        for texts, langs in batches:
            rows = zip(worker.strings(texts), worker.strings(langs), strict=True)
            yield pa.array([measure(t, x, ids)[-1] for t, x in rows], pa.bool_())
        worker.give_back()

    return docs.where(F.arrow_udf(passes, "boolean")(F.col(text_col), lang))
