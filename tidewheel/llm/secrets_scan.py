"""Secret scans: an Aho-Corasick automaton finds keywords, anchored expressions run only there, checksums decide.

The automaton reads each text once, with A-Z lower-cased for keywords that count in either case.  Hexadecimal runs have
no keyword and are found by a plain expression.  The kinds that the method adds carry their own proof: tokens that end
in the base-62 CRC-32 of their body, web tokens whose header decodes, and key blocks whose outer length field is right.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import worker

#: fixed: base kinds in their order, then the method's
KINDS = ["assign", "access", "hex", "checked", "webtoken", "keyblock"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CHECKED = re.compile(r"(?:ghp|gho|ghu|ghs|ghr|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
WEBTOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
KEYBLOCK = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(65, 91)}
#: keyword (lower case) -> kinds that may begin there
_KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "eyj": "webtoken", "-----begin ": "keyblock"} | {f"{x}_": "checked" for x in ("ghp", "gho", "ghu", "ghs", "ghr", "npm")}


def _checked(m: re.Match) -> bool:
    """The last six characters are the base-62 CRC-32 of the rest after the prefix."""
    body, given = m[0][4:-6], m[0][-6:]
    value, text = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        text = _DIGITS[digit] + text
    return text.rjust(6, "0") == given


def _webtoken(m: re.Match) -> bool:
    head = m[0].split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def _keyblock(m: re.Match) -> bool:
    """The DER sequence inside says how long it is."""
    try:
        data = base64.b64decode("".join(m[2].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(data) < 2 or data[0] != 0x30:
        return False
    wide = data[1] & 0x7F if data[1] & 0x80 else 0
    length = int.from_bytes(data[2 : 2 + wide], "big") if wide else data[1]
    return length == len(data) - 2 - wide


_RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "checked": (CHECKED, _checked),
    "webtoken": (WEBTOKEN, _webtoken),
    "keyblock": (KEYBLOCK, _keyblock),
}
_AUTOMATON = []


def automaton():
    """Built once per worker."""
    if not _AUTOMATON:
        import ahocorasick

        found = ahocorasick.Automaton()
        for word, kind in _KEYWORDS.items():
            found.add_word(word, (kind, len(word)))
        found.make_automaton()
        _AUTOMATON.append(found)
    return _AUTOMATON[0]


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; per kind leftmost and not overlapping, matches that fail are consumed too."""
    if not text:
        return []
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in automaton().iter(low):
        starts.setdefault(kind, []).append(end + 1 - n)
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, places in starts.items():
        rule, proof = _RULES[kind]
        done = 0
        for at in sorted(places):
            if at >= done and (m := rule.match(text, at)):
                done = m.end()
                if proof(m):
                    out.append((at, m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, end exclusive.  Null and empty texts have none; repeated rows are
    scanned one by one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = spans(text)
                base = [s for s in found if s[2] in KINDS[:3]]
                joined = lambda part: ",".join(f"{k}:{a}:{b}" for a, b, k in part)
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(each, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact_text(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    found = spans(text)
    if not found:
        return text
    out, done = [], 0
    merged: list[list[int]] = []
    for start, end, _ in found:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[done:start], mark]
        done = end
    return "".join([*out, text[done:]])


def _redacted(texts: pa.Array, mark: str) -> pa.Array:
    """Few texts are Python strings at a time, and an array without a secret comes back as it is."""
    parts, same = [], True
    for at in range(0, len(texts), worker.SLICE):
        part = texts.slice(at, worker.SLICE)
        before = part.to_pylist()
        after = [redact_text(t, mark) for t in before]
        same &= after == before
        parts.append(part if after == before else pa.array(after, texts.type))
    return texts if same else pa.concat_arrays(parts)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """All rows with secrets replaced; texts without one, and nulls, stay as they are."""

    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return worker.tidy(lambda given: (_redacted(texts, mark) for texts in given))(batches)

    return docs.withColumn(text_col, F.arrow_udf(cleaned, "string")(F.col(text_col)))
