"""Plain restatements of the contracts, one text at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encode(text, end):
    return np.array([*library_cached().encode(text or "", add_special_tokens=False).ids, end], "<u4")


_LIB = []


def library_cached():
    if not _LIB:
        _LIB.append(library())
    return _LIB[0]


def token_rows(docs):
    """op3 rows for [(doc_id, text)] with distinct ids."""
    out, start = [], 0
    for key, text in sorted(docs):
        ids = encode(text, 2)
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def piece_rows(docs, capacity=2048):
    """op1 rows without the place."""
    out = []
    for key, text in docs:
        ids = encode(text, 0)
        for piece, at in enumerate(range(0, len(ids), capacity)):
            out.append((key, piece, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())))
    return sorted(out)


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    names = ["assign", "access", "hex"]
    joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found))
    return *(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def licenses(text):
    w = words(text)
    places = [(i, label) for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def contamination(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        v = words(body)
        k = min(width, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                found.add(str(item))
                hit.update(range(i, i + k))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def repeats(texts, length=400):
    """op9: (n_bytes, n_removed, n_spans, kept_sha256) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        spans = int((np.diff(np.concatenate([[0], gone[:-1].astype(int)])) == 1).sum())
        out.append((len(d), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def lines(docs, least=10):
    """op12: [(doc_id, text)] -> (doc_id, n_lines, n_dropped, kept_sha256) per row."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    def rank(doc):
        return (doc is not None, doc or 0)

    holders = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(rank(doc))
    out = []
    for doc, text in docs:
        split = (text or "").split("\n")
        kept = [x for x in split if len(key(x)) < least or len(holders[key(x)]) < 2 or rank(doc) == min(holders[key(x)])]
        out.append((doc, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def hard_negatives(rows, positives=5, negatives=10):
    """op11: [(id, vector, label)] -> rows, one pair after the other."""
    import math

    sound = [(i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows
             if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, tuple(v), y) for i, v, y in sound if i % 100 == 0}
    out = []
    for i, v, y in anchors:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, z == y) for j, w, z in sound if j != i and len(w) == len(v)]
        for p, pid in sorted({(s, j) for s, j, same in scored if same})[:positives]:
            fits = sorted({(s, j) for s, j, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p})[:negatives]
            out += [(i, pid, rank, j, -p, -s) for rank, (s, j) in enumerate(fits, 1)]
    return out


def alignment(texts):
    """op13 per text, whole texts through either library, every pair by itself."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]: chr(c).encode() for c in range(128)}
    for c in range(128, 0x800):
        for mark, byte in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0], chr(c).encode(), strict=True):
            shown[mark] = bytes([byte])
    for lead in range(0x10000, 0x110000, 0x10000):
        for mark, byte in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(lead))[0][0], chr(lead).encode(), strict=True):
            shown[mark] = bytes([byte])
    for c in range(0x800, 0x10000, 64):
        if not 0xD800 <= c < 0xE000:
            for mark, byte in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0], chr(c).encode(), strict=True):
                shown[mark] = bytes([byte])

    def cuts(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    made = []
    for text in texts:
        data = (" " + (text or "")).encode()
        ai = a.encode(" " + (text or ""), add_special_tokens=False).ids
        bi = b.encode(text or "")
        ab = [b"".join(shown[c] for c in a.id_to_token(i)) for i in ai]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in bi]
        if not text or b"".join(ab) != data or b"".join(bb) != data:
            made.append(None)
            continue
        ae, be = cuts(ab), cuts(bb)
        both = sorted(set(ae) & set(be))
        groups, i, j = [], 0, 0
        for cut in both:
            p, q = ae.index(cut, i) + 1, be.index(cut, j) + 1
            groups.append((ai[i:p], bi[j:q]))
            i, j = p, q
        made.append((len(ai), len(bi), groups))
    count = Counter(pair for m in made if m for pair in {(x, y) for g in m[2] for x in g[0] for y in g[1]})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for m in made:
        if not m:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        pairs = [(x, y) for g in m[2] for x in g[0] for y in g[1]]
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in m[2])
        out.append((m[0], m[1], len(m[2]), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return out
