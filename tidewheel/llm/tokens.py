"""Token ids of whole texts with a public vocabulary, one word at a time.

The vocabulary never joins across white space, so the ids of a text are those of its white-space separated words in
turn.  Each worker keeps the ids of words it has met (at most ``limit``), and the library encodes only new ones.  When
half of them are new since the last time, the older half goes, but for words that come again.
"""

from __future__ import annotations

import string
import sys
from array import array

from tidewheel.llm import worker

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("token ids are laid out for little-endian machines with 32-bit integers")
_UINT32 = "I"
WORD_VOCABULARY = "word_bpe_49k.json"
_MARKS = string.punctuation.encode()
#: letters below this code point are in composed form, and every Unicode version agrees on them
_PLAIN = "\u0250"


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable Latin-1 for itself, all others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """word bytes -> its ids as little-endian unsigned 32-bit integers, for a vocabulary that lower-cases."""

    LONGEST = 64

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.limit = limit
        self.old: dict[bytes, bytes] = {}
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.marks = {m: self._ids(m) for m in (b",", b".")}
        self.shown = {b: c for c, b in byte_alphabet().items()}

    def _ids(self, word: bytes) -> bytes:
        return array(_UINT32, self.library.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def _letters(self, letters: bytes) -> bytes:
        """Ids of lower-case letters, which the vocabulary's own splitter leaves whole."""
        return array(_UINT32, [t.id for t in self.model.tokenize(letters.decode("latin-1").translate(self.shown))]).tobytes()

    def _other(self, word: bytes) -> bytes:
        """Ids of a word that is not plain a-z: letters beyond ASCII, marks after a letter or digit (a token run of their own), or anything."""
        if len(word) > self.LONGEST or b"<|" in word:
            return self._ids(word)
        text = word.decode("utf-8", "replace").lower()
        if text.isalpha() and max(text) < _PLAIN:
            return self._letters(text.encode())
        stem = word.rstrip(_MARKS)
        if 0 < len(stem) < len(word):
            end = text[len(stem) - len(word) - 1]  # marks are as many characters as bytes
            if end < _PLAIN and (end.isalpha() or end.isdecimal()):
                return self[stem] + self[word[len(stem) :]]
        return self._ids(word)

    def __missing__(self, word: bytes) -> bytes:
        if word in self.old:
            ids = self[word] = self.old[word]
            return ids
        if word.isalpha() and word.islower() and len(word) <= self.LONGEST:
            ids = self._letters(word)
        elif word[-1:] in self.marks and word[-2:-1].isalnum():
            return self[word[:-1]] + self.marks[word[-1:]]
        else:
            ids = self._other(word)
        if len(word) <= self.LONGEST:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; null counts as empty."""
        if not text:
            return b""
        if len(self) > self.limit // 2:
            self.old = dict(self)
            self.clear()
        data = text.encode("utf-8", "replace")
        if b"<|" not in data:  # names of special tokens are matched before letters are lower-cased
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))


def word_ids(path: str, limit: int = 400_000) -> WordIds:
    """The cache of this worker process."""
    return worker.keep(("word ids", path, limit), lambda: WordIds(path, limit))
