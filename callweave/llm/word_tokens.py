"""Ids of a lower-casing word tokenizer file, encoded once per distinct word of a task.

The tokenizer replaces white space, lower-cases and splits into letter runs, digits and other runs before it merges, so
no id depends on anything beyond its white-space delimited word.  Words of Latin letters are taken apart here and
their pieces go to the tokenizer's own model; every other word goes through the whole tokenizer.
"""

from __future__ import annotations

import re
from sys import getsizeof

import regex
from tokenizers import Tokenizer

#: Bytes that a worker's tables of words and of pieces hold.  Full tables take nothing new: what is frequent came early.
WORDS, PARTS = 40 << 20, 20 << 20
#: Characters of the longest word held, and bytes of a place in a table.
LONGEST, PLACE = 256, 64
#: Characters below U+0180 without U+0130: composed already, and lower-cased one by one.
LATIN = re.compile("[\0-įı-ſ]*").fullmatch
#: Fixed value: the split pattern of the tokenizer file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
#: str.split() also splits at these, which the tokenizer does not take for white space.
SEPARATORS = re.compile("[\x1c-\x1f]").search
SPACES = re.compile("[ \t-\r\x85\xa0]+").split


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Held(dict):
    """Computed values, kept up to a limit in bytes; those of long words are not kept."""

    def __init__(self, limit: int, compute):
        super().__init__()
        self.room, self.compute = limit, compute

    def __missing__(self, key):
        value = self.compute(key)
        if self.room > 0 and len(key) <= LONGEST:
            self[key] = value
            self.room -= getsizeof(key) + getsizeof(value) + PLACE
        return value


class WordEncoder:
    """Word to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.parts = Held(PARTS, self._part)
        self.words = Held(WORDS, self._word)

    def _word(self, word: str) -> bytes:
        low = word.lower()
        if low.isascii() or LATIN(word):
            if low.isalpha():
                return self.parts[word if word == low else low]  # one string for both tables
            if low[:-1].isalpha():
                return self.parts[low[:-1]] + self.parts[low[-1]]
            if "<|" not in low:  # special tokens are written so
                return b"".join(map(self.parts.__getitem__, PIECES(low)))
        return b"".join(map(self.packed.__getitem__, self.tokenizer.encode(word, add_special_tokens=False).ids))

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() and part.isprintable() else "".join(map(self.letters.__getitem__, part.encode()))
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(spelled)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        words = SPACES(text) if SEPARATORS(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per file and worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
