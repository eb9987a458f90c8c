"""Byte-level BPE encoding with a rank queue, and decoding.

A pre-token's bytes form a linked list of parts.  Every pair of neighbours that is a token waits in the bucket of its
rank.  A two-level bitmap over the ranks tells the lowest bucket in use by finding the first set bit twice; its pairs
merge from left to right, and the pairs that a merge makes go to their own buckets.  Entries of pairs that are gone
stay where they are and are skipped.  So a pre-token of a million bytes costs a million steps, not their square.
Distinct pre-tokens are encoded once per worker while its table holds them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Pre-tokens held by one worker; the table is emptied beyond it.
HELD = 3 << 18
#: Fixed value: the split pattern for which ``LATIN_SPLIT`` is the same thing on texts below U+0180.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = re.compile("[\0-ſ]*").fullmatch
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_SPLIT = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
).findall


def read_ranks(lines: list[str]) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteEncoder(dict):
    """Pre-token to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.tokens}.__getitem__
        self.split = regex.compile(pattern).findall
        self.latin = pattern == KNOWN_PATTERN
        # The queue: a bit per word of ranks, words of 256 bits, positions per rank.  Every merge leaves it empty.
        self.words = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.buckets: dict[int, list[int]] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= HELD:
            self.clear()
        piece = word.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(piece)
        value = self[word] = b"".join(map(self.packed, self.merge(piece) if rank is None else [rank]))
        return value

    def merge(self, piece: bytes) -> list[int]:
        n, get, words, buckets = len(piece), self.ranks.get, self.words, self.buckets
        end = list(range(1, n + 1))  # of the part that starts here, so also the next part
        before = list(range(-1, n - 1))
        waits = [-1] * n  # rank of the pair that starts here
        top = 0
        for i in range(n - 1):
            rank = get(piece[i:i + 2])
            if rank is not None:
                waits[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            lowest = high << 8 | (word & -word).bit_length() - 1
            bucket = buckets[lowest]
            bucket.sort(reverse=True)
            overtaken = False
            while bucket and not overtaken:
                i = bucket.pop()
                if waits[i] != lowest:
                    continue  # stale
                gone = end[i]
                after = end[i] = end[gone]
                waits[gone] = waits[i] = -1
                if after < n:
                    before[after] = i
                for start, stop in ((i, end[after] if after < n else 0), (before[i], after)):
                    if start < 0 or not stop:
                        continue
                    rank = get(piece[start:stop])
                    waits[start] = -1 if rank is None else rank
                    if rank is None:
                        continue
                    overtaken |= rank < lowest
                    if rank in buckets:
                        buckets[rank].append(start)
                    else:
                        buckets[rank] = [start]
                        words[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)
            if not bucket:
                del buckets[lowest]
                words[high] &= ~(1 << (lowest & 255))
                if not words[high]:
                    top &= ~(1 << high)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i:end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        split = LATIN_SPLIT if self.latin and LATIN(text) else self.split
        return b"".join(map(self.__getitem__, split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple, ByteEncoder] = {}


def _encoder(path: str, pattern: str) -> ByteEncoder:
    """One per worker process, kept between tasks."""
    if (path, pattern) not in _encoders:
        with open(path, encoding="ascii") as file:
            _encoders[path, pattern] = ByteEncoder(read_ranks(file.read().splitlines()), pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian, four bytes each) for every row.

    ``ranks`` is a vocabulary file that every executor has.  No special tokens: their strings are ordinary text.  An
    empty or null text has no ids.  Rows go through one by one, so null ids and repeated rows are rows like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(ranks, pattern)
        for batch in sliced(batches):
            ids = [own.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``encoded`` (not ``ids``, ``bytes``) with ``bytes``, decoded from ``ids``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(ranks, pattern)
        for batch in sliced(batches):
            ids = batch.column(len(columns))
            out = [None if x is None else own.decode(x) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(columns)], ids, pa.array(out, pa.binary())], [*columns, "ids", "bytes"]
            )

    rows = encoded.select(*columns, "ids")
    return rows.mapInArrow(run, rows.withColumn("bytes", F.col("ids")).schema)

