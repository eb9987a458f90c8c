"""Target-distribution importance resampling over hashed word runs, with an Aho-Corasick dictionary as scanner.

A block of texts is brought to one form: words apart by single spaces, with a space at both ends.  Its distinct words, each with
the space before and behind it, go into an automaton, so a match is a whole word and neighbours share their space.  A word carries
its CRC-32 and its length as payload; a scan emits payloads in order, and payloads of neighbours compose to the CRC-32 of the run
without reading its letters again: CRCs are linear, so the first is moved over the length of the second.  Dictionaries hold the
words of one block, so their memory is bounded by the block at every size of the corpus; words longer than ``LONG`` stay outside.

Texts are scanned once: the buckets of a document are stored as numbers.  Counting adds up one vector of buckets per task, gains
are one small table of ``buckets`` rows, and the draw numbers the documents by range partition, so no task sees all of them.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, release, sliced, stored

#: What stands between words: ASCII other than digits and letters.
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Code points of a block of texts, and of a word that enters a dictionary.
BLOCK, LONG = 1 << 20, 256
OVERLONG = re.compile(rf" ([^ ]{{{LONG + 1},}})(?= )")
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Payload pairs composed at a time.
PAIRS = 1 << 18


def _times_x(value: int, bits: int) -> int:
    for _ in range(bits):
        value = value >> 1 ^ (POLYNOMIAL if value & 1 else 0)
    return value


@lru_cache(maxsize=4096)
def _mover(length: int) -> np.ndarray:
    """Four tables that move a CRC over ``length`` bytes: the images of each of its bytes."""
    # x^(8 length) by squaring, as a reflected polynomial: bit 31 stands for 1.
    def product(a: int, b: int) -> int:
        out = 0
        while b:
            if b & 0x80000000:
                out ^= a
            b = b << 1 & 0xFFFFFFFF
            a = _times_x(a, 1)
        return out

    power, square, left = 0x80000000, _times_x(0x80000000, 8), length
    while left:
        if left & 1:
            power = product(power, square)
        square = product(square, square)
        left >>= 1
    images = np.array([product(power, 1 << bit) for bit in range(32)], np.uint32)
    tables = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            tables[byte, np.arange(256) >> bit & 1 == 1] ^= images[8 * byte + bit]
    return tables


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The part of a CRC-32 that comes from ``crc`` when ``length`` more bytes follow."""
    out = np.empty_like(crc)
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        tables, value = _mover(int(size)), crc[at]
        out[at] = tables[0][value & 255] ^ tables[1][value >> 8 & 255] ^ tables[2][value >> 16 & 255] ^ tables[3][value >> 24]
    return out


def composed(first, second):
    """Payloads of two byte strings in a row, from their payloads."""
    return moved(first[0], second[1]) ^ second[0], first[1] + second[1]


def _normal(text: str) -> str:
    return f" {BETWEEN.sub(' ', text.translate(LOWER)).strip(' ')} "


class Scanner:
    """Payloads (CRC-32, bytes) of the words of texts, from one dictionary over all of them."""

    def __init__(self, texts: list[str]):
        words = {w for text in texts for w in text.split(" ") if w and len(w) <= LONG}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        crc, length = np.zeros(len(words), np.uint32), np.zeros(len(words), np.int64)
        for k, word in enumerate(words):
            data = word.encode()
            crc[k], length[k] = zlib.crc32(data), len(data)
            self.automaton.add_word(f" {word} ", k)
        if words:
            self.automaton.make_automaton()
        self.crc, self.length = crc, length

    def _found(self, text: str):
        numbers = np.fromiter((k for _, k in self.automaton.iter(text)), np.int64) if len(self.automaton) else np.zeros(0, np.int64)
        return self.crc[numbers], self.length[numbers]

    def payloads(self, text: str):
        """Of the words of a text in its one form, in order."""
        parts = OVERLONG.split(text)
        if len(parts) == 1:
            return self._found(text)
        found = []
        for k, part in enumerate(parts):
            if k % 2:
                data = part.encode()
                found.append((np.array([zlib.crc32(data)], np.uint32), np.array([len(data)], np.int64)))
            else:
                found.append(self._found(part + " "))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def buckets_of(payloads, longest: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``longest`` neighbours, joined by one space: first the single words, then pairs, and so on."""
    words = payloads
    space = (np.full(len(words[0]), zlib.crc32(b" "), np.uint32), np.ones(len(words[0]), np.int64))
    runs, out = words, [words[0] % buckets]
    for size in range(2, longest + 1):
        n = len(words[0]) - size + 1
        if n < 1:
            break
        runs = [np.concatenate(x) for x in zip(*(
            composed(composed(_cut(runs, at, min(at + PAIRS, n)), _cut(space, at, min(at + PAIRS, n))), _cut(words, at + size - 1, min(at + PAIRS, n) + size - 1))
            for at in range(0, n, PAIRS)
        ))]
        out.append(runs[0] % buckets)
    return np.concatenate(out)


def _cut(payloads, start: int, end: int):
    return payloads[0][start:end], payloads[1][start:end]


def _blocks(batches):
    """Groups of neighbouring rows with ``BLOCK`` code points in all, or one longer text."""
    for batch in sliced(batches):
        start = held = 0
        texts: list[str] = []
        for row, value in enumerate(batch.column("text")):
            text = _normal(value.as_py())
            if texts and held + len(text) > BLOCK:
                yield batch.slice(start, len(texts)), texts
                start, held, texts = row, 0, []
            texts.append(text)
            held += len(text)
        if texts:
            yield batch.slice(start, len(texts)), texts


def _scanned(batches, longest: int, buckets: int):
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    for batch, texts in _blocks(batches):
        scanner = Scanner(texts)
        n_words, features = [], []
        for text in texts:
            payloads = scanner.payloads(text)
            n_words.append(len(payloads[0]))
            features.append(buckets_of(payloads, longest, buckets).astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_hash"), pa.array(n_words, pa.int64()), pa.array(features, pa.binary())],
            ["doc_id", "row_hash", "n_words", "features"],
        )


def word_buckets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """``doc_id``, ``row_hash``, ``n_words``, ``features`` per row of ``docs``; null counts as empty.

    Words are runs of digits, letters and code points beyond ASCII, with A-Z lower-cased.  ``features`` holds the bucket (CRC-32 of
    the UTF-8 bytes modulo ``buckets``) of every run of 1 to ``longest`` words joined by one space, repeats included, as
    little-endian numbers of 16 bits, or of 32 beyond 65,536 buckets.
    """
    schema = "doc_id long, row_hash long, n_words long, features binary"
    return keyed(docs, id_col, text_col).mapInArrow(lambda b: _scanned(b, longest, buckets), schema)


def _numbers(value, buckets: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<u2" if buckets <= 1 << 16 else "<u4")


def _counted(batches, buckets: int):
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for value in batch.column(0):
            total += np.bincount(_numbers(value, buckets), minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])


def bucket_counts(scanned: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``bucket``, ``n``: how many features of all rows fall into each bucket that has any."""
    partial = scanned.select("features").mapInArrow(lambda b: _counted(b, buckets), "bucket long, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Per bucket 1000 times the log of its smoothed share in the target over that in the source, floored; both sides are counts.

    The table has ``buckets`` rows whatever the input, so the driver holds it and tasks get it with their code.
    """
    all_s, all_t = (F.lit(side.agg(F.sum("n")).first()[0] or 0).cast("double") for side in (source, target))
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").fillna(0, ["s", "t"])
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    every = both.union(both.sparkSession.range(buckets).select("id", F.lit(0), F.lit(0))).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    gain = F.floor(F.lit(1000) * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).cast("long")
    out = np.zeros(buckets, np.int64)
    for bucket, value in every.select("bucket", gain).collect():
        out[bucket] = value
    return out


def _weighed(batches, gain: np.ndarray):
    for batch in batches:
        features = [_numbers(value, len(gain)) for value in batch.column("features")]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([len(f) for f in features], pa.int64()), pa.array([int(gain[f].sum()) for f in features], pa.int64())],
            ["doc_id", "row_hash", "n_words", "n_features", "weight"],
        )


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
             longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """``doc_id``, ``row_hash``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` for every row of ``docs``.

    ``weight`` adds the gains of a row's features (none: 0), ``score`` adds Gumbel noise drawn from ``seed`` and id, so the highest
    scores are a sample without replacement by importance.  Of the rows with ``least_words`` words or more, ``percent`` of a
    hundred are drawn, rounded down: they carry their ``rank`` by falling score, ties by rising id (null last), text hash; all others
    carry null.  Null texts have no words; rows without id share the noise of the empty id; repeated rows are rows of their own.
    An empty target or source counts nothing, and every bucket keeps its smoothing.
    """
    scanned = stored(word_buckets(docs, id_col, text_col, longest, buckets), "features")
    source = stored(bucket_counts(scanned, buckets), "source")
    wanted = stored(bucket_counts(word_buckets(target, target_id, target_text, longest, buckets), buckets), "target")
    gain = gains(source, wanted, buckets)
    schema = "doc_id long, row_hash long, n_words long, n_features long, weight long"
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    noise = F.floor(F.lit(-1000) * F.log(-F.log(uniform))).cast("long")
    scored = stored(scanned.mapInArrow(lambda b: _weighed(b, gain), schema).withColumn("score", F.col("weight") + noise), "scored")
    release(scanned, source, wanted)
    # Numbers tell repeated rows apart, so a range partition never has to hold all of them.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row_hash"), F.asc("copy")]
    able = scored.filter(F.col("n_words") >= least_words).withColumn("copy", F.monotonically_increasing_id())
    ranged = able.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy")
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # One row per range partition.
    sizes = sorted(ranged.groupBy(part.alias("part")).count().collect())
    ends = np.cumsum([0] + [n for _, n in sizes])
    drawn = int(ends[-1]) * percent // 100
    before = scored.sparkSession.createDataFrame([(p, int(e)) for (p, _), e in zip(sizes, ends)], "part long, before long")
    rank = F.col("before") + place + 1
    columns = ["doc_id", "row_hash", "n_words", "n_features", "weight", "score"]
    ranked = ranged.withColumn("part", part).join(F.broadcast(before), "part").select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.union(scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long")))
