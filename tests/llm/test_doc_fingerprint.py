"""Document fingerprints against brute force: least hashes, densification, packing, estimates, neighbours."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from callweave.llm import doc_fingerprint as df

SCHEMA = "doc_id long, text string, id long, no_id string, fingerprint int, part int"


def chained(longs, seed=42):
    for value in longs:
        seed = _hash_long(value, seed)
    return seed


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _hash_long(value, seed):
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed=seed)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def hashes_of(text, size):
    words = [_signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in words_of(text)]
    runs = [words[i:i + size] for i in range(len(words) - size + 1)]
    if words and not runs:
        array = 42
        for w in words:
            array = _hash_long(w, array)
        return {_signed(array)}
    return {_signed(chained(r)) for r in runs}


def brute(text, size=5, bins=256, bits=8):
    shift = 65 - bins.bit_length()
    full = [None] * bins
    for h in sorted(hashes_of(text, size), reverse=True):
        full[(h >> shift) + bins // 2] = h
    if not any(h is not None for h in full):
        return ""
    out = []
    for own, (start, step) in zip(full, df._probes(bins)):
        out.append(next(h for h in [own, *(full[(start + t * step) % bins] for t in range(bins))] if h is not None))
    return "".join(format(h & ((1 << bits) - 1), f"0{bits // 4}x") for h in out)


@pytest.mark.parametrize("size,bins,bits,piece", [(5, 256, 8, 8192), (5, 16, 4, 7), (3, 32, 8, 2), (1, 2, 4, 1)])
def test_fingerprints(spark, size, bins, bits, piece):
    rng = random.Random(size)
    blank = [" ", "  ", "\n", "\t", "\x0b\f", "\r\n", " \xa0"]
    rows = [(i, "".join(rng.choice(["a", "Bé", "😀", "word", *blank]) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(None, None), (None, "x"), (3, ""), (3, " \n"), (9, "one two three four"), (10, "w " * 5000 + "tail"), (11, "\n a b c d e f "), (12, "longword" * 40 + " b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", df.fingerprint(F.col("text"), size, bins, bits, piece).alias("f"))
    for row in docs.collect():
        assert row.f == brute(row.text, size, bins, bits), repr(row.text)


def test_probing_orders_visit_every_bin():
    for bins in (2, 16, 256):
        for start, step in df._probes(bins):
            assert {(start + t * step) % bins for t in range(bins)} == set(range(bins))


def test_likeness_is_near_the_jaccard_similarity(spark):
    rng, pairs = random.Random(4), []
    for k in range(240):
        n = rng.choice([60, 300, 900])
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = a[:int(n * rng.random())]
        b = b + [f"v{rng.randrange(10**6)}" for _ in range(n - len(b))]
        x, y = hashes_of(" ".join(a), 5), hashes_of(" ".join(b), 5)
        pairs.append((" ".join(a), " ".join(b), len(x & y) / len(x | y)))
    got = spark.createDataFrame(pairs, "a string, b string, want double").select(
        "want", df.likeness(df.fingerprint(F.col("a")), df.fingerprint(F.col("b"))).alias("got")).collect()
    error = np.array([r.got - r.want for r in got])
    assert abs(error.mean()) < 0.01 and error.std() < 0.05 and np.abs(error).max() < 0.2
    assert all(0 <= r.got <= 1 for r in got)


def test_edited_and_next(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "été", "😀", "x1", "gamma"]) for _ in range(rng.randint(0, 40)))
    rows = [(i, text()) for i in rng.sample(range(-500, 500), 120)] + [(700, same := "the same row " * 9), (700, same), (700, same), (701, ""), (702, None), (None, None), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, "n", 2, 3) for d, t in rows], SCHEMA)
    got = df.edited_and_next(docs, bins=64).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = Counter()
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[:len(t) - cut] + after[:cut]
        own, new, nxt = (brute(x, 5, 64) for x in (t, edited, after))
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, new, near(own, new, 64), near(own, nxt, 64)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert df.edited_and_next(docs.limit(0)).collect() == []
    (row,) = df.edited_and_next(docs.filter("doc_id = 701")).collect()
    assert (row.fingerprint, row.near_edited, row.near_next) == ("", 1.0, 1.0)
    assert len(df.fingerprints(docs).collect()) == len(rows)


def near(a, b, bins, bits=8):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = sum(a[i:i + 2] == b[i:i + 2] for i in range(0, len(a), 2)) / bins
    return round(max((same - 2.0 ** -bits) / (1 - 2.0 ** -bits), 0.0), 9)


def test_many_copies_are_repeated_in_blocks(spark):
    rows = spark.createDataFrame([(1, "a", 10), (None, "b", 1)], "doc_id long, edited_sha256 string, times long")
    got = Counter(r.edited_sha256 for r in df._repeated(rows, block=4).collect())
    assert got == {"a": 10, "b": 1}
