"""Importance resampling against brute force: composed payloads, scans, gains, draws."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from callweave.llm import importance_resampling as ir

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, weight long, score string, features int, part int"


def words_of(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs_of(words, longest):
    return [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def test_payloads_compose():
    rng = random.Random(1)
    strings = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 7, 300, 70_000]))) for _ in range(40)]
    pack = lambda data: (np.array([zlib.crc32(data)], np.uint32), np.array([len(data)], np.int64))
    for a in strings:
        for b in strings:
            crc, length = ir.composed(pack(a), pack(b))
            assert (int(crc[0]), int(length[0])) == (zlib.crc32(a + b), len(a + b))


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 100_000)])
def test_scans(monkeypatch, longest, buckets):
    monkeypatch.setattr(ir, "PAIRS", 7)
    rng = random.Random(2)
    texts = ["", " ", "a", "A-a", "x" * 5000, f"b {'é' * 300} {'y' * 400} b"]
    texts += ["".join(rng.choice(["a", "B ", "ab", " ", "é", "😀 ", "\n", "0", "_", "z" * 257, "\x7f"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    scanner = ir.Scanner([ir._normal(t) for t in texts])
    for text in texts:
        payloads = scanner.payloads(ir._normal(text))
        assert payloads[0].tolist() == [zlib.crc32(w.encode()) for w in words_of(text)]
        assert ir.buckets_of(payloads, longest, buckets).tolist() == [zlib.crc32(r.encode()) % buckets for r in runs_of(words_of(text), longest)]


def brute(rows, target, longest, buckets, seed, percent, least):
    features = [[zlib.crc32(r.encode()) % buckets for r in runs_of(words_of(t), longest)] for _, t in rows]
    s, t = Counter(x for f in features for x in f), Counter(zlib.crc32(r.encode()) % buckets for x in target for r in runs_of(words_of(x), longest))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (d, text), f in zip(rows, features):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((d, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    ranks = Counter((*r, k if k <= drawn else None) for k, r in enumerate(able, 1))
    return ranks + Counter((*r, None) for r in out if r[1] < least)


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (2, 70_000, 45), (3, 50, 100)])
def test_draws(spark, longest, buckets, percent):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["Alpha", "beta", "été", "Ünder", "x1", "--", "w" * 300]) for _ in range(rng.randint(0, 30)))
    rows = [(i, text()) for i in range(200)] + [(None, None), (None, "alpha beta " * 9), (None, "alpha beta " * 9), (7, rows_text := "same id " * 8), (7, rows_text), (-3, "long " * 60_000), (500, "")]
    target = [(i, text()) for i in range(30)] + [(None, None)]
    docs = spark.createDataFrame([(d, t, 1, "s", 2, 3) for d, t in rows], SCHEMA)
    items = spark.createDataFrame(target, "item_id long, text string")
    got = ir.resample(docs, items, longest=longest, buckets=buckets, seed=5, percent=percent, least_words=8).collect()
    want = brute(rows, [t for _, t in target], longest, buckets, 5, percent, 8)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got) == want


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, "s", 2, 3)], SCHEMA)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ir.resample(docs.limit(0), items).collect() == []
    (row,) = ir.resample(docs, items.limit(0), least_words=1, percent=100).collect()
    assert row.rank == 1 and row.n_features == 3
    want = brute([(1, "a b c")], [], 1, 10_000, 2024, 100, 1)
    assert Counter([(row.doc_id, row.n_words, row.n_features, row.weight, row.score, row.rank)]) == want
