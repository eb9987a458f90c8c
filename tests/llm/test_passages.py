import hashlib
import random
import re
from collections import Counter

import pytest

from callweave.llm.passage_dedup import remove_repeated_words, remove_repeats, sample


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(rows):
    return [(r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in rows]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randint(5, 60)) for _ in range(6)]
    out = [None, "", "short", "a" * 150, "ab" * 90, "ab" * 91]
    for _ in range(60):
        parts = [rng.choice([prose(rng.randint(1, 40)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 20):]]) for _ in range(rng.randint(1, 5))]
        out.append("".join(parts))
        if rng.random() < 0.5:
            old = rng.choice(out) or ""
            at = rng.randint(0, max(0, len(old) - 1))
            out.append(old[:at] + "#" + old[at + rng.randint(0, 2):])
    return out + out[10:14]


def test_sample_is_the_same_in_pieces():
    text = corpus(3)[20].encode() * 3
    whole = {(p, a) for at, lo, hi in sample(text, 40, 33) for a, s, e in zip(at, lo, hi) for p in range(s, e + 1)}
    parts = {(p, a) for at, lo, hi in sample(text, 40, 33, at_once=50) for a, s, e in zip(at, lo, hi) for p in range(s, e + 1)}
    assert whole == parts and len(whole) == len(text) - 39


@pytest.mark.parametrize("length,step", [(40, 6), (64, 22), (17, 5)])
def test_against_brute_force(spark, length, step):
    texts = corpus(length)
    ids = [None if i == 20 else i // 2 if i < 8 else i for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "1 as core", "2 as lo", "3 as row_hash")
    got = remove_repeats(docs, length=length, step=step).collect()
    want = brute(texts, length)
    assert sum(w[1] for w in want) > 0
    assert sorted(result(got)) == sorted(want)


def test_repeated_rows_and_empty_table(spark):
    text = "xyz" * 30
    rows = [(1, text), (1, text), (2, "other")]
    got = sorted(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40, step=6).collect(), key=str)
    assert sorted(result(got)) == sorted(brute([t for _, t in rows], 40))
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_words(texts, words):
    cut = [[(m.group(), m.start()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    seen = Counter(tuple(w for w, _ in c[i:i + words]) for c in cut for i in range(len(c) - words + 1))
    out = []
    for text, c in zip(texts, cut):
        gone = [False] * len(c)
        for i in range(len(c) - words + 1):
            if seen[tuple(w for w, _ in c[i:i + words])] > 1:
                gone[i:i + words] = [True] * words
        ends = [s for _, s in c[1:]] + [len(text or "")]
        kept = (text or "")[:c[0][1] if c else None] + "".join((text or "")[s:e] for (_, s), e, g in zip(c, ends, gone) if not g)
        out.append((kept, sum(gone)))
    return out


@pytest.mark.parametrize("words,seed", [(8, 1), (12, 2), (50, 3)])
def test_repeated_words(spark, words, seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice(["a", "Bé", "😀", "word", "long" * 9]) + str(rng.randrange(300)) + rng.choice([" ", "  ", "\n", "\t\x0b"]) for _ in range(n))
    shared = [prose(rng.randint(words - 2, 3 * words)) for _ in range(5)]
    texts = [None, "", " \n", "same " * (words - 1), "same " * (3 * words), "  lead " + shared[0]]
    for _ in range(50):
        parts = [rng.choice([prose(rng.randint(1, 60)), rng.choice(shared), " ".join(rng.choice(shared).split()[rng.randint(0, 9):])]) for _ in range(rng.randint(1, 4))]
        texts.append(" ".join(parts))
    texts += [texts[-1], "tail " + prose(20_000) + shared[1]]
    docs = spark.createDataFrame([(i if i else None, t, "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, runs string, lo int")
    got = remove_repeated_words(docs, words=words, carry=True).collect()
    want = brute_words(texts, words)
    assert {r.doc_id or 0: (r.kept, r.n_removed) for r in got} == dict(enumerate(want)) and any(n for _, n in want)
    assert all(r.extra.runs == "r" for r in got)
    assert remove_repeated_words(docs.limit(0)).collect() == []


def test_words_are_hashed_and_sampled_by_one_python_worker(spark, monkeypatch):
    from callweave.llm import passage_dedup

    plans, write = {}, passage_dedup.stored

    def stored(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(passage_dedup, "stored", stored)
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, "a " + text)], "doc_id long, text string")
    assert [r.n_removed for r in passage_dedup.remove_repeated_words(docs, words=50).collect()] == [80, 80]
    assert plans["sample"].count("MapInArrow") == 1
