"""Fill-in-middle against brute force: skip lists, cuts, forms, restored texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm.fill_in_middle import SkipList, Units, fill_in_middle, restore

SCHEMA = "doc_id long, text string, n long, form string, output string, h1 long, extra string"


def test_skip_list_reaches_every_rank():
    rng = random.Random(1)
    for size in (0, 1, 2, 5, 64, 999, 5000):
        units = np.array([rng.randint(1, 5) for _ in range(size)], np.int64)
        chars = np.array([rng.randint(1, 9) for _ in range(size)], np.int64)
        lanes = SkipList(units, chars)
        ends = np.concatenate(([0], np.cumsum(units)))
        offsets = np.concatenate(([0], np.cumsum(chars)))
        assert len(lanes.lanes) <= 2 + np.log2(size + 2)
        for rank in {0, 1, int(ends[-1])} | {rng.randint(0, int(ends[-1])) for _ in range(200)}:
            k = int(np.searchsorted(ends, rank, "right")) - 1
            assert lanes.reach(rank) == (ends[k], offsets[k])


@pytest.mark.parametrize("unit", [None, r"\S+", r"(?s).", r"\b"])
@pytest.mark.parametrize("run", [1, 3, 64])
def test_unit_offsets(unit, run):
    rng, pattern = random.Random(2), re.compile(unit) if unit else None
    for _ in range(150):
        text = "".join(rng.choice(["a", "bc ", " ", "é", "😀", "\n"]) for _ in range(rng.randint(0, 60)))
        starts = [m.start() for m in pattern.finditer(text) if m.group()] if pattern else list(range(len(text)))
        units = Units(text, pattern, run)
        assert units.n == len(starts)
        want = [0, *starts[1:], len(text)] if starts else [0]
        assert [units.offset(k) for k in range(units.n + 1)] == want


def brute(doc_id, text, seed, unit, plain, spm):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    starts = [m.start() for m in re.finditer(unit, text)] if unit else list(range(len(text)))
    n = len(starts)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return doc_id, n, "plain", None, None, text
    ends = [0, *starts[1:], len(text)]
    a, b = (ends[k] for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", [None, r"\S+"])
def test_cuts_and_round_trip(spark, unit):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["word ", "é", "😀", "\n", "<", "S>", "<P", ">", "x"]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(None, None), (None, "no id"), (5, "same id"), (5, "same id"), (400, ""), (401, "a<S>b"), (402, "é\n" * 200_000), (403, " \n"), (-7, "minus")]
    docs = spark.createDataFrame([(d, t, 1, "f", "o", 2, "e") for d, t in rows], SCHEMA)
    got = fill_in_middle(docs, seed=9, unit=unit, plain_percent=20, spm_percent=50, carry=True)
    got = got.withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    want = Counter(brute(d, t, 9, unit, 20, 50) for d, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert Counter((r.doc_id, r.back) for r in got) == Counter((d, t or "") for d, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r.extra.extra == "e" and r.extra.n == 1 for r in got)
    assert fill_in_middle(docs.limit(0)).collect() == []


def test_marks_that_overlap_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("<P>", "<S>", ""), ("aba", "x", "y"), ("<P>", "><", "y"), ("ab", "abc", "y")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, marks=marks)
