import random

import numpy as np

from callweave.llm import near_dedup
from callweave.llm.simhash_dedup import rotated_links, rotated_pairs


def roots(n, links):
    up = list(range(n))
    for i, j in links:
        a, b = up[i], up[j]
        up = [min(a, b) if x in (a, b) else x for x in up]
    return up


def test_rotations_meet_every_pair_of_the_budget(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for p in prints[:100]:  # all differing bits anywhere, up to the budget and one beyond it
        prints.append(p ^ sum(1 << b for b in rng.sample(range(64), rng.choice([4, 14, 15, 16]))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    place = {p: i for i, p in enumerate(signed)}
    docs = spark.createDataFrame([(p,) for p in signed], "print long")
    near = [(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 15]
    for cell in (1 << 16, 20):
        found = [(place[r.src], place[r.dst]) for r in rotated_links(docs, 15, 4, cell).collect()]
        assert all((prints[i] ^ prints[j]).bit_count() <= 15 for i, j in found)
        assert roots(len(prints), found) == roots(len(prints), near)


def test_fingerprints_propose_the_pairs(spark, monkeypatch):
    """With fingerprints as far apart as can be, no near copy is met."""
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1]))], "doc_id long, text string")
    assert near_dedup.near_links(docs).count() == 1
    monkeypatch.setattr(near_dedup, "_prints", apart)
    assert near_dedup.near_links(docs).count() == 0


def apart(batches, size):
    import pyarrow as pa

    for batch in batches:
        prints = np.array([0 if t.as_py().endswith("w299") else -1 for t in batch.column(1)], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["node", "print"])


def test_all_pairs_of_the_budget_but_those_within_a_part(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(120)]
    for p in prints[:100]:
        prints.append(p ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 8, 14, 15, 16]))))
    prints += [p ^ 1 << b for p in prints[:3] for b in range(12)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    part = [rng.choice([None, 1, 2, 3]) for _ in prints]
    rows = spark.createDataFrame(list(zip(signed, part)), "print long, part long")
    want = sorted((min(signed[i], signed[j]), max(signed[i], signed[j])) for j in range(len(prints)) for i in range(j)
                  if (prints[i] ^ prints[j]).bit_count() <= 15 and (part[i] is None or part[i] != part[j]))
    for cell in (1 << 16, 20):
        assert sorted((r.src, r.dst) for r in rotated_pairs(rows, 15, 4, cell).collect()) == want
