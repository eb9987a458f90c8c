import random
import re

import xxhash

from callweave.llm.simhash_dedup import near_components


def brute(rows, shingle=3, bits=2):
    prints = []
    for _, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", text)
        parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            first[g] = min(first.get(g, doc_id), doc_id)
    return [(d, f"{p:016x}", first.get(g)) for (d, _), p, g in zip(rows, prints, group)]


def as_set(rows):
    return sorted(map(repr, rows))


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split(" ")
            words[rng.randrange(len(words))] = rng.choice(["Zeta", "ärger", "x\x1fy"])
        else:
            words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        out.append(" ".join(words))
    return out


def test_against_brute_force_at_several_cell_sizes(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts(1, 160))] + [(7, None), (None, "null id"), (8, ""), (9, " \n"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as print", "2 as component")
    want = as_set(brute(rows))
    for cell in (1 << 16, 16, 2):
        got = near_components(docs, cell=cell).collect()
        assert as_set(map(tuple, got)) == want, cell


def test_empty_table(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
