import random

from callweave.llm.near_dedup import keep_one


def sets(text, size=5):
    words = text.lower().split()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b)


def edited(rng, text, least):
    """A copy with as many changed words as ``least`` allows."""
    words, near = text.split(), text
    while True:
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10 ** 6)}"
        if jaccard(text, " ".join(words)) < least:
            return near
        near = " ".join(words)


def test_the_stage_of_the_pipeline_finds_pairs_down_to_the_similarity(spark):
    import corpus_pipeline

    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(200)]
    near = [edited(rng, t, (0.8, 0.85, 0.9, 0.95)[i % 4]) for i, t in enumerate(texts)]
    far = [edited(rng, t, 0.7) for t in texts]
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(texts, near)) and all(jaccard(a, b) < 0.8 for a, b in zip(texts, far))
    docs = lambda copies: spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs(near), "").collect()}
    assert set(range(200)) <= kept and len(kept) <= 202
    assert corpus_pipeline.dedup_near(spark, docs(far), "").count() == 400


def test_odd_rows(spark):
    rows = [(None, "a b"), (3, "A  b"), (4, None), (5, " \n"), (6, "a b c"), (6, "a b c"), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, node int")
    assert sorted(map(str, (r.doc_id for r in keep_one(docs).collect()))) == ["3", "4", "6", "None"]
    assert keep_one(docs.limit(0)).collect() == []


def test_counts_tell_only_pairs_that_are_not_similar():
    import numpy as np

    from callweave.llm import near_dedup

    rng = random.Random(3)
    base = [[f"w{rng.randrange(9000)}" for _ in range(n)] for n in (0, 3, 40, 300, 300, 30_000)]
    texts = [" ".join(words[:max(0, len(words) - cut)]).encode() for words in base for cut in (0, 1, 6, 30)]
    sets = [near_dedup.shingles(t, 5) for t in texts]
    rows = near_dedup.pa.RecordBatch.from_arrays([near_dedup.pa.array(range(len(texts))), near_dedup.pa.array(texts)], ["node", "text"])
    counts = [c for b in near_dedup._counted([rows], 5, near_dedup._prints) for c in b.column(2).to_pylist()]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    assert all(near_dedup.most(counts[i], counts[j]) >= near_dedup.jaccard(sets[i], sets[j]) for i, j in pairs)
    assert [len(np.frombuffer(c, np.uint8)) for c in counts[-4:]] == [4 * near_dedup.PLACES] * 4
    assert near_dedup.most(counts[12], counts[16]) < 0.8 <= near_dedup.most(counts[12], counts[13])


def test_texts_of_pairs_that_cannot_be_similar_are_not_joined(spark, monkeypatch):
    from callweave.llm import near_dedup

    tables, write = {}, near_dedup.stored

    def stored(df, label):
        tables[label] = (out := write(df, label)).count()
        return out

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    monkeypatch.setattr(near_dedup, "stored", stored)
    monkeypatch.setattr(near_dedup, "_prints", alike)
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + " end"])), "doc_id long, text string")
    assert near_dedup.near_links(docs).count() == tables["pairs"] == 1
    assert tables["texts"] == 2


def alike(batches, size):
    import pyarrow as pa

    for batch in batches:  # every text has the same fingerprint
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1] * batch.num_rows, pa.int64())], ["node", "print"])


def test_every_pair_that_fingerprints_meet_is_decided(spark, monkeypatch):
    """Pairs behind links of texts that are not similar, and pairs between the least and the greatest text of one fingerprint."""
    from callweave.llm import near_dedup

    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + [t + " end" for t in texts])), "doc_id long, text string")
    for prints in (alike, crowded):
        monkeypatch.setattr(near_dedup, "_prints", prints)
        assert sorted(r.doc_id for r in keep_one(docs).collect()) == list(range(20))


def crowded(batches, size):
    import pyarrow as pa

    for batch in batches:  # seven fingerprints, of which any two differ in two bits
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1 << n % 7 for n in batch.column(0).to_pylist()], pa.int64())], ["node", "print"])
