"""MMR, Ward clustering, vector and keyword search against brute force."""

import math
import os
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from callweave.operators import search, ward
from callweave.operators.mmr import mmr
from callweave.plans import retrieve


def greedy(vectors, relevance, k, lam, low_ties):
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-12)
    sims = unit @ unit.T
    picked = [int(np.argmax(np.round(relevance, 12)))]
    while len(picked) < min(k, len(vectors)):
        best = None
        for i in range(len(vectors)):
            if i in picked:
                continue
            score = round(lam * relevance[i] - (1 - lam) * max(sims[i, j] for j in picked), 11)
            key = (score, -i if low_ties else i)
            if best is None or key > best[0]:
                best = (key, i)
        picked.append(best[1])
    return picked


@pytest.mark.parametrize("pool", [2, 5, 512])
@pytest.mark.parametrize("low_ties", [True, False])
def test_mmr_equals_greedy(spark, pool, low_ties):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for group, n in (("a", 40), ("b", 7), ("c", 1)):
        vectors = rng.normal(size=(n, 6))
        if n > 20:
            vectors[10:20] = vectors[0:10]  # exact copies make ties
        centre = vectors.mean(axis=0)
        relevance = vectors @ centre / np.linalg.norm(vectors, axis=1) / np.linalg.norm(centre)
        want[group] = greedy(vectors, np.round(relevance, 12), 8, 0.6, low_ties)
        rows += [(group, i, [float(x) for x in v], float(r)) for i, (v, r) in enumerate(zip(vectors, relevance))]
    items = spark.createDataFrame(rows, "grp string, pos long, vector array<double>, relevance double")
    out = mmr(items, ["grp"], 8, 0.6, low_ties, pool).collect()
    for group, picks in want.items():
        assert [r.pos for r in sorted((r for r in out if r.grp == group), key=lambda r: r.pick)] == picks


def brute_ward(points, k):
    clusters = [[i] for i in range(len(points))]
    while len(clusters) > k:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                x, y = points[clusters[a]], points[clusters[b]]
                cost = len(x) * len(y) / (len(x) + len(y)) * ((x.mean(0) - y.mean(0)) ** 2).sum()
                if best is None or cost < best[0]:
                    best = (cost, a, b)
        _, a, b = best
        clusters[a] += clusters.pop(b)
    return {frozenset(c) for c in clusters}


def vector_rows(spark, points):
    return spark.createDataFrame([("f", i, [float(x) for x in p]) for i, p in enumerate(points)],
                                 "field string, item_id long, vector array<double>")


def parts(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.label, set()).add(r.item_id)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("local,block", [(2000, 4000), (9, 7), (2, 4000)])
def test_ward_is_exact_at_every_size(spark, local, block):
    rng = np.random.default_rng(5)
    points, other = rng.normal(size=(40, 3)), rng.normal(size=(13, 3))
    rows = vector_rows(spark, points).unionByName(vector_rows(spark, other).replace("f", "g", "field"))
    found = ward.cluster_vectors(rows, 6, local, block).collect()
    assert parts(r for r in found if r.field == "f") == brute_ward(points, 6)
    assert parts(r for r in found if r.field == "g") == brute_ward(other, 6)
    first = {}
    for r in sorted(found, key=lambda r: r.item_id):
        first.setdefault((r.field, r.label), r.item_id)
    assert all(first["f", n] < first["f", n + 1] for n in range(5))


def test_ward_of_few_and_equal_points(spark):
    points = np.array([[0.0, 0.0]] * 5 + [[3.0, 0.0]] * 5)
    for local in (2000, 2):
        assert parts(ward.cluster_vectors(vector_rows(spark, points), 2, local).collect()) == {frozenset(range(5)), frozenset(range(5, 10))}
        assert len(parts(ward.cluster_vectors(vector_rows(spark, points[:3]), 5, local).collect())) == 3


def test_ward_skips_pairs_of_blocks_and_leaves_odd_rows_out(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 4)) * 50
    points = np.concatenate([c + rng.normal(size=(25, 4)) for c in centres])
    report = []
    found = ward.cluster_vectors(vector_rows(spark, points), 12, local=30, block=25, report=report).collect()
    assert parts(found) == {frozenset(range(25 * i, 25 * i + 25)) for i in range(12)}
    assert parts(found) == parts(ward.cluster_vectors(vector_rows(spark, points), 12).collect())
    # Clusters that search, times all: most of these pairs lie in balls too far apart.
    assert report[0]["asking"] == 300 and report[0]["compared"] < 300 * 300 / 3
    assert sum(r["compared"] for r in report) < sum(r["clusters"] ** 2 for r in report) / 3
    odd = spark.createDataFrame([("f", 900, None), ("f", 901, [1.0, None, 0.0, 0.0]), ("f", 902, [float("nan")] * 4), ("f", 903, [float("inf")] * 4), ("f", 904, [])],
                                "field string, item_id long, vector array<double>")
    for local in (2000, 30):
        again = ward.cluster_vectors(vector_rows(spark, points).unionByName(odd), 12, local, 25).collect()
        assert parts(again) == parts(found)
    assert ward.cluster_vectors(odd, 3).collect() == []
    with pytest.raises(ValueError):
        ward.cluster_vectors(vector_rows(spark, [[1.0], [1.0, 2.0]]), 1)


def test_rows_without_a_vector_are_not_searched(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0])], "item_id long, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "query_id long, vector array<double>")
    assert [(r.query_id, r.item_id) for r in search.cosine_topk(items, queries).collect()] == [(7, 1)]


def test_cosine_topk_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(8)
    items, queries = rng.normal(size=(50, 4)), rng.normal(size=(6, 4))
    items[3] = 0
    monkeypatch.setattr(search, "BLOCK_ROWS", 7)
    monkeypatch.setattr(search, "PAGE_QUERIES", 2)
    frame = lambda rows, name: spark.createDataFrame(
        [(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{name} long, vector array<double>")
    out = search.cosine_topk(frame(items, "item_id"), frame(queries, "query_id"), 4, 0.1).collect()
    norms = np.where(np.linalg.norm(items, axis=1) == 0, 1, np.linalg.norm(items, axis=1))
    sims = np.round((items / norms[:, None]) @ (queries / np.linalg.norm(queries, axis=1)[:, None]).T, 12)
    for q in range(6):
        want = sorted((-sims[i, q], i) for i in range(50) if sims[i, q] >= 0.1)[:4]
        assert [r.item_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in want]


def test_bm25_by_hand(spark):
    texts = {1: "red apple red", 2: "green apple", 3: "blue sky over red hills", 4: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    queries = spark.createDataFrame([(9, "Red APPLE!")], "query_id long, text string")
    out = {r.doc_id: r.score for r in search.bm25_topk(docs, queries).collect()}
    words = {d: t.split() for d, t in texts.items()}
    mean = sum(map(len, words.values())) / 4
    want = {}
    for d, w in words.items():
        counts = Counter(w)
        for term in ("red", "apple"):
            df = sum(term in x for x in words.values())
            tf = counts[term]
            if tf:
                want[d] = want.get(d, 0) + math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
    assert out == pytest.approx(want)


def test_rerank_drops_empty_text_and_keeps_order_without_scores(spark):
    rows = spark.createDataFrame([(1, 1, "x", 0.1), (1, 2, "", 0.9), (1, 3, "y", 0.5)], "query_id int, rank int, preview string, score double")
    assert [r["rank"] for r in search.rerank(rows, 2).orderBy("final_rank").collect()] == [3, 1]
    assert [r["rank"] for r in search.rerank(rows, 1, score=None).collect()] == [1]


def test_fewer_picks_for_some_questions(spark):
    rng = np.random.default_rng(4)
    unit = lambda: [float(x) for x in rng.normal(size=5)]
    l1 = spark.createDataFrame([("f", f"A{i}", i, unit()) for i in range(6)], "field string, id string, pos long, embedding array<double>")
    l2 = spark.createDataFrame([("f", f"B{i}", f"A{i % 6}", i, unit()) for i in range(30)],
                               "field string, id string, parent_id string, pos long, embedding array<double>")
    queries = spark.createDataFrame([("open", "f", unit()), ("masked", "f", unit())], "query_id string, field string, query_vector array<double>")
    limits = spark.createDataFrame([("open", 2, 3)], "query_id string, n_l1 int, n_l2 int")
    heads, kids = retrieve.pick_clusters(queries, l1, l2, 4, 5, limits=limits)
    alone, _ = retrieve.pick_clusters(queries, l1, l2, 2, 3)
    of = lambda df, q: {r.l1_id for r in df.collect() if r.query_id == q}
    assert of(heads, "open") == of(alone, "open") and len(of(heads, "masked")) == 4
    assert kids.filter("query_id = 'open'").count() == 6


def test_ward_searches_many_blocks_in_one_task(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(60, 5)) + np.repeat([0.0, 40.0, 0.5], 20)[:, None]
    rows = pd.DataFrame({"field": "f", "block": np.repeat([1, 2, 3], 20), "point": np.arange(60), "vector": list(vectors),
                         "weight": rng.integers(1, 5, 60).astype(float), "height": np.inf})
    weight = rows["weight"].to_numpy()
    costs = ward._costs(vectors, weight, vectors, weight)
    asked = rows[:20]
    found = ward._nearest_in_group(asked, rows[20:].sample(frac=1, random_state=1))
    assert (found["height"].to_numpy() == costs[:20, 20:].min(axis=1)).all()
    assert (found["nearest"].to_numpy() == 20 + costs[:20, 20:].argmin(axis=1)).all()
    known = asked.assign(height=costs[:20, 40:].min(axis=1))
    assert set(ward._nearest_in_group(known, rows[20:])["compared"]) == {20}  # the far block is skipped
    assert ward._nearest_in_group(asked, rows[:20])["height"].eq(np.inf).all()  # its own block was searched before


def test_ward_in_groups_of_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ward, "GROUP", 30)
    points = np.random.default_rng(6).normal(size=(90, 3))
    assert parts(ward.cluster_vectors(vector_rows(spark, points), 6, 40, 8).collect()) == brute_ward(points, 6)


def test_ward_compares_no_rows_of_one_name():
    rng = np.random.default_rng(13)
    vectors, weight = rng.normal(size=(30, 4)), rng.integers(1, 5, 30).astype(float)
    for names in (np.repeat(np.arange(15), 2), np.repeat([f"c{i:02d}" for i in range(10)], 3).astype(object)):
        costs = np.where(names[:, None] == names[None, :], np.inf, ward._costs(vectors, weight, vectors, weight))
        height, place = ward._best((vectors, weight, names), (vectors, weight, names))
        assert (height == costs.min(axis=1)).all() and (place == costs.argmin(axis=1)).all()
        alone = (vectors[:2], weight[:2], names[:2])  # a block of one name holds nothing nearer
        assert np.isinf(ward._best(alone, alone)[0]).all()


def test_ward_rounds_leave_no_tables_of_clusters(spark, monkeypatch):
    """A round copies no vectors for its search and deletes what the one before has left."""
    tables, write = [], ward.materialize

    def materialize(df, label="state"):
        tables.append((label, write(df, label)))
        return tables[-1][1]

    monkeypatch.setattr(ward, "materialize", materialize)
    points = np.random.default_rng(12).normal(size=(60, 3))
    found = ward.cluster_vectors(vector_rows(spark, points), 5, 20, 10)
    left = [label for label, df in tables if "vector" in df.columns and os.path.exists(df.inputFiles()[0].removeprefix("file://"))]
    assert left == ["points"] and sum(label == "points" for label, _ in tables) > 3  # that after the last round
    assert parts(found.collect()) == brute_ward(points, 5)


def test_keyword_blocks_are_bounded_by_term_counts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + int(x))}" for x in rng.integers(0, 9, 12))) for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w{chr(97 + i)} w{chr(98 + i)} zz") for i in range(6)], "query_id long, text string")
    run = lambda: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in search.bm25_topk(docs, queries, 5).collect())
    whole = run()
    monkeypatch.setattr(search, "BLOCK_CELLS", 25)
    monkeypatch.setattr(search, "PAGE_QUERIES", 2)
    assert run() == whole and len(whole) == 30


def test_text_vectors_bring_texts_together_once(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (2, "c d"), (3, None), (None, "d d"), (None, "e")], "item_id long, text string")
    found = search.text_vectors(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("Aggregate") == 1
    tf = {1: {"a": 1, "b": 2}, 2: {"a": 1, "c": 2, "d": 1}}
    df = {"a": 2, "b": 1, "c": 1, "d": 2}
    want = {i: {t: n * np.log(7 / (df[t] + 1)) for t, n in terms.items()} for i, terms in tf.items()}
    got = {(r.item_id, r.term): r.weight for r in found.collect()}
    assert got.keys() == {(i, t) for i in want for t in want[i]}
    assert all(abs(got[i, t] - want[i][t] / np.sqrt(sum(x * x for x in want[i].values()))) < 1e-12 for i, t in got)
