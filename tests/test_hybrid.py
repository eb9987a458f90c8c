"""Fused retrieval: every leg takes part, and a missing leg is no loss."""

from callweave.operators import graph, search
from callweave.plans import retrieve


def test_three_legs_and_missing_ones(spark):
    edges = spark.createDataFrame(
        [(t, "HAS_DRIVER", d) for t, d in (("c1", "refund"), ("c2", "refund"), ("c2", "delay"), ("c3", "delay"))]
        + [(t, "IN_DOMAIN", "Flight") for t in ("c1", "c2", "c3", "c4")], "transcript_id string, edge string, target string")
    calls = spark.createDataFrame(
        [("c1", "lost bag and refund", [1.0, 0.0]), ("c2", None, [0.9, 0.1]), ("c3", "late plane", None), ("c4", "bag", [0.0, 1.0])],
        "transcript_id string, text string, vector array<double>")
    questions = spark.createDataFrame(
        [("all", "refund bag", [1.0, 0.0]), ("words", "plane", None), ("vector", None, [0.0, 2.0]), ("graph", None, None)],
        "query_id string, text string, vector array<double>")
    wanted = graph.question_table(
        spark.createDataFrame([("all", "refund"), ("graph", "delay")], "query_id string, driver string"),
        spark.createDataFrame([], "query_id string, domain string"))
    got = {}
    for r in retrieve.hybrid_retrieve(questions, calls, graph.adjacency_of_edges(edges), wanted, k=3, depth=2).collect():
        got.setdefault(r.query_id, {})[r.transcript_id] = (r.rank, r.keyword_rank, r.vector_rank, r.graph_rank, r.score)
    assert got["all"]["c1"] == (1, 1, 1, got["all"]["c1"][3], got["all"]["c1"][4]) and got["all"]["c1"][3] in (1, 2)
    assert got["all"]["c2"][1] is None and got["all"]["c2"][2] == 2 and got["all"]["c2"][3] in (1, 2)
    assert got["all"]["c4"][1:4] == (2, None, None)
    assert {q: {t: x[1:4] for t, x in rows.items()} for q, rows in got.items() if q in ("words", "vector")} == {
        "words": {"c3": (1, None, None)}, "vector": {"c4": (None, 1, None), "c2": (None, 2, None)}}
    assert set(got["graph"]) == {"c2", "c3"} and all(x[1:3] == (None, None) for x in got["graph"].values())
    for rows in got.values():
        for _, *ranks, score in rows.values():
            assert abs(score - sum(1 / (60 + r) for r in ranks if r)) < 1e-11


def test_index_counts_words_where_texts_lie(spark, monkeypatch):
    texts = [(f"d{i % 7}", "lost bag, lost plane" if i % 3 else "Bag refund late") for i in range(40)]
    docs = spark.createDataFrame(texts + [(None, "bag bag"), (None, "plane bag"), ("e", None), ("f", ""), ("g", "nothing here")], "doc_id string, text string")
    queries = spark.createDataFrame([("a", "lost bag"), ("b", "refund plane"), ("c", None)], "query_id string, text string")
    plans, write = [], search.materialize

    def watched(df, label="state", *rest):
        if label == "index":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label, *rest)

    def run(**limits):
        for name, value in limits.items():
            monkeypatch.setattr(search, name, value)
        return sorted((r.query_id, r["rank"], r.doc_id or "", round(r.score, 9)) for r in search.bm25_topk(docs, queries, 6).collect())

    monkeypatch.setattr(search, "materialize", watched)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        here = run()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in plans[0] and plans[0].count("Generate") == 1  # words of texts without an id only are rows of their own
    joined = run(INDEX_TERMS=0)
    assert "MapInArrow" not in plans[1]
    at = lambda rows, ids: [r for r in rows if r[2] in ids]
    assert {r[2] for r in here} and [r[:2] for r in here] == [r[:2] for r in joined]
    assert at(here, ("", "e", "f", "g")) == at(joined, ("", "e", "f", "g"))


def test_index_equals_the_joined_one(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, " ".join(w for k, w in enumerate(("lost", "bag", "late", "plane", "refund", "bag")) if i >> k & 1)) for i in range(64)]
        + [(3, "lost bag"), (None, "bag bag"), (None, "plane")], "doc_id long, text string")
    queries = spark.createDataFrame([("a", "lost bag"), ("b", "refund plane")], "query_id string, text string")
    run = lambda: sorted((r.query_id, r["rank"], r.doc_id or -1, round(r.score, 9)) for r in search.bm25_topk(docs, queries, 8).collect())
    here = run()
    monkeypatch.setattr(search, "INDEX_TERMS", 0)
    assert here == run() and len(here) == 16
