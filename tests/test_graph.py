"""Graph, masks and personalized PageRank against plain references."""

import numpy as np
import pytest

from callweave.operators import graph, ppr
from callweave.plans import retrieve


def call_rows(rng, n):
    return [
        (str(i), ["Retail", "Hotel", "Telecom"][rng.integers(3)], f"reason{rng.integers(4)}",
         [f"d{j}" for j in rng.choice(6, size=rng.integers(0, 5), replace=False)])
        for i in range(n)
    ]


def adjacency_of(spark, rows):
    records = spark.createDataFrame(rows, "transcript_id string, domain string, reason string, drivers array<string>")
    return graph.adjacency(records)


def power_iteration(calls, seeds, alpha=0.85, tol=1e-6, max_iter=100):
    """Scores over the undirected call-label graph of ``{call: [labels]}``."""
    nodes = list(calls) + sorted({l for labels in calls.values() for l in labels})
    at = {node: i for i, node in enumerate(nodes)}
    adj = np.zeros((len(nodes), len(nodes)))
    for call, labels in calls.items():
        for label in labels:
            adj[at[call], at[label]] = adj[at[label], at[call]] = 1
    step = adj / adj.sum(axis=1, keepdims=True)
    restart = np.zeros(len(nodes))
    restart[[at[s] for s in seeds]] = 1 / len(seeds)
    x = np.full(len(nodes), 1 / len(nodes))
    for _ in range(max_iter):
        last, x = x, alpha * (x @ step) + (1 - alpha) * restart
        if np.abs(x - last).sum() < len(nodes) * tol:
            break
    return {c: x[at[c]] for c in calls}


@pytest.fixture(scope="module")
def sample(spark):
    rows = call_rows(np.random.default_rng(3), 120)
    questions = spark.createDataFrame(
        [("q1", "d0", None), ("q1", "d1", None), ("q2", "d2", ["Hotel"]), ("q3", "unknown", None), ("q4", "d3", ["Retail", "Telecom"])],
        "query_id string, driver string, allowed_domains array<string>")
    return rows, questions, graph.driver_overlap(adjacency_of(spark, rows), questions)


def test_overlap_respects_masks(sample):
    rows, _, candidates = sample
    found = {(r.query_id, r.transcript_id): r.overlap for r in candidates.collect()}
    want = {}
    for tid, domain, _, drivers in rows:
        for query, wanted, allowed in (("q1", {"d0", "d1"}, None), ("q2", {"d2"}, ["Hotel"]), ("q4", {"d3"}, ["Retail", "Telecom"])):
            n = len(wanted & set(drivers))
            if n and (allowed is None or domain in allowed):
                want[query, tid] = n
    assert found == want


@pytest.mark.parametrize("method,tol", [("labels", 1e-6), ("joins", 1e-3)])
def test_ppr_equals_power_iteration(sample, method, tol):
    rows, _, candidates = sample
    labels = {r[0]: [f"D:{r[1]}", f"R:{r[2]}"] + [f"I:{d}" for d in r[3]] for r in rows}
    picked = candidates.collect()
    scores = {(r.query_id, r.transcript_id): r.ppr_score for r in ppr.ppr_scores(candidates, method=method, tol=tol).collect()}
    assert len(scores) == len(picked)
    for query in {r.query_id for r in picked}:
        mine = [r for r in picked if r.query_id == query]
        best = max(r.overlap for r in mine)
        want = power_iteration({r.transcript_id: labels[r.transcript_id] for r in mine},
                               [r.transcript_id for r in mine if r.overlap == best], tol=tol)
        for tid, value in want.items():
            assert scores[query, tid] == pytest.approx(value, abs=1e-12)


def test_candidate_list_applies_only_where_given(spark, sample):
    rows, questions, candidates = sample
    allowed = [r.transcript_id for r in candidates.filter("query_id = 'q1'").limit(3).collect()]
    pruned = spark.createDataFrame([("q1", t) for t in allowed], "query_id string, transcript_id string")
    out = graph.driver_overlap(adjacency_of(spark, rows), questions, pruned).collect()
    assert {r.transcript_id for r in out if r.query_id == "q1"} == set(allowed)
    assert sum(r.query_id == "q2" for r in out) == candidates.filter("query_id = 'q2'").count()


def test_edges_of_calls_without_drivers(spark):
    records = spark.createDataFrame(
        [("a", "Unknown", "Refund", []), ("b", "Hotel", "Unknown", ["x", "x"])],
        "transcript_id string, domain string, reason string, drivers array<string>")
    edges = {tuple(r) for r in graph.record_edges(records).collect()}
    assert edges == {("a", "IN_DOMAIN", "Unknown"), ("a", "HAS_REASON", "Refund"), ("b", "IN_DOMAIN", "Hotel"),
                     ("b", "HAS_REASON", "Unknown"), ("b", "HAS_DRIVER", "x")}


def test_label_helpers(spark):
    labels = spark.createDataFrame(
        [("q", "telecom_domain"), ("q", "refund request"), ("q", "refund request")], "query_id string, label string")
    taxonomy = spark.createDataFrame([("telecom_domain", "domain"), ("refund_request", "content")], "label string, kind string")
    domains, content = graph.split_labels(labels, taxonomy)
    assert [r.domain for r in graph.domain_mask(domains).collect()] == ["Telecom"]
    assert {r.driver for r in graph.normalize_drivers(content).collect()} == {"refund request", "refund_request"}


def test_retrieval_returns_counts_and_attributes(spark, sample):
    rows, questions, candidates = sample
    out = retrieve.graph_retrieve(adjacency_of(spark, rows), questions, k=5).collect()
    by_id = {r[0]: r for r in rows}
    sizes = {r["query_id"]: r["count"] for r in candidates.groupBy("query_id").count().collect()}
    assert {r.query_id for r in out} == set(sizes)
    for r in out:
        assert r.retrieved_count == sizes[r.query_id]
        assert (r.domain, r.call_intent) == by_id[r.transcript_id][1:3]
        assert sorted(r.drivers) == sorted(by_id[r.transcript_id][3])
