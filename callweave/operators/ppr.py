"""Personalized PageRank of calls in the candidate subgraph of every question at once.

The subgraph is bipartite: calls on one side, labels (domain, reason, drivers) on the
other, and labels are few.  Two steps of the power iteration, call -> label -> call,
collapse into one step between labels whose weights are per-call sums::

    W[a, b] = sum over calls with labels a and b of 1 / degree(call)

One aggregation over the candidates builds W; the up to 100 iterations then run on the
label matrix of each question, never on the calls.  A second pass measures the exact
change of the call scores for the few iterations at which the stop rule could fire, and
a third computes the scores of that iteration.  When W of some question is too large
for one task, the same recurrence runs as joins over all the executors.

Start vector, damping and stop rule (summed absolute change below ``N * tol``) are those
of the usual power iteration for personalized PageRank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import bounded_broadcast, top_k

#: Weight-matrix entries of one question that a single task may hold.
LABEL_MATRIX_LIMIT = 4_000_000
#: Copies of the label scores over which a hot label's calls are spread.
LABEL_SALTS = 64


def _prepared(candidates: DataFrame) -> DataFrame:
    """Candidates with degree, seed mass and the sizes of their question's subgraph."""
    by_overlap = candidates.groupBy("query_id", "overlap").agg(F.count("*").alias("n"))
    totals = by_overlap.groupBy("query_id").agg(
        F.max("overlap").alias("best"),
        F.max_by("n", "overlap").alias("n_seeds"),
        F.sum("n").alias("n_calls"),
    )
    return candidates.join(bounded_broadcast(totals), "query_id").select(
        "query_id",
        "transcript_id",
        "overlap",
        "neighbours",
        "n_calls",
        (1.0 / F.size("neighbours")).alias("share"),
        F.when(F.col("overlap") == F.col("best"), 1.0 / F.col("n_seeds")).otherwise(0.0).alias("restart"),
    )


def _label_weights(calls: DataFrame) -> DataFrame:
    """Upper triangle of W; diagonal entries also carry the label's degree and seed mass."""
    first = calls.select(
        "query_id", "n_calls", "share", "restart", "neighbours",
        F.posexplode("neighbours").alias("at", "a"),
    )
    pairs = first.select(
        "query_id", "n_calls", "share", "restart", "a",
        F.explode(F.slice("neighbours", F.col("at") + 1, F.size("neighbours"))).alias("b"),
    )
    return pairs.groupBy("query_id", "a", "b").agg(
        F.sum("share").alias("weight"),
        F.count("*").alias("degree"),
        F.sum(F.col("restart") * F.col("share")).alias("seed_mass"),
        F.first("n_calls").alias("n_calls"),
    )


def _label_solver(alpha: float, max_iter: int, tol: float):
    def solve(key, pdf):
        import numpy as np
        import pandas as pd

        diagonal = pdf[pdf["a"] == pdf["b"]]
        labels = diagonal["a"].to_numpy()
        place = {label: i for i, label in enumerate(labels)}
        rows = pdf["a"].map(place).to_numpy()
        cols = pdf["b"].map(place).to_numpy()
        weight = pdf["weight"].to_numpy()
        off = rows != cols
        rows, cols, weight = (
            np.concatenate([rows, cols[off]]), np.concatenate([cols, rows[off]]),
            np.concatenate([weight, weight[off]]),
        )
        degree = diagonal["degree"].to_numpy(dtype=float)
        seed_mass = diagonal["seed_mass"].to_numpy()
        size = len(labels)
        n = size + int(pdf["n_calls"].iloc[0])

        scores = [np.full(size, 1.0 / n), alpha / n * diagonal["weight"].to_numpy()]
        label_change, low, high = [0.0, np.abs(scores[1] - scores[0]).sum()], None, None
        for k in range(2, max_iter + 1):
            mixed = np.bincount(rows, weights=weight * (scores[k - 2] / degree)[cols], minlength=size)
            scores.append(alpha * (1 - alpha) * seed_mass + alpha * alpha * mixed)
            label_change.append(np.abs(scores[k] - scores[k - 1]).sum())
            step = scores[k - 1] - scores[k - 2]
            if low is None and label_change[k] + alpha * abs(step.sum()) < n * tol:
                low = k
            if label_change[k] + alpha * np.abs(step).sum() < n * tol:
                high = k
                break
        high = high or max_iter
        low = min(low or high, high)
        window = range(low, high + 1)
        share = [score / degree for score in scores]
        return pd.DataFrame({
            "query_id": [key[0]] * size,
            "label": labels,
            "n": [n] * size,
            "first_k": [low] * size,
            "label_change": [[float(label_change[k]) for k in window]] * size,
            "share": [[float(share[k - 1][i]) for k in window] for i in range(size)],
            "step": [[float(share[k - 1][i] - share[k - 2][i]) for k in window] for i in range(size)],
        })

    return solve


def _solved(weights: DataFrame, calls: DataFrame, alpha: float, max_iter: int, tol: float) -> DataFrame:
    """Label shares ``(query_id, label, share)`` at the iteration where each question stops."""
    id_type = weights.schema["query_id"].dataType.simpleString()
    history = materialize(
        weights.groupBy("query_id").applyInPandas(
            _label_solver(alpha, max_iter, tol),
            f"query_id {id_type}, label string, n long, first_k int, label_change array<double>, "
            "share array<double>, step array<double>",
        ),
        "ppr-labels",
    )
    open_ended = history.filter(F.size("share") > 1)
    change = (
        calls.select("query_id", "transcript_id", F.explode("neighbours").alias("label"))
        .join(bounded_broadcast(open_ended), ["query_id", "label"])
        .select("query_id", "transcript_id", F.posexplode("step").alias("at", "step"))
        .groupBy("query_id", "transcript_id", "at").agg(F.sum("step").alias("step"))
        .groupBy("query_id", "at").agg((alpha * F.sum(F.abs("step"))).alias("call_change"))
    )
    labels = open_ended.groupBy("query_id").agg(
        F.first("n").alias("n"), F.first("label_change").alias("label_change")
    )
    stops = (
        change.join(labels, "query_id")
        .filter(F.col("call_change") + F.get("label_change", F.col("at")) < F.col("n") * tol)
        .groupBy("query_id").agg(F.min("at").alias("stop"))
    )
    last = F.size("share") - 1
    return history.join(stops, "query_id", "left").select(
        "query_id", "label", F.get("share", F.coalesce("stop", last)).alias("share")
    )


def _iterated(calls: DataFrame, alpha: float, max_iter: int, tol: float) -> DataFrame:
    """The same label shares by joins, for label matrices beyond one task.

    State is the label table of the last two iterations.  Label rows are repeated over
    salts so that the calls of a hot label spread evenly.
    """
    edges = calls.select(
        "query_id", "transcript_id", "share", "restart", "n_calls",
        F.explode("neighbours").alias("label"),
        F.pmod(F.xxhash64("transcript_id"), F.lit(LABEL_SALTS)).alias("salt"),
    )
    labels = edges.groupBy("query_id", "label").agg(
        F.count("*").alias("degree"), F.sum("share").alias("weight"), F.first("n_calls").alias("n_calls")
    )
    counts = labels.groupBy("query_id").agg((F.count("*") + F.first("n_calls")).alias("n"))
    state = materialize(
        labels.join(counts, "query_id").select(
            "query_id", "label", "degree", "n",
            (1.0 / F.col("n")).alias("before"),
            (alpha / F.col("n") * F.col("weight")).alias("now"),
            F.lit(False).alias("done"),
        ),
        "ppr-state",
    )
    for _ in range(2, max_iter + 1):
        # "before" and "now" are the label scores of iterations k-2 and k-1.
        spread = state.filter("not done").select(
            "query_id", "label", (F.col("before") / F.col("degree")).alias("h2"),
            (F.col("now") / F.col("degree")).alias("h1"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LABEL_SALTS - 1).cast("long"))).alias("salt"),
        )
        scored = (
            edges.join(spread, ["query_id", "label", "salt"])
            .groupBy("query_id", "transcript_id").agg(
                F.first("share").alias("share"), F.first("restart").alias("restart"),
                F.sum("h2").alias("s2"), F.sum("h1").alias("s1"), F.collect_set("label").alias("labels"),
            )
        )
        change = scored.groupBy("query_id").agg(
            (alpha * F.sum(F.abs(F.col("s1") - F.col("s2")))).alias("call_change")
        )
        arrived = (
            scored.select("query_id", F.explode("labels").alias("label"),
                          (((1 - alpha) * F.col("restart") + alpha * F.col("s2")) * F.col("share")).alias("flow"))
            .groupBy("query_id", "label").agg((alpha * F.sum("flow")).alias("next"))
        )
        moved = materialize(
            state.join(arrived, ["query_id", "label"], "left").select("*"), "ppr-step"
        )
        decided = (
            moved.filter("not done").groupBy("query_id").agg(
                F.sum(F.abs(F.col("next") - F.col("now"))).alias("label_change"), F.first("n").alias("n")
            )
            .join(change, "query_id")
            .select("query_id", (F.col("call_change") + F.col("label_change") < F.col("n") * tol).alias("stop"))
        )
        # A stopped question keeps "now", the label scores from which its call scores follow.
        state = materialize(
            moved.join(decided, "query_id", "left").select(
                "query_id", "label", "degree", "n",
                F.when(F.col("done") | F.col("stop"), F.col("before")).otherwise(F.col("now")).alias("before"),
                F.when(F.col("done") | F.col("stop"), F.col("now")).otherwise(F.col("next")).alias("now"),
                (F.col("done") | F.coalesce("stop", F.lit(False))).alias("done"),
            ),
            "ppr-state",
        )
        if state.filter("not done").isEmpty():
            break
    # A question that never stopped ran max_iter steps; its call scores follow from "before".
    shown = F.when(F.col("done"), F.col("now")).otherwise(F.col("before"))
    return state.select("query_id", "label", (shown / F.col("degree")).alias("share"))


def stored_candidates(candidates: DataFrame) -> DataFrame:
    return materialize(candidates, "candidates")


def ppr_scores(
    candidates: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6, method: str = "auto",
    stored: bool = False,
) -> DataFrame:
    """``(query_id, transcript_id, overlap, ppr_score)`` for every candidate.

    The candidates are read several times, each time only the columns of that pass;
    unless they are ``stored`` already they are written first.  Summing a call's labels
    happens where the call was read, so a pass moves one small row per call.
    """
    if not stored:
        candidates = stored_candidates(candidates)
    calls = _prepared(candidates.select("query_id", "transcript_id", "overlap", "neighbours"))
    if method == "auto":
        labels = calls.select("query_id", F.explode("neighbours").alias("a")).distinct()
        widest = labels.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
        method = "labels" if widest * (widest + 1) / 2 <= LABEL_MATRIX_LIMIT else "joins"
    if method == "labels":
        shares = _solved(_label_weights(calls), calls, alpha, max_iter, tol)
    else:
        shares = _iterated(calls, alpha, max_iter, tol)
    shares = materialize(shares, "ppr-shares")
    return (
        calls.select(
            "query_id", "transcript_id", "overlap", "restart", F.explode("neighbours").alias("label")
        )
        .join(bounded_broadcast(shares), ["query_id", "label"])
        .groupBy("query_id", "transcript_id")
        .agg(
            F.first("overlap").alias("overlap"),
            ((1 - alpha) * F.first("restart") + alpha * F.sum("share")).alias("ppr_score"),
        )
    )


def ppr_top(scores: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` calls per question; equal scores are ordered by id."""
    rounded = scores.withColumn("ppr_score", F.round("ppr_score", 12))
    return top_k(rounded, ["query_id"], [F.desc("ppr_score"), F.asc("transcript_id")], k)
