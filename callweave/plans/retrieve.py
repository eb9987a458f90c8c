"""Questions to ranked evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions import vectors as vx
from ..operators.graph import driver_overlap, neighbours_of
from ..operators.joins import bounded_broadcast
from ..operators.mmr import mmr
from ..operators.ppr import ppr_scores, ppr_top, stored_candidates
from ..operators.scan import positions, range_blocks
from ..operators.search import bm25_topk, cosine_topk, fuse_legs, pair_bm25, rerank
from ..session import materialize


def split_questions(questions: DataFrame, column: str = "question") -> DataFrame:
    """One row per part of a question; each part depends on the one before it."""
    return (
        questions.withColumn("_parts", fx.sub_questions(F.col(column)))
        .select(*[c for c in questions.columns if c != column], F.posexplode_outer("_parts").alias("_at", "sub_query"))
        .filter("_at is not null")
        .withColumn("hop_id", (F.col("_at") + 1).cast("long"))
        .withColumn("depends_on", F.when(F.col("hop_id") > 1, F.col("hop_id") - 1))
        .drop("_at")
    )


# MMR weight, and picks per level with and without a domain mask.
MMR_LAMBDA = 0.7
PICKS = {"default": (3, 4), "open": (5, 7), "masked": (6, 8)}


def cluster_candidates(queries: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters of every query's field with their cosine to the query.

    Clusters per field are few by construction (20 and 200), and they are joined on the
    field, so the rows grow with the number of queries only.
    """
    side = bounded_broadcast(
        clusters.select("field", F.col("id").alias("cluster_id"), "parent_id", "pos", vx.as_vector("embedding").alias("vector"))
    )
    asked = queries.select("query_id", "field", vx.unit(vx.as_vector("query_vector")).alias("query_vector"))
    return asked.join(side, "field").withColumn("relevance", vx.cosine(F.col("query_vector"), F.col("vector")))


def pick_clusters(
    queries: DataFrame, l1: DataFrame, l2: DataFrame, k_l1: int = 3, k_l2: int = 4,
    min_similarity: float | None = None, per_field: bool = True, limits: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """MMR over L1 clusters, then over the children of each picked one.

    Returns ``(query_id, [field,] l1_id, l1_rank)`` and the picked L2 clusters with score.
    Without ``per_field`` the L1 clusters of all the fields compete.  ``limits`` holds
    smaller numbers of picks ``(query_id, n_l1, n_l2)`` for some questions; greedy picks
    of a smaller number are the first of a larger one.
    """
    capped = lambda rows, column, limit: rows if limits is None else rows.join(
        bounded_broadcast(limits.select("query_id", limit)), "query_id", "left"
    ).filter(F.col(limit).isNull() | (F.col(column) <= F.col(limit))).drop(limit)
    keys = ["query_id", "field"] if per_field else ["query_id"]
    queries = materialize(queries.select("query_id", "field", "query_vector"), "questions")
    heads = materialize(
        cluster_candidates(queries, l1.withColumn("parent_id", F.lit(None).cast("string"))), "l1-candidates"
    )
    picked = capped(
        mmr(heads.select(*keys, "pos", "vector", "relevance"), keys, k_l1, MMR_LAMBDA, low_ties=False), "pick", "n_l1")
    chosen_l1 = materialize(
        picked.join(heads.drop("vector", "query_vector", "relevance"), [*keys, "pos"]).select(
            "query_id", "field", F.col("cluster_id").alias("l1_id"), F.col("pick").alias("l1_rank")), "picked-l1")
    children = cluster_candidates(queries, l2).join(
        bounded_broadcast(chosen_l1.withColumnRenamed("l1_id", "parent_id")), ["query_id", "field", "parent_id"]
    )
    if min_similarity is not None:
        children = children.filter(F.col("relevance") >= min_similarity)
    children = materialize(children, "l2-candidates")
    inner = ["query_id", "parent_id"]
    found = capped(
        mmr(children.select(*inner, "pos", "vector", "relevance"), inner, k_l2, MMR_LAMBDA, low_ties=False), "pick", "n_l2")
    chosen_l2 = found.join(children.drop("vector", "query_vector", "relevance"), [*inner, "pos"]).select(
        "query_id", "field", F.col("cluster_id").alias("l2_id"), F.col("parent_id").alias("l1_id"),
        "l1_rank", F.col("pick").alias("l2_rank"), F.col("relevance").alias("score"))
    return chosen_l1, materialize(chosen_l2, "picked-l2")


def cluster_documents(chosen_l2: DataFrame, members: DataFrame) -> DataFrame:
    """Members of the picked clusters, each once per query at its first place.

    The place ``(l1_rank, l2_rank, position)`` orders a query's documents; it is the
    smallest one, found map-side, so no query's documents meet in one task.
    """
    rows = members.select("field", "l2_id", "transcript_id", "position").join(
        bounded_broadcast(chosen_l2.select("query_id", "field", "l2_id", "l1_rank", "l2_rank")), ["field", "l2_id"]
    )
    place = F.min(F.struct("l1_rank", "l2_rank", "position"))
    return rows.groupBy("query_id", "transcript_id").agg(place.alias("place")).select(
        "query_id", "transcript_id", "place.l1_rank", "place.l2_rank", "place.position"
    )


def document_ranks(documents: DataFrame) -> DataFrame:
    """1-based place of every document in its query's order, for candidate sets of any size."""
    order = ["query_id", "l1_rank", "l2_rank", "position", "transcript_id"]
    return positions(range_blocks(documents, order), ["query_id"], [F.col(c) for c in order[1:]], name="doc_rank")


def prune_by_clusters(
    queries: DataFrame, masked: DataFrame, l1: DataFrame, l2: DataFrame, members: DataFrame, fields: list[str]
) -> DataFrame:
    """Allow-list ``(query_id, transcript_id)`` from the clusters nearest to each question.

    Questions with a domain mask look into more clusters than open ones.
    """
    spread = queries.withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))
    with_mask = masked.select("query_id").distinct()
    (open_l1, open_l2), (most_l1, most_l2) = PICKS["open"], PICKS["masked"]
    limits = materialize(
        queries.select("query_id").join(with_mask, "query_id", "left_anti").select(
            "query_id", F.lit(open_l1).alias("n_l1"), F.lit(open_l2).alias("n_l2")), "limits")
    _, chosen = pick_clusters(spread, l1, l2, most_l1, most_l2, per_field=False, limits=limits)
    return cluster_documents(chosen, members).select("query_id", "transcript_id")


def graph_retrieve(adjacency: DataFrame, questions: DataFrame, pruned: DataFrame | None = None, k: int = 20) -> DataFrame:
    """Ranked calls of a table of questions.

    Overlap under both masks, PageRank of the candidates, the first ``k`` calls per
    question.  Candidates carry their neighbours, so the ranked calls' attributes need no
    second look at the call table; the number of candidates is a column of every row.
    """
    candidates = stored_candidates(driver_overlap(adjacency, questions, pruned))
    counts = bounded_broadcast(candidates.groupBy("query_id").agg(F.count("*").alias("retrieved_count")))
    ranked = materialize(ppr_top(ppr_scores(candidates, stored=True), k).drop("overlap"), "ranked")
    return candidates.join(ranked, ["query_id", "transcript_id"]).join(counts, "query_id").select(
        "query_id", "rank", "transcript_id", F.round("ppr_score", 6).alias("ppr_score"),
        F.get(neighbours_of("Domain"), F.lit(0)).alias("domain"),
        F.get(neighbours_of("CallReason"), F.lit(0)).alias("call_intent"),
        neighbours_of("InteractionDriver").alias("drivers"),
        F.col("overlap").alias("driver_overlap"), "retrieved_count",
    )


def hybrid_retrieve(
    questions: DataFrame, calls: DataFrame, adjacency: DataFrame, wanted: DataFrame, pruned: DataFrame | None = None, k: int = 10,
    depth: int = 20
) -> DataFrame:
    """Calls by the fused ranks of three legs: words, vectors and the graph.

    ``questions`` are ``(query_id, text, vector)`` and ``calls`` ``(transcript_id, text, vector)``; ``adjacency``, ``wanted`` and
    ``pruned`` are those of ``graph_retrieve``.  Every leg ranks ``depth`` calls.  A question or call without text, vector or
    drivers takes no part in that leg and keeps the others; its rank there is null.
    """
    docs = calls.withColumnRenamed("transcript_id", "item_id")
    words = bm25_topk(
        docs.select(F.col("item_id").alias("doc_id"), "text").filter("text IS NOT NULL"),
        questions.select("query_id", "text").filter("text IS NOT NULL"), depth).withColumnRenamed("doc_id", "item_id")
    near = cosine_topk(docs.select("item_id", "vector"), questions.select("query_id", "vector"), depth)
    walked = graph_retrieve(adjacency, wanted, pruned, depth).withColumnRenamed("transcript_id", "item_id")
    return fuse_legs({"keyword": words, "vector": near, "graph": walked}, k).withColumnRenamed("item_id", "transcript_id")


def rerank_by_text(retrieved: DataFrame, utterances: DataFrame, queries: DataFrame, final_k: int = 10) -> DataFrame:
    """Second-stage order of retrieved calls by the text they share with the question.

    Calls without any text are dropped first.
    """
    pairs = materialize(retrieved.select("query_id", F.col("transcript_id").alias("doc_id"), "rank"), "retrieved")
    spoken = utterances.select(F.col("transcript_id").alias("doc_id"), F.col("utterance").alias("text")).filter("text <> ''")
    heard = spoken.join(bounded_broadcast(pairs.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id").distinct()
    scored = pair_bm25(pairs.join(heard, "doc_id", "left_semi"), spoken, queries)
    best = rerank(scored.withColumn("preview", F.lit("text")), final_k)
    return best.select("query_id", F.col("doc_id").alias("transcript_id"), "score", "final_rank")


def hop_union(hops: DataFrame) -> DataFrame:
    """Distinct calls and drivers over the hops of a request; both come from top-k lists."""
    return hops.groupBy("request_id").agg(
        F.array_sort(F.collect_set("transcript_id")).alias("transcript_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("drivers")))).alias("query_drivers"),
        F.countDistinct("hop_id").alias("hops"),
    )


def answer_context(retrieved: DataFrame, questions: DataFrame, columns: list[str]) -> DataFrame:
    """Prompt text per question: its ranked rows as JSON, then the question."""
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.struct(*columns).alias("row")))), lambda s: s["row"]
    )
    found = retrieved.groupBy("query_id").agg(F.to_json(rows).alias("evidence"))
    return questions.join(found, "query_id", "left").select(
        "query_id", F.concat(F.coalesce("evidence", F.lit("[]")), F.lit("\nQuestion: "), "text").alias("prompt")
    )


def hop_transcript(hops: DataFrame) -> DataFrame:
    """``Q1/A1 ... Qn/An`` of a request's hops in their order."""
    hop = F.col("hop_id").cast("string")
    entry = F.concat(F.lit("\nQ"), hop, F.lit(": "), "sub_query", F.lit("\nA"), hop, F.lit(": "), "answer", F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("hop_id", entry.alias("entry"))))
    return hops.groupBy("request_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["entry"]), "").alias("steps")
    )
