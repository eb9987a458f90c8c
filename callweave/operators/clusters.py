"""Two-level cluster tables: centroids, catalog, members, representatives, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions import vectors as vx
from ..session import materialize
from .joins import bounded_broadcast, top_k
from .mmr import mmr

# Cluster numbers, representative picks and view weights.
N_L2, N_L1 = 200, 20
REPRESENTATIVES, REPRESENTATIVE_LAMBDA = 20, 0.6
CENTROID_WEIGHT, NAME_WEIGHT, DESCRIPTION_WEIGHT = 1.0, 0.5, 0.5
NO_DESCRIPTION = "General grouping"
REPRESENTATIVE_SEPARATOR = "\n---\n"


def centroids(members: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vector and size per cluster."""
    return members.groupBy(*keys).agg(vx.mean_vector("vector").alias("centroid"), F.count("*").alias("size"))


def multiview(clusters: DataFrame) -> DataFrame:
    """Centroid, name and description vectors as one unit vector; the centroid alone without labels."""
    mixed = vx.weighted_sum([
        (CENTROID_WEIGHT, F.col("centroid")), (NAME_WEIGHT, F.col("name_vector")),
        (DESCRIPTION_WEIGHT, F.col("description_vector")),
    ])
    return clusters.withColumn("embedding", vx.unit(F.coalesce(mixed, F.col("centroid"))))


def representatives(members: DataFrame, keys: list[str], k: int = REPRESENTATIVES) -> DataFrame:
    """MMR picks per cluster against its centroid."""
    means = bounded_broadcast(centroids(members, keys).select(*keys, "centroid"))
    scored = members.join(means, keys).withColumn("relevance", vx.cosine(vx.as_vector("vector"), F.col("centroid")))
    return mmr(scored.select(*keys, "pos", vx.as_vector("vector").alias("vector"), "relevance"),
               keys, k, REPRESENTATIVE_LAMBDA)


def prompt_text(picks: DataFrame, texts: DataFrame, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """Representatives' texts in pick order; a cluster has at most the picked number of them."""
    rows = bounded_broadcast(picks).join(texts, on or ["pos"])
    ordered = F.array_sort(F.collect_list(F.struct("pick", "text")))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), REPRESENTATIVE_SEPARATOR).alias("prompt_text"),
        F.count("*").alias("samples"),
    )


def member_map(members: DataFrame, l2: DataFrame) -> DataFrame:
    """``(field, transcript_id, l2_id, l1_id)``: a member's cluster and its parent."""
    parents = bounded_broadcast(l2.select("field", F.col("id").alias("l2_id"), F.col("parent_id").alias("l1_id")))
    return members.select("field", "l2_id", "transcript_id").join(parents, ["field", "l2_id"])


def catalog(l1: DataFrame, l2: DataFrame) -> DataFrame:
    """L1 and L2 rows of one table; fields of the other level are null."""
    children = l2.groupBy("field", "parent_id").agg(F.count("*").alias("child_count"))
    heads = l1.join(
        children.withColumnRenamed("parent_id", "id"), ["field", "id"], "left"
    ).withColumn("type", F.lit("L1Cluster")).withColumn("child_count", F.coalesce("child_count", F.lit(0)))
    return heads.unionByName(l2.withColumn("type", F.lit("L2Cluster")), allowMissingColumns=True)


def labelled(rows: DataFrame, level: str) -> DataFrame:
    """Ids, and fallback names and descriptions where labelling gave none."""
    return rows.select(
        "*", fx.cluster_id(F.col("field"), level, F.col("number")).alias("id")
    ).withColumn("name", fx.cluster_name(F.col("name"), F.col("field"), level, F.col("number"))).withColumn(
        "description", F.coalesce("description", F.lit(NO_DESCRIPTION))
    )


def doc_index(members: DataFrame) -> DataFrame:
    """Clusters of every transcript per field; sets hold cluster ids only."""
    return members.groupBy("transcript_id", "field").agg(
        F.array_sort(F.collect_set("l1_id")).alias("l1_ids"), F.array_sort(F.collect_set("l2_id")).alias("l2_ids")
    )


def search_text(clusters: DataFrame, query: str, with_field: bool = True) -> DataFrame:
    """L2 clusters whose joined name, description, parent and field contain the query."""
    parts = ["name", "description", "parent_id"] + (["field"] if with_field else [])
    joined = F.lower(F.concat(*[F.coalesce(F.col(p), F.lit("")) for p in parts]))
    return clusters.filter(F.col("type") == "L2Cluster").filter(F.contains(joined, F.lower(F.lit(query))))


def distinguishing_terms(texts: DataFrame, k: int = 3, within: list[str] | None = None) -> DataFrame:
    """Top terms per cluster by class-based tf-idf: ``(cluster, term, score, rank)``, with the columns ``within`` that part the texts.

    Terms are counted per cluster where the texts were read, so a cluster's size shows
    only in the counts.
    """
    part = within or []
    counted = materialize(
        fx.word_rows(texts.select(*part, "cluster", "text"), [*part, "cluster"])
        .groupBy(*part, "cluster", "term").agg(F.count("*").alias("tf")),
        "cluster-terms",
    )
    sizes = counted.groupBy(*part, "cluster").agg(F.sum("tf").alias("words"))
    overall = counted.groupBy(*part, "term").agg(F.sum("tf").alias("everywhere"))
    means = sizes.groupBy(*part).agg(F.avg("words").alias("mean_words"))
    sizes = sizes.join(means, part) if part else sizes.withColumn("mean_words", F.lit(float(means.first()[0] or 0.0)))
    scored = counted.join(overall, [*part, "term"]).join(bounded_broadcast(materialize(sizes, "cluster-sizes")), [*part, "cluster"]).withColumn(
        "score", F.col("tf") / F.col("words") * F.log(1 + F.col("mean_words") / F.col("everywhere"))
    )
    return top_k(scored, [*part, "cluster"], [F.desc(F.round("score", 9)), F.asc("term")], k).select(*part, "cluster", "term", "score", "rank")


def names_from_terms(terms: DataFrame) -> DataFrame:
    """Cluster names out of their few top terms."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return terms.groupBy("cluster").agg(F.array_join(F.transform(ordered, lambda s: s["term"]), " ").alias("name"))
