"""Report tables behind the charts, keyed by question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import bounded_broadcast


def clusters_hit(members: DataFrame, retrieved: DataFrame) -> DataFrame:
    """L2 clusters with at least one retrieved member: ``(query_id, field, l2_id)``."""
    return (
        members.join(bounded_broadcast(retrieved.select("query_id", "transcript_id").distinct()), "transcript_id")
        .select("query_id", "field", "l2_id").distinct()
    )


def driver_call_counts(hits: DataFrame, retrieved: DataFrame, drivers: DataFrame) -> DataFrame:
    """Retrieved calls per requested driver; a call counts once per driver."""
    return (
        _requested(hits, retrieved, drivers).select("query_id", "driver", "transcript_id").distinct()
        .groupBy("query_id", "driver").agg(F.count("*").alias("calls"))
    )


def driver_frequency(hits: DataFrame, retrieved: DataFrame, drivers: DataFrame) -> DataFrame:
    """Occurrences per requested driver in the retrieved calls, 0 for drivers without any."""
    found = (
        _requested(hits, retrieved, drivers).groupBy("query_id", "driver", "transcript_id").agg(F.count("*").alias("n"))
        .groupBy("query_id", "driver").agg(F.sum("n").alias("total"), F.count("*").alias("calls"))
    )
    wanted = drivers.select("query_id", "driver").distinct()
    return wanted.join(found, ["query_id", "driver"], "left").select(
        "query_id", "driver", F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        F.coalesce("calls", F.lit(0)).cast("long").alias("calls"))


def _requested(hits: DataFrame, retrieved: DataFrame, drivers: DataFrame) -> DataFrame:
    """Driver hits of retrieved calls, narrowed to the requested drivers first."""
    wanted = bounded_broadcast(drivers.select("query_id", "driver").distinct())
    ids = bounded_broadcast(retrieved.select("query_id", "transcript_id").distinct())
    return hits.select("transcript_id", "driver").join(wanted, "driver").join(ids, ["query_id", "transcript_id"], "left_semi")


def cluster_breakdown(l2: DataFrame, hit: DataFrame) -> DataFrame:
    """Pie slices of the hit clusters: sizes, shares and angles of parents and children.

    Sizes are those of the whole clusters.  Parents follow each other by id, children by
    their position; there are at most a few hundred rows per question.
    """
    rows = hit.join(bounded_broadcast(l2.select(F.col("id").alias("l2_id"), "parent_id", "pos", "name", "member_count")), "l2_id")
    per_query = Window.partitionBy("query_id")
    per_parent = Window.partitionBy("query_id", "parent_id")
    parent_order = per_query.orderBy("parent_id")
    child_order = per_parent.orderBy("pos")
    size = F.col("member_count")
    grand, parent = F.sum(size).over(per_query), F.sum(size).over(per_parent)
    before_parent = F.coalesce(F.sum(size).over(parent_order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - parent, F.lit(0))
    before_child = F.coalesce(F.sum(size).over(child_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place, children = F.row_number().over(child_order) - 1, F.count("*").over(per_parent)
    return rows.select(
        "query_id", "parent_id", "l2_id", "name", F.col("member_count").alias("size"), parent.alias("parent_size"),
        grand.alias("total"),
        (before_parent / grand * 360).alias("parent_start"), ((before_parent + parent) / grand * 360).alias("parent_end"),
        ((before_parent + before_child) / grand * 360).alias("child_start"),
        ((before_parent + before_child + size) / grand * 360).alias("child_end"),
        F.when(children > 1, 0.4 + 0.3 * place / (children - 1)).otherwise(0.5).alias("alpha"),
    ).filter("total > 0")


def bubble_sizes(l2: DataFrame, hit: DataFrame) -> DataFrame:
    """Bubble radius per hit cluster, and the members of its parent's hit clusters."""
    rows = hit.join(bounded_broadcast(l2.select(F.col("id").alias("l2_id"), "parent_id", "member_count")), "l2_id")
    parents = rows.groupBy("query_id", "parent_id").agg(F.sum("member_count").alias("parent_members"))
    return rows.join(parents, ["query_id", "parent_id"]).select(
        "query_id", "parent_id", "l2_id", F.sqrt("member_count").alias("radius"), "parent_members")


def sentiment_curves(turns: DataFrame, retrieved: DataFrame, top: int = 10) -> DataFrame:
    """Turn scores, from turn 1, of the top retrieved calls."""
    best = bounded_broadcast(retrieved.filter(F.col("rank") <= top).select("query_id", "transcript_id", "rank"))
    return turns.join(best, "transcript_id").select(
        "query_id", "rank", "transcript_id", "turn", F.coalesce("score", F.lit(0.0)).alias("score"))


def sentiment_trend(turns: DataFrame, retrieved: DataFrame, top: int = 10) -> DataFrame:
    """Mean score per turn over the top retrieved calls; ended calls drop out."""
    return sentiment_curves(turns, retrieved, top).groupBy("query_id", "turn").agg(
        F.avg("score").alias("mean_score"), F.count("*").alias("calls"))


def report_tables(
    hits: DataFrame, retrieved: DataFrame, drivers: DataFrame, l2: DataFrame, members: DataFrame
) -> DataFrame:
    """The reports of a set of questions as one table ``(query_id, report, key, value)``.

    Driver reports exist for questions with drivers, cluster reports for questions with
    retrieved calls; the joins see to both.  ``retrieved`` and the other inputs are read
    by several reports and should be stored tables.
    """
    hit = materialize(clusters_hit(members, retrieved).select("query_id", "l2_id"), "clusters-hit")
    long = lambda df, report, key, value: df.select(
        "query_id", F.lit(report).alias("report"), F.col(key).alias("key"), F.col(value).cast("double").alias("value")
    )
    asked = drivers.join(bounded_broadcast(retrieved.select("query_id").distinct()), "query_id", "left_semi")
    return (
        long(driver_call_counts(hits, retrieved, asked), "driver_calls", "driver", "calls")
        .unionByName(long(driver_frequency(hits, retrieved, asked), "driver_frequency", "driver", "total"))
        .unionByName(long(cluster_breakdown(l2, hit), "cluster_end", "l2_id", "child_end"))
        .unionByName(long(bubble_sizes(l2, hit), "bubble_radius", "l2_id", "radius"))
    )
