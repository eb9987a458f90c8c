"""Call graph: nodes, edges, adjacency rows, masks and driver overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import bounded_broadcast

#: Edge names and the node type each one points to.
EDGE_TARGETS = {"IN_DOMAIN": "Domain", "HAS_REASON": "CallReason", "HAS_DRIVER": "InteractionDriver"}


def graph_records(calls: DataFrame) -> DataFrame:
    """``(transcript_id, domain, reason, drivers[])`` of nested calls; the reason is the intent."""
    drivers = F.transform(
        F.filter(
            F.coalesce(F.col("metadata.predefined_interaction_drivers"), F.array()),
            lambda d: d["driver"].isNotNull(),
        ),
        lambda d: d["driver"],
    )
    return calls.select(
        "transcript_id",
        F.coalesce("domain", F.lit("Unknown")).alias("domain"),
        F.coalesce("intent", F.lit("Unknown")).alias("reason"),
        drivers.alias("drivers"),
    )


def adjacency(records: DataFrame) -> DataFrame:
    """One row per call with its distinct neighbours, from nested records."""
    return adjacency_of_edges(record_links(records))


def adjacency_of_edges(edges: DataFrame) -> DataFrame:
    """Adjacency rows ``(transcript_id, domains, reasons, drivers)`` from edge rows, repeats allowed.

    One aggregation drops repeats map-side and builds the lists, so a list holds graph labels, whose number the taxonomy
    bounds, however often a call or driver occurs.
    """
    linked = edges.groupBy("transcript_id").agg(F.array_sort(F.collect_set(F.struct("edge", "target"))).alias("links"))
    pick = lambda edge: F.transform(
        F.filter("links", lambda x: x["edge"] == edge), lambda x: x["target"]
    )
    return linked.select(
        "transcript_id", pick("IN_DOMAIN").alias("domains"), pick("HAS_REASON").alias("reasons"),
        pick("HAS_DRIVER").alias("drivers"))


def record_links(records: DataFrame) -> DataFrame:
    """Edges of nested records, repeats included, from one scan of them."""
    link = lambda edge, value: F.struct(F.lit(edge).alias("edge"), value.alias("target"))
    return records.select(
        "transcript_id",
        F.inline(
            F.concat(
                F.array(link("IN_DOMAIN", F.col("domain")), link("HAS_REASON", F.col("reason"))),
                F.transform("drivers", lambda d: link("HAS_DRIVER", d)),
            )
        ),
    )


def record_edges(records: DataFrame) -> DataFrame:
    """Distinct edges of nested records."""
    return record_links(records).distinct()


def table_links(calls: DataFrame, hits: DataFrame) -> DataFrame:
    """Edges of a calls table and its exploded driver hits, repeats included."""
    heads = calls.select(
        "transcript_id",
        F.inline(
            F.array(
                F.struct(F.lit("IN_DOMAIN").alias("edge"), F.coalesce("domain", F.lit("Unknown")).alias("target")),
                F.struct(F.lit("HAS_REASON").alias("edge"), F.coalesce("intent", F.lit("Unknown")).alias("target")),
            )
        ),
    )
    drivers = hits.filter(F.col("driver").isNotNull()).select(
        "transcript_id", F.lit("HAS_DRIVER").alias("edge"), F.col("driver").alias("target")
    )
    return heads.unionByName(drivers)


def table_edges(calls: DataFrame, hits: DataFrame) -> DataFrame:
    """Distinct edges of a calls table and its exploded driver hits."""
    return table_links(calls, hits).distinct()


def target_type(edge="edge"):
    kind = F.lit(None).cast("string")
    for name, target in EDGE_TARGETS.items():
        kind = F.when(F.col(edge) == name, F.lit(target)).otherwise(kind)
    return kind


def nodes_of_edges(edges: DataFrame) -> DataFrame:
    """Distinct ``(type, id)`` nodes; both ends come from one pass over the edges."""
    return edges.select(
        F.inline(
            F.array(
                F.struct(F.lit("Transcript").alias("type"), F.col("transcript_id").alias("id")),
                F.struct(target_type().alias("type"), F.col("target").alias("id")),
            )
        )
    ).distinct()


def key_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (the uniqueness constraints of the graph)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert increment: incoming rows whose key is not stored yet, once each."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


# --- question side ---------------------------------------------------------------


def split_labels(labels: DataFrame, taxonomy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ``(query_id, label)`` split into domain labels and content labels."""
    distinct = labels.select("query_id", "label").distinct()
    domains = bounded_broadcast(taxonomy.filter("kind = 'domain'").select("label").distinct())
    return distinct.join(domains, "label", "left_semi"), distinct.join(domains, "label", "left_anti")


def normalize_drivers(content: DataFrame) -> DataFrame:
    """Content labels as driver names: as written, and with blanks as underscores."""
    return content.select(
        "query_id",
        F.explode(F.array("label", F.replace("label", F.lit(" "), F.lit("_")))).alias("driver"),
    ).distinct()


def domain_mask(domains: DataFrame) -> DataFrame:
    """``telecom_domain`` becomes the domain name ``Telecom``."""
    return domains.select(
        "query_id", F.initcap(F.split("label", "_")[0]).alias("domain")
    ).distinct()


def question_table(drivers: DataFrame, mask: DataFrame) -> DataFrame:
    """``(query_id, driver, allowed_domains)``; null allows every domain."""
    allowed = mask.groupBy("query_id").agg(F.array_sort(F.collect_set("domain")).alias("allowed_domains"))
    return drivers.join(allowed, "query_id", "left")


def driver_overlap(adjacency_rows: DataFrame, questions: DataFrame, pruned: DataFrame | None = None) -> DataFrame:
    """Candidates ``(query_id, transcript_id, overlap, neighbours[])``.

    The domain mask is applied on the scanned row before anything is shuffled, and each
    candidate carries its own neighbours, so the call table is scanned exactly once.
    ``pruned`` holds ``(query_id, transcript_id)`` allow-lists; a question without any
    keeps all its candidates.
    """
    keyed = lambda edge, column: F.transform(
        column, lambda v: F.concat(F.lit(EDGE_TARGETS[edge] + ":"), v)
    )
    neighbours = F.concat(
        keyed("IN_DOMAIN", F.col("domains")),
        keyed("HAS_REASON", F.col("reasons")),
        keyed("HAS_DRIVER", F.col("drivers")),
    )
    rows = adjacency_rows.select(
        "transcript_id", "domains", neighbours.alias("neighbours"), F.explode_outer("drivers").alias("driver")
    )
    hits = rows.join(bounded_broadcast(questions), "driver").filter(
        F.col("allowed_domains").isNull() | F.arrays_overlap("allowed_domains", "domains")
    )
    found = hits.groupBy("query_id", "transcript_id").agg(
        F.count("*").alias("overlap"), F.first("neighbours").alias("neighbours")
    )
    if pruned is None:
        return found
    listed = pruned.select("query_id").distinct().withColumn("has_list", F.lit(True))
    keep = pruned.select("query_id", "transcript_id").distinct().withColumn("listed", F.lit(True))
    return (
        found.join(keep, ["query_id", "transcript_id"], "left")
        .join(bounded_broadcast(listed), "query_id", "left")
        .filter(F.col("has_list").isNull() | F.col("listed"))
        .drop("has_list", "listed")
    )


def neighbours_of(target: str):
    """Names of one target type among a candidate's neighbours."""
    prefix = f"{target}:"
    mine = F.filter("neighbours", lambda n: n.startswith(prefix))
    return F.transform(mine, lambda n: n.substr(F.lit(len(prefix) + 1), F.length(n)))


def seeds(candidates: DataFrame) -> DataFrame:
    """All candidates at their question's highest overlap."""
    best = candidates.groupBy("query_id").agg(F.max("overlap").alias("overlap"))
    return candidates.join(best, ["query_id", "overlap"], "left_semi")


def candidate_edges(candidates: DataFrame) -> DataFrame:
    """Edges of each question's candidate subgraph."""
    split = F.split("neighbour", ":", 2)
    return candidates.select("query_id", "transcript_id", F.explode("neighbours").alias("neighbour")).select(
        "query_id", "transcript_id", split[0].alias("target_type"), split[1].alias("target_name")
    )


def subgraph_stats(candidates: DataFrame) -> DataFrame:
    """Candidates, nodes and edges per question.

    Targets are made distinct map-side first, so no task sees a question whole.
    """
    calls = candidates.groupBy("query_id").agg(
        F.count("*").alias("retrieved_count"), F.sum(F.size("neighbours")).cast("long").alias("edges")
    )
    targets = (
        candidates.select("query_id", F.explode("neighbours").alias("n")).distinct()
        .groupBy("query_id").agg(F.count("*").alias("targets"))
    )
    return calls.join(targets, "query_id").select(
        "query_id", "retrieved_count", (F.col("retrieved_count") + F.col("targets")).alias("nodes"), "edges"
    )
