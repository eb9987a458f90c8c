"""Adapters: the given tables seen as calls, turns, clusters, questions and chats.

Each Spark adapter has an SQL twin registered under the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import text as fx
from callweave.functions import vectors as vx
from callweave.operators import clusters

from .registry import view


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- calls: orders as calls, line brands as interaction drivers --------------------

view("calls_star", """
SELECT cast(o_orderkey AS VARCHAR) AS transcript_id,
       upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS domain,
       o_orderpriority AS intent, o_orderstatus AS outcome
FROM orders JOIN customer ON o_custkey = c_custkey""")
view("driver_hits", """
SELECT cast(l_orderkey AS VARCHAR) AS transcript_id, p_brand AS driver,
       cast(l_linenumber AS BIGINT) AS pair_index, p_type AS keyword
FROM lineitem JOIN part ON l_partkey = p_partkey""")
view("call_edges", """
SELECT transcript_id, 'IN_DOMAIN' AS edge, domain AS target FROM calls_star
UNION SELECT transcript_id, 'HAS_REASON', intent FROM calls_star
UNION SELECT transcript_id, 'HAS_DRIVER', driver FROM driver_hits""")


def calls_star(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("transcript_id"),
        F.initcap("c_mktsegment").alias("domain"),
        F.col("o_orderpriority").alias("intent"),
        F.col("o_orderstatus").alias("outcome"),
    )


def driver_hits(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("transcript_id"),
        F.col("p_brand").alias("driver"),
        F.col("l_linenumber").cast("long").alias("pair_index"),
        F.col("p_type").alias("keyword"),
    )


# --- questions: one per part type, asking for two brands, most with a domain -------

view("question_labels", """
SELECT query_id, label FROM (
  SELECT p_type AS query_id, p_brand AS label,
         row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey DESC) AS top,
         row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS low
  FROM part) WHERE top = 1 OR low = 1
UNION
SELECT t.p_type, lower(s.c_mktsegment) || '_domain'
FROM (SELECT p_type, row_number() OVER (ORDER BY p_type) AS n FROM (SELECT DISTINCT p_type FROM part)) t
JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS n
      FROM (SELECT DISTINCT c_mktsegment FROM customer)) s USING (n)""")
view("star_taxonomy", """
SELECT DISTINCT lower(c_mktsegment) || '_domain' AS label, 'domain' AS kind FROM customer
UNION SELECT DISTINCT p_brand, 'content' FROM part""")


def question_labels(spark, sf):
    part = table(spark, sf, "part").select("p_type", "p_brand", "p_retailprice", "p_partkey")
    order = F.struct("p_retailprice", "p_partkey")
    brands = (
        part.groupBy("p_type")
        .agg(F.max_by("p_brand", order).alias("a"), F.min_by("p_brand", order).alias("b"))
        .select(F.col("p_type").alias("query_id"), F.explode(F.array("a", "b")).alias("label"))
    )
    numbered = lambda df, c: df.select(c).distinct().agg(F.array_sort(F.collect_set(c)).alias("v")).select(
        F.posexplode("v").alias("n", c)
    )
    types = numbered(part, "p_type")
    segments = numbered(table(spark, sf, "customer"), "c_mktsegment")
    domains = types.join(segments, "n").select(
        F.col("p_type").alias("query_id"), F.concat(F.lower("c_mktsegment"), F.lit("_domain")).alias("label")
    )
    return brands.unionByName(domains).distinct()


def star_taxonomy(spark, sf):
    segments = table(spark, sf, "customer").select(
        F.concat(F.lower("c_mktsegment"), F.lit("_domain")).alias("label"), F.lit("domain").alias("kind")
    )
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("label"), F.lit("content").alias("kind"))
    return segments.distinct().unionByName(brands.distinct())


view("question_drivers", """
SELECT DISTINCT query_id, unnest([label, replace(label, ' ', '_')]) AS driver
FROM question_labels WHERE label NOT IN (SELECT label FROM star_taxonomy WHERE kind = 'domain')""")
view("question_domains", """
SELECT DISTINCT query_id, upper(substr(split_part(label, '_', 1), 1, 1)) || lower(substr(split_part(label, '_', 1), 2)) AS domain
FROM question_labels WHERE label IN (SELECT label FROM star_taxonomy WHERE kind = 'domain')""")
view("unmasked_candidates", """
SELECT q.query_id, e.transcript_id, count(*) AS overlap
FROM call_edges e JOIN question_drivers q ON e.edge = 'HAS_DRIVER' AND e.target = q.driver
LEFT JOIN (SELECT DISTINCT query_id FROM question_domains) m ON m.query_id = q.query_id
LEFT JOIN (SELECT DISTINCT d.query_id, x.transcript_id FROM question_domains d JOIN call_edges x ON x.edge = 'IN_DOMAIN' AND x.target = d.domain) a
  ON a.query_id = q.query_id AND a.transcript_id = e.transcript_id
WHERE m.query_id IS NULL OR a.transcript_id IS NOT NULL
GROUP BY 1, 2""")


# --- calls: conversations as nested call documents ---------------------------------

# A conversation of any length is one call: one id, one set of attributes, one document, so ``part`` is always 0.
view("turns_conv", """
SELECT cast(conv_id AS VARCHAR) AS transcript_id, turn AS utterance_idx,
       CASE role WHEN 'assistant' THEN 'Agent' WHEN 'user' THEN 'Customer' ELSE 'System' END AS speaker,
       text AS utterance, (length(text) % 200 - 100) / 100.0::DOUBLE AS score, 0 AS part
FROM conversations""")
view("spoken", "SELECT transcript_id, utterance_idx, speaker, utterance FROM turns_conv WHERE speaker <> 'System'")
view("conv_calls", r"""
SELECT transcript_id, part,
       CASE WHEN count(*) FILTER (speaker = 'System') > 0 THEN NULL ELSE 'Retail' END AS domain,
       arg_max(speaker, utterance_idx) AS intent,
       arg_min(utterance, utterance_idx) FILTER (speaker = 'Customer') AS reason_for_call,
       arg_min(utterance, utterance_idx) FILTER (speaker = 'Agent') AS call_summary,
       arg_max(utterance, utterance_idx) FILTER (speaker = 'Agent') AS outcome
FROM turns_conv GROUP BY 1, 2""")
view("conv_drivers", r"""
SELECT transcript_id, part, utterance_idx, speaker AS driver, utterance AS definition, score,
       lower(regexp_extract(utterance, '\p{L}+')) AS keyword
FROM turns_conv WHERE speaker <> 'System'""")


def turns_conv(spark, sf):
    speaker = F.when(F.col("role") == "assistant", "Agent").when(F.col("role") == "user", "Customer").otherwise("System")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("transcript_id"),
        F.col("turn").alias("utterance_idx"),
        speaker.alias("speaker"),
        F.col("text").alias("utterance"),
        ((F.length("text") % 200 - 100) / 100.0).alias("score"),
        F.lit(0).alias("part"),
    )


def calls_conv(spark, sf):
    """Nested calls, each with all its utterances."""
    said = turns_conv(spark, sf)
    agent, customer = F.col("speaker") == "Agent", F.col("speaker") == "Customer"
    idx = F.col("utterance_idx")
    spoken_part = F.col("speaker") != "System"
    ordered = lambda item: F.transform(
        F.array_sort(F.collect_list(F.struct("utterance_idx", item.alias("item")))), lambda s: s["item"]
    )
    turn = F.struct(
        F.array(F.struct("speaker", "utterance")).alias("conversation"),
        F.struct("score", F.when(F.col("score") < 0, "negative").otherwise("positive").alias("label")).alias("sentiment"),
    )
    predefined = F.when(spoken_part, F.struct(F.col("speaker").alias("driver"), idx.alias("dialogue_pair_index"),
                                              F.col("score").alias("sentiment")))
    identified = F.when(spoken_part, F.struct(
        F.lower(F.regexp_extract("utterance", r"(\p{L}+)", 1)).alias("keyword"),
        F.col("utterance").alias("definition"), idx.alias("dialogue_pair_index"), F.col("score").alias("sentiment")))
    present = lambda c: F.filter(c, lambda x: x.isNotNull())
    nested = said.groupBy("transcript_id", "part").agg(
        F.when(F.max((~spoken_part).cast("int")) > 0, F.lit(None)).otherwise(F.lit("Retail")).alias("domain"),
        F.max_by("speaker", idx).alias("intent"),
        F.min_by(F.when(customer, F.col("utterance")), F.when(customer, idx)).alias("reason_for_call"),
        F.min_by(F.when(agent, F.col("utterance")), F.when(agent, idx)).alias("call_summary"),
        F.max_by(F.when(agent, F.col("utterance")), F.when(agent, idx)).alias("outcome"),
        ordered(turn).alias("turns"),
        present(ordered(predefined)).alias("predefined_interaction_drivers"),
        present(ordered(identified)).alias("identified_interaction_drivers"),
    )
    completed = F.struct(
        F.lit("Filled").alias("domain"), F.col("intent"), F.col("call_summary").alias("reason_for_the_call")
    )
    return nested.select(
        "transcript_id", "part", "domain", "intent", "reason_for_call", "turns",
        F.struct(
            completed.alias("completed_fields"), "call_summary", "outcome",
            "predefined_interaction_drivers", "identified_interaction_drivers",
            F.lit(None).cast("array<struct<dialogue_pair_index:bigint,intents:array<string>>>").alias("dialogue_pair_intents"),
        ).alias("metadata"),
    )


# --- clusters: labelled vectors as a two-level hierarchy over two fields -----------

view("vec_members", """
SELECT 'keywords' AS field, vec_id, label AS l1, label * 4 + vec_id % 4 AS l2, vec_id AS pos, embedding::DOUBLE[] AS v FROM embeddings
UNION ALL
SELECT 'reason_for_call', vec_id, label, label * 3 + vec_id % 3, vec_id, embedding::DOUBLE[] FROM embeddings""")
view("l2_centroids", """
SELECT field, l1, l2, list(x ORDER BY i) AS centroid FROM (
  SELECT field, l1, l2, i, avg(x) AS x FROM (
    SELECT field, l1, l2, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM vec_members) GROUP BY ALL)
GROUP BY 1, 2, 3""")
view("l2_clusters_vec", """
SELECT field, field || '_L2_' || l2 AS id, field || '_L1_' || l1 AS parent_id,
       cast(l2 + CASE field WHEN 'keywords' THEN 0 ELSE 100000 END AS BIGINT) AS pos, l2 AS number,
       list_transform(centroid, lambda x: x / sqrt(list_dot_product(centroid, centroid))) AS vec FROM l2_centroids""")
view("l1_clusters_vec", """
SELECT field, id, pos, child_count, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS vec FROM (
  SELECT field, parent_id AS id, cast(min(pos) AS BIGINT) AS pos, any_value(c) AS child_count, list(x ORDER BY i) AS m
  FROM (SELECT field, parent_id, i, avg(x) AS x, min(pos) AS pos, count(*) AS c FROM (
        SELECT field, parent_id, pos, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS i FROM l2_clusters_vec)
      GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
view("call_members", """
SELECT m.field, m.field || '_L2_' || m.l2 AS l2_id, m.field || '_L1_' || m.l1 AS l1_id,
       cast(o.o_orderkey AS VARCHAR) AS transcript_id, o.o_orderkey AS position
FROM orders o JOIN vec_members m ON m.vec_id = o.o_orderkey % (SELECT count(*) FROM embeddings)""")
view("label_vectors", """
SELECT label AS query_id, list(x ORDER BY i) AS query_vector FROM (
  SELECT label, i, avg(x) AS x FROM (
    SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2)
GROUP BY 1""")
view("question_vectors", """
SELECT t.p_type AS query_id, query_vector FROM (
  SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS n FROM (SELECT DISTINCT p_type FROM part)) t
JOIN label_vectors l ON l.query_id = t.n""")


def vec_members(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("l1"), F.col("vec_id").alias("pos"),
        F.col("embedding").cast("array<double>").alias("vector"))
    fields = F.explode(F.array(
        F.struct(F.lit("keywords").alias("field"), (F.col("l1") * 4 + F.col("vec_id") % 4).alias("l2")),
        F.struct(F.lit("reason_for_call").alias("field"), (F.col("l1") * 3 + F.col("vec_id") % 3).alias("l2"))))
    return rows.select("*", fields.alias("f")).select("f.field", "vec_id", "l1", "f.l2", "pos", "vector")


def l2_clusters_vec(spark, sf):
    means = clusters.centroids(vec_members(spark, sf), ["field", "l1", "l2"])
    return means.select(
        "field", fx.cluster_id(F.col("field"), "L2", F.col("l2")).alias("id"),
        fx.cluster_id(F.col("field"), "L1", F.col("l1")).alias("parent_id"),
        (F.col("l2") + F.when(F.col("field") == "keywords", 0).otherwise(100000)).cast("long").alias("pos"),
        F.col("l2").alias("number"), vx.unit(F.col("centroid")).alias("embedding"), "size")


def l1_clusters_vec(l2):
    return l2.groupBy("field", F.col("parent_id").alias("id")).agg(
        F.min("pos").alias("pos"), F.count("*").alias("child_count"),
        vx.mean_vector("embedding").alias("centroid"),
    ).select("field", "id", "pos", "child_count", vx.unit(F.col("centroid")).alias("embedding"))


def call_members(spark, sf):
    vectors = table(spark, sf, "embeddings").count()
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("transcript_id"), F.col("o_orderkey").alias("position"),
        (F.col("o_orderkey") % vectors).alias("vec_id"))
    rows = vec_members(spark, sf).select(
        "field", "vec_id", fx.cluster_id(F.col("field"), "L2", F.col("l2")).alias("l2_id"),
        fx.cluster_id(F.col("field"), "L1", F.col("l1")).alias("l1_id"))
    return orders.join(rows, "vec_id").select("field", "l2_id", "l1_id", "transcript_id", "position")


def label_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vector"))
    return rows.groupBy(F.col("label").alias("query_id")).agg(vx.mean_vector("vector").alias("query_vector"))


def question_vectors(spark, sf):
    types = table(spark, sf, "part").agg(F.array_sort(F.collect_set("p_type")).alias("v")).select(
        F.posexplode("v").alias("n", "p_type"))
    return types.join(label_vectors(spark, sf), F.col("n") == F.col("query_id")).select(
        F.col("p_type").alias("query_id"), "query_vector")
