"""End-to-end retrieval, multi-hop, keyword search, reranking, fusion and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import graph, reports, search, taxonomy
from callweave.operators.joins import bounded_broadcast, top_k
from callweave.operators.scan import pages, positions, range_blocks
from callweave.plans import retrieve
from callweave.session import materialize

from . import views as v
from .cluster_checks import hierarchy_ctes, l2_named
from .graph_checks import adjacency_star, candidates_star, ppr_ctes, questions_star
from .registry import check, view

LONG = "long"

view("question_text", """
SELECT p_type AS query_id, max(p_name) FILTER (top = 1) || ' and ' || max(p_name) FILTER (low = 1) AS text FROM (
  SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey DESC) AS top,
         row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS low FROM part) GROUP BY 1""")
view("named_hits", """
SELECT cast(l_orderkey AS VARCHAR) AS transcript_id, replace(p_name, ' ', '_') AS driver,
       cast(l_linenumber AS BIGINT) AS pair_index, p_name AS utterance
FROM lineitem JOIN part ON l_partkey = p_partkey""")
view("named_edges", """
SELECT transcript_id, 'IN_DOMAIN' AS edge, domain AS target FROM calls_star
UNION SELECT transcript_id, 'HAS_REASON', intent FROM calls_star
UNION SELECT transcript_id, 'HAS_DRIVER', driver FROM named_hits""")


def question_text(spark, sf):
    part = v.table(spark, sf, "part")
    order = F.struct("p_retailprice", "p_partkey")
    return part.groupBy(F.col("p_type").alias("query_id")).agg(
        F.concat(F.max_by("p_name", order), F.lit(" and "), F.min_by("p_name", order)).alias("text"))


def named_hits(spark, sf):
    lines = v.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = v.table(spark, sf, "part").select("p_partkey", "p_name")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("transcript_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("driver"),
        F.col("l_linenumber").cast("long").alias("pair_index"), F.col("p_name").alias("utterance"))


def pruned_star(spark, sf):
    l2 = materialize(v.l2_clusters_vec(spark, sf), "l2")
    domains, _ = graph.split_labels(v.question_labels(spark, sf), v.star_taxonomy(spark, sf))
    return retrieve.prune_by_clusters(
        v.question_vectors(spark, sf), domains, v.l1_clusters_vec(l2), l2, v.call_members(spark, sf),
        ["keywords", "reason_for_call"])


def result_sql(final, edges="call_edges", k=20):
    return f"""
SELECT f.query_id, cast(f.rank AS BIGINT) AS rank, f.transcript_id, round(f.ppr_score, 6) AS ppr_score, c.domain,
       c.intent AS call_intent, d.drivers, f.overlap AS driver_overlap, n.retrieved_count
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ppr_score, 12) DESC, transcript_id) AS rank FROM {final}) f
JOIN (SELECT query_id, count(*) AS retrieved_count FROM {final} GROUP BY 1) n USING (query_id)
JOIN calls_star c USING (transcript_id)
JOIN (SELECT transcript_id, string_agg(target, '|' ORDER BY target) AS drivers FROM {edges} WHERE edge = 'HAS_DRIVER' GROUP BY 1) d
  USING (transcript_id) WHERE rank <= {k}"""


def shown(df):
    return df.withColumn("drivers", F.array_join("drivers", "|")).withColumn("rank", F.col("rank").cast(LONG))


PRUNED = [
    *hierarchy_ctes("m", 6, 8, None, False), *hierarchy_ctes("o", 5, 7, None, False),
    ("pruned_candidates", """
     SELECT c.* FROM unmasked_candidates c JOIN (
       SELECT query_id, transcript_id FROM mdocs WHERE query_id IN (SELECT query_id FROM question_domains)
       UNION ALL SELECT query_id, transcript_id FROM odocs WHERE query_id NOT IN (SELECT query_id FROM question_domains)) d
     USING (query_id, transcript_id)"""),
]


@check("graph_retrieve", result_sql("final"), extra=PRUNED + ppr_ctes("pruned_candidates"))
def graph_retrieve(spark, sf):
    return shown(retrieve.graph_retrieve(adjacency_star(spark, sf), questions_star(spark, sf), pruned_star(spark, sf)))


@check("graph_retrieve_unmasked", result_sql("final"), extra=ppr_ctes("unmasked_candidates"))
def graph_retrieve_unmasked(spark, sf):
    return shown(retrieve.graph_retrieve(adjacency_star(spark, sf), questions_star(spark, sf)))


# --- multi-hop ---------------------------------------------------------------------

HOPS = [
    ("hops", """SELECT query_id AS request_id, query_id || '#' || hop_id AS query_id, hop_id, sub_query FROM (
        SELECT query_id, unnest([1, 2]) AS hop_id, unnest(string_split(text, ' and ')) AS sub_query FROM question_text)"""),
    ("hop_drivers", """SELECT DISTINCT h.query_id, t.driver FROM hops h JOIN (SELECT DISTINCT driver FROM named_hits) t
        ON list_has_all(list_transform(string_split(h.sub_query, ' '), lambda x: rtrim(x, 's')),
                        list_transform(string_split(t.driver, '_'), lambda x: rtrim(x, 's')))"""),
    ("hop_candidates", """SELECT q.query_id, e.transcript_id, count(*) AS overlap FROM named_edges e
        JOIN hop_drivers q ON e.edge = 'HAS_DRIVER' AND e.target = q.driver GROUP BY 1, 2"""),
    *ppr_ctes("hop_candidates", edges="named_edges"),
    ("hop_top", """SELECT h.request_id, h.hop_id, f.* FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ppr_score, 12) DESC, transcript_id) AS rank FROM final) f
        JOIN hops h USING (query_id) WHERE rank <= 20"""),
]


def hop_rows(spark, sf):
    """Hops with their ranked calls, from the question's text alone."""
    questions = question_text(spark, sf).select(F.col("query_id").alias("request_id"), "text")
    hops = retrieve.split_questions(questions, "text").withColumn(
        "query_id", F.concat_ws("#", "request_id", F.col("hop_id").cast("string")))
    hits = named_hits(spark, sf)
    labels = v.table(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("label")).distinct()
    matched = taxonomy.match_intents(
        hops.select("query_id", F.col("sub_query").alias("text")), labels.withColumn("kind", F.lit("content")), threshold=1.0)
    drivers = graph.normalize_drivers(matched)
    edges = graph.table_links(v.calls_star(spark, sf), hits)
    none = drivers.select("query_id").limit(0).withColumn("domain", F.lit(""))
    found = retrieve.graph_retrieve(graph.adjacency_of_edges(edges), graph.question_table(drivers, none))
    return hops, found.join(hops.select("query_id", "request_id", "hop_id"), "query_id")


@check("multihop_retrieve", """
SELECT request_id, cast(hop_id AS BIGINT) AS hop_id, cast(rank AS BIGINT) AS rank, transcript_id, overlap AS driver_overlap,
       round(ppr_score, 6) AS ppr_score FROM hop_top""", extra=HOPS)
def multihop_retrieve(spark, sf):
    _, found = hop_rows(spark, sf)
    return found.select("request_id", "hop_id", F.col("rank").cast(LONG).alias("rank"), "transcript_id", "driver_overlap", "ppr_score")


@check("hop_union", """
SELECT request_id, string_agg(DISTINCT transcript_id, ',' ORDER BY transcript_id) AS transcript_ids,
       string_agg(DISTINCT target, ',' ORDER BY target) AS query_drivers, count(DISTINCT hop_id) AS hops
FROM hop_top JOIN named_edges USING (transcript_id) WHERE edge = 'HAS_DRIVER' GROUP BY 1""", extra=HOPS)
def hop_union(spark, sf):
    _, found = hop_rows(spark, sf)
    return retrieve.hop_union(found).select(
        "request_id", F.array_join("transcript_ids", ",").alias("transcript_ids"),
        F.array_join("query_drivers", ",").alias("query_drivers"), "hops")


@check("hop_transcript", """
SELECT request_id, string_agg(chr(10) || 'Q' || hop_id || ': ' || sub_query || chr(10) || 'A' || hop_id || ': ' || n || ' calls' || chr(10), ''
       ORDER BY hop_id) AS steps
FROM hops h JOIN (SELECT driver, count(DISTINCT transcript_id) AS n FROM named_hits GROUP BY 1) c
  ON c.driver = replace(h.sub_query, ' ', '_') GROUP BY 1""", extra=HOPS[:1])
def hop_transcript(spark, sf):
    questions = question_text(spark, sf).select(F.col("query_id").alias("request_id"), "text")
    hops = retrieve.split_questions(questions, "text")
    counts = named_hits(spark, sf).select("driver", "transcript_id").distinct().groupBy("driver").count()
    answered = hops.withColumn("driver", F.replace("sub_query", F.lit(" "), F.lit("_"))).join(counts, "driver")
    return retrieve.hop_transcript(answered.withColumn("answer", F.concat(F.col("count").cast("string"), F.lit(" calls"))))


@check("answer_context", """
SELECT query_id, '[' || string_agg('{"rank":' || rank || ',"transcript_id":"' || transcript_id || '","driver_overlap":' || overlap || '}', ','
       ORDER BY rank) || ']' || chr(10) || 'Question: ' || any_value(text) AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ppr_score, 12) DESC, transcript_id) AS rank FROM final)
JOIN question_text USING (query_id) WHERE rank <= 20 GROUP BY 1""", extra=ppr_ctes("unmasked_candidates"))
def answer_context(spark, sf):
    found = retrieve.graph_retrieve(adjacency_star(spark, sf), questions_star(spark, sf))
    return retrieve.answer_context(found, question_text(spark, sf), ["rank", "transcript_id", "driver_overlap"])


# --- attaching text, reranking -----------------------------------------------------

TOP = ppr_ctes("unmasked_candidates") + [
    ("first20", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ppr_score, 12) DESC, transcript_id) AS rank
                   FROM final) WHERE rank <= 20"""),
]


def first20(spark, sf):
    return retrieve.graph_retrieve(adjacency_star(spark, sf), questions_star(spark, sf))


@check("attach_call", """
SELECT f.query_id, f.transcript_id, 0 AS page, string_agg('Customer: ' || utterance, ' | ' ORDER BY pair_index, utterance) AS preview
FROM first20 f JOIN named_hits h USING (transcript_id) GROUP BY 1, 2""", extra=TOP)
def attach_call(spark, sf):
    top = materialize(first20(spark, sf).select("query_id", "transcript_id"), "top")
    said = named_hits(spark, sf).join(bounded_broadcast(top), "transcript_id")
    lines = pages(said, ["query_id", "transcript_id"], ["pair_index", "utterance"],
                  F.concat(F.lit("Customer: "), "utterance"), 1000, "lines")
    return lines.select("query_id", "transcript_id", "page", F.array_join("lines", " | ").alias("preview"))


RERANK = TOP + [
    ("said", r"SELECT transcript_id, unnest(regexp_extract_all(lower(utterance), '\p{L}+')) AS term FROM named_hits WHERE transcript_id IN (SELECT transcript_id FROM first20)"),
    ("said_tf", "SELECT transcript_id, term, count(*)::DOUBLE AS tf FROM said GROUP BY 1, 2"),
    ("said_len", "SELECT transcript_id, count(*)::DOUBLE AS len FROM said GROUP BY 1"),
    ("asked", r"SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM question_text"),
    ("idf", "SELECT term, ln(1 + ((SELECT count(*) FROM said_len) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM said_tf GROUP BY 1"),
    ("pair_scores", """SELECT query_id, transcript_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM said_len)))) AS score
        FROM asked JOIN idf USING (term) JOIN said_tf USING (term) JOIN said_len USING (transcript_id) GROUP BY 1, 2"""),
]


@check("rerank_topk", """
SELECT query_id, transcript_id, round(score, 6) AS score, cast(final_rank AS BIGINT) AS final_rank FROM (
  SELECT query_id, transcript_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS final_rank FROM (
    SELECT f.query_id, f.transcript_id, f.rank, coalesce(s.score, 0) AS score FROM first20 f
    LEFT JOIN pair_scores s USING (query_id, transcript_id))) WHERE final_rank <= 10""", extra=RERANK)
def rerank_topk(spark, sf):
    best = retrieve.rerank_by_text(first20(spark, sf), named_hits(spark, sf), question_text(spark, sf), 10)
    return best.select("query_id", "transcript_id", F.round("score", 6).alias("score"),
                       F.col("final_rank").cast(LONG).alias("final_rank"))


# --- keyword and hybrid search -----------------------------------------------------

BM25 = [
    ("doc_terms", r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents"),
    ("doc_tf", "SELECT doc_id, term, count(*)::DOUBLE AS tf FROM doc_terms GROUP BY 1, 2"),
    ("doc_len", r"SELECT doc_id, len(regexp_extract_all(lower(text), '\p{L}+'))::DOUBLE AS len FROM documents"),
    ("item_terms", r"SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM benchmark"),
    ("doc_idf", "SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM doc_tf GROUP BY 1"),
    ("keyword_scores", """SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM doc_len)))) AS score
        FROM item_terms JOIN doc_idf USING (term) JOIN doc_tf USING (term) JOIN doc_len USING (doc_id) GROUP BY 1, 2"""),
    ("keyword_top", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM keyword_scores)
        WHERE rank <= 10"""),
]


def keyword_top(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    return search.bm25_topk(docs, v.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


@check("bm25_topk", "SELECT query_id, doc_id, round(score, 6) AS score, cast(rank AS BIGINT) AS rank FROM keyword_top", extra=BM25)
def bm25_topk(spark, sf):
    return keyword_top(spark, sf).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast(LONG).alias("rank"))


@check("hybrid_rank", """
SELECT query_id, item_id, round(score, 6) AS score, cast(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (
      SELECT query_id, doc_id AS item_id, rank FROM keyword_top UNION ALL SELECT query_id, item_id, rank FROM near_top)
    GROUP BY 1, 2)) WHERE rank <= 10""", extra=BM25 + [("near_top", """
    SELECT * FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
      SELECT query_id, vec_id AS item_id, round(list_cosine_similarity(query_vector, embedding::DOUBLE[]), 12) AS score
      FROM label_vectors, embeddings)) WHERE rank <= 10""")])
def hybrid_rank(spark, sf):
    words = keyword_top(spark, sf).select("query_id", F.col("doc_id").alias("item_id"), "rank")
    items = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    queries = v.label_vectors(spark, sf).select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").alias("vector"))
    near = search.cosine_topk(items, queries, 10)
    return search.fuse([words, near], 10).select(
        "query_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast(LONG).alias("rank"))


HYBRID = [
    ("call_text", "SELECT transcript_id, string_agg(utterance, ' ' ORDER BY pair_index) AS text FROM named_hits GROUP BY 1"),
    ("call_words", r"SELECT transcript_id, regexp_extract_all(lower(text), '\p{L}+') AS words FROM call_text"),
    ("call_tf", "SELECT transcript_id, term, count(*)::DOUBLE AS tf FROM (SELECT transcript_id, unnest(words) AS term FROM call_words) GROUP BY 1, 2"),
    ("call_len", "SELECT transcript_id, len(words)::DOUBLE AS len FROM call_words"),
    ("asked_terms", r"SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM question_text"),
    ("call_idf", "SELECT term, ln(1 + ((SELECT count(*) FROM call_words) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM call_tf GROUP BY 1"),
    ("word_leg", """SELECT query_id, transcript_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, transcript_id) AS rank FROM (
        SELECT query_id, transcript_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM call_len)))) AS score
        FROM asked_terms JOIN call_idf USING (term) JOIN call_tf USING (term) JOIN call_len USING (transcript_id) GROUP BY 1, 2)"""),
    ("vector_leg", """SELECT query_id, transcript_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, transcript_id) AS rank FROM (
        SELECT query_id, cast(o_orderkey AS VARCHAR) AS transcript_id, round(list_cosine_similarity(query_vector, embedding::DOUBLE[]), 12) AS score
        FROM question_vectors, orders JOIN embeddings ON vec_id = o_orderkey % (SELECT count(*) FROM embeddings))"""),
    *ppr_ctes("unmasked_candidates"),
    ("graph_leg", "SELECT query_id, transcript_id, row_number() OVER (PARTITION BY query_id ORDER BY round(ppr_score, 12) DESC, transcript_id) AS rank FROM final"),
]


def call_texts(spark, sf):
    """``(transcript_id, text, vector)`` of calls with lines; an order has few.

    Calls are written with the number of their vector; the vector stands beside them when they are read.
    """
    said = F.transform(F.array_sort(F.collect_list(F.struct("pair_index", "utterance"))), lambda s: s["utterance"])
    texts = named_hits(spark, sf).groupBy("transcript_id").agg(F.array_join(said, " ").alias("text"))
    items = v.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    placed = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("transcript_id"), (F.col("o_orderkey") % items.count()).alias("vec_id"))
    known = placed.join(items.select("vec_id").distinct(), "vec_id", "left_semi")
    calls = materialize(texts.join(known, "transcript_id", "full"), "call-texts")
    return calls.join(items, "vec_id", "left").select("transcript_id", "text", "vector")


@check("hybrid_retrieve", """
SELECT query_id, transcript_id, round(score, 6) AS score, cast(rank AS BIGINT) AS rank, keyword_rank, vector_rank, graph_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, transcript_id) AS rank FROM (
    SELECT query_id, transcript_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(rank) FILTER (leg = 'w') AS keyword_rank,
           min(rank) FILTER (leg = 'v') AS vector_rank, min(rank) FILTER (leg = 'g') AS graph_rank
    FROM (SELECT 'w' AS leg, * FROM word_leg UNION ALL SELECT 'v', * FROM vector_leg UNION ALL SELECT 'g', * FROM graph_leg)
    WHERE rank <= 20 GROUP BY 1, 2)) WHERE rank <= 10""", extra=HYBRID)
def hybrid_retrieve(spark, sf):
    questions = question_text(spark, sf).join(
        v.question_vectors(spark, sf).withColumnRenamed("query_vector", "vector"), "query_id", "left")
    found = retrieve.hybrid_retrieve(materialize(questions, "asked"), call_texts(spark, sf), adjacency_star(spark, sf), questions_star(spark, sf))
    return found.select("query_id", "transcript_id", F.round("score", 6).alias("score"), F.col("rank").cast(LONG).alias("rank"),
                        "keyword_rank", "vector_rank", "graph_rank")


# --- report tables -----------------------------------------------------------------

view("seed_calls", """
SELECT query_id, transcript_id FROM unmasked_candidates c
WHERE overlap = (SELECT max(overlap) FROM unmasked_candidates m WHERE m.query_id = c.query_id)""")
view("wanted_drivers", """
SELECT query_id, driver FROM question_drivers UNION SELECT query_id, query_id FROM question_drivers""")


def seed_calls(spark, sf):
    stored = materialize(candidates_star(spark, sf).select("query_id", "transcript_id", "overlap"), "candidates")
    return materialize(graph.seeds(stored).select("query_id", "transcript_id"), "seeds")


def wanted_drivers(spark, sf):
    known = materialize(questions_star(spark, sf).select("query_id", "driver"), "wanted")
    return known.unionByName(known.select("query_id", F.col("query_id").alias("driver"))).distinct()


CALLS_SQL = """SELECT query_id, driver, count(DISTINCT transcript_id) AS calls
FROM seed_calls JOIN driver_hits USING (transcript_id) JOIN wanted_drivers USING (query_id, driver) GROUP BY 1, 2"""
FREQ_SQL = """SELECT query_id, driver, count(h.transcript_id) AS total, count(DISTINCT h.transcript_id) AS calls FROM wanted_drivers w
LEFT JOIN (SELECT query_id, transcript_id, driver FROM seed_calls JOIN driver_hits USING (transcript_id)) h USING (query_id, driver) GROUP BY 1, 2"""


@check("driver_call_counts", CALLS_SQL)
def driver_call_counts(spark, sf):
    return reports.driver_call_counts(v.driver_hits(spark, sf), seed_calls(spark, sf), wanted_drivers(spark, sf))


@check("driver_frequency", FREQ_SQL)
def driver_frequency(spark, sf):
    return reports.driver_frequency(v.driver_hits(spark, sf), seed_calls(spark, sf), wanted_drivers(spark, sf))


view("hit_clusters", """
SELECT DISTINCT s.query_id, c.id AS l2_id, c.parent_id, c.name, c.member_count, n.pos FROM seed_calls s JOIN call_members m USING (transcript_id)
JOIN l2_named c ON c.id = m.l2_id JOIN l2_clusters_vec n ON n.id = c.id""")
PIE_SQL = """
SELECT query_id, parent_id, l2_id, name, size, parent_size, total, round(before_parent / total * 360, 6) AS parent_start,
       round((before_parent + parent_size) / total * 360, 6) AS parent_end, round((before_parent + before_child) / total * 360, 6) AS child_start,
       round((before_parent + before_child + size) / total * 360, 6) AS child_end,
       round(CASE WHEN children > 1 THEN 0.4 + 0.3 * place / (children - 1) ELSE 0.5 END, 6) AS alpha FROM (
  SELECT query_id, parent_id, l2_id, name, member_count AS size,
    cast(sum(member_count) OVER (PARTITION BY query_id, parent_id) AS BIGINT) AS parent_size,
    cast(sum(member_count) OVER (PARTITION BY query_id) AS BIGINT) AS total,
    coalesce(sum(member_count) OVER (PARTITION BY query_id ORDER BY parent_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             - sum(member_count) OVER (PARTITION BY query_id, parent_id), 0)::DOUBLE AS before_parent,
    coalesce(sum(member_count) OVER (PARTITION BY query_id, parent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before_child,
    (row_number() OVER (PARTITION BY query_id, parent_id ORDER BY pos) - 1)::DOUBLE AS place,
    count(*) OVER (PARTITION BY query_id, parent_id) AS children FROM hit_clusters)"""


def sized_l2(spark, sf):
    order = v.l2_clusters_vec(spark, sf).select("id", "pos")
    return materialize(l2_named(spark, sf).join(order, "id").drop("embedding"), "l2")


def hit_star(spark, sf):
    return reports.clusters_hit(v.call_members(spark, sf), seed_calls(spark, sf)).select("query_id", "l2_id")


@check("cluster_breakdown", PIE_SQL)
def cluster_breakdown(spark, sf):
    out = reports.cluster_breakdown(sized_l2(spark, sf), hit_star(spark, sf))
    angles = ["parent_start", "parent_end", "child_start", "child_end", "alpha"]
    return out.select(*[F.round(c, 6).alias(c) if c in angles else c for c in out.columns])


BUBBLE_SQL = """SELECT query_id, parent_id, l2_id, round(sqrt(member_count), 6) AS radius,
  cast(sum(member_count) OVER (PARTITION BY query_id, parent_id) AS BIGINT) AS parent_members FROM hit_clusters"""


@check("bubble_sizes", BUBBLE_SQL)
def bubble_sizes(spark, sf):
    return reports.bubble_sizes(sized_l2(spark, sf), hit_star(spark, sf)).withColumn("radius", F.round("radius", 6))


@check("report_tables", f"""
SELECT query_id, 'driver_calls' AS report, driver AS key, calls::DOUBLE AS value FROM ({CALLS_SQL})
UNION ALL SELECT query_id, 'driver_frequency', driver, total::DOUBLE FROM ({FREQ_SQL})
UNION ALL SELECT query_id, 'cluster_end', l2_id, child_end FROM ({PIE_SQL})
UNION ALL SELECT query_id, 'bubble_radius', l2_id, radius FROM ({BUBBLE_SQL})""")
def report_tables(spark, sf):
    seeds = seed_calls(spark, sf)
    hits, wanted = v.driver_hits(spark, sf), wanted_drivers(spark, sf)
    l2 = sized_l2(spark, sf)
    return reports.report_tables(hits, seeds, wanted, l2, v.call_members(spark, sf)).withColumn("value", F.round("value", 6))


view("event_turns", """
SELECT user_id AS transcript_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn,
       greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 50)) AS score FROM events""")
view("active_users", """
SELECT * FROM (SELECT event_type AS query_id, user_id AS transcript_id,
  row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rank FROM events GROUP BY 1, 2) WHERE rank <= 20""")


def event_turns(spark, sf):
    rows = v.table(spark, sf, "events").select(
        F.col("user_id").alias("transcript_id"), "ts", "event_id",
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 50)).alias("score"))
    return positions(range_blocks(rows, ["transcript_id", "ts", "event_id"]), ["transcript_id"],
                     [F.col("ts"), F.col("event_id")], name="turn").select("transcript_id", "turn", "score")


def active_users(spark, sf):
    counts = v.table(spark, sf, "events").groupBy(
        F.col("event_type").alias("query_id"), F.col("user_id").alias("transcript_id")).count()
    return top_k(counts, ["query_id"], [F.desc("count"), F.asc("transcript_id")], 20).drop("count")


@check("sentiment_curves", """
SELECT query_id, cast(rank AS BIGINT) AS rank, transcript_id, turn, round(score, 6) AS score
FROM event_turns JOIN active_users USING (transcript_id) WHERE rank <= 10""")
def sentiment_curves(spark, sf):
    return reports.sentiment_curves(event_turns(spark, sf), active_users(spark, sf)).select(
        "query_id", F.col("rank").cast(LONG).alias("rank"), "transcript_id", "turn", F.round("score", 6).alias("score"))


@check("sentiment_trend", """
SELECT query_id, turn, round(avg(score), 6) AS mean_score, count(*) AS calls
FROM event_turns JOIN active_users USING (transcript_id) WHERE rank <= 10 GROUP BY 1, 2""")
def sentiment_trend(spark, sf):
    return reports.sentiment_trend(event_turns(spark, sf), active_users(spark, sf)).withColumn("mean_score", F.round("mean_score", 6))
