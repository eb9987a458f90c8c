"""Graph, masks, overlap, PageRank."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import graph, ppr

from . import views as v
from .registry import check

EDGE_TYPE = """CASE edge WHEN 'IN_DOMAIN' THEN 'Domain' WHEN 'HAS_REASON' THEN 'CallReason'
               ELSE 'InteractionDriver' END"""


def edges_star(spark, sf):
    return graph.table_edges(v.calls_star(spark, sf), v.driver_hits(spark, sf))


def adjacency_star(spark, sf):
    return graph.adjacency_of_edges(graph.table_links(v.calls_star(spark, sf), v.driver_hits(spark, sf)))


def questions_star(spark, sf):
    domains, content = graph.split_labels(v.question_labels(spark, sf), v.star_taxonomy(spark, sf))
    return graph.question_table(graph.normalize_drivers(content), graph.domain_mask(domains))


def candidates_star(spark, sf, pruned=None):
    return graph.driver_overlap(adjacency_star(spark, sf), questions_star(spark, sf), pruned)


def ppr_ctes(candidates: str, prefix: str = "", steps: int = 60, edges: str = "call_edges") -> list[tuple[str, str]]:
    """Power iteration over the raw edges, one CTE per step, with the library stop rule."""
    p = prefix
    ctes = [
        (f"{p}cand", f"SELECT * FROM {candidates}"),
        (f"{p}half", f"""SELECT c.query_id, 'Transcript:' || e.transcript_id AS src, {EDGE_TYPE} || ':' || e.target AS dst
                      FROM {p}cand c JOIN {edges} e USING (transcript_id)"""),
        (f"{p}edge", f"SELECT query_id, src, dst FROM {p}half UNION ALL SELECT query_id, dst, src FROM {p}half"),
        (f"{p}best", f"SELECT query_id, max(overlap) AS best FROM {p}cand GROUP BY 1"),
        (f"{p}seed", f"""SELECT query_id, 'Transcript:' || transcript_id AS node,
                      1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS p
                      FROM {p}cand JOIN {p}best USING (query_id) WHERE overlap = best"""),
    ]
    ctes.append((f"{p}node", f"""SELECT d.query_id, d.node, d.deg, (count(*) OVER (PARTITION BY d.query_id))::DOUBLE AS n,
                      coalesce(s.p, 0.0) AS p
                      FROM (SELECT query_id, src AS node, count(*)::DOUBLE AS deg FROM {p}edge GROUP BY 1, 2) d
                      LEFT JOIN {p}seed s ON s.query_id = d.query_id AND s.node = d.node"""))
    ctes.append((f"{p}r0", f"SELECT query_id, node, deg, n, p, 1.0 / n AS r, 0.0::DOUBLE AS last FROM {p}node"))
    for k in range(1, steps + 1):
        ctes.append((f"{p}r{k}", f"""
            SELECT x.query_id, x.node, x.deg, x.n, x.p, 0.15 * x.p + 0.85 * coalesce(f.flow, 0.0) AS r, x.r AS last
            FROM {p}r{k-1} x LEFT JOIN (
              SELECT e.query_id, e.dst AS node, sum(s.r / s.deg) AS flow
              FROM {p}edge e JOIN {p}r{k-1} s ON s.query_id = e.query_id AND s.node = e.src GROUP BY 1, 2) f
            ON f.query_id = x.query_id AND f.node = x.node"""))
    errs = " UNION ALL ".join(
        f"SELECT query_id, {k} AS k, sum(abs(r - last)) AS err, max(n) AS n FROM {p}r{k} GROUP BY 1"
        for k in range(1, steps + 1)
    )
    ctes.append((f"{p}stop", f"SELECT query_id, min(k) AS k FROM ({errs}) WHERE err < n * 1e-6 GROUP BY 1"))
    ranks = " UNION ALL ".join(
        f"SELECT {k} AS k, query_id, node, r FROM {p}r{k} WHERE node LIKE 'Transcript:%'" for k in range(20, steps + 1)
    )
    ctes.append((f"{p}final", f"""
        SELECT f.query_id, substr(f.node, 12) AS transcript_id, f.r AS ppr_score, c.overlap
        FROM ({ranks}) f JOIN {p}stop USING (query_id, k)
        JOIN {p}cand c ON c.query_id = f.query_id AND c.transcript_id = substr(f.node, 12)"""))
    return ctes


@check("graph_edges", "SELECT * FROM call_edges")
def graph_edges(spark, sf):
    return edges_star(spark, sf)


@check("graph_nodes", f"""
SELECT DISTINCT 'Transcript' AS type, transcript_id AS id FROM call_edges
UNION SELECT DISTINCT {EDGE_TYPE}, target FROM call_edges""")
def graph_nodes(spark, sf):
    return graph.nodes_of_edges(edges_star(spark, sf))


@check("graph_key_violations", """
SELECT transcript_id, driver, count(*) AS n FROM driver_hits GROUP BY 1, 2 HAVING count(*) > 1""")
def graph_key_violations(spark, sf):
    return graph.key_violations(v.driver_hits(spark, sf), ["transcript_id", "driver"])


@check("graph_upsert", """
SELECT DISTINCT transcript_id, 'HAS_DRIVER' AS edge, driver AS target FROM driver_hits WHERE pair_index > 3
EXCEPT SELECT transcript_id, 'HAS_DRIVER', driver FROM driver_hits WHERE pair_index <= 3""")
def graph_upsert(spark, sf):
    hits = v.driver_hits(spark, sf).select(
        "transcript_id", F.lit("HAS_DRIVER").alias("edge"), F.col("driver").alias("target"), "pair_index"
    )
    keys = ["transcript_id", "edge", "target"]
    stored = hits.filter("pair_index <= 3").select(*keys)
    return graph.new_rows(stored, hits.filter("pair_index > 3").select(*keys), keys)


@check("intent_partition", """
SELECT query_id, label, CASE WHEN label IN (SELECT label FROM star_taxonomy WHERE kind = 'domain')
  THEN 'domain' ELSE 'content' END AS kind FROM question_labels""")
def intent_partition(spark, sf):
    domains, content = graph.split_labels(v.question_labels(spark, sf), v.star_taxonomy(spark, sf))
    return domains.withColumn("kind", F.lit("domain")).unionByName(content.withColumn("kind", F.lit("content")))


@check("normalize_drivers", "SELECT query_id, driver FROM question_drivers")
def normalize_drivers(spark, sf):
    _, content = graph.split_labels(v.question_labels(spark, sf), v.star_taxonomy(spark, sf))
    return graph.normalize_drivers(content)


@check("domain_mask", "SELECT query_id, domain FROM question_domains")
def domain_mask(spark, sf):
    domains, _ = graph.split_labels(v.question_labels(spark, sf), v.star_taxonomy(spark, sf))
    return graph.domain_mask(domains)


@check("driver_overlap", "SELECT * FROM unmasked_candidates")
def driver_overlap(spark, sf):
    return candidates_star(spark, sf).select("query_id", "transcript_id", "overlap")


@check("ppr_seeds", """
SELECT query_id, transcript_id, overlap FROM unmasked_candidates c
WHERE overlap = (SELECT max(overlap) FROM unmasked_candidates m WHERE m.query_id = c.query_id)""")
def ppr_seeds(spark, sf):
    return graph.seeds(candidates_star(spark, sf)).select("query_id", "transcript_id", "overlap")


@check("candidate_subgraph", f"""
SELECT c.query_id, c.transcript_id, {EDGE_TYPE} AS target_type, e.target AS target_name
FROM unmasked_candidates c JOIN call_edges e USING (transcript_id)""")
def candidate_subgraph(spark, sf):
    return graph.candidate_edges(candidates_star(spark, sf))


@check("subgraph_stats", """
SELECT c.query_id, count(DISTINCT c.transcript_id) AS retrieved_count,
       count(DISTINCT c.transcript_id) + count(DISTINCT e.edge || e.target) AS nodes, count(*) AS edges
FROM unmasked_candidates c JOIN call_edges e USING (transcript_id) GROUP BY 1""")
def subgraph_stats(spark, sf):
    return graph.subgraph_stats(candidates_star(spark, sf))


@check("ppr_rank", """
SELECT query_id, transcript_id, overlap, round(ppr_score, 6) AS ppr_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ppr_score, 12) DESC, transcript_id) AS rank FROM final)
WHERE rank <= 10""", extra=ppr_ctes("unmasked_candidates"))
def ppr_rank(spark, sf):
    top = ppr.ppr_top(ppr.ppr_scores(candidates_star(spark, sf)), 10)
    return top.select("query_id", "transcript_id", "overlap", F.round("ppr_score", 6).alias("ppr_score"),
                      F.col("rank").cast("long").alias("rank"))
