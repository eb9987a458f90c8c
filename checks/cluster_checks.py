"""Vectors, MMR, cluster tables, hierarchical retrieval and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import vectors as vx
from callweave.operators import clusters, search, ward
from callweave.operators.joins import top_k
from callweave.plans import retrieve
from callweave.plans.cluster_build import cluster_build as build_clusters
from callweave.session import fresh_path, materialize

from . import views as v
from .registry import check, view


def mmr_ctes(prefix, items, keys, k, lam, high):
    """One CTE per greedy round over ``items(keys, pos, vec, rel)``."""
    p, key = prefix, ", ".join(keys)
    on = " AND ".join(f"i.{c} = p.{c}" for c in keys)
    late = "pos DESC" if high else "pos"
    ctes = [(f"{p}1", f"""SELECT {key}, pos, vec, rel, 1 AS pick, round({lam} * rel, 12) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(rel, 12) DESC, pos) AS rn FROM {items}) WHERE rn = 1""")]
    for r in range(2, k + 1):
        ctes.append((f"{p}{r}", f"""
            SELECT * FROM {p}{r-1} UNION ALL
            SELECT {key}, pos, vec, rel, {r} AS pick, score FROM (
              SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, {late}) AS rn FROM (
                SELECT {', '.join('i.' + c for c in keys)}, i.pos, any_value(i.vec) AS vec, any_value(i.rel) AS rel,
                       round({lam} * any_value(i.rel) - (1 - {lam}) * max(list_dot_product(i.vec, p.vec)), 12) AS score
                FROM {items} i JOIN {p}{r-1} p ON {on}
                GROUP BY {', '.join('i.' + c for c in keys)}, i.pos
                HAVING bool_and(i.pos <> p.pos))) WHERE rn = 1"""))
    return ctes


@check("normalize_vectors", """
SELECT vec_id, round(list_dot_product(u, u), 6) AS squared, round(u[1], 6) AS first_x, round(u[64], 6) AS last_x FROM (
  SELECT vec_id, list_transform(e, lambda x: (x + 0.1) / sqrt(list_sum(list_transform(e, lambda y: (y + 0.1) * (y + 0.1))))) AS u
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""")
def normalize_vectors(spark, sf):
    shifted = F.transform(vx.as_vector("embedding"), lambda x: x + 0.1)
    rows = v.table(spark, sf, "embeddings").select("vec_id", vx.unit(shifted).alias("u"))
    return rows.select("vec_id", F.round(vx.dot(F.col("u"), F.col("u")), 6).alias("squared"),
                       F.round(F.get("u", F.lit(0)), 6).alias("first_x"), F.round(F.get("u", F.lit(63)), 6).alias("last_x"))


@check("cluster_centroid", """
SELECT field, l2, cast(unnest(range(1, len(centroid) + 1)) AS BIGINT) AS i, round(unnest(centroid), 6) AS x FROM l2_centroids""")
def cluster_centroid(spark, sf):
    means = clusters.centroids(v.vec_members(spark, sf), ["field", "l1", "l2"])
    return means.select("field", "l2", F.posexplode("centroid").alias("i", "x")).select(
        "field", "l2", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


view("views_of_l2", """
SELECT a.field, a.l2, a.centroid AS c, n.query_vector AS nv, d.query_vector AS dv
FROM l2_centroids a JOIN label_vectors n ON n.query_id = a.l1 LEFT JOIN label_vectors d ON d.query_id = a.l1 + 1""")


@check("multiview_embedding", """
SELECT field, l2, unnest(range(1, 65)) AS i, round(unnest(list_transform(m, lambda x: x / sqrt(list_dot_product(m, m)))), 6) AS x FROM (
  SELECT field, l2, CASE WHEN dv IS NULL THEN c ELSE list_transform(range(1, 65), lambda i: c[i] + 0.5 * nv[i] + 0.5 * dv[i]) END AS m
  FROM views_of_l2)""")
def multiview_embedding(spark, sf):
    means = clusters.centroids(v.vec_members(spark, sf), ["field", "l1", "l2"])
    names = v.label_vectors(spark, sf)
    name = names.select(F.col("query_id").alias("l1"), F.col("query_vector").alias("name_vector"))
    desc = names.select((F.col("query_id") - 1).alias("l1"), F.col("query_vector").alias("description_vector"))
    mixed = clusters.multiview(means.join(name, "l1").join(desc, "l1", "left"))
    return mixed.select("field", "l2", F.posexplode("embedding").alias("i", "x")).select(
        "field", "l2", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


view("rep_items", """
SELECT e.label, vec_id AS pos, list_transform(e.v, lambda x: x / sqrt(list_dot_product(e.v, e.v))) AS vec,
       list_cosine_similarity(e.v, l.query_vector) AS rel
FROM (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings) e JOIN label_vectors l ON l.query_id = e.label""")
REPS = mmr_ctes("rep", "rep_items", ["label"], 20, 0.6, False)


def picked_representatives(spark, sf):
    members = v.table(spark, sf, "embeddings").select(
        "label", F.col("vec_id").alias("pos"), vx.as_vector("embedding").alias("vector"))
    return clusters.representatives(members, ["label"])


@check("mmr_representatives", "SELECT label, cast(pick AS BIGINT) AS pick, pos, round(score, 6) AS score FROM rep20", extra=REPS)
def mmr_representatives(spark, sf):
    return picked_representatives(spark, sf).select("label", "pick", "pos", F.round("score", 6).alias("score"))


@check("cluster_prompt_text", r"""
SELECT label, string_agg(text, chr(10) || '---' || chr(10) ORDER BY pick) AS prompt_text, count(*) AS samples
FROM rep20 JOIN documents ON doc_id = pos GROUP BY 1""", extra=REPS)
def cluster_prompt_text(spark, sf):
    texts = v.table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text")
    return clusters.prompt_text(picked_representatives(spark, sf), texts, ["label"])


@check("mmr_select", "SELECT query_id, cast(pick AS BIGINT) AS pick, pos, round(score, 6) AS score FROM sel6", extra=[
    ("sel_items", """SELECT q.query_id, c.pos, c.vec, list_cosine_similarity(q.query_vector, c.vec) AS rel
                     FROM label_vectors q JOIN l2_clusters_vec c ON c.field = 'keywords'"""),
    *mmr_ctes("sel", "sel_items", ["query_id"], 6, 0.7, True)])
def mmr_select(spark, sf):
    queries = fields_of(v.label_vectors(spark, sf), ("keywords",))
    items = retrieve.cluster_candidates(queries, v.l2_clusters_vec(spark, sf))
    return retrieve.mmr(items.select("query_id", "pos", "vector", "relevance"), ["query_id"], 6,
                        retrieve.MMR_LAMBDA, low_ties=False).select(
        "query_id", "pick", "pos", F.round("score", 6).alias("score"))


@check("transcript_cluster_map", "SELECT field, transcript_id, l2_id, l1_id FROM call_members")
def transcript_cluster_map(spark, sf):
    members = v.call_members(spark, sf).drop("l1_id")
    return clusters.member_map(members, v.l2_clusters_vec(spark, sf)).select("field", "transcript_id", "l2_id", "l1_id")


@check("doc_cluster_index", """
SELECT transcript_id, field, string_agg(DISTINCT l1_id, ',' ORDER BY l1_id) AS l1_ids,
       string_agg(DISTINCT l2_id, ',' ORDER BY l2_id) AS l2_ids FROM call_members GROUP BY 1, 2""")
def doc_cluster_index(spark, sf):
    return clusters.doc_index(v.call_members(spark, sf)).select(
        "transcript_id", "field", F.array_join("l1_ids", ",").alias("l1_ids"), F.array_join("l2_ids", ",").alias("l2_ids"))


view("l2_named", """
SELECT field, id, parent_id, CASE WHEN number % 2 = 0 THEN 'Topic ' || number ELSE field || ' L2 Group ' || number END AS name,
       'General grouping' AS description, (SELECT count(*) FROM call_members m WHERE m.l2_id = c.id) AS member_count
FROM l2_clusters_vec c""")


def l2_named(spark, sf):
    l2 = v.l2_clusters_vec(spark, sf).select(
        "field", "parent_id", "number", "embedding",
        F.when(F.col("number") % 2 == 0, F.concat(F.lit("Topic "), F.col("number").cast("string"))).alias("name"),
        F.lit(None).cast("string").alias("description"))
    sizes = v.call_members(spark, sf).groupBy(F.col("l2_id").alias("id")).agg(F.count("*").alias("member_count"))
    return clusters.labelled(l2, "L2").join(sizes, "id", "left").withColumn(
        "member_count", F.coalesce("member_count", F.lit(0)))


@check("cluster_catalog", """
SELECT 'L1Cluster' AS type, field, id, NULL AS parent_id, NULL AS name, child_count, NULL::BIGINT AS member_count FROM l1_clusters_vec
UNION ALL SELECT 'L2Cluster', field, id, parent_id, name, NULL, member_count FROM l2_named""")
def cluster_catalog(spark, sf):
    l2 = l2_named(spark, sf)
    l1 = v.l1_clusters_vec(v.l2_clusters_vec(spark, sf)).drop("child_count")
    rows = clusters.catalog(l1.select("field", "id", "embedding"), l2)
    return rows.select("type", "field", "id", "parent_id", "name", "child_count", "member_count")


@check("cluster_search", """
SELECT id, name FROM l2_named WHERE contains(lower(name || description || parent_id || field), 'topic 1')""")
def cluster_search(spark, sf):
    rows = l2_named(spark, sf).withColumn("type", F.lit("L2Cluster"))
    return clusters.search_text(rows, "Topic 1").select("id", "name")


view("words_by_source", r"SELECT source AS cluster, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents")


@check("cluster_terms", """
SELECT cluster, term, round(score, 6) AS score, cast(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS rank FROM (
    SELECT cluster, term, tf / words * ln(1 + (SELECT avg(w) FROM (SELECT count(*) AS w FROM words_by_source GROUP BY cluster)) / everywhere) AS score
    FROM (SELECT cluster, term, count(*)::DOUBLE AS tf FROM words_by_source GROUP BY 1, 2)
    JOIN (SELECT cluster, count(*) AS words FROM words_by_source GROUP BY 1) USING (cluster)
    JOIN (SELECT term, count(*) AS everywhere FROM words_by_source GROUP BY 1) USING (term))) WHERE rank <= 3""")
def cluster_terms(spark, sf):
    texts = v.table(spark, sf, "documents").select(F.col("source").alias("cluster"), "text")
    return clusters.distinguishing_terms(texts).select(
        "cluster", "term", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def ward_ctes(prefix, items, n_clusters, rounds=36):
    """Rounds of merges of mutual nearest clusters of ``items(field, item_id, vec)``, then the roots below the dearest merges."""
    p = prefix
    ctes = [(f"{p}w0", f"SELECT field, item_id AS point, vec, 1.0::DOUBLE AS w FROM {items}")]
    for r in range(rounds):
        ctes += [
            (f"{p}n{r}", f"""SELECT field, point, best[1] AS height, best[2] AS nearest FROM (
                SELECT a.field, a.point, min(row(a.w * b.w / (a.w + b.w) * pow(list_distance(a.vec, b.vec), 2), b.point)) AS best
                FROM {p}w{r} a JOIN {p}w{r} b ON a.field = b.field AND a.point <> b.point GROUP BY 1, 2)"""),
            (f"{p}m{r}", f"""SELECT x.field, x.point AS kept, y.point AS gone, x.height, {r} AS round FROM {p}n{r} x JOIN {p}n{r} y
                ON x.field = y.field AND x.nearest = y.point AND y.nearest = x.point AND x.point < y.point"""),
            (f"{p}w{r+1}", f"""SELECT k.field, k.point, CASE WHEN g.w IS NULL THEN k.vec ELSE
                list_transform(range(1, len(k.vec) + 1), lambda i: (k.vec[i] * k.w + g.vec[i] * g.w) / (k.w + g.w)) END AS vec, k.w + coalesce(g.w, 0) AS w
                FROM {p}w{r} k LEFT JOIN {p}m{r} m ON m.field = k.field AND m.kept = k.point
                LEFT JOIN {p}w{r} g ON g.field = m.field AND g.point = m.gone
                WHERE NOT EXISTS (SELECT 1 FROM {p}m{r} d WHERE d.field = k.field AND d.gone = k.point)"""),
        ]
    every = " UNION ALL ".join(f"SELECT * FROM {p}m{r}" for r in range(rounds))
    ctes.append((f"{p}held", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY height DESC, gone DESC) AS dear
                                 FROM ({every})) WHERE dear > {n_clusters - 1}"""))
    ctes.append((f"{p}r0", f"SELECT field, item_id, item_id AS root FROM {items}"))
    for r in range(rounds):
        ctes.append((f"{p}r{r+1}", f"""SELECT a.field, a.item_id, coalesce(h.kept, a.root) AS root FROM {p}r{r} a
                                       LEFT JOIN {p}held h ON h.round = {r} AND h.field = a.field AND h.gone = a.root"""))
    ctes.append((f"{p}labels", f"""SELECT field, item_id, root, cast(dense_rank() OVER (PARTITION BY field ORDER BY root) - 1 AS BIGINT) AS label
                                   FROM {p}r{rounds}"""))
    return ctes


view("ward_items", "SELECT 'keywords' AS field, vec_id AS item_id, embedding::DOUBLE[] AS vec FROM embeddings")
view("ward_heads", "SELECT field, id AS item_id, vec FROM l2_clusters_vec")
L2_WARD, L1_WARD = ward_ctes("wa", "ward_items", 200), ward_ctes("wb", "ward_heads", 20)


def ward_items(spark, sf):
    return v.table(spark, sf, "embeddings").select(
        F.lit("keywords").alias("field"), F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


@check("l2_clusters", "SELECT field, item_id, label FROM walabels", extra=L2_WARD)
def l2_clusters(spark, sf):
    return ward.cluster_vectors(ward_items(spark, sf), clusters.N_L2)


@check("l2_clusters_rounds", "SELECT field, item_id, label FROM walabels", extra=L2_WARD)
def l2_clusters_rounds(spark, sf):
    """The same clusters, with all but the last merges found in rounds over the executors, block against block."""
    return ward.cluster_vectors(ward_items(spark, sf), clusters.N_L2, local=200, block=128)


@check("l1_clusters", "SELECT field, item_id, label FROM wblabels", extra=L1_WARD)
def l1_clusters(spark, sf):
    rows = v.l2_clusters_vec(spark, sf).select("field", F.col("id").alias("item_id"), F.col("embedding").alias("vector"))
    return ward.cluster_vectors(rows, clusters.N_L1)


def label_ctes(prefix, texts):
    """Terms, names, descriptions and their vectors of ``texts(cluster, item_id, text)``; vectors come from all items."""
    p = prefix
    return [
        (f"{p}words", f"SELECT cluster, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM {texts}"),
        (f"{p}sizes", f"SELECT cluster, count(*) AS words FROM {p}words GROUP BY 1"),
        (f"{p}terms", f"""SELECT cluster, term, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS rank FROM (
              SELECT cluster, term, tf / words * ln(1 + (SELECT avg(words) FROM {p}sizes) / everywhere) AS score
              FROM (SELECT cluster, term, count(*)::DOUBLE AS tf FROM {p}words GROUP BY 1, 2) JOIN {p}sizes USING (cluster)
              JOIN (SELECT term, count(*) AS everywhere FROM {p}words GROUP BY 1) USING (term))) WHERE rank <= 8"""),
        (f"{p}held", f"""SELECT DISTINCT item_id, vec, term FROM (
            SELECT item_id, vec, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM build_items)
            WHERE term IN (SELECT term FROM {p}terms)"""),
        (f"{p}coords", f"""SELECT term, i, avg(x) AS x FROM (SELECT term, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS i FROM {p}held)
                           GROUP BY 1, 2"""),
        (f"{p}views", f"""SELECT cluster, list(nx ORDER BY i) AS nv, list(dx ORDER BY i) AS dv FROM (
            SELECT cluster, i, avg(x) FILTER (rank <= 3) AS nx, avg(x) AS dx FROM {p}terms JOIN {p}coords USING (term) GROUP BY 1, 2) GROUP BY 1"""),
        (f"{p}names", f"""SELECT cluster, string_agg(term, ' ' ORDER BY rank) FILTER (rank <= 3) AS name,
            'About ' || string_agg(term, ', ' ORDER BY rank) AS description FROM {p}terms GROUP BY 1"""),
    ]


def level_ctes(prefix, members, level):
    """Clusters of ``members(cluster, pos, vec, text)`` with names from ``<prefix>names`` and multi-view vectors; their picks and prompt texts."""
    p = prefix
    return [
        (f"{p}means", f"""SELECT cluster, list(x ORDER BY i) AS c FROM (SELECT cluster, i, avg(x) AS x FROM (
            SELECT cluster, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS i FROM {members}) GROUP BY 1, 2) GROUP BY 1"""),
        (f"{p}mixed", f"""SELECT cluster, c, CASE WHEN nv IS NULL THEN c ELSE list_transform(range(1, len(c) + 1), lambda i: c[i] + 0.5 * nv[i] + 0.5 * dv[i]) END AS m
            FROM {p}means LEFT JOIN {p}views USING (cluster)"""),
        (f"{p}level", f"""SELECT cluster, 'keywords_{level}_' || cluster AS id, coalesce(name, 'keywords {level} Group ' || cluster) AS name,
            coalesce(description, 'General grouping') AS description, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS vec
            FROM {p}mixed LEFT JOIN {p}names USING (cluster)"""),
        (f"{p}items", f"""SELECT cluster, pos, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec,
            list_cosine_similarity(vec, c) AS rel FROM {members} JOIN {p}means USING (cluster)"""),
        *mmr_ctes(f"{p}p", f"{p}items", ["cluster"], 20, 0.6, False),
        (f"{p}prompts", f"""SELECT cluster, string_agg(m.text, chr(10) || '---' || chr(10) ORDER BY pick) AS prompt_text
            FROM {p}p20 JOIN {members} m USING (cluster, pos) GROUP BY 1"""),
    ]


view("build_items", """
SELECT 'keywords' AS field, vec_id AS item_id, embedding::DOUBLE[] AS vec, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id""")
BUILD = [
    *ward_ctes("ca", "build_items", 200),
    ("l2_in", "SELECT label AS cluster, item_id, item_id AS pos, vec, text FROM calabels JOIN build_items USING (field, item_id)"),
    *label_ctes("cb", "l2_in"), *level_ctes("cb", "l2_in", "L2"),
    ("l2_heads", "SELECT 'keywords' AS field, id AS item_id, vec FROM cblevel"),
    *ward_ctes("cc", "l2_heads", 20),
    ("l1_of", "SELECT l.label AS l1, b.cluster AS l2, b.id FROM cclabels l JOIN cblevel b ON b.id = l.item_id"),
    ("l1_in", """SELECT o.l1 AS cluster, o.l2 AS pos, b.vec, 'Sub-Group Name: ' || b.name || chr(10) || 'Description: ' || b.description AS text
                 FROM l1_of o JOIN cblevel b ON b.cluster = o.l2"""),
    ("l1_texts", "SELECT o.l1 AS cluster, i.item_id, i.text FROM l2_in i JOIN l1_of o ON o.l2 = i.cluster"),
    *label_ctes("cd", "l1_texts"), *level_ctes("cd", "l1_in", "L1"),
]


@check("cluster_build", """
SELECT 'L1Cluster' AS type, 'keywords' AS field, id, NULL AS parent_id, name, description, (SELECT count(*) FROM l1_of o WHERE o.l1 = c.cluster) AS child_count,
       NULL::BIGINT AS member_count, prompt_text, round(vec[1], 6) AS first_x FROM cdlevel c JOIN cdprompts USING (cluster)
UNION ALL
SELECT 'L2Cluster', 'keywords', c.id, 'keywords_L1_' || o.l1, name, description, NULL, (SELECT count(*) FROM l2_in i WHERE i.cluster = c.cluster),
       prompt_text, round(vec[1], 6) FROM cblevel c JOIN cbprompts p USING (cluster) JOIN l1_of o ON o.l2 = c.cluster""", extra=BUILD)
def cluster_build(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    items = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    items = items.join(docs, "item_id", "left").withColumn("field", F.lit("keywords"))
    built = build_clusters(items, fresh_path(spark, "cluster-build"))
    return built["catalog"].join(built["prompts"].select("id", "prompt_text"), "id").select(
        "type", "field", "id", "parent_id", "name", "description", "child_count", "member_count", "prompt_text",
        F.round(F.get("embedding", F.lit(0)), 6).alias("first_x"))


@check("text_vectors", r"""
WITH words AS (SELECT doc_id AS item_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents),
tf AS (SELECT item_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
rarity AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (count(*) + 1)) AS r FROM tf GROUP BY 1),
w AS (SELECT item_id, term, tf * r AS w FROM tf JOIN rarity USING (term))
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w WHERE w > 0""")
def text_vectors(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return search.text_vectors(docs).withColumn("weight", F.round("weight", 6))


@check("cosine_topk", """
SELECT query_id, item_id, round(score, 6) AS score, cast(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT query_id, vec_id AS item_id, round(list_cosine_similarity(query_vector, embedding::DOUBLE[]), 12) AS score
    FROM label_vectors, embeddings) WHERE score >= 0.425) WHERE rank <= 10""")
def cosine_topk(spark, sf):
    items = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    queries = v.label_vectors(spark, sf).withColumnRenamed("query_vector", "vector")
    return search.cosine_topk(items, queries, 10, 0.425).select(
        "query_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- hierarchical retrieval --------------------------------------------------------


def hierarchy_ctes(prefix, k1, k2, min_sim, per_field, queries="question_vectors"):
    p = prefix
    keys = ["query_id", "field"] if per_field else ["query_id"]
    floor = f"WHERE rel >= {min_sim}" if min_sim is not None else ""
    return [
        (f"{p}heads", f"""SELECT query_id, c.field, c.id, c.pos, c.vec, list_cosine_similarity(query_vector, c.vec) AS rel
                       FROM {queries} CROSS JOIN l1_clusters_vec c"""),
        *mmr_ctes(f"{p}h", f"{p}heads", keys, k1, 0.7, True),
        (f"{p}l1", f"""SELECT b.query_id, b.field, b.id AS l1_id, a.pick AS l1_rank FROM {p}h{k1} a
                    JOIN {p}heads b ON a.query_id = b.query_id AND a.pos = b.pos"""),
        (f"{p}kids", f"""SELECT * FROM (SELECT a.query_id, c.field, a.l1_rank, c.parent_id, c.id, c.pos, c.vec,
                      list_cosine_similarity(q.query_vector, c.vec) AS rel
                      FROM {p}l1 a JOIN {queries} q USING (query_id) JOIN l2_clusters_vec c ON c.parent_id = a.l1_id) {floor}"""),
        *mmr_ctes(f"{p}k", f"{p}kids", ["query_id", "parent_id"], k2, 0.7, True),
        (f"{p}l2", f"""SELECT b.query_id, b.field, b.id AS l2_id, b.parent_id AS l1_id, b.l1_rank, a.pick AS l2_rank, b.rel AS score
                    FROM {p}k{k2} a JOIN {p}kids b ON a.query_id = b.query_id AND a.parent_id = b.parent_id AND a.pos = b.pos"""),
        (f"{p}docs", f"""SELECT query_id, transcript_id, min((l1_rank, l2_rank, position)) AS place
                      FROM {p}l2 JOIN call_members USING (field, l2_id) GROUP BY 1, 2"""),
    ]


def fields_of(queries, names=("keywords", "reason_for_call")):
    return queries.withColumn("field", F.explode(F.array(*[F.lit(n) for n in names])))


def picked(spark, sf, k1, k2, min_sim=None, per_field=True):
    l2 = materialize(v.l2_clusters_vec(spark, sf), "l2")
    return retrieve.pick_clusters(fields_of(v.question_vectors(spark, sf)), v.l1_clusters_vec(l2), l2, k1, k2, min_sim, per_field)


@check("retrieve_by_field", """
SELECT query_id, field, l1_id, l2_id, l1_rank, l2_rank, round(score, 6) AS score FROM fl2""",
       extra=hierarchy_ctes("f", 3, 5, 0.25, True))
def retrieve_by_field(spark, sf):
    _, l2 = picked(spark, sf, 3, 5, 0.25)
    return l2.select("query_id", "field", "l1_id", "l2_id", F.col("l1_rank").cast("long").alias("l1_rank"),
                     F.col("l2_rank").cast("long").alias("l2_rank"), F.round("score", 6).alias("score"))


@check("hierarchical_retrieve", """
SELECT query_id, transcript_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS doc_rank FROM ddocs""",
       extra=hierarchy_ctes("d", 3, 4, None, False))
def hierarchical_retrieve(spark, sf):
    _, l2 = picked(spark, sf, *retrieve.PICKS["default"], per_field=False)
    docs = retrieve.cluster_documents(l2, v.call_members(spark, sf))
    return retrieve.document_ranks(docs).select("query_id", "transcript_id", "doc_rank")


@check("clusters_hit", """
SELECT DISTINCT query_id, field, l2_id FROM (
  SELECT query_id, transcript_id FROM unmasked_candidates c
  WHERE overlap = (SELECT max(overlap) FROM unmasked_candidates m WHERE m.query_id = c.query_id))
JOIN call_members USING (transcript_id)""")
def clusters_hit(spark, sf):
    from callweave.operators import graph, reports

    from .graph_checks import candidates_star

    stored = materialize(candidates_star(spark, sf).select("query_id", "transcript_id", "overlap"), "candidates")
    retrieved = materialize(graph.seeds(stored).select("query_id", "transcript_id"), "seeds")
    return reports.clusters_hit(v.call_members(spark, sf), retrieved)
