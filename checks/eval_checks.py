"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import vectors as vx
from callweave.operators import evaluate as ev

from . import views as v
from .registry import VIEWS, check, view

view("eval_truth", """
SELECT q.vec_id AS query_idx, d AS gt_pos, t.embedding::DOUBLE[] AS v
FROM embeddings q CROSS JOIN (SELECT unnest([0, 1]) AS d) LEFT JOIN embeddings t ON t.vec_id = q.vec_id + d + 1""")
view("eval_retrieved", """
SELECT q.vec_id AS query_idx, d AS ret_pos, t.embedding::DOUBLE[] AS v
FROM embeddings q CROSS JOIN (SELECT unnest([0, 1, 2]) AS d, unnest([3, 1, 4]) AS shift)
LEFT JOIN embeddings t ON t.vec_id = q.vec_id + shift""")
view("eval_pairs", """
SELECT query_idx, gt_pos, ret_pos, coalesce(round(list_cosine_similarity(g.v, r.v), 12), 0.0) AS sim
FROM eval_truth g JOIN eval_retrieved r USING (query_idx)""")


def eval_sides(spark, sf):
    """Every vector as a question: its two successors are true, three others retrieved; the last ones lack vectors."""
    vectors = v.table(spark, sf, "embeddings").select("vec_id", vx.unit(vx.as_vector("embedding")).alias("vector"))
    questions = vectors.select(F.col("vec_id").alias("query_idx"))

    def side(shifts):
        wanted = questions.select("query_idx", F.posexplode(F.array(*[F.lit(s) for s in shifts])).alias("pos", "shift"))
        return wanted.withColumn("vec_id", F.col("query_idx") + F.col("shift")).join(vectors, "vec_id", "left").select(
            "query_idx", "pos", "vector")

    return questions, side([1, 2]), side([3, 1, 4])


METRICS_SQL = """
SELECT q.query_idx, coalesce(g.n, 0) AS num_gt_calls, coalesce(r.n, 0) AS num_retrieved,
       round(coalesce(b.recall, 0.0), 6) AS recall, round(coalesce(b.mean_max, 0.0), 6) AS mean_max_cosine_similarity,
       CASE WHEN f.first IS NULL THEN 0 ELSE 1 END::BIGINT AS hit_at_k, round(coalesce(1.0::DOUBLE / f.first, 0.0), 6) AS mrr
FROM (SELECT vec_id AS query_idx FROM embeddings) q
LEFT JOIN (SELECT query_idx, count(*) AS n FROM eval_truth GROUP BY 1) g USING (query_idx)
LEFT JOIN (SELECT query_idx, count(*) AS n FROM eval_retrieved GROUP BY 1) r USING (query_idx)
LEFT JOIN (SELECT query_idx, avg(best) AS mean_max, avg(CASE WHEN best >= 0.25 THEN 1.0 ELSE 0.0 END::DOUBLE) AS recall
           FROM (SELECT query_idx, gt_pos, max(sim) AS best FROM eval_pairs GROUP BY 1, 2) GROUP BY 1) b USING (query_idx)
LEFT JOIN (SELECT query_idx, min(ret_pos) + 1 AS first FROM eval_pairs WHERE sim >= 0.25 AND ret_pos < 2 GROUP BY 1) f USING (query_idx)"""


# The report asks one question per document; its lists name vectors, most of which do not exist.
METRICS_DOCS_SQL = METRICS_SQL.replace("eval_pairs", "doc_pairs").replace("eval_truth", "doc_truth").replace("eval_retrieved", "doc_retrieved").replace(
    "(SELECT vec_id AS query_idx FROM embeddings)", "(SELECT doc_id AS query_idx FROM documents)")
for _name, _column, _shifts in (("doc_truth", "gt_pos", "SELECT unnest([0, 1]) AS d, unnest([1, 2]) AS shift"),
                                ("doc_retrieved", "ret_pos", "SELECT unnest([0, 1, 2]) AS d, unnest([3, 1, 4]) AS shift")):
    view(_name, f"SELECT q.doc_id AS query_idx, d AS {_column}, t.embedding::DOUBLE[] AS v FROM documents q CROSS JOIN ({_shifts}) LEFT JOIN embeddings t ON t.vec_id = q.doc_id + shift")
view("doc_pairs", VIEWS["eval_pairs"].replace("eval_truth", "doc_truth").replace("eval_retrieved", "doc_retrieved"))


@check("pair_similarity", "SELECT query_idx, cast(gt_pos AS BIGINT) AS gt_pos, cast(ret_pos AS BIGINT) AS ret_pos, round(sim, 6) AS sim FROM eval_pairs")
def pair_similarity(spark, sf):
    _, truth, retrieved = eval_sides(spark, sf)
    return ev.pair_similarity(truth, retrieved).select(
        "query_idx", F.col("gt_pos").cast("long").alias("gt_pos"), F.col("ret_pos").cast("long").alias("ret_pos"),
        F.round("sim", 6).alias("sim"))


@check("retrieval_metrics", METRICS_SQL)
def retrieval_metrics(spark, sf):
    out = ev.retrieval_metrics(*eval_sides(spark, sf), threshold=ev.SAMPLE_THRESHOLD, k=2)
    return out.select(*[F.round(c, 6).alias(c) if c in ("recall", "mean_max_cosine_similarity", "mrr") else c for c in out.columns])


@check("eval_sides", """
SELECT query_idx, side, cast(pos AS BIGINT) AS pos, call FROM (
  SELECT p_partkey AS query_idx, 'ground_truth' AS side, unnest(range(0, len(items))) AS pos, unnest(items) AS call FROM (
    SELECT p_partkey, CASE WHEN cell IS NULL THEN [] WHEN cell LIKE '[%]' THEN regexp_extract_all(cell, '''([^'']*)''', 1) ELSE [trim(cell)] END AS items FROM cells)
  UNION ALL SELECT p_partkey, 'retrieved', 0, p_brand FROM part)""")
def eval_sides_check(spark, sf):
    from .text_checks import cells

    rows = cells(spark, sf).join(v.table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey").select(
        F.col("p_partkey").alias("query_idx"), F.col("cell").alias("Ground_Truth"), F.col("p_brand").alias("Retrieved_Calls"))
    return ev.sides(ev.parsed_lists(rows)).withColumn("pos", F.col("pos").cast("long"))


# --- text metrics ------------------------------------------------------------------


def answer_rows(spark, sf):
    """Every document as an answer; the reference texts take turns."""
    items = v.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("Expected_Answer"))
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("query_idx"), F.col("text").alias("Final_Answer"))
    turns = items.count()
    # A file of one row group is one task: rows are dealt out before each of them is scored.
    docs = docs.repartition(2 * spark.sparkContext.defaultParallelism)
    return docs.withColumn("item_id", F.col("query_idx") % turns).join(items, "item_id").drop("item_id")


def _tokens_sql(expr):
    out = f"' ' || {expr} || ' '"
    for pattern, replacement in ev.TOKEN_RULES:
        pattern, replacement = pattern.replace("'", "''"), replacement.replace("$", "\\").replace("'", "''")
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"list_filter(string_split_regex({out}, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')"


view("answer_pairs", "SELECT d.doc_id AS query_idx, d.text AS candidate, b.text AS reference FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)")


def gram_ctes(prefix, tokens, orders):
    p = prefix
    grams = ["w"]
    for n in range(1, orders):
        grams.append(f"{grams[-1]} || ' ' || lead(w, {n}) OVER o")
    return [
        (f"{p}tok", f"""SELECT query_idx, side, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (
            SELECT query_idx, 'c' AS side, {tokens('candidate')} AS t FROM answer_pairs
            UNION ALL SELECT query_idx, 'r', {tokens('reference')} FROM answer_pairs)"""),
        (f"{p}wide", f"""SELECT query_idx, side, {', '.join(f'{g} AS g{n}' for n, g in enumerate(grams, 1))}
            FROM {p}tok WINDOW o AS (PARTITION BY query_idx, side ORDER BY i)"""),
        (f"{p}gram", " UNION ALL ".join(
            f"SELECT query_idx, side, {n} AS n, g{n} AS gram FROM {p}wide WHERE g{n} IS NOT NULL" for n in range(1, orders + 1))),
        (f"{p}cnt", f"SELECT query_idx, n, gram, count(*) FILTER (side = 'c') AS c, count(*) FILTER (side = 'r') AS r FROM {p}gram GROUP BY 1, 2, 3"),
        (f"{p}stat", f"SELECT query_idx, n, sum(least(c, r))::DOUBLE AS m, sum(c)::DOUBLE AS t, sum(r)::DOUBLE AS r FROM {p}cnt GROUP BY 1, 2"),
    ]


def _bleu_sql():
    cols = ", ".join(f"coalesce(max(m) FILTER (n = {n}), 0) AS m{n}, coalesce(max(t) FILTER (n = {n}), 0) AS t{n}" for n in range(1, 5))
    doubled = "1.0::DOUBLE"
    logs = []
    for n in range(1, 5):
        doubled = f"({doubled} * CASE WHEN t{n} > 0 AND m{n} = 0 THEN 2 ELSE 1 END)"
        logs.append(f"CASE WHEN t{n} = 0 THEN 0 WHEN m{n} > 0 THEN ln(m{n} / t{n}) ELSE ln(1 / ({doubled} * t{n})) END")
    order = " + ".join(f"CASE WHEN t{n} > 0 THEN 1 ELSE 0 END" for n in range(1, 5))
    return f"""SELECT query_idx, round(CASE WHEN m1 + m2 + m3 + m4 = 0 THEN 0.0 ELSE
      CASE WHEN t1 < rl THEN exp(1 - rl / t1) ELSE 1.0 END * exp(({' + '.join(logs)}) / ({order})) END, 6) AS bleu
      FROM (SELECT query_idx, {cols}, max(r) FILTER (n = 1) AS rl FROM bstat GROUP BY 1)"""


ROUGE_SQL = """SELECT query_idx, round(coalesce(max(f) FILTER (n = 1), 0.0), 6) AS rouge1_f, round(coalesce(max(f) FILTER (n = 2), 0.0), 6) AS rouge2_f
FROM (SELECT query_idx, n, CASE WHEN m > 0 THEN 2 * m / (t + r) ELSE 0.0 END AS f FROM gstat) GROUP BY 1"""
BLEU_CTES = gram_ctes("b", _tokens_sql, 4)
ROUGE_CTES = gram_ctes("g", lambda e: f"regexp_extract_all(lower({e}), '[a-z0-9]+')", 2)


@check("bleu", _bleu_sql(), extra=BLEU_CTES)
def bleu(spark, sf):
    return ev.bleu(ev.text_pairs(answer_rows(spark, sf))).withColumn("bleu", F.round("bleu", 6))


@check("rouge_n", ROUGE_SQL, extra=ROUGE_CTES)
def rouge_n(spark, sf):
    return ev.rouge_n(ev.text_pairs(answer_rows(spark, sf))).select(
        "query_idx", F.round("rouge1_f", 6).alias("rouge1_f"), F.round("rouge2_f", 6).alias("rouge2_f"))


@check("rouge_l")
def rouge_l(spark, sf):
    return ev.rouge_l(ev.text_pairs(answer_rows(spark, sf))).select(
        "query_idx", F.round("rougeL_f", 6).alias("rougeL_f"), F.round("rougeLsum_f", 6).alias("rougeLsum_f"))


JUDGE_SQL = """
SELECT query_idx, round(coalesce(avg(s) FILTER (criterion = 'relevancy'), 0.0), 6) AS answer_relevancy_score,
       round(coalesce(avg(s) FILTER (criterion = 'completeness'), 0.0), 6) AS completeness_score,
       round(coalesce(avg(s) FILTER (criterion = 'coherence'), 0.0), 6) AS coherence_score, round(avg(s), 6) AS llm_mean_relevancy
FROM (SELECT user_id AS query_idx, CASE event_id % 3 WHEN 0 THEN 'relevancy' WHEN 1 THEN 'completeness' ELSE 'coherence' END AS criterion,
             least(1.0::DOUBLE, floor(value) / 100) AS s FROM events) GROUP BY 1"""


def judgements(spark, sf):
    kind = F.element_at(F.array(F.lit("relevancy"), F.lit("completeness"), F.lit("coherence")), (F.col("event_id") % 3 + 1).cast("int"))
    return v.table(spark, sf, "events").select(
        F.col("user_id").alias("query_idx"), kind.alias("criterion"),
        F.concat(F.lit("Score "), (F.floor("value") / 100).cast("string"), F.lit(", clear")).alias("raw_judgement"))


@check("judge_scores", JUDGE_SQL)
def judge_scores(spark, sf):
    out = ev.judge_scores(judgements(spark, sf))
    return out.select("query_idx", *[F.round(c, 6).alias(c) for c in out.columns if c != "query_idx"])


REPORT_SQL = f"""
SELECT r.*, m.num_gt_calls, m.num_retrieved, m.recall, m.mean_max_cosine_similarity, m.hit_at_k, m.mrr, b.bleu, g.rouge1_f, g.rouge2_f,
       j.answer_relevancy_score, j.completeness_score, j.coherence_score, j.llm_mean_relevancy
FROM (SELECT query_idx, length(reference) AS expected_chars, length(candidate) AS final_chars FROM answer_pairs) r
LEFT JOIN ({METRICS_DOCS_SQL}) m USING (query_idx) LEFT JOIN ({_bleu_sql()}) b USING (query_idx) LEFT JOIN ({ROUGE_SQL}) g USING (query_idx) LEFT JOIN ({JUDGE_SQL}) j USING (query_idx)"""


def report_rows(spark, sf):
    """The whole report, from a CSV file with list cells to metrics."""
    from callweave.session import fresh_path, materialize
    from callweave.sources import tables as io

    i = F.col("query_idx")
    quoted = lambda *shifts: F.concat(F.lit("['"), F.concat_ws("', '", *[(i + s).cast("string") for s in shifts]), F.lit("']"))
    rows = answer_rows(spark, sf).select(
        "query_idx", F.concat(F.lit("Question "), i.cast("string")).alias("Query"), "Expected_Answer",
        quoted(1, 2).alias("Ground_Truth"), quoted(3, 1, 4).alias("Retrieved_Calls"), "Final_Answer")
    path = fresh_path(spark, "evaluation")
    io.write_csv(rows.drop("query_idx"), path)  # as users have it: five columns by name, no index
    loaded = ev.parsed_lists(ev.with_answer_columns(io.read_evaluation(spark, path)))
    # Every metric reads the questions, so the file is split and parsed once.
    loaded = materialize(loaded.withColumn("query_idx", F.regexp_extract("Query", "([0-9]+)", 1).cast("long")), "questions")
    vectors = v.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("call"), F.col("embedding").alias("vector"))
    truth, retrieved = ev.side_vectors(ev.sides(loaded), vectors)
    pairs = ev.text_pairs(loaded)
    metrics = ev.retrieval_metrics(loaded.select("query_idx"), truth, retrieved, ev.SAMPLE_THRESHOLD, 2)
    return ev.report(loaded, [metrics, ev.bleu(pairs), ev.rouge_n(pairs), ev.rouge_l(pairs), ev.judge_scores(judgements(spark, sf))])


JUDGED = ["answer_relevancy_score", "completeness_score", "coherence_score", "llm_mean_relevancy"]
ROUNDED = ["recall", "mean_max_cosine_similarity", "mrr", "bleu", "rouge1_f", "rouge2_f", *JUDGED]


@check("eval_report", REPORT_SQL, extra=BLEU_CTES + ROUGE_CTES)
def eval_report(spark, sf):
    return report_rows(spark, sf).select(
        "query_idx", F.length("Expected_Answer").cast("long").alias("expected_chars"), F.length("Final_Answer").cast("long").alias("final_chars"),
        "num_gt_calls", "num_retrieved", "hit_at_k", *[F.round(c, 6).alias(c) for c in ROUNDED])


@check("eval_report_rouge_l")
def eval_report_rouge_l(spark, sf):
    """The columns of the report that SQL cannot repeat."""
    return report_rows(spark, sf).select("query_idx", *[F.round(c, 6).alias(c) for c in ("rougeL_f", "rougeLsum_f")])


@check("eval_summary", f"""
SELECT count(*) AS questions, {', '.join(f'round(avg({c}), 5) AS {c}' for c in ROUNDED)} FROM ({REPORT_SQL})""", extra=BLEU_CTES + ROUGE_CTES)
def eval_summary(spark, sf):
    out = ev.summary(report_rows(spark, sf), ROUNDED)
    return out.select("questions", *[F.round(c, 5).alias(c) for c in ROUNDED])
