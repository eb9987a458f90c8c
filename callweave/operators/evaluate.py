"""Retrieval and text metrics of a table of answered questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions import vectors as vx
from ..functions.overlap import lcs_length, union_lcs_hits

# Similarity from which a call counts as found, and the one of the sample run.
MATCH_THRESHOLD, SAMPLE_THRESHOLD = 0.7, 0.25
#: Retrieved vectors that one joined row holds.
PAGE = 64
#: Longest n-gram of BLEU; text pairs whose n-grams are counted at once.
ORDERS, PAIRS = 4, 256


def with_answer_columns(rows: DataFrame) -> DataFrame:
    """Blank answer columns where the input has none."""
    for name in ("Expected_Answer", "Final_Answer"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(""))
    return rows


def parsed_lists(rows: DataFrame) -> DataFrame:
    return rows.withColumn("Ground_Truth", fx.parse_list_cell(F.col("Ground_Truth"))).withColumn(
        "Retrieved_Calls", fx.parse_list_cell(F.col("Retrieved_Calls")))


def sides(rows: DataFrame) -> DataFrame:
    """Ground truth and retrieved calls in one table ``(query_idx, side, pos, call)``."""
    part = lambda name, column: rows.select(
        "query_idx", F.lit(name).alias("side"), F.posexplode(column).alias("pos", "call"))
    return part("ground_truth", "Ground_Truth").unionByName(part("retrieved", "Retrieved_Calls"))


def side_vectors(both: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ground truth and retrieved vectors, looked up by one join; a call without a vector stays, with none."""
    found = both.join(vectors.select(F.col("call"), vx.unit(vx.as_vector("vector")).alias("vector")), "call", "left")
    one = lambda name: found.filter(F.col("side") == name).select("query_idx", "pos", "vector")
    return one("ground_truth"), one("retrieved")


def similarity_rows(truth: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per ground-truth call and page of retrieved ones: the list of similarities.

    Retrieved vectors travel in pages of bounded length, so a question with many calls
    is spread over rows and no list outgrows its row.
    """
    paged = retrieved.groupBy("query_idx", F.floor(F.col("pos") / PAGE).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos").alias("ret_pos"), F.col("vector").alias("v")))).alias("items"))
    return truth.select("query_idx", F.col("pos").alias("gt_pos"), "vector").join(paged, "query_idx").select(
        "query_idx", "gt_pos",
        F.transform("items", lambda r: F.struct(
            r["ret_pos"].alias("ret_pos"), F.coalesce(F.round(vx.dot(r["v"], F.col("vector")), 12), F.lit(0.0)).alias("sim"))).alias("sims"))


def pair_similarity(truth: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The similarity matrix of every question as rows."""
    return similarity_rows(truth, retrieved).select("query_idx", "gt_pos", F.inline("sims"))


def retrieval_metrics(
    queries: DataFrame, truth: DataFrame, retrieved: DataFrame, threshold: float = MATCH_THRESHOLD, k: int | None = None
) -> DataFrame:
    """Recall, mean best similarity, hit@k and reciprocal rank per question.

    A call without a vector is like no other, so it counts as a miss.  Recall and the mean look at all retrieved calls; ``k`` limits hit and rank only.  A
    question without ground truth or without retrieved calls scores 0 everywhere.
    """
    sims = similarity_rows(truth, retrieved)
    best_of_truth = (
        sims.groupBy("query_idx", "gt_pos").agg(F.max(F.array_max(F.transform("sims", lambda s: s["sim"]))).alias("best"))
        .groupBy("query_idx").agg(
            F.avg("best").alias("mean_max_cosine_similarity"),
            F.avg((F.col("best") >= threshold).cast("double")).alias("recall"))
    )
    hit = F.filter("sims", lambda s: (s["sim"] >= threshold) & (F.lit(True) if k is None else s["ret_pos"] < k))
    first = sims.select("query_idx", F.array_min(F.transform(hit, lambda s: s["ret_pos"])).alias("p")).groupBy(
        "query_idx").agg((F.min("p") + 1).alias("first_rank"))
    counts = lambda df, name: df.groupBy("query_idx").agg(F.count("*").alias(name))
    joined = (
        queries.join(counts(truth, "num_gt_calls"), "query_idx", "left")
        .join(counts(retrieved, "num_retrieved"), "query_idx", "left")
        .join(best_of_truth, "query_idx", "left").join(first, "query_idx", "left")
    )
    return joined.select(
        *queries.columns,
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("num_gt_calls", "num_retrieved")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("recall", "mean_max_cosine_similarity")],
        F.col("first_rank").isNotNull().cast("long").alias("hit_at_k"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
    )


# --- text metrics ------------------------------------------------------------------

# The substitutions of the mteval 13a tokeniser.
TOKEN_RULES = [
    (r"-\n", ""), (r"\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    (r"([{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
]


def bleu_tokens(text: Column) -> Column:
    """Tokens by ``TOKEN_RULES``; plain strings are replaced as such, and a blank, which no later rule tells from three, stays one."""
    out = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    for pattern, replacement in TOKEN_RULES:
        if "(" in pattern:
            out = F.regexp_replace(out, pattern.replace(" -&", "!-&"), replacement)
        else:
            out = F.replace(out, F.lit(pattern.replace(r"\n", "\n")), F.lit(replacement))
    return F.filter(F.split(out, r"\s+"), lambda w: w != "")


def rouge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def _matched(batches, orders: int):
    """Clipped matches of the n-grams of two lists of token hashes, a batch of rows at once.

    A gram's name is made of its tokens' hashes and its row, so the grams of all rows are counted together.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    factor, turn = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def tokens(column):
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(lengths)), lengths), lengths

    for whole in batches:
        for at in range(0, whole.num_rows, PAIRS):
            batch = whole.slice(at, PAIRS)
            (c, c_row, n_c), (r, r_row, n_r) = (tokens(batch.column(i)) for i in (1, 2))
            names, out = [c, r], [batch.column(0)]
            for n in range(1, orders + 1):
                if n > 1:
                    names = [x[:-1] * factor + side[n - 1:] if len(x) else x for x, side in zip(names, (c, r))]
                whole_grams = [row[:len(x)] == row[n - 1:][:len(x)] for x, row in zip(names, (c_row, r_row))]
                row_c, row_r = (row[:len(x)][ok] for x, row, ok in zip(names, (c_row, r_row), whole_grams))
                mine, other = (x[ok] + row.astype(np.uint64) * turn for x, row, ok in zip(names, (row_c, row_r), whole_grams))
                known, first, copies = np.unique(other, return_index=True, return_counts=True)
                hits = np.zeros(batch.num_rows, np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    found = np.bincount(place[known[place] == mine], minlength=len(known))
                    np.add.at(hits, row_r[first], np.minimum(found, copies))
                out += [pa.array(x) for x in (hits, np.maximum(n_c - (n - 1), 0), np.maximum(n_r - (n - 1), 0))]
            yield pa.RecordBatch.from_arrays(out, ["query_idx", *(f"{x}{n}" for n in range(1, orders + 1) for x in "mtr")])


def gram_overlap(pairs: DataFrame, orders: int, tokens) -> DataFrame:
    """``m1``, ``t1``, ``r1`` and so on per row of ``pairs``: clipped matches, candidate's and reference's n-grams.

    Both texts stand in one row and are counted there, so nothing is exploded or exchanged.
    """
    hashes = lambda c: F.transform(tokens(F.col(c)), lambda w: F.xxhash64(w)).alias(c)
    counts = ", ".join(f"{x}{n} long" for n in range(1, orders + 1) for x in "mtr")
    rows = pairs.select("query_idx", hashes("candidate"), hashes("reference"))
    return rows.mapInArrow(lambda batches: _matched(batches, orders), f"query_idx {rows.schema['query_idx'].dataType.simpleString()}, {counts}")


def bleu(pairs: DataFrame) -> DataFrame:
    """Sentence BLEU in [0, 1]: effective order, exponential smoothing, brevity penalty; a row per pair."""
    stats = gram_overlap(pairs, ORDERS, bleu_tokens)
    log_sum, order, doubled = F.lit(0.0), F.lit(0), F.lit(1.0)
    for n in range(1, ORDERS + 1):
        m, t = F.col(f"m{n}").cast("double"), F.col(f"t{n}").cast("double")
        doubled = F.when((t > 0) & (m == 0), doubled * 2).otherwise(doubled)
        precision = F.when(m > 0, m / t).otherwise(1.0 / (doubled * t))
        log_sum = log_sum + F.when(t > 0, F.log(precision)).otherwise(0.0)
        order = order + (t > 0).cast("int")
    brevity = F.when(F.col("t1") < F.col("r1"), F.exp(1 - F.col("r1") / F.col("t1"))).otherwise(1.0)
    any_match = sum((F.col(f"m{n}") for n in range(2, ORDERS + 1)), F.col("m1")) > 0
    return stats.select("query_idx", F.when(any_match, brevity * F.exp(log_sum / order)).otherwise(0.0).alias("bleu"))


def _f_measure(matched: Column, candidate: Column, reference: Column) -> Column:
    return F.when(matched > 0, 2.0 * matched / (candidate + reference)).otherwise(0.0)


def rouge_n(pairs: DataFrame) -> DataFrame:
    """ROUGE-1 and ROUGE-2 F-measures, a row per pair."""
    stats = gram_overlap(pairs, 2, rouge_tokens)
    return stats.select("query_idx", *[_f_measure(F.col(f"m{n}"), F.col(f"t{n}"), F.col(f"r{n}")).alias(f"rouge{n}_f") for n in (1, 2)])


def rouge_l(pairs: DataFrame) -> DataFrame:
    """ROUGE-L over whole texts and ROUGE-Lsum over their lines."""
    lines = lambda c: F.filter(
        F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), rouge_tokens), lambda t: F.size(t) > 0)
    tokens = pairs.select(
        "query_idx", rouge_tokens(F.col("candidate")).alias("c"), rouge_tokens(F.col("reference")).alias("r"),
        lines("candidate").alias("cl"), lines("reference").alias("rl"))
    measured = tokens.select(
        "query_idx", F.size("c").alias("nc"), F.size("r").alias("nr"),
        lcs_length()("r", "c").alias("common"), union_lcs_hits()("rl", "cl").alias("hits"))
    return measured.select(
        "query_idx", _f_measure(F.col("common"), F.col("nc"), F.col("nr")).alias("rougeL_f"),
        _f_measure(F.col("hits"), F.col("nc"), F.col("nr")).alias("rougeLsum_f"))


def text_pairs(rows: DataFrame) -> DataFrame:
    return rows.select("query_idx", F.col("Final_Answer").alias("candidate"), F.col("Expected_Answer").alias("reference"))


def judge_scores(judgements: DataFrame) -> DataFrame:
    """Scores of raw judgement texts: one column per criterion, averaged per question."""
    parsed = judgements.withColumn("score", fx.parse_score(F.col("raw_judgement")))
    names = {"relevancy": "answer_relevancy_score", "completeness": "completeness_score", "coherence": "coherence_score"}
    return parsed.groupBy("query_idx").agg(
        *[F.coalesce(F.avg(F.when(F.col("criterion") == c, F.col("score"))), F.lit(0.0)).alias(out) for c, out in names.items()],
        F.avg("score").alias("llm_mean_relevancy"))


def report(rows: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """All metric tables beside the questions, joined on the question index.

    A column that several tables have is taken from the first.
    """
    out = rows
    for part in parts:
        fresh = [c for c in part.columns if c not in out.columns]
        out = out.join(part.select("query_idx", *fresh), "query_idx", "left")
    return out


def summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Corpus means of the metrics."""
    return metrics.agg(F.count("*").alias("questions"), *[F.avg(c).alias(c) for c in columns])
