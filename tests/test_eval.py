"""Evaluation metrics, reports, chats and streams on hand-made cases."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callweave import schema
from callweave.functions.overlap import lcs_length
from callweave.operators import chats, evaluate, questions, reports
from callweave.session import fresh_path
from callweave.sources import tables
from callweave.streaming import chats as streams
from callweave.streaming import corpus as corpus_stream


def pairs(spark, *texts):
    return spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(texts)], "query_idx int, candidate string, reference string")


def test_identical_empty_and_disjoint_texts(spark):
    df = pairs(spark, ("The cat sat on the mat.",) * 2, ("", "words here"), ("alpha", "beta"))
    by = lambda out: {r.query_idx: r for r in out.collect()}
    bleu, rouge, longest = by(evaluate.bleu(df)), by(evaluate.rouge_n(df)), by(evaluate.rouge_l(df))
    assert bleu[0].bleu == pytest.approx(1) and bleu[1].bleu == 0 and bleu[2].bleu == 0
    assert (rouge[0].rouge1_f, rouge[0].rouge2_f, rouge[1].rouge1_f) == (1, 1, 0)
    assert (longest[0].rougeL_f, longest[0].rougeLsum_f, longest[1].rougeL_f) == (1, 1, 0)


def test_bleu_smoothing_and_brevity(spark):
    # 3 of 4 words match, 1 of 3 pairs, no longer n-gram: precisions 3/4, 1/3, 1/(2*2), 1/(4*1).
    got = evaluate.bleu(pairs(spark, ("a b x c", "a b c d e"))).first().bleu
    want = math.exp(1 - 5 / 4) * math.exp((math.log(3 / 4) + math.log(1 / 3) + math.log(1 / 4) + math.log(1 / 4)) / 4)
    assert got == pytest.approx(want)


def test_bleu_tokens(spark):
    got = pairs(spark, ('He said: "1,000.5 re-use" (ok).', "")).select(evaluate.bleu_tokens(F.col("candidate")).alias("t")).first().t
    assert got == ["He", "said", ":", '"', "1,000.5", "re-use", '"', "(", "ok", ")", "."]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_length(spark):
    import random

    rng = random.Random(2)
    rows = [([rng.choice("abcd") for _ in range(rng.randrange(0, 90))], [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").withColumn("n", lcs_length()("a", "b"))
    assert [r.n for r in df.collect()] == [lcs(r.a, r.b) for r in df.collect()]


def test_rouge_lsum_joins_lines(spark):
    # Line 1 is covered by both candidate lines together, line 2 not at all.
    out = evaluate.rouge_l(pairs(spark, ("w1 w2\nw5 w4", "w1 w2 w3 w4 w5\nw9"))).first()
    assert out.rougeLsum_f == pytest.approx(2 * (3 / 6) * (3 / 4) / (3 / 6 + 3 / 4))


def test_retrieval_metrics_edges(spark):
    vec = lambda *rows: spark.createDataFrame(list(rows), "query_idx int, pos int, vector array<double>")
    queries = spark.createDataFrame([(i,) for i in range(4)], "query_idx int")
    x, y, z = [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]
    truth = vec((0, 0, x), (0, 1, y), (1, 0, x), (3, 0, x))
    retrieved = vec((0, 0, z), (0, 1, x), (2, 0, x), (3, 0, z), (3, 1, z), (3, 2, x))
    out = {r.query_idx: r for r in evaluate.retrieval_metrics(queries, truth, retrieved, 0.7, k=2).collect()}
    assert (out[0].recall, out[0].mean_max_cosine_similarity, out[0].hit_at_k, out[0].mrr) == (0.5, 0.5, 1, 0.5)
    assert (out[1].num_gt_calls, out[1].num_retrieved, out[1].recall, out[1].mrr) == (1, 0, 0, 0)
    assert (out[2].num_gt_calls, out[2].num_retrieved, out[2].hit_at_k) == (0, 1, 0)
    assert (out[3].recall, out[3].hit_at_k, out[3].mrr) == (1, 0, 0)  # found, but behind k
    assert evaluate.retrieval_metrics(queries, truth, retrieved, 0.7).filter("query_idx = 3").first().mrr == pytest.approx(1 / 3)


def test_cluster_breakdown_of_the_worked_example(spark):
    sizes = [("a", 150), ("a", 80), ("a", 60), ("b", 200), ("b", 100), ("b", 50), ("c", 40), ("c", 30)]
    l2 = spark.createDataFrame([(f"x{i}", p, i, f"n{i}", n) for i, (p, n) in enumerate(sizes)],
                               "id string, parent_id string, pos long, name string, member_count long")
    hit = l2.select(F.lit("q").alias("query_id"), F.col("id").alias("l2_id"))
    out = reports.cluster_breakdown(l2, hit).orderBy("child_start").collect()
    assert out[-1].child_end == pytest.approx(360) and out[-1].parent_end == pytest.approx(360)
    assert [r.l2_id for r in out] == [f"x{i}" for i in range(8)]
    assert all(a.child_end == pytest.approx(b.child_start) for a, b in zip(out, out[1:]))
    assert [round(r.alpha, 2) for r in out] == [0.4, 0.55, 0.7, 0.4, 0.55, 0.7, 0.4, 0.7]
    bubbles = {r.l2_id: (r.radius, r.parent_members) for r in reports.bubble_sizes(l2, hit).collect()}
    assert bubbles["x3"] == (math.sqrt(200), 350)


def test_driver_reports_fill_zeros_and_count_calls_once(spark):
    hits = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "a"), ("3", "b")], "transcript_id string, driver string")
    got = spark.createDataFrame([("q", "1"), ("q", "3")], "query_id string, transcript_id string")
    wanted = spark.createDataFrame([("q", "a"), ("q", "c")], "query_id string, driver string")
    assert {tuple(r) for r in reports.driver_frequency(hits, got, wanted).collect()} == {("q", "a", 2, 1), ("q", "c", 0, 0)}
    assert {tuple(r) for r in reports.driver_call_counts(hits, got, wanted).collect()} == {("q", "a", 1)}


def test_unreadable_generations(spark):
    rows = spark.createDataFrame([("a", '{"question": "1. Why?", "ground_truth": "x"}', "{}"), ("b", "sorry", "{}")],
                                 "cluster_id string, generation string, labels string")
    assert [r.cluster_id for r in questions.cleaned_questions(rows).collect()] == ["a"]
    with pytest.raises(Exception, match="unreadable generation"):
        questions.cleaned_questions(rows, strict=True).collect()


T0 = datetime(2024, 1, 1)


def message_rows(spark, rows):
    return spark.createDataFrame(
        [(f"m{i}", c, r, f"text {i}", None, None, None, T0 + timedelta(minutes=m)) for i, c, r, m in rows], schema.MESSAGE)


def test_append_and_delete(spark):
    chat_rows = spark.createDataFrame([("c1", "New Chat", T0, T0), ("c2", "Old", T0, T0)], schema.CHAT)
    stored = message_rows(spark, [(0, "c2", "user", 1)])
    incoming = message_rows(spark, [(0, "c2", "user", 1), (1, "c1", "user", 5), (2, "c1", "system", 6), (3, "c2", "user", 7)])
    after, messages = chats.append_messages(chat_rows, stored, incoming)
    assert {(r.id, r.title, r.updated_at) for r in after.collect()} == {
        ("c1", "text 1", T0 + timedelta(minutes=5)), ("c2", "Old", T0 + timedelta(minutes=7))}
    assert {r.id for r in messages.collect()} == {"m0", "m1", "m3"}
    kept, rest = chats.cascade_delete(chat_rows, messages, spark.createDataFrame([("c2",)], "chat_id string"))
    assert [r.id for r in kept.collect()] == ["c1"] and [r.id for r in rest.collect()] == ["m1"]


def test_history_stream_sorts_late_messages(spark):
    source, path, checkpoint = (fresh_path(spark, n) for n in ("in", "history", "checkpoint"))
    first = message_rows(spark, [(i, "c", "user", i) for i in range(10, 30)])
    late = message_rows(spark, [(5, "c", "user", 5), (99, "c", "assistant", 28), (31, "c", "user", 31)])
    first.write.parquet(source)
    streams.update_history(spark, source, path, checkpoint, n=4)
    late.write.mode("append").parquet(source)
    out = streams.update_history(spark, source, path, checkpoint, n=4)
    want = [r.id for r in chats.recent_history(first.unionByName(late), 4).orderBy("place").collect()]
    assert [r.id for r in out.orderBy("place").collect()] == want == ["m28", "m99", "m29", "m31"]


def test_graph_stream_adds_only_new_edges(spark):
    source, path, checkpoint = (fresh_path(spark, n) for n in ("in", "edges", "checkpoint"))
    call = lambda tid, *drivers: {"transcript_id": tid, "domain": "Hotel", "intent": "Stay", "metadata": {
        "predefined_interaction_drivers": [{"driver": d} for d in drivers]}}
    spark.createDataFrame([call("a", "x"), call("b", "x", "y")], schema.CALL).write.json(source)
    corpus_stream.update_graph(spark, source, path, checkpoint)
    known = {tuple(r) for r in corpus_stream.stored_edges(spark, path).collect()}
    spark.createDataFrame([call("a", "x", "z"), call("c")], schema.CALL).write.mode("append").json(source)
    corpus_stream.update_graph(spark, source, path, checkpoint)
    edges = [tuple(r) for r in corpus_stream.stored_edges(spark, path).collect()]
    assert len(edges) == len(set(edges)) == 10
    assert {e for e in set(edges) - known if e[1] == "HAS_DRIVER"} == {("a", "HAS_DRIVER", "z")}


def test_corpus_stream_takes_calls_of_any_age_once(spark):
    source, target, checkpoint = (fresh_path(spark, n) for n in ("in", "corpus", "checkpoint"))
    call = lambda tid, day: {"transcript_id": tid, "timestamp": datetime(2024, 1, day)}
    spark.createDataFrame([call("new", 30), call("new", 30)], schema.CALL).write.json(source)
    corpus_stream.append_corpus(spark, source, target, checkpoint)
    spark.createDataFrame([call("old", 1), call("new", 30), call("older", 2)], schema.CALL).write.mode("append").json(source)
    corpus_stream.append_corpus(spark, source, target, checkpoint)
    stored = spark.read.schema(schema.CALL).parquet(target).collect()
    assert sorted(r.transcript_id for r in stored) == ["new", "old", "older"]


def test_metrics_count_calls_without_vectors_and_files_without_index(spark):
    rows = spark.createDataFrame([("Q", "['1', '9']", "['1']", "a b")], ["Query", "Ground_Truth", "Retrieved_Calls", "Final_Answer"])
    path = fresh_path(spark, "evaluation")
    tables.write_csv(rows, path)
    loaded = evaluate.parsed_lists(evaluate.with_answer_columns(tables.read_evaluation(spark, path)))
    first = loaded.first()
    assert (first.Query, first.Final_Answer, first.Expected_Answer, first.Retrieved_Calls) == ("Q", "a b", "", ["1"])
    vectors = spark.createDataFrame([("1", [1.0, 0.0])], "call string, vector array<double>")
    out = evaluate.retrieval_metrics(loaded.select("query_idx"), *evaluate.side_vectors(evaluate.sides(loaded), vectors)).first()
    assert (out.num_gt_calls, out.num_retrieved, out.recall, out.mrr) == (2, 1, 0.5, 1.0)


def test_gram_matches_are_multiset_intersections(spark):
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    rng = random.Random(6)
    side = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))
    rows = [(i, side(), side()) for i in range(200)] + [(900, "a a a a", "a a"), (901, None, "a"), (902, "", ""), (903, "a b " * 500, "b a " * 700)]
    pairs = spark.createDataFrame(rows, "query_idx long, candidate string, reference string")
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")
    got = {r.query_idx: r for r in evaluate.gram_overlap(pairs, 3, split).collect()}
    for i, c, r in rows:
        c, r = (c or "").split(), r.split()
        for n in (1, 2, 3):
            a, b = (Counter(tuple(x[k:k + n]) for k in range(len(x) - n + 1)) for x in (c, r))
            assert (got[i][f"m{n}"], got[i][f"t{n}"], got[i][f"r{n}"]) == ((a & b).total(), a.total(), b.total())


def test_bleu_tokens_follow_the_rules(spark):
    import re

    texts = ['a-\nb &quot;x&quot; &amp;lt; 5-6 3.5 3., .5,. a.b,c', '  ..  ,, - "(x)" {y}~ [z]_` $5 #1 %&+ 7- -7 : ; <=> ?@ / end.', "ä. ö,ü\t\x0bq  -\n\n", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in rows.select("t", evaluate.bleu_tokens(F.col("t")).alias("got")).collect():
        out = f" {r.t or ''} "
        for pattern, replacement in evaluate.TOKEN_RULES:
            out = re.sub(pattern, replacement.replace("$", "\\"), out)
        assert r.got == re.split(r"[ \t\n\x0b\f\r]+", out.strip(" \t\n\x0b\f\r")) or (r.got == [] and not out.strip())


def test_grams_of_a_batch_are_counted_together(spark):
    from collections import Counter

    import numpy as np

    rng = np.random.default_rng(2)
    texts = [tuple(" ".join(rng.choice(list("abcd"), rng.integers(0, 30))) for _ in range(2)) for _ in range(300)]
    pairs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "query_idx long, candidate string, reference string").coalesce(1)
    counted = evaluate.gram_overlap(pairs, 4, lambda c: F.filter(F.split(c, " "), lambda w: w != ""))
    assert "MapInArrow" in counted._jdf.queryExecution().optimizedPlan().toString()
    for r in counted.collect():
        for n in range(1, 5):
            c, x = (Counter(tuple(t.split()[i:i + n]) for i in range(len(t.split()) - n + 1)) for t in texts[r.query_idx])
            assert (r[f"m{n}"], r[f"t{n}"], r[f"r{n}"]) == (sum((c & x).values()), sum(c.values()), sum(x.values()))


def test_the_report_reads_its_file_once(spark):
    from checks import eval_checks

    plan = eval_checks.report_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "csv" not in plan.lower()
