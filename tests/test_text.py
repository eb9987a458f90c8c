"""Text helpers, dialogue pairs and scans, with the worked examples."""

import pytest
from pyspark.sql import functions as F

from callweave.functions import text as fx
from callweave.operators import dialogue, scan, taxonomy
from callweave.plans import retrieve


def values(spark, rows, fn, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, t {kind}")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_scores(spark):
    got = values(spark, ["0.8, good", "Score: 7", "none", None, "-3 then 0.5", "1e-1", "1d 0.25"], fx.parse_score)
    assert got == [0.8, 1.0, 0.0, 0.0, 0.0, 0.1, 0.25]


def test_list_cells(spark):
    cells = ["['a', 'b']", '["x, y"]', " plain ", None, "[broken", "[]", "12"]
    assert values(spark, cells, fx.parse_list_cell) == [["a", "b"], ["x, y"], ["plain"], [], ["[broken"], [], ["12"]]
    assert values(spark, ["5.0", "012", "['7', 'x1']", None], fx.clean_tid_list) == [["5"], ["12"], ["7", "x1"], []]


def test_cleaning(spark):
    raw = ["- ﬁne ​text 😀", "```json```", "•  item", None, " ½ ", "a - b"]
    assert values(spark, raw, fx.clean_response) == ["fine text", "json", "item", "", "1⁄2", "a - b"]
    assert values(spark, ["12. • Why?  ", "-3 a", "plain"], fx.clean_question) == ["Why?", "a", "plain"]


def test_titles_footers_and_json(spark):
    assert values(spark, ["x" * 40, "y" * 41], fx.chat_title) == ["x" * 40, "y" * 40 + "..."]
    assert values(spark, ["a\n\n---\nb\n\n---\nc", "a\nb"], fx.strip_footer) == ["a\n\n---\nb", "a\nb"]
    assert values(spark, ['Sure: [{"id": 1}, [2]] ok', "none"], fx.extract_json_array) == ['[{"id": 1}, [2]]', None]
    assert values(spark, ['{"hop": "multi-hop"}', "broken", None], lambda t: fx.json_field(t, "hop", "single-hop")) == [
        "multi-hop", "single-hop", "single-hop"]


def test_splitting(spark):
    assert values(spark, ["why a and why b", "x; then y or z", "sand and", "android band", ""], fx.sub_questions) == [
        ["why a", "why b"], ["x", "y", "z"], ["sand and"], ["android band"], [""]]
    df = spark.createDataFrame([(1, "a and b and c")], "id int, question string")
    hops = retrieve.split_questions(df).orderBy("hop_id").collect()
    assert [(h.hop_id, h.sub_query, h.depends_on) for h in hops] == [(1, "a", None), (2, "b", 1), (3, "c", 2)]


def test_call_string(spark):
    row = spark.createDataFrame(
        [("Retail", None, "refund", [([("Agent", "Hi"), ("Customer", "No")], (-0.3, "negative")), ([("Agent", "Bye")], None)])],
        "d string, i string, r string, t array<struct<conversation:array<struct<speaker:string,utterance:string>>,"
        "sentiment:struct<score:double,label:string>>>")
    out = row.select(fx.call_string(*[F.col(c) for c in "dirt"]).alias("s"), fx.preview(F.col("t")).alias("p")).first()
    assert out.s == ("domain: Retail\nintent: \nreason_for_call: refund\n\nturn 0: Agent: Hi | Customer: No [sentiment_score=-0.3 "
                     "label=negative]\nturn 1: Agent: Bye [sentiment_score=None label=None]")
    assert out.p == "Agent: Hi | Customer: No | Agent: Bye"
    floats = [0.1, 1.0, -1.0, 0.0005, 0.00012, 2e-05, None]
    assert values(spark, floats, fx.python_float, "double") == [str(f) for f in floats]


def greedy_pairs(speakers):
    pairs, open_speaker, number = [], None, -1
    for speaker in speakers:
        if open_speaker is not None and speaker != open_speaker:
            pairs.append(number)
            open_speaker = None
        else:
            number += 1
            pairs.append(number)
            open_speaker = speaker
    return pairs


@pytest.mark.parametrize("block", [3, 4096])
def test_dialogue_pairs(spark, block):
    calls = {"agent_first": "ACAC", "customer_first": "CACA", "repeat": "CCAC", "odd": "ACA", "runs": "AACCCACAACACCA", "one": "A"}
    rows = [(name, i, s) for name, speakers in calls.items() for i, s in enumerate(speakers)]
    df = spark.createDataFrame(rows, "transcript_id string, utterance_idx long, speaker string")
    out = dialogue.dialogue_pairs(df, block_rows=block).orderBy("utterance_idx").collect()
    for name, speakers in calls.items():
        assert [r.pair_index for r in out if r.transcript_id == name] == greedy_pairs(speakers), name


def test_positions_and_pages_of_a_hot_group(spark):
    # Keep the range partitions apart that would be merged for being small.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot_group(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def hot_group(spark):
    rows = [("hot", (i * 7919) % 5000) for i in range(5000)] + [("cold", 1), ("cold", 0)]
    df = spark.createDataFrame(rows, "k string, at long")
    out = scan.positions(scan.range_blocks(df, ["k", "at"]), ["k"], [F.col("at")])
    assert out.filter("position <> at + 1").count() == 0 and out.count() == 5002
    assert out.select("block").distinct().count() > 1
    paged = scan.pages(df, ["k"], ["at"], F.col("at"), 1000, "items").orderBy("k", "page").collect()
    assert [(r.k, r.page, len(r["items"])) for r in paged] == [("cold", 0, 2)] + [("hot", p, 1000) for p in range(5)]
    assert [x for r in paged if r.k == "hot" for x in r["items"]] == list(range(5000))


def test_field_text_and_metadata(spark):
    from callweave import schema

    meta = {"completed_fields": {"domain": "Retail"}, "call_summary": "sum", "outcome": "",
            "predefined_interaction_drivers": [{"driver": "d"}],
            "identified_interaction_drivers": [{"keyword": "a_b"}, {"keyword": "c"}]}
    rows = [{"transcript_id": "t", "reason_for_call": "why", "metadata": meta}, {"transcript_id": "", "reason_for_call": "x"}]
    calls = spark.createDataFrame(rows, schema.CALL)
    text = {f: [r.text for r in dialogue.field_text(calls, f).collect()] for f in ("summary", "outcome", "keywords", "reason_for_call")}
    assert text == {"summary": ["sum"], "outcome": [], "keywords": ["a_b, c"], "reason_for_call": ["why"]}
    assert calls.filter("transcript_id = 't'").select(dialogue.five_key_metadata(F.col("metadata")).alias("v")).first().v is True


def test_rules(spark):
    known = spark.createDataFrame([("good", "positive"), ("bad", "negative"), ("any", "neutral")], "label string, polarity string")
    drivers = spark.createDataFrame([(d, s) for d in ("good", "bad", "any") for s in (-0.5, -0.1, 0.1, 0.5)], "driver string, score double")
    kept = {(r.driver, r.score) for r in dialogue.polarity_gate(drivers, known).collect()}
    assert kept == {("good", s) for s in (-0.1, 0.1, 0.5)} | {("bad", s) for s in (-0.5, -0.1, 0.1)} | {("any", s) for s in (-0.5, -0.1, 0.1, 0.5)}
    ten = " ".join(["word"] * 10)
    cases = [("a_b", ten, True), ("a_1", ten, False), ("A_b", ten, False), ("a_b", "short", False), ("a_b", ten + " x" * 11, False)]
    df = spark.createDataFrame([c[:2] for c in cases], "k string, d string")
    assert [r.v for r in df.select(dialogue.keyword_valid(F.col("k"), F.col("d")).alias("v")).collect()] == [c[2] for c in cases]


def test_taxonomy_file_and_matching(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_text("DOMAIN CLASSIFICATION INTENTS\n- hotel_domain — Hotels.\n\n## Retail Domain\n- **refund_request** — Refunds.\nnot a label\n")
    labels = taxonomy.read_taxonomy(spark, str(path))
    assert {tuple(r) for r in labels.collect()} == {
        ("hotel_domain", "DOMAIN CLASSIFICATION INTENTS", "Hotels.", "domain"), ("refund_request", "Retail Domain", "Refunds.", "content")}
    questions = spark.createDataFrame([(1, "Why hotel refund requests?"), (2, "nothing")], "query_id int, text string")
    found = taxonomy.with_default(taxonomy.match_intents(questions, labels), questions).orderBy("query_id", "priority").collect()
    assert [(r.query_id, r.label, r.score) for r in found] == [
        (1, "hotel_domain", 1.0), (1, "refund_request", 1.0), (2, taxonomy.NO_INTENT, 0.0)]
