"""Text rendering, cleaning, list cells, dialogue pairs and enrichment rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import text as fx
from callweave.operators import dialogue, graph, taxonomy

from . import views as v
from .registry import check, view


@check("graph_records", """
SELECT c.transcript_id, c.part, coalesce(c.domain, 'Unknown') AS domain, coalesce(c.intent, 'Unknown') AS reason,
       coalesce((SELECT string_agg(d.driver, '|' ORDER BY d.utterance_idx) FROM conv_drivers d
        WHERE d.transcript_id = c.transcript_id AND d.part = c.part), '') AS drivers
FROM conv_calls c""")
def graph_records(spark, sf):
    calls = v.calls_conv(spark, sf)
    records = graph.graph_records(calls.withColumn("transcript_id", F.struct("transcript_id", "part")))
    return records.select("transcript_id.transcript_id", "transcript_id.part", "domain", "reason",
                          F.array_join("drivers", "|").alias("drivers"))


@check("nested_graph_edges", """
SELECT DISTINCT transcript_id, 'IN_DOMAIN' AS edge, coalesce(domain, 'Unknown') AS target FROM conv_calls
UNION SELECT transcript_id, 'HAS_REASON', coalesce(intent, 'Unknown') FROM conv_calls
UNION SELECT transcript_id, 'HAS_DRIVER', driver FROM conv_drivers""")
def nested_graph_edges(spark, sf):
    return graph.record_edges(graph.graph_records(v.calls_conv(spark, sf)))


@check("call_string", r"""
SELECT c.transcript_id, c.part,
  'domain: ' || coalesce(c.domain, '') || chr(10) || 'intent: ' || coalesce(c.intent, '') || chr(10)
  || 'reason_for_call: ' || coalesce(c.reason_for_call, '') || chr(10) || chr(10) || t.lines AS call_text
FROM conv_calls c JOIN (
  SELECT transcript_id, part, string_agg('turn ' || utterance_idx || ': ' || speaker || ': ' || utterance
    || ' [sentiment_score=' || score || ' label=' || CASE WHEN score < 0 THEN 'negative' ELSE 'positive' END || ']',
    chr(10) ORDER BY utterance_idx) AS lines FROM turns_conv GROUP BY 1, 2) t USING (transcript_id, part)""")
def call_string(spark, sf):
    return v.calls_conv(spark, sf).select(
        "transcript_id", "part",
        fx.call_string(F.col("domain"), F.col("intent"), F.col("reason_for_call"), F.col("turns")).alias("call_text"),
    )


@check("preview", """
SELECT transcript_id, part, string_agg(speaker || ': ' || utterance, ' | ' ORDER BY utterance_idx) AS preview
FROM turns_conv GROUP BY 1, 2""")
def preview(spark, sf):
    return v.calls_conv(spark, sf).select("transcript_id", "part", fx.preview(F.col("turns")).alias("preview"))


@check("extract_field", """
SELECT transcript_id, part, 'summary' AS field, call_summary AS text FROM conv_calls WHERE call_summary <> ''
UNION ALL SELECT transcript_id, part, 'outcome', outcome FROM conv_calls WHERE outcome <> ''
UNION ALL SELECT transcript_id, part, 'reason_for_call', reason_for_call FROM conv_calls WHERE reason_for_call <> ''
UNION ALL SELECT transcript_id, part, 'keywords', string_agg(keyword, ', ' ORDER BY utterance_idx)
  FROM conv_drivers WHERE keyword <> '' GROUP BY 1, 2""")
def extract_field(spark, sf):
    calls = v.calls_conv(spark, sf).withColumn("transcript_id", F.concat_ws("#", "transcript_id", "part"))
    out = None
    for field in ("summary", "outcome", "keywords", "reason_for_call"):
        rows = dialogue.field_text(calls, field)
        out = rows if out is None else out.unionByName(rows)
    key = F.split("transcript_id", "#")
    return out.select(key[0].alias("transcript_id"), key[1].cast("long").alias("part"), "field", "text")


@check("complete_fields", """
SELECT transcript_id, part, domain, 'Filled' AS completed_domain, coalesce(domain, 'Filled') AS domain_filled,
       coalesce(intent, intent) AS intent_filled, coalesce(reason_for_call, call_summary) AS reason_filled
FROM conv_calls""")
def complete_fields(spark, sf):
    calls = v.calls_conv(spark, sf).withColumn("transcript_id", F.concat_ws("#", "transcript_id", "part"))
    key = F.split("transcript_id", "#")
    return dialogue.complete_fields(calls).select(
        key[0].alias("transcript_id"), key[1].cast("long").alias("part"), "domain", "completed_domain",
        "domain_filled", "intent_filled", "reason_filled")


@check("metadata_keys", """
SELECT transcript_id, part, (call_summary IS NOT NULL AND outcome IS NOT NULL) AS five_keys FROM conv_calls""")
def metadata_keys(spark, sf):
    return v.calls_conv(spark, sf).select(
        "transcript_id", "part", dialogue.five_key_metadata(F.col("metadata")).alias("five_keys"))


view("pairs_conv", """
SELECT transcript_id, utterance_idx, speaker,
       dense_rank() OVER (PARTITION BY transcript_id ORDER BY run, pos // 2) - 1 AS pair_index
FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, run ORDER BY utterance_idx) - 1 AS pos
      FROM (SELECT *, sum(same) OVER (PARTITION BY transcript_id ORDER BY utterance_idx) AS run
            FROM (SELECT transcript_id, utterance_idx, speaker,
                         CASE WHEN speaker = lag(speaker) OVER (PARTITION BY transcript_id ORDER BY utterance_idx)
                              THEN 1 ELSE 0 END AS same FROM spoken)))""")


def pairs_conv(spark, sf):
    rows = v.turns_conv(spark, sf).filter("speaker <> 'System'").select("transcript_id", "utterance_idx", "speaker")
    return dialogue.dialogue_pairs(rows)


@check("dialogue_pairs", "SELECT * FROM pairs_conv")
def dialogue_pairs(spark, sf):
    return pairs_conv(spark, sf)


@check("normalize_calls", r"""
SELECT transcript_id, utterance_idx - min(utterance_idx) OVER (PARTITION BY transcript_id, part) AS utterance_idx,
       part, speaker, utterance FROM turns_conv""")
def normalize_calls(spark, sf):
    nested = v.calls_conv(spark, sf)
    empty = nested.schema["turns"].dataType.simpleString()
    said = F.flatten(F.transform("turns", lambda t: t["conversation"]))
    flat = nested.select(
        F.concat_ws("#", "transcript_id", "part").alias("transcript_id"),
        F.lit(None).cast(empty).alias("turns"),
        F.transform(said, lambda u: F.struct(u["speaker"].alias("speaker"), u["utterance"].alias("text"))).alias("dialogue"),
        F.lit(None).cast("struct<score:double,label:string>").alias("sentiment"),
    )
    rows = dialogue.utterances(dialogue.one_shape(flat))
    key = F.split("transcript_id", "#")
    return rows.select(key[0].alias("transcript_id"), key[1].cast("long").alias("part"),
                       "utterance_idx", "speaker", "utterance")


@check("uncovered_pairs", """
SELECT DISTINCT transcript_id, pair_index FROM pairs_conv
EXCEPT SELECT transcript_id, pair_index FROM pairs_conv WHERE speaker = 'Agent'""")
def uncovered_pairs(spark, sf):
    pairs = pairs_conv(spark, sf)
    return dialogue.uncovered_pairs(pairs, pairs.filter("speaker = 'Agent'"))


@check("dedupe_drivers", """
SELECT DISTINCT user_id AS transcript_id, cast(hour(ts) AS BIGINT) AS pair_index, event_type AS driver FROM events""")
def dedupe_drivers(spark, sf):
    rows = v.table(spark, sf, "events").select(
        F.col("user_id").alias("transcript_id"), F.hour("ts").cast("long").alias("pair_index"),
        F.col("event_type").alias("driver"))
    return dialogue.dedupe_drivers(rows)


# The polarity given to the five event types in this check.
POLARITY = {"purchase": "positive", "signup": "positive", "error": "negative", "click": "neutral", "view": "neutral"}


@check("polarity_gate", f"""
SELECT event_id, driver, score, polarity FROM (
  SELECT event_id, event_type AS driver, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 50)) AS score,
         CASE event_type {' '.join(f"WHEN '{k}' THEN '{p}'" for k, p in POLARITY.items())} END AS polarity FROM events)
WHERE polarity = 'neutral' OR score BETWEEN -0.1 AND 0.1 OR (score < -0.1 AND polarity = 'negative')
   OR (score > 0.1 AND polarity = 'positive')""")
def polarity_gate(spark, sf):
    rows = v.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("driver"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 50)).alias("score"))
    known = spark.createDataFrame(list(POLARITY.items()), "label string, polarity string")
    return dialogue.polarity_gate(rows, known).select("event_id", "driver", "score", "polarity")


@check("keyword_validity", r"""
SELECT doc_id, regexp_full_match(source, '[a-z]+(_[a-z]+)*')
       AND len(list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')) BETWEEN 10 AND 20 AS valid
FROM documents""")
def keyword_validity(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id", dialogue.keyword_valid(F.col("source"), F.col("text")).alias("valid"))


@check("taxonomy_check", """
SELECT l_partkey AS part, label, label IN (SELECT lower(p_type) FROM part) AS known FROM (
  SELECT l_partkey, lower(c_mktsegment) AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
  UNION SELECT p_partkey, lower(p_type) FROM part)""")
def taxonomy_check(spark, sf):
    part = v.table(spark, sf, "part")
    segments = (
        v.table(spark, sf, "lineitem").join(v.table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
        .join(v.table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
        .select(F.col("l_partkey").alias("part"), F.lower("c_mktsegment").alias("label"))
    )
    types = part.select(F.col("p_partkey").alias("part"), F.lower("p_type").alias("label"))
    labels = segments.unionByName(types).distinct()
    return dialogue.taxonomy_check(labels, types)


@check("clean_question", r"""
SELECT event_id, regexp_replace(ltrim(event_id || '. - ' || chr(8226) || ' ' || event_type || ' ?  ',
       '0123456789.-' || chr(8226) || ' '), '^\s+|\s+$', '', 'g') AS question FROM events""")
def clean_question(spark, sf):
    raw = F.concat(F.col("event_id").cast("string"), F.lit(". - • "), "event_type", F.lit(" ?  "))
    return v.table(spark, sf, "events").select("event_id", fx.clean_question(raw).alias("question"))


@check("clean_response", r"""
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(
    CASE role WHEN 'assistant' THEN '- ' || text WHEN 'user' THEN '```' || text || '``` ' || chr(128512) ELSE text || chr(8203) END),
    '[' || chr(8203) || chr(8204) || chr(8205) || chr(65279) || ']', '', 'g'), '`{1,3}', '', 'g'),
    '^[•●◦▪▫➤►➡✦—–-]\s*|' || chr(128512), '', 'g').regexp_replace('^\s+|\s+$', '', 'g') AS answer
FROM conversations""")
def clean_response(spark, sf):
    text = F.col("text")
    raw = (
        F.when(F.col("role") == "assistant", F.concat(F.lit("- "), text))
        .when(F.col("role") == "user", F.concat(F.lit("```"), text, F.lit("``` \U0001F600")))
        .otherwise(F.concat(text, F.lit("​")))
    )
    return v.table(spark, sf, "conversations").select("conv_id", "turn", fx.clean_response(raw).alias("answer"))


view("cells", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '[''' || p_brand || ''', ''' || p_name || ''']'
  WHEN 'SMALL' THEN '  ' || p_name || ' ' WHEN 'LARGE' THEN cast(p_size AS VARCHAR)
  WHEN 'PROMO' THEN cast(p_size AS VARCHAR) || '.0' WHEN 'STANDARD' THEN '[' || p_name END AS cell FROM part""")
LIST_SQL = """CASE WHEN cell IS NULL THEN [] WHEN cell LIKE '[%]' THEN regexp_extract_all(cell, '''([^'']*)''', 1)
  ELSE [trim(cell)] END"""


def cells(spark, sf):
    size, kind = F.col("p_size").cast("string"), F.col("p_type")
    cell = (
        F.when(kind == "ECONOMY", F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_name", F.lit("']")))
        .when(kind == "SMALL", F.concat(F.lit("  "), "p_name", F.lit(" ")))
        .when(kind == "LARGE", size).when(kind == "PROMO", F.concat(size, F.lit(".0")))
        .when(kind == "STANDARD", F.concat(F.lit("["), "p_name"))
    )
    return v.table(spark, sf, "part").select("p_partkey", cell.alias("cell"))


@check("parse_list_cell", f"""
SELECT p_partkey, len(items) AS n, array_to_string(items, '|') AS items, array_to_string(items, ' ') AS joined
FROM (SELECT p_partkey, {LIST_SQL} AS items FROM cells)""")
def parse_list_cell(spark, sf):
    items = fx.parse_list_cell(F.col("cell"))
    return cells(spark, sf).select("p_partkey", F.size(items).cast("long").alias("n"),
                                   F.array_join(items, "|").alias("items"), fx.join_list_cell(items).alias("joined"))


@check("clean_tid_list", f"""
SELECT p_partkey, array_to_string(list_transform(items, lambda x: regexp_replace(x, '^(\\d+)\\.\\d+$', '\\1')), '|') AS ids
FROM (SELECT p_partkey, {LIST_SQL} AS items FROM cells)""")
def clean_tid_list(spark, sf):
    return cells(spark, sf).select("p_partkey", F.array_join(fx.clean_tid_list(F.col("cell")), "|").alias("ids"))


@check("parse_score", """
SELECT event_id, least(1.0::DOUBLE, cast(cast(floor(value) / 10 AS VARCHAR) AS DOUBLE)) AS score FROM events""")
def parse_score(spark, sf):
    shown = (F.floor("value") / 10).cast("string")
    raw = F.concat("event_type", F.lit(": "), shown, F.lit(", fine 0.9"))
    return v.table(spark, sf, "events").select("event_id", fx.parse_score(raw).alias("score"))


@check("extract_json_array", r"""
SELECT o_orderkey, '[{"id": 1, "text": "' || o_orderpriority || '"}]' AS array_text, o_orderpriority AS first_text FROM orders""")
def extract_json_array(spark, sf):
    raw = F.concat(F.lit('Sure! ```json\n[{"id": 1, "text": "'), "o_orderpriority", F.lit('"}]\n``` done'))
    found = fx.extract_json_array(raw)
    return v.table(spark, sf, "orders").select(
        "o_orderkey", found.alias("array_text"),
        F.get_json_object(found, "$[0].text").alias("first_text"))


@check("labels_with_defaults", """
SELECT event_id, coalesce(props->>'$.k', 'easy') AS difficulty, coalesce(props->>'$.hop', 'single-hop') AS hop,
       'customer' AS target, 'action' AS cause_type FROM events""")
def labels_with_defaults(spark, sf):
    props = F.regexp_replace("props", '"k"', '"difficulty"')
    return v.table(spark, sf, "events").select(
        "event_id", *[fx.json_field(props, name, default).alias(name) for name, default in taxonomy.LABEL_DEFAULTS.items()])


@check("split_query", r"""
SELECT conv_id, turn, hop_id, sub_query, CASE WHEN hop_id > 1 THEN hop_id - 1 END AS depends_on FROM (
  SELECT conv_id, turn, unnest(range(1, len(parts) + 1)) AS hop_id, unnest(parts) AS sub_query FROM (
    SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN p ELSE [text] END AS parts FROM (
      SELECT conv_id, turn, text, list_filter(list_transform(
        string_split_regex(text, '(?i)\s*;\s*(?:(?:and|then|or)\s+)*|\s+(?:(?:and|then|or)\s+)+'),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM conversations)))""")
def split_query(spark, sf):
    from callweave.plans.retrieve import split_questions

    rows = v.table(spark, sf, "conversations").withColumnRenamed("text", "question")
    return split_questions(rows, "question").select("conv_id", "turn", "hop_id", "sub_query", "depends_on")


view("named_taxonomy", "SELECT DISTINCT lower(p_type) || '_' || split_part(p_name, ' ', 2) AS label, 'content' AS kind FROM part")


@check("match_intents", """
SELECT p_partkey AS query_id, label, score, cast(row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, label) AS BIGINT) AS priority
FROM (SELECT p_partkey, label, count(*) / 2.0::DOUBLE AS score
      FROM (SELECT DISTINCT p_partkey, rtrim(unnest(string_split(lower(p_name || ' ' || p_type), ' ')), 's') AS w FROM part) q
      JOIN (SELECT label, rtrim(unnest(string_split(label, '_')), 's') AS w FROM named_taxonomy) t USING (w)
      GROUP BY 1, 2) WHERE score >= 0.5""")
def match_intents(spark, sf):
    part = v.table(spark, sf, "part")
    labels = part.select(
        F.concat_ws("_", F.lower("p_type"), F.split("p_name", " ")[1]).alias("label"), F.lit("content").alias("kind")).distinct()
    questions = part.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return taxonomy.match_intents(questions, labels).select(
        "query_id", "label", "score", F.col("priority").cast("long").alias("priority"))
