"""Chats, question sets, sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callweave import schema
from callweave.functions import text as fx
from callweave.operators import chats as ch
from callweave.operators import dialogue, questions
from callweave.session import fresh_path, materialize
from callweave.sources import corpus, tables

from . import views as v
from . import views_chat as vc
from .cluster_checks import l2_named
from .registry import check, view

TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"


def ts(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@check("valid_messages", "SELECT id, role, role IN ('user', 'assistant') AS valid FROM messages")
def valid_messages(spark, sf):
    ok, bad = ch.valid_messages(vc.messages(spark, sf))
    mark = lambda df, flag: df.select("id", "role", F.lit(flag).alias("valid"))
    return mark(ok, True).unionByName(mark(bad, False))


@check("chat_threads", """
SELECT c.id AS chat_id, c.title, 0::BIGINT AS page, count(m.id) AS n,
       coalesce(string_agg(m.id || ' ' || m.role || ' ' || m.content, chr(10) ORDER BY m.created_at, m.id), '') AS thread
FROM chats c LEFT JOIN messages m ON m.chat_id = c.id AND m.role IN ('user', 'assistant') GROUP BY 1, 2""")
def chat_threads(spark, sf):
    ok, _ = ch.valid_messages(vc.messages(spark, sf))
    lines = F.transform("messages", lambda m: F.concat_ws(" ", m["id"], m["role"], m["content"]))
    return ch.chat_threads(vc.chats(spark, sf), ok).select(
        "chat_id", "title", "page", F.size("messages").cast("long").alias("n"), F.array_join(lines, "\n").alias("thread"))


@check("cascade_delete", """
SELECT 'chat' AS kind, id FROM chats WHERE id NOT IN (SELECT chat_id FROM messages WHERE role = 'system')
UNION ALL SELECT 'message', id FROM messages WHERE chat_id NOT IN (SELECT chat_id FROM messages WHERE role = 'system')""")
def cascade_delete(spark, sf):
    messages = vc.messages(spark, sf)
    kept, rest = ch.cascade_delete(vc.chats(spark, sf), messages, messages.filter("role = 'system'"))
    return kept.select(F.lit("chat").alias("kind"), "id").unionByName(rest.select(F.lit("message").alias("kind"), "id"))


HISTORY = """SELECT id, chat_id, role, content, row_number() OVER (PARTITION BY chat_id ORDER BY age DESC) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id DESC) AS age FROM messages) WHERE age <= {n}"""


@check("recent_history", f"SELECT id, chat_id, place FROM ({HISTORY.format(n=4)})")
def recent_history(spark, sf):
    return ch.recent_history(vc.messages(spark, sf), 4).select("id", "chat_id", "place")


@check("recent_user_queries", f"""
SELECT chat_id, content, back FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY place DESC) AS back
  FROM ({HISTORY.format(n=10)}) WHERE role = 'user') WHERE back <= 3""")
def recent_user_queries(spark, sf):
    return ch.recent_user_queries(vc.messages(spark, sf)).select("chat_id", "content", F.col("back").cast("long").alias("back"))


@check("chat_last_update", f"SELECT chat_id, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM messages GROUP BY 1")
def chat_last_update(spark, sf):
    return ch.last_update(vc.messages(spark, sf)).select("chat_id", ts("updated_at").alias("updated_at"))


@check("chat_list", """
SELECT c.id, strftime(greatest(c.created_at, m.u), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM chats c JOIN (SELECT chat_id, max(created_at) AS u FROM messages GROUP BY 1) m ON m.chat_id = c.id""")
def chat_list(spark, sf):
    latest = ch.last_update(vc.messages(spark, sf)).withColumnRenamed("chat_id", "id")
    return ch.by_recency(vc.chats(spark, sf).join(latest, "id").select("id", F.greatest("created_at", "updated_at").alias("updated_at"))).select(
        "id", ts("updated_at").alias("updated_at"))


@check("chat_token_totals", r"""
SELECT chat_id, cast(sum(len(list_filter(string_split_regex(content, '[ \t\n\r\f\x0B]+'), lambda w: w <> ''))) AS BIGINT) AS tokens, count(*) AS messages
FROM messages GROUP BY 1""")
def chat_token_totals(spark, sf):
    return ch.token_totals(vc.messages(spark, sf))


TITLE = "substr(content, 1, 40) || CASE WHEN length(content) > 40 THEN '...' ELSE '' END"


@check("chat_title", f"SELECT id, {TITLE} AS title FROM messages")
def chat_title(spark, sf):
    return vc.messages(spark, sf).select("id", fx.chat_title(F.col("content")).alias("title"))


@check("append_messages", f"""
SELECT c.id, CASE WHEN s.chat_id IS NULL AND f.title IS NOT NULL THEN f.title ELSE c.title END AS title, n.n AS messages
FROM chats c LEFT JOIN (SELECT DISTINCT chat_id FROM messages WHERE role = 'system') s ON s.chat_id = c.id
LEFT JOIN (SELECT chat_id, {TITLE.replace('content', "arg_min(content, created_at)")} AS title FROM messages WHERE role = 'user' GROUP BY 1) f ON f.chat_id = c.id
LEFT JOIN (SELECT chat_id, count(*) AS n FROM messages GROUP BY 1) n ON n.chat_id = c.id""")
def append_messages(spark, sf):
    messages = vc.messages(spark, sf)
    stored = messages.filter("role = 'system'")
    chats, after = ch.append_messages(
        vc.chats(spark, sf).withColumn("updated_at", F.col("created_at")), stored, messages)
    counts = after.groupBy(F.col("chat_id").alias("id")).agg(F.count("*").alias("messages"))
    return chats.join(counts, "id", "left").select("id", "title", "messages")


@check("strip_footer", r"""
SELECT id, CASE role WHEN 'assistant' THEN content || chr(10) || chr(10) || '---' || chr(10) || 'first' ELSE content END AS content FROM messages""")
def strip_footer(spark, sf):
    raw = F.when(F.col("role") == "assistant", F.concat("content", F.lit("\n\n---\nfirst\n\n---\n"), "model")).otherwise(F.col("content"))
    return vc.messages(spark, sf).select("id", fx.strip_footer(raw).alias("content"))


@check("message_metadata", """
SELECT id, CASE WHEN role = 'system' THEN '{"stored":true}' WHEN model IS NOT NULL THEN '{"model":"' || model || '","token_count":' || token_count || '}' END AS metadata FROM messages""")
def message_metadata(spark, sf):
    stored = F.when(F.col("role") == "system", F.lit('{"stored":true}'))
    return vc.messages(spark, sf).select("id", fx.message_metadata(stored, F.col("model"), F.col("token_count")).alias("metadata"))


@check("last_wins", """
SELECT cast(o_custkey AS VARCHAR) AS transcript_id, arg_max(o_orderpriority, o_orderkey) AS summary FROM orders GROUP BY 1""")
def last_wins(spark, sf):
    rows = v.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("transcript_id"), F.col("o_orderpriority").alias("summary"), "o_orderkey")
    return ch.last_wins(rows, "transcript_id", "o_orderkey").select("transcript_id", "summary")


@check("document_registry", """
SELECT cast(o_orderkey AS VARCHAR) AS id, o_orderpriority AS summary, true AS known FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT DISTINCT transcript_id, NULL, false FROM call_members
WHERE transcript_id NOT IN (SELECT cast(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P')""")
def document_registry(spark, sf):
    known = v.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("summary"))
    mentioned = v.call_members(spark, sf).select(F.col("transcript_id").alias("id"))
    return ch.registry_union(known, mentioned)


# --- question sets -----------------------------------------------------------------

CLEAN = r"regexp_replace(nfc_normalize({}), '^\s+|\s+$', '', 'g')"


def conv_keyed(spark, sf):
    return v.calls_conv(spark, sf).withColumn("transcript_id", F.concat_ws("#", "transcript_id", "part"))


@check("question_labels", """
SELECT transcript_id || '#' || part AS transcript_id,
       string_agg(keyword, '|' ORDER BY utterance_idx) || '|' || string_agg(driver, '|' ORDER BY utterance_idx) AS intents
FROM conv_drivers GROUP BY 1""")
def question_labels(spark, sf):
    return conv_keyed(spark, sf).select("transcript_id", F.array_join(questions.call_intents(F.col("metadata")), "|").alias("intents"))


@check("single_call_questions", f"""
SELECT c.transcript_id || '#' || c.part AS transcript_id, {CLEAN.format("coalesce(c.reason_for_call, '')")} AS Question,
       {CLEAN.format("coalesce(c.outcome, '')")} AS expected_answer, 'Filled' AS domains, d.n AS intents, 'hard' AS difficulty, 'single-hop' AS hop
FROM conv_calls c JOIN (SELECT transcript_id, part, count(*) * 2 AS n FROM conv_drivers GROUP BY 1, 2) d USING (transcript_id, part)""")
def single_call_questions(spark, sf):
    calls = conv_keyed(spark, sf)
    generations = calls.select(
        "transcript_id",
        F.to_json(F.struct(F.coalesce("reason_for_call", F.lit("")).alias("question"),
                           F.coalesce("metadata.outcome", F.lit("")).alias("ground_truth"))).alias("generation"),
        F.lit('{"difficulty": "hard"}').alias("labels"))
    out = questions.single_call_questions(calls, generations)
    return out.select("transcript_id", "Question", "expected_answer", F.array_join("Domains", "|").alias("domains"),
                      F.size("Intents").cast("long").alias("intents"), "difficulty", "hop")


@check("sample_calls", "SELECT * FROM calls_star ORDER BY md5('42:' || transcript_id), transcript_id LIMIT 1000")
def sample_calls(spark, sf):
    return dialogue.sample_calls(v.calls_star(spark, sf), 1000)


view("member_items", """
SELECT l2_id, 'context' AS list, position, 0 AS place, c.outcome || ' ' AS value FROM call_members JOIN calls_star c USING (transcript_id)
UNION ALL SELECT l2_id, 't_id', position, 0, transcript_id FROM call_members
UNION ALL SELECT l2_id, 'domain', position, 0, c.domain FROM call_members JOIN calls_star c USING (transcript_id)
UNION ALL SELECT l2_id, 'intent', position, h.pair_index, h.keyword FROM call_members
  JOIN calls_star c USING (transcript_id) JOIN driver_hits h USING (transcript_id) WHERE c.outcome <> 'P'""")


@check("multi_call_questions", """
SELECT i.l2_id AS cluster_id, i.list, i.page, count(*) AS n, md5(string_agg(i.value, '|' ORDER BY i.position, i.place, i.value)) AS items,
       any_value(c.name) AS question, any_value(c.parent_id) AS expected_answer
FROM (SELECT *, (row_number() OVER (PARTITION BY l2_id, list ORDER BY position, place, value) - 1) // 1000 AS page FROM member_items) i
JOIN l2_named c ON c.id = i.l2_id WHERE c.name LIKE 'Topic%' AND c.id IN (SELECT id FROM l2_clusters_vec ORDER BY pos LIMIT 30) GROUP BY 1, 2, 3""")
def multi_call_questions(spark, sf):
    l2 = materialize(l2_named(spark, sf).join(v.l2_clusters_vec(spark, sf).select("id", "pos"), "id").select(
        F.col("id").alias("cluster_id"), "pos", "name", "parent_id"), "l2")
    readable = F.to_json(F.struct(F.col("name").alias("question"), F.col("parent_id").alias("ground_truth")))
    generations = l2.select(
        "cluster_id", F.when(F.col("name").startswith("Topic"), readable).otherwise("no json").alias("generation"),
        F.lit("{}").alias("labels"))
    members = v.call_members(spark, sf).select(F.col("l2_id").alias("cluster_id"), "transcript_id", "position")
    calls = v.calls_star(spark, sf)
    complete = calls.filter("outcome <> 'P'").select("transcript_id")
    keywords = v.driver_hits(spark, sf).join(complete, "transcript_id", "left_semi").select(
        "transcript_id", F.col("pair_index").alias("place"), "keyword")
    lists = questions.cluster_lists(
        members, calls.select("transcript_id", "domain", F.concat("outcome", F.lit(" ")).alias("summary")), keywords)
    out = questions.multi_call_questions(l2, lists, generations, 30)
    return out.select("cluster_id", "list", "page", F.size("items").cast("long").alias("n"),
                      F.md5(F.array_join("items", "|").cast("binary")).alias("items"),
                      F.col("Question").alias("question"), "expected_answer")


@check("context_concat", """
SELECT o_custkey, 0::BIGINT AS page, string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey) AS context
FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def context_concat(spark, sf):
    orders = v.table(spark, sf, "orders")
    ids = orders.select("o_custkey", F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("transcript_id"))
    known = orders.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").cast("string").alias("transcript_id"), F.col("o_orderpriority").alias("summary"))
    return questions.context_pages(ids, known, ["o_custkey"])


@check("followups_wide", """
SELECT cell AS t_id, p_name AS original_question, p_brand || ' 1' AS follow_up_1, 'a1' AS answer_1,
       CASE WHEN p_size % 4 > 0 THEN p_brand || ' 2' END AS follow_up_2, CASE WHEN p_size % 4 > 0 THEN 'a2' END AS answer_2,
       CASE WHEN p_size % 4 > 1 THEN p_brand || ' 3' END AS follow_up_3, CASE WHEN p_size % 4 > 1 THEN 'a3' END AS answer_3
FROM part JOIN cells USING (p_partkey) WHERE p_type <> 'MEDIUM'""")
def followups_wide(spark, sf):
    from .text_checks import cells

    qa = F.transform(F.sequence(F.lit(1), F.col("p_size") % 4 + 1), lambda i: F.struct(
        F.concat_ws(" ", "p_brand", i.cast("string")).alias("question"), F.concat(F.lit("a"), i.cast("string")).alias("expected_answer")))
    rows = v.table(spark, sf, "part").join(cells(spark, sf), "p_partkey").select(
        F.col("cell").alias("t_id"), F.col("p_name").alias("original_question"),
        F.when(F.col("p_type") == "MEDIUM", "sorry").otherwise(F.to_json(F.struct(qa.alias("follow_ups")))).alias("generation"))
    return questions.followups_wide(rows)


@check("question_balance", """
SELECT difficulty, dimension, value, count(*) AS n FROM (
  SELECT CASE quality WHEN 1 THEN 'hard' ELSE 'easy' END AS difficulty,
         unnest(['cause_type', 'hop', 'target']) AS dimension,
         unnest([CASE toxic WHEN 1 THEN 'emotion' ELSE 'action' END, source, lang]) AS value FROM labels JOIN documents USING (doc_id))
GROUP BY 1, 2, 3""")
def question_balance(spark, sf):
    rows = v.table(spark, sf, "labels").join(v.table(spark, sf, "documents"), "doc_id").select(
        F.when(F.col("quality") == 1, "hard").otherwise("easy").alias("difficulty"),
        F.when(F.col("toxic") == 1, "emotion").otherwise("action").alias("cause_type"),
        F.col("source").alias("hop"), F.col("lang").alias("target"))
    return questions.question_balance(rows)


# --- sources -----------------------------------------------------------------------

CALL_COUNTS = """SELECT c.transcript_id || '#' || c.part AS transcript_id, c.domain, c.outcome, count(*) AS turns, sum(length(t.utterance))::BIGINT AS chars
FROM conv_calls c JOIN turns_conv t USING (transcript_id, part) GROUP BY 1, 2, 3"""


def call_counts(calls):
    said = F.flatten(F.transform("turns", lambda t: t["conversation"]))
    return calls.select(
        "transcript_id", "domain", F.col("metadata.outcome").alias("outcome"), F.size("turns").cast("long").alias("turns"),
        F.aggregate(said, F.lit(0).cast("long"), lambda s, u: s + F.length(u["utterance"])).alias("chars"))


def write_values(rows, path, opening, closing):
    """JSON files, one per ``file``: the texts ``body`` between ``opening`` and ``closing``, with commas between them."""
    order, whole = Window.partitionBy("file").orderBy("body"), Window.partitionBy("file")
    line = F.concat(
        F.when(F.row_number().over(order) == 1, opening).otherwise(F.lit(",")), "body",
        F.when(F.row_number().over(order) == F.count("*").over(whole), closing).otherwise(F.lit("")))
    at = F.row_number().over(order).alias("at")
    rows.select(line.alias("value"), "file", at).sortWithinPartitions("file", "at").drop("at").write.partitionBy("file").text(path)


@check("scan_calls", CALL_COUNTS)
def scan_calls(spark, sf):
    path = fresh_path(spark, "array")
    # Array files as raw corpora arrive; a file may be as large as it likes.
    calls = v.calls_conv(spark, sf).withColumn("transcript_id", F.concat_ws("#", "transcript_id", "part")).drop("part")
    body = F.to_json(F.struct(*calls.columns))
    write_values(calls.select(body.alias("body"), F.pmod(F.xxhash64("transcript_id"), F.lit(4)).alias("file")), path, F.lit("["), F.lit("]"))
    stored = corpus.store_corpus(corpus.read_corpus(spark, f"{path}/*").drop(corpus.CORRUPT), fresh_path(spark, "corpus"))
    return call_counts(stored)


@check("embedding_map", """
SELECT field, cast(vec_id AS VARCHAR) AS transcript_id, len(v) AS n, round(list_sum(v), 5) AS total, field || '_L2_' || l2 AS l2_id, field || '_L1_' || l1 AS l1_id
FROM vec_members""")
def embedding_map(spark, sf):
    path = fresh_path(spark, "map")
    entry = F.struct(F.col("vector").alias("embeds"), fx.cluster_id(F.col("field"), "L2", F.col("l2")).alias("parent_l2_cluster"),
                     fx.cluster_id(F.col("field"), "L1", F.col("l1")).alias("parent_l1_cluster"))
    body = F.concat(F.lit('"'), F.col("vec_id").cast("string"), F.lit('": '), F.to_json(entry))
    write_values(v.vec_members(spark, sf).select(body.alias("body"), F.col("field").alias("file")), path,
                 F.concat(F.lit('{"none": {}, "'), "file", F.lit('": {')), F.lit("}}"))
    rows = corpus.read_embedding_map(spark, f"{path}/*")
    total = F.aggregate("embeds", F.lit(0.0), lambda s, x: s + x)
    return rows.select("field", "transcript_id", F.size("embeds").cast("long").alias("n"), F.round(total, 5).alias("total"), "l2_id", "l1_id")


@check("jsonl_round_trip", CALL_COUNTS)
def jsonl_round_trip(spark, sf):
    path = fresh_path(spark, "lines")
    corpus.write_lines(conv_keyed(spark, sf).drop("part"), path)
    return call_counts(corpus.lines_to_corpus(spark, path, fresh_path(spark, "corpus")))


@check("transcript_lookup", "SELECT transcript_id, domain, intent FROM calls_star WHERE transcript_id = '7'")
def transcript_lookup(spark, sf):
    calls = v.calls_star(spark, sf).withColumns({"id": F.lit(None).cast("string"), "filename": F.lit(None).cast("string")})
    return dialogue.transcript_lookup(calls, "7").select("transcript_id", "domain", "intent")


@check("cluster_files", "SELECT field, l2_id, l1_id, cast(transcript_id AS BIGINT) AS transcript_id FROM (SELECT field, field || '_L2_' || l2 AS l2_id, field || '_L1_' || l1 AS l1_id, vec_id AS transcript_id FROM vec_members)")
def cluster_files(spark, sf):
    path = fresh_path(spark, "clusters")
    # A large cluster is listed in several entries of at most 1000 members.
    l2 = v.vec_members(spark, sf).groupBy("field", "l1", "l2", F.floor(F.col("vec_id") / 1000).alias("part")).agg(
        F.array_sort(F.collect_list("vec_id")).cast("array<string>").alias("member_ids"))
    rows = l2.select(
        F.lit("L2Cluster").alias("type"), "field", fx.cluster_id(F.col("field"), "L2", F.col("l2")).alias("id"),
        fx.cluster_id(F.col("field"), "L1", F.col("l1")).alias("parent_id"), "member_ids")
    one = F.to_json(F.struct(*rows.columns))
    as_list = F.concat(F.lit("["), one, F.lit("]"))
    as_dict = F.concat(F.lit('{"clusters": ['), one, F.lit('], "documents": []}'))
    form = F.when(F.col("field") == "keywords", as_list).otherwise(as_dict)
    # A multi-line file holds one JSON value, so every cluster gets a file of its own here.
    rows.select(form.alias("value"), F.md5(one).alias("file")).write.partitionBy("file").text(path)
    _, out = corpus.read_clusters(spark, f"{path}/*")
    return corpus.members_of(out).select("field", "l2_id", "l1_id", F.col("transcript_id").cast("long").alias("transcript_id"))


@check("cluster_tables", "SELECT field, count(*) AS clusters FROM l2_named GROUP BY 1")
def cluster_tables(spark, sf):
    path = fresh_path(spark, "by-field")
    corpus.write_by_field(l2_named(spark, sf), path)
    return spark.read.parquet(path).groupBy("field").agg(F.count("*").alias("clusters"))


@check("csv_round_trip", """
SELECT conv_id * 100 + turn AS query_idx, text AS "Query", role AS "Expected_Answer", NULL::VARCHAR AS "Final_Answer" FROM conversations""")
def csv_round_trip(spark, sf):
    path = fresh_path(spark, "csv")
    rows = v.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_idx"), F.col("text").alias("Query"), F.col("role").alias("Expected_Answer"),
        F.array("role", F.lit("x")).alias("Ground_Truth"), F.lit(None).cast("string").alias("Retrieved_Calls"),
        F.lit(None).cast("string").alias("Final_Answer"))
    tables.write_csv(rows, path)
    back = tables.read_evaluation(spark, path)
    return back.filter(F.size(fx.parse_list_cell(F.col("Ground_Truth"))) == 2).select("query_idx", "Query", "Expected_Answer", "Final_Answer")


@check("json_table", "SELECT id, role, content FROM messages")
def json_table(spark, sf):
    path = fresh_path(spark, "json")
    vc.messages(spark, sf).write.json(path)
    return tables.read_json_table(spark, path, schema.MESSAGE, multiline=False).select("id", "role", "content")


@check("json_array_table", "SELECT id, role, content FROM messages")
def json_array_table(spark, sf):
    path = fresh_path(spark, "json-array")
    messages = vc.messages(spark, sf)
    body = F.to_json(F.struct(*messages.columns))
    write_values(messages.select(body.alias("body"), F.lit(0).alias("file")), path, F.lit("["), F.lit("]"))
    return tables.read_json_table(spark, f"{path}/*", schema.MESSAGE).select("id", "role", "content")


@check("chat_tables", "SELECT m.id, m.chat_id, c.title, m.role FROM messages m JOIN chats c ON c.id = m.chat_id")
def chat_tables(spark, sf):
    base = fresh_path(spark, "chats")
    vc.chats(spark, sf).withColumn("updated_at", F.col("created_at")).write.parquet(f"{base}/chats")
    vc.messages(spark, sf).withColumn("metadata", F.lit(None).cast("string")).write.parquet(f"{base}/messages")
    chats, messages = tables.read_chats(spark, f"{base}/chats", f"{base}/messages")
    return messages.join(chats.select(F.col("id").alias("chat_id"), "title"), "chat_id").select("id", "chat_id", "title", "role")
