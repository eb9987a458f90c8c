"""Question sets: frames around generated questions, labels, contexts and follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from .joins import bounded_broadcast
from .scan import pages
from .taxonomy import LABEL_DEFAULTS

#: Calls whose texts one context row holds.
CONTEXT_CALLS = 1000
#: Follow-up questions of one row.
FOLLOW_UPS = 3

GENERATION = "struct<question:string,ground_truth:string>"
FOLLOW_UP_LIST = "struct<follow_ups:array<struct<question:string,expected_answer:string>>>"


def call_intents(metadata: Column) -> Column:
    """Keywords, then predefined drivers, of one call; repeats kept."""
    names = lambda c, key: F.transform(F.coalesce(metadata[c], F.array()), lambda d: d[key])
    return F.concat(names("identified_interaction_drivers", "keyword"), names("predefined_interaction_drivers", "driver"))


def parsed_generation(text: Column, strict: bool) -> Column:
    """A generated question as a struct; unreadable text is null, or an error when strict."""
    parsed = F.from_json(text, GENERATION, {"mode": "PERMISSIVE"})
    bad = parsed["question"].isNull() & parsed["ground_truth"].isNull()
    refuse = F.raise_error(F.concat(F.lit("unreadable generation: "), F.coalesce(text, F.lit("null"))))
    if strict:
        return F.when(bad, refuse.cast(GENERATION)).otherwise(parsed)
    return F.when(bad, F.lit(None).cast(GENERATION)).otherwise(parsed)


def cleaned_questions(generations: DataFrame, strict: bool = False) -> DataFrame:
    """Generated questions cleaned and labelled; unreadable ones drop out unless strict."""
    parsed = generations.withColumn("_g", parsed_generation(F.col("generation"), strict)).filter("_g is not null")
    return parsed.select(
        *[c for c in generations.columns if c not in ("generation", "labels")],
        fx.clean_response(F.col("_g.question")).alias("Question"),
        fx.clean_response(F.col("_g.ground_truth")).alias("expected_answer"),
        *[fx.json_field(F.col("labels"), n, d).alias(n) for n, d in LABEL_DEFAULTS.items()],
    )


def single_call_questions(calls: DataFrame, generations: DataFrame, strict: bool = True) -> DataFrame:
    """One row per sampled call: its question with domain, intents and id lists."""
    frame = calls.select(
        "transcript_id",
        F.array(F.col("metadata.completed_fields.domain")).alias("Domains"),
        call_intents(F.col("metadata")).alias("Intents"),
        F.array("transcript_id").alias("t_id"),
    )
    return frame.join(cleaned_questions(generations, strict), "transcript_id")


def first_clusters(l2: DataFrame, max_clusters: int) -> DataFrame:
    """The first L2 clusters in file order."""
    return l2.orderBy("pos").limit(max_clusters)


def cluster_lists(members: DataFrame, calls: DataFrame, keywords: DataFrame) -> DataFrame:
    """Ids, domains, keywords and summaries of every cluster's members, in member order.

    A cluster may hold any share of all calls, so each list comes in pages of bounded
    length: ``(cluster_id, list, page, items[])``.  Joining a list's pages in order gives
    the whole list; summaries joined without a separator give the cluster's context.
    ``keywords`` leaves out calls whose metadata is incomplete.
    """
    rows = members.join(calls, "transcript_id")
    item = lambda name, value: F.struct(F.lit(name).alias("list"), F.lit(0).cast("long").alias("place"), value.alias("value"))
    base = rows.select("cluster_id", "position", F.inline(F.array(
        item("t_id", F.col("transcript_id")), item("domain", F.col("domain")), item("context", F.col("summary")))))
    words = members.join(keywords, "transcript_id").select(
        "cluster_id", "position", F.lit("intent").alias("list"), "place", F.col("keyword").alias("value"))
    return pages(base.unionByName(words).filter("value is not null"), ["cluster_id", "list"], ["position", "place", "value"],
                 F.col("value"), CONTEXT_CALLS, "items")


def multi_call_questions(clusters: DataFrame, lists: DataFrame, generations: DataFrame, max_clusters: int) -> DataFrame:
    """Questions over whole clusters, with the pages of their lists.

    The first ``max_clusters`` clusters are taken before unreadable generations drop out.
    """
    taken = bounded_broadcast(first_clusters(clusters, max_clusters).select("cluster_id"))
    questions = cleaned_questions(generations).join(taken, "cluster_id", "left_semi")
    return lists.join(bounded_broadcast(questions), "cluster_id")


def context_pages(ids: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of listed calls joined by line breaks, in list order; unknown ids are skipped."""
    rows = ids.join(summaries, "transcript_id").filter("summary is not null")
    paged = pages(rows, keys, ["pos", "transcript_id"], F.col("summary"), CONTEXT_CALLS, "items")
    return paged.select(*keys, "page", F.array_join("items", "\n").alias("context"))


def followups_wide(rows: DataFrame) -> DataFrame:
    """Up to three follow-ups per row as columns, null where there are fewer.

    Rows whose generation cannot be read are dropped; one without follow-ups stays.
    """
    parsed = rows.withColumn("_f", F.from_json("generation", FOLLOW_UP_LIST, {"mode": "PERMISSIVE"}))
    readable = F.col("generation").isNotNull() & F.get_json_object("generation", "$").isNotNull()
    at = lambda k, name: F.get("_f.follow_ups", F.lit(k - 1))[name]
    return parsed.filter(readable).select(
        "t_id", "original_question",
        *[c for k in range(1, FOLLOW_UPS + 1) for c in (
            at(k, "question").alias(f"follow_up_{k}"), at(k, "expected_answer").alias(f"answer_{k}"))])


def question_balance(questions: DataFrame) -> DataFrame:
    """Questions per difficulty and value of every other label, in one pass."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("cause_type", "hop", "target")]))
    return (
        questions.select("difficulty", pairs.alias("p")).groupBy("difficulty", "p.dimension", "p.value")
        .agg(F.count("*").alias("n"))
    )
