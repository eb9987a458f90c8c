"""Dialogue pairs, enrichment rules and intent coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from .joins import bounded_broadcast
from .scan import BLOCK_ROWS, carried, index_block


def one_shape(calls: DataFrame) -> DataFrame:
    """Both raw shapes as one: a flat ``dialogue`` becomes turns of one utterance each."""
    turns = F.transform(
        "dialogue",
        lambda d: F.struct(
            F.array(F.struct(d["speaker"].alias("speaker"), d["text"].alias("utterance"))).alias("conversation"),
            F.col("sentiment").alias("sentiment"),
        ),
    )
    return calls.withColumn("turns", F.coalesce("turns", turns)).drop("dialogue", "sentiment")


def utterances(calls: DataFrame) -> DataFrame:
    """Utterance rows of nested calls with their position in the call."""
    said = F.flatten(F.transform("turns", lambda t: t["conversation"]))
    return calls.select("transcript_id", F.posexplode(said).alias("utterance_idx", "u")).select(
        "transcript_id", F.col("utterance_idx").cast("long").alias("utterance_idx"), "u.speaker", "u.utterance"
    )


def dialogue_pairs(rows: DataFrame, index: str = "utterance_idx", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number Agent/Customer pairs from 0; an utterance repeated by one speaker starts anew.

    Pairing is greedy inside runs of alternating speakers.  Positions, run starts and
    pair counts are running values, carried over blocks of the index so that a call of
    any length spreads over tasks.
    """
    keys = ["transcript_id"]
    df = rows.withColumn("block", index_block(index, block_rows))
    inside = Window.partitionBy(*keys, "block").orderBy(index)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    df = df.withColumn("_rn", F.row_number().over(inside))
    df = carried(df, keys, "block", F.struct(F.max(index).alias("at"), F.max_by("speaker", index).alias("speaker")),
                 "_last", combine=F.max)
    df = carried(df, keys, "block", F.count("*"), "_offset")
    df = df.withColumn("_pos", F.col("_rn") + F.coalesce("_offset", F.lit(0)))
    previous = F.coalesce(F.lag("speaker").over(inside), F.when(F.col("_rn") == 1, F.col("_last.speaker")))
    df = df.withColumn("_start", F.when(previous.isNull() | (previous == F.col("speaker")), F.col("_pos")))
    df = carried(df, keys, "block", F.max("_start"), "_carried_start", combine=F.max)
    df = df.withColumn("_run_start", F.coalesce(F.max("_start").over(so_far), "_carried_start"))
    df = df.withColumn("_opens", ((F.col("_pos") - F.col("_run_start")) % 2 == 0).cast("long"))
    df = carried(df, keys, "block", F.sum("_opens"), "_carried_pairs")
    pair = F.sum("_opens").over(so_far) + F.coalesce("_carried_pairs", F.lit(0)) - 1
    return df.select(*rows.columns, pair.cast("long").alias("pair_index"))


def complete_fields(calls: DataFrame) -> DataFrame:
    """Raw fields untouched, the completed ones beside them and the first available of both."""
    done = "metadata.completed_fields"
    return calls.select(
        "transcript_id", "domain", "intent", "reason_for_call",
        F.col(f"{done}.domain").alias("completed_domain"),
        F.col(f"{done}.intent").alias("completed_intent"),
        F.col(f"{done}.reason_for_the_call").alias("completed_reason"),
        F.coalesce("domain", f"{done}.domain").alias("domain_filled"),
        F.coalesce("intent", f"{done}.intent").alias("intent_filled"),
        F.coalesce("reason_for_call", f"{done}.reason_for_the_call").alias("reason_filled"),
    )


def polarity_gate(drivers: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Drivers whose polarity fits the sentiment score; neutral includes both bounds of 0.1."""
    side = bounded_broadcast(taxonomy.select(F.col("label").alias("driver"), "polarity"))
    score, polarity = F.col("score"), F.col("polarity")
    return drivers.join(side, "driver").filter(
        (polarity == "neutral")
        | score.between(-0.1, 0.1)
        | ((score < -0.1) & (polarity == "negative"))
        | ((score > 0.1) & (polarity == "positive"))
    )


def keyword_valid(keyword: Column, definition: Column) -> Column:
    """snake_case without digits, and a definition of 10 to 20 words."""
    return F.coalesce(fx.is_snake_case(keyword), F.lit(False)) & F.coalesce(
        fx.word_count(definition).between(10, 20), F.lit(False)
    )


def taxonomy_check(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Mark every label as known or new."""
    known = bounded_broadcast(taxonomy.select("label").distinct().withColumn("known", F.lit(True)))
    return labels.join(known, "label", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def uncovered_pairs(pairs: DataFrame, pair_intents: DataFrame) -> DataFrame:
    """Dialogue pairs without any intent."""
    keys = ["transcript_id", "pair_index"]
    return pairs.select(*keys).distinct().join(pair_intents.select(*keys), keys, "left_anti")


def dedupe_drivers(drivers: DataFrame) -> DataFrame:
    return drivers.dropDuplicates(["transcript_id", "pair_index", "driver"])


def field_text(calls: DataFrame, field: str) -> DataFrame:
    """``(transcript_id, text)`` of a clusterable field, without empty texts or ids."""
    meta = "metadata"
    source = {
        "summary": F.col(f"{meta}.call_summary"),
        "outcome": F.col(f"{meta}.outcome"),
        "keywords": F.array_join(
            F.filter(F.transform(f"{meta}.identified_interaction_drivers", lambda d: d["keyword"]),
                     lambda k: k.isNotNull() & (k != "")), ", "),
        "reason_for_call": F.col("reason_for_call"),
    }
    if field not in source:
        raise ValueError(f"unknown field {field!r}; known: {sorted(source)}")
    return calls.select("transcript_id", F.lit(field).alias("field"), source[field].alias("text")).filter(
        (F.col("text") != "") & (F.col("transcript_id") != "")
    )


def five_key_metadata(metadata: Column) -> Column:
    """Whether a call's metadata has exactly its five top-level fields."""
    names = ["completed_fields", "call_summary", "outcome",
             "predefined_interaction_drivers", "identified_interaction_drivers", "dialogue_pair_intents"]
    present = sum((metadata[n].isNotNull().cast("int") for n in names[1:]), metadata[names[0]].isNotNull().cast("int"))
    return present == 5


def transcript_lookup(calls: DataFrame, wanted: str) -> DataFrame:
    """The call with this id: ``transcript_id``, else ``id``, else ``filename``."""
    key = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("transcript_id", "id", "filename")))
    return calls.filter(key == F.lit(str(wanted))).limit(1)


def sample_calls(df: DataFrame, n: int, id_column: str = "transcript_id", seed: int = 42) -> DataFrame:
    """A reproducible sample without replacement: the ``n`` smallest seeded hashes of the id."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary")), id_column).limit(n)
