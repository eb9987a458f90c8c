"""Label taxonomies: reading them from prompt text, and matching questions to labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import word_rows
from .joins import bounded_broadcast

# Labels given to a question when its classification cannot be read.
LABEL_DEFAULTS = {"difficulty": "easy", "hop": "single-hop", "target": "customer", "cause_type": "action"}
# The six domain labels, and the intents of an unclassified and of a failed question.
DOMAIN_LABELS = ["flight_domain", "insurance_domain", "hotel_domain", "retail_domain", "banking_domain", "telecom_domain"]
NO_INTENT = "general inquiry"
FAILED_INTENT = "general query"


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``(label, section, description, kind)`` from a prompt file with bulleted labels.

    A label line is ``- name — description`` with or without bold marks; a section is a
    ``#`` heading or an upper-case line.  The file is one prompt, so it is read as one row.
    """
    lines = (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    )
    bullet = r"^- \**([a-z][a-z0-9_]*)\**\s+—\s+(.*)$"
    heading = r"^#+\s+(.*)$|^([A-Z][A-Z ,&-]+)$"
    title = F.coalesce(
        F.nullif(F.regexp_extract("line", heading, 1), F.lit("")),
        F.nullif(F.regexp_extract("line", heading, 2), F.lit("")),
    )
    # A prompt is a small text; its lines form one window.
    above = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        lines.withColumn("section", F.last(title, ignorenulls=True).over(above))
        .filter(F.col("line").rlike(bullet))
        .select(
            F.regexp_extract("line", bullet, 1).alias("label"), "section",
            F.regexp_extract("line", bullet, 2).alias("description"),
        )
        .withColumn("kind", F.when(F.col("label").endswith("_domain"), "domain").otherwise("content"))
    )


def _stem(word: Column) -> Column:
    return F.rtrim(word, F.lit("s"))


def match_intents(questions: DataFrame, taxonomy: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Lexical classification: share of a label's words that occur in the question.

    Domain labels match on the domain word alone.  Labels come back in order of their
    share; ``(query_id, label, score, priority)``.
    """
    parts = F.filter(F.split("label", "_"), lambda w: (w != "domain") & (w != ""))
    terms = taxonomy.select("label", F.array_distinct(F.transform(parts, _stem)).alias("terms")).distinct()
    label_terms = terms.select("label", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    asked = word_rows(questions, ["query_id"]).select("query_id", _stem(F.col("term")).alias("term")).distinct()
    scored = (
        asked.join(bounded_broadcast(label_terms), "term")
        .groupBy("query_id", "label").agg((F.count("*") / F.first("n")).alias("score"))
        .filter(F.col("score") >= threshold)
    )
    # Labels of one question are at most the taxonomy.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "label")
    return scored.withColumn("priority", F.row_number().over(order))


def with_default(matched: DataFrame, questions: DataFrame, default: str = NO_INTENT) -> DataFrame:
    """Questions without any label get the default one."""
    rest = questions.select("query_id").join(matched, "query_id", "left_anti")
    return matched.unionByName(
        rest.select("query_id", F.lit(default).alias("label"), F.lit(0.0).alias("score"), F.lit(1).alias("priority"))
    )
