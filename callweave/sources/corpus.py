"""Reading and writing call corpora and cluster files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .. import schema
from ..session import materialize
from .json_split import json_map_entries, json_objects

CORRUPT = "_corrupt_record"


def read_corpus(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Nested calls from JSON array files (``multiline``) or JSON lines.

    The schema is fixed; unreadable values arrive as rows with ``_corrupt_record`` set.  Array files are cut at byte ranges like
    lines are, so one file of any size is read by all tasks.
    """
    columns = StructType([*schema.CALL.fields, StructField(CORRUPT, StringType())])
    if not multiline:
        return spark.read.schema(columns).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    parsed = F.from_json("value", columns, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return json_objects(spark, path).select(parsed.alias("call")).select("call.*")


def store_corpus(calls: DataFrame, path: str) -> DataFrame:
    """Write a corpus as Parquet once and read it from there on."""
    calls.write.mode("overwrite").parquet(path)
    return calls.sparkSession.read.schema(calls.schema).parquet(path)


def write_lines(calls: DataFrame, path: str) -> None:
    """JSON lines, one call each; what was there is replaced."""
    calls.write.mode("overwrite").json(path)


def lines_to_corpus(spark: SparkSession, lines_path: str, corpus_path: str, rejects_path: str | None = None) -> DataFrame:
    """JSON lines to a stored corpus; blank lines are skipped, unreadable ones go to ``rejects_path``, or fail the job without it."""
    rows = materialize(read_corpus(spark, lines_path, multiline=False), "lines")
    bad = rows.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))
    if rejects_path is not None:
        bad.write.mode("overwrite").parquet(rejects_path)
    elif not bad.isEmpty():
        raise ValueError(f"unreadable lines in {lines_path}, such as {bad.first()['line'][:200]!r}")
    return store_corpus(rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), corpus_path)


def read_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """L1 and L2 clusters of mixed files, plain lists or ``{clusters, documents}`` objects."""
    wrapped = StructType([*schema.CLUSTER.fields, StructField("clusters", ArrayType(schema.CLUSTER))])
    rows = spark.read.schema(wrapped).option("multiLine", True).json(path)
    flat = rows.filter("type is not null").select(*schema.CLUSTER.names).unionByName(
        rows.filter("clusters is not null").select(F.inline("clusters")))
    return flat.filter("type = 'L1Cluster'"), flat.filter("type = 'L2Cluster'")


def members_of(l2: DataFrame) -> DataFrame:
    """Membership rows of L2 clusters with the place in the list."""
    return l2.select("field", F.col("id").alias("l2_id"), F.col("parent_id").alias("l1_id"),
                     F.posexplode("member_ids").alias("position", "transcript_id"))


def write_by_field(rows: DataFrame, path: str) -> None:
    """Cluster tables partitioned by field, so that a field's readers skip the others."""
    rows.write.mode("overwrite").partitionBy("field").parquet(path)


def read_embedding_map(spark: SparkSession, path: str) -> DataFrame:
    """``{field: {transcript: {embeds, parents}}}`` files as rows; a file of any size is read by all tasks."""
    entry = F.from_json("value", "embeds array<double>, parent_l2_cluster string, parent_l1_cluster string")
    rows = json_map_entries(spark, path).select(F.col("outer").alias("field"), F.col("key").alias("transcript_id"), entry.alias("e"))
    return rows.select("field", "transcript_id", "e.embeds", F.col("e.parent_l2_cluster").alias("l2_id"), F.col("e.parent_l1_cluster").alias("l1_id"))
