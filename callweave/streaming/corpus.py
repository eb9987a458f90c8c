"""Corpus and graph kept up to date from files as they arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.graph import graph_records, record_links


def corpus_stream(spark: SparkSession, source: str) -> DataFrame:
    """Calls with an id from JSON line files; a call without a timestamp takes its file's."""
    rows = spark.readStream.schema(schema.CALL).option("mode", "PERMISSIVE").json(source)
    timed = rows.withColumn("timestamp", F.coalesce("timestamp", "_metadata.file_modification_time"))
    return timed.filter(F.coalesce("transcript_id", F.lit("")) != "")


def stored_ids(spark: SparkSession, target: str) -> DataFrame | None:
    """``transcript_id``, ``batch`` of the calls written so far, None before the first batch."""
    try:
        return spark.read.schema("transcript_id string, batch long").parquet(target)
    except AnalysisException:
        return None


def add_calls(batch: DataFrame, number: int, target: str) -> None:
    """Write the calls of a batch whose ids earlier batches have not, each once.

    Ids decide, not times: a call may be older than all stored ones.  A batch has its own folder and compares only with
    earlier ones, so a batch that runs again replaces its own output.  Of the stored calls only the ids are read.
    """
    fresh = batch.dropDuplicates(["transcript_id"])
    known = stored_ids(batch.sparkSession, target)
    if known is not None:
        earlier = known.filter(F.col("batch") < number).select("transcript_id")
        fresh = fresh.join(earlier, "transcript_id", "left_anti")
    fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")


def append_corpus(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Append the files that have arrived since the last run, each call once."""
    query = (
        corpus_stream(spark, source).writeStream.foreachBatch(lambda df, n: add_calls(df, n, target))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def update_graph(spark: SparkSession, source: str, path: str, checkpoint: str, max_files: int | None = None) -> None:
    """Add nodes and edges of newly arrived calls to the stored graph.

    The keys of known edges live in the state store, so a batch reads and writes its own edges only.
    """
    reader = spark.readStream.schema(schema.CALL)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    calls = reader.json(source).filter(F.coalesce("transcript_id", F.lit("")) != "")
    edges = record_links(graph_records(calls)).dropDuplicates(["transcript_id", "edge", "target"])
    query = (
        edges.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stored_edges(spark: SparkSession, path: str) -> DataFrame:
    """The edges written so far."""
    return spark.read.schema("transcript_id string, edge string, target string").parquet(path)
