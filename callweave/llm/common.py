"""Shared pieces of the training-data operators: keyed rows, stored tables, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id``, ``text`` (null counts as empty) and ``row_hash``, which tells apart texts under one id.

    Only these columns go on, so extra columns never clash; with ``carry`` the others (all but the text) travel in one
    struct ``extra``.  Ids may be null or repeat: operators join on ``doc_id`` and ``row_hash`` null-safely, and what they join
    is unique in both, so no row is multiplied.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    extra = [F.struct(*(F.lit(None).cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col(c) for c in docs.columns)).alias("extra")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_hash"), *(extra if carry else []))


def with_extra(schema: str, rows: DataFrame) -> str:
    """``schema`` and what ``keyed`` rows carry."""
    return schema + "".join(f", extra {rows.schema[c].dataType.simpleString()}" for c in rows.columns[3:])


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """The null-safe join condition of ``keyed`` rows."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["row_hash"] == right["row_hash"])


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the files behind ``stored`` tables that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a few rows, so that the Python objects made of a batch stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of an undirected edge table.

    Alternating large-star and small-star steps: each is one aggregation with map-side combine and one join
    that adaptive execution can split, so hubs do not gather their neighbours anywhere.  The number of edges
    never grows.  Every round is stored; the loop ends when a round changes nothing.
    """
    pairs = edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).filter("hi <> lo").distinct()
    pairs = stored(pairs, "star")
    mark = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        both = pairs.union(pairs.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m")))
        before, pairs = pairs, stored(small.filter("hi <> lo").distinct(), "star")
        release(before)
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        pairs.select("lo", "lo").distinct()
    )
