"""CSV tables of evaluations and question sets, and chat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..session import materialize
from .csv_split import csv_header, csv_records, csv_rows
from .json_split import json_objects

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def write_csv(rows: DataFrame, path: str) -> None:
    """Write a table as CSV; list and struct columns become JSON text."""
    cells = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name)
        for f in rows.schema.fields
    ]
    rows.select(*cells).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """CSV files with a header as rows of ``columns``, by position, read in ranges."""
    return csv_rows(csv_records(spark, path), columns).select(*columns.names)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation files by their header: known columns as text, in any order, numbered by ``query_idx``.

    Without that column the rows are numbered from 0 in the order of the files and their records.  Files are read in ranges.
    """
    records = materialize(csv_records(spark, path), "records")
    header = csv_header(records)
    # Columns are taken by place, so names that are unknown, or come twice, do no harm.
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    rows = csv_rows(records, cells) if header else records.filter("false")
    known = [F.col(f"c{header.index(c)}").alias(c) for c in schema.EVALUATION.names if c in header]
    if "query_idx" in header:
        return rows.select(*known).withColumn("query_idx", F.col("query_idx").cast("long"))
    # One row per file; its header is a record too.
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = records.groupBy("file").agg((F.count("*") - 1).alias("n")).select("file", earlier.alias("earlier"))
    return rows.join(files, "file").select((F.col("earlier") + F.col("number") - 1).alias("query_idx"), *known)


def read_json_table(spark: SparkSession, path: str, columns: T.StructType, multiline: bool = True) -> DataFrame:
    """JSON array files, read in ranges, or JSON lines without ``multiline``, as a flat table."""
    if not multiline:
        return spark.read.schema(columns).json(path)
    return json_objects(spark, path).select(F.from_json("value", columns).alias("row")).select("row.*")


def read_chats(spark: SparkSession, chats_path: str, messages_path: str) -> tuple[DataFrame, DataFrame]:
    """Stored chats and messages; predicates on them reach the files."""
    return spark.read.schema(schema.CHAT).parquet(chats_path), spark.read.schema(schema.MESSAGE).parquet(messages_path)
