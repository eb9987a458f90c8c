"""Records of large CSV files whose cells hold line ends, read by all tasks at once.

A quote inside a cell is written twice, so every record has an even number of quotes, and a line end stands in a cell exactly
where the quotes before it are odd in number.  Files are read as lines, which Spark splits; the quotes of the lines of an input
split, and of the splits before it, tell each line whether it ends a record.  A record may span any number of splits.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

CELLS = {"quote": '"', "escape": '"'}
#: An input split of a file.
SPLIT = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return rows.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, number, record)``: the records of CSV files as text, numbered from 0 in each file, its header among them.

    Blank lines between records are left out.  A record that ends with CR LF has LF as line end in its cells too.  What follows a quote
    that is never closed is one record; a quote inside a cell without quotes around it is not CSV and has no defined result.
    """
    within = Window.partitionBy(*SPLIT).orderBy("at")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    lines = _lines(spark, path)

    splits = lines.groupBy(*SPLIT).agg(F.sum("quotes").alias("inside"))
    placed = lines.join(splits.select(*SPLIT, earlier("inside").alias("inside")), SPLIT)
    closes = F.pmod(F.col("inside") + F.sum("quotes").over(within), F.lit(2)) == 0
    blank = (F.col("quotes") == 0) & F.col("line").rlike(r"^[\r\uFEFF]*$")
    # A blank line that closes where a line closed before it is no record.
    ends = placed.withColumn("closes", closes).withColumn("skip", F.col("closes") & blank)
    ends = materialize(ends.select(*SPLIT, "at", "line", "skip", (F.col("closes") & ~F.col("skip")).cast("long").alias("closed")), "lines")

    counts = ends.groupBy(*SPLIT).agg(F.sum("closed").alias("n")).select(*SPLIT, earlier("n").alias("earlier"))
    number = F.col("earlier") + F.sum("closed").over(within) - F.col("closed")
    numbered = ends.join(counts, SPLIT).withColumn("number", number).filter("not skip")
    records = numbered.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    text = F.when(text.endswith("\r"), F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r$", "")).otherwise(text)
    return records.select("file", "number", F.when(F.col("number") == 0, F.ltrim(text, F.lit("\ufeff"))).otherwise(text).alias("record"))


def csv_header(records: DataFrame) -> list[str]:
    """Column names of the files; all must have the same header.  Without any record there are none."""
    heads = records.filter("number = 0").select("record").distinct().limit(2).collect()
    if len(heads) > 1:
        raise ValueError(f"CSV files with different headers: {heads[0][0]!r}, {heads[1][0]!r}")
    return next(csv.reader(io.StringIO(heads[0][0], newline=""))) if heads else []


def csv_rows(records: DataFrame, columns: T.StructType) -> DataFrame:
    """``(file, number, ...)``: the records behind the headers as rows of ``columns``, by position."""
    parsed = F.from_csv("record", columns.simpleString(), CELLS)
    return records.filter("number > 0").select("file", "number", parsed.alias("row")).select("file", "number", "row.*")
