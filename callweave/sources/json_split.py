"""Values of large JSON arrays and maps, read by all tasks at once.

A JSON file has no line that a task could start at: whether a brace ends a value depends on all text before it.  That state is
small, though: whether a string is open, and how deep the text stands.  So files are read as pieces that end at ``}``, which
Spark splits like lines.  Every piece tells how many quotes it has, and how it changes the depth if it starts outside or
inside a string.  Sums over the pieces of an input split, and over the few splits before it, then give every piece its state, and
pieces up to one that closes a value at the wanted depth are put together.  A value may span any number of splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

#: A JSON string, its letters as group.
STRING = r'"((?:[^"\\]|\\.)*)"'
#: Order of the pieces: file, split, place in the split.
SPLIT = ["file", "block"]


def _depth_change(bare: Column, inside: bool) -> Column:
    """Openings less closings of a piece without escapes, outside of strings."""
    text = F.regexp_replace(F.concat(F.lit('"' if inside else ""), bare), r'"[^"]*("|$)', "")
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    # A backslash stands in strings only and never before a brace, so no escape reaches over the end of a piece.
    bare = F.regexp_replace("piece", r"(?s)\\.", "")
    return rows.select("*", F.pmod(F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit(""))), F.lit(2)).alias("quotes"),
                       _depth_change(bare, False).alias("out"), _depth_change(bare, True).alias("in"))


def _closed_objects(spark: SparkSession, path: str, level: int) -> DataFrame:
    """``(file, number, text)``: the text up to every object that ends at depth ``level``, in order.

    ``level`` 1 is that of the elements of an array; a file that starts as an object is one value.
    """
    pieces = _pieces(spark, path)
    within = Window.partitionBy(*SPLIT).orderBy("at")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    odd = lambda c: F.pmod(c, F.lit(2)) == 1

    # Both ways a split may start: outside of strings (0) and in one (1).  The brace behind a piece counts where the piece ends outside.
    opened = pieces.withColumn("open", F.sum("quotes").over(within) - F.col("quotes"))
    known = opened.select(
        *SPLIT, "at", "piece", "quotes",
        *[F.when(odd(F.col("open") + flip), F.col("in")).otherwise(F.col("out")).alias(f"change{flip}") for flip in (0, 1)],
        *[(1 - F.pmod(F.col("open") + F.col("quotes") + flip, F.lit(2))).alias(f"brace{flip}") for flip in (0, 1)])
    splits = known.groupBy(*SPLIT).agg(
        F.sum("quotes").alias("quotes"), *[F.sum(F.col(f"change{f}") - F.col(f"brace{f}")).alias(f"depth{f}") for f in (0, 1)],
        F.min_by(F.substring(F.regexp_replace("piece", r"^\s+", ""), 1, 1), "at").alias("first"))
    # One row per input split.
    splits = materialize(splits.withColumn("flip", F.pmod(earlier("quotes"), F.lit(2))), "splits")
    states = splits.select(
        *SPLIT, "flip", earlier(F.when(F.col("flip") == 1, F.col("depth1")).otherwise(F.col("depth0"))).alias("base"),
        F.first("first").over(Window.partitionBy("file").orderBy("block")).alias("first"))

    pick = lambda c: F.when(F.col("flip") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    placed = known.join(F.broadcast(states), SPLIT)
    depth = F.col("base") + F.sum(pick("change") - pick("brace")).over(within)
    wanted = F.when(F.col("first") == "[", 1).otherwise(0) if level == 1 else F.lit(level)
    ends = placed.select(*SPLIT, "at", "piece", ((pick("brace") == 1) & (depth == wanted)).cast("long").alias("closed"))
    ends = materialize(ends.withColumn("inner", F.sum("closed").over(within) - F.col("closed")), "pieces")
    counts = ends.groupBy(*SPLIT).agg(F.sum("closed").alias("n"))
    counts = counts.select(*SPLIT, earlier("n").alias("earlier"))
    numbered = ends.join(F.broadcast(counts), SPLIT).withColumn("number", F.col("earlier") + F.col("inner"))
    values = numbered.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "piece"))).alias("parts"), F.max("closed").alias("whole"))
    text = F.array_join(F.transform("parts", lambda p: p["piece"]), "}")
    return values.filter("whole = 1").select("file", "number", F.concat(text, F.lit("}")).alias("text"))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``(file, number, value)``: the objects of JSON array files as text, in order; a file that is one object is one value."""
    found = _closed_objects(spark, path, 1)
    return found.select("file", "number", F.regexp_replace("text", r"^[\s,\[]+", "").alias("value"))


def json_map_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(file, number, outer, key, value)``: the objects of files ``{outer: {key: object}}`` as text.

    Outer keys are few and not empty; an entry without one before it belongs to the last one before.
    """
    found = _closed_objects(spark, path, 2)
    head = rf"^[\s,{{}}]*(?:{STRING}\s*:\s*\{{[\s}}]*,?\s*)*{STRING}\s*:\s*(?=\{{)"
    parted = materialize(found.select(
        "file", "number", F.regexp_extract("text", head, 1).alias("outer"), F.regexp_extract("text", head, 2).alias("key"),
        F.regexp_replace("text", head, "").alias("value")), "entries")
    plain = lambda c: F.get(F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>"), 0)
    follows = F.lead("number").over(Window.partitionBy("file").orderBy("number"))
    starts = parted.filter("outer <> ''").select("file", "outer", F.col("number").alias("begin"), follows.alias("end"))
    of = starts.select(F.col("file").alias("f"), plain(F.col("outer")).alias("outer"), "begin", "end")
    here = (F.col("file") == F.col("f")) & (F.col("number") >= F.col("begin")) & (F.col("end").isNull() | (F.col("number") < F.col("end")))
    return parted.drop("outer").join(F.broadcast(of), here).select("file", "number", "outer", plain(F.col("key")).alias("key"), "value")
