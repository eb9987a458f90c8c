"""CSV files read in ranges against the whole read, at several sizes of a range."""

import csv
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.sources import tables
from callweave.sources.csv_split import csv_records

CELLS = ["", "plain", "a,b", 'say ""hi""', '"', '""', "line\nend", "\n", "\n\n", '",\n"', "é😀", "x" * 300, "['1', '2']", "\\", '\\"', " spaced "]


@pytest.fixture
def ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]

    def of(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")

    yield of
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def written(path, rows, header, end="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL)
        out.writerow(header)
        out.writerows(rows)


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_equal_the_whole_read(spark, tmp_path, ranges, size, end):
    rng, want = random.Random(size), []
    for name, n in (("a", 60), ("b", 0), ("c", 1), ("d", 30)):
        rows = [[f"{name}{i}", *("".join(rng.choice(CELLS) for _ in range(rng.randint(0, 3))) for _ in range(2))] for i in range(n)]
        written(tmp_path / f"{name}.csv", rows, ["id", "x", "y"], end)
        want += [tuple(r) for r in rows]
    ranges(size)
    columns = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "x", "y")])
    read = tables.read_csv(spark, str(tmp_path), columns)
    # Spark's own reader takes an empty cell for null too.  LF is the line end in cells of files with CR LF.
    assert sorted((r.id, r.x or "", r.y or "") for r in read.collect()) == sorted(want)
    whole = spark.read.schema(columns).options(**tables.CSV_OPTIONS).csv(str(tmp_path))
    assert sorted(map(str, read.collect())) == sorted(map(str, whole.collect()))
    if size == 64:
        assert csv_records(spark, str(tmp_path)).groupBy("file").count().count() == 4
        blocks = spark.read.option("lineSep", "\n").text(str(tmp_path)).select(F.input_file_block_start().alias("b")).distinct().count()
        assert blocks > 20


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_spark_files_and_types_come_back(spark, tmp_path, ranges, size):
    rows = [(i, c if i % 2 else None, i / 4) for i, c in enumerate(CELLS * 4)]
    columns = T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.StringType()), T.StructField("v", T.DoubleType())])
    path = str(tmp_path / "t")
    tables.write_csv(spark.createDataFrame(rows, columns).repartition(3), path)
    ranges(size)
    whole = spark.read.schema(columns).options(**tables.CSV_OPTIONS).csv(path)
    got = tables.read_csv(spark, path, columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert got.schema == whole.schema


def test_evaluation_by_header(spark, tmp_path, ranges):
    ranges(64)
    rows = [[f"extra {i}", f"line one\nline two {i}", f"['{i}']"] for i in range(20)]
    written(tmp_path / "a.csv", rows, ["other", "Query", "Ground_Truth"])
    written(tmp_path / "b.csv", [["", "last", "[]"]], ["other", "Query", "Ground_Truth"])
    got = tables.read_evaluation(spark, str(tmp_path)).orderBy("query_idx").collect()
    assert [(r.query_idx, r.Query) for r in got] == [(i, r[1]) for i, r in enumerate(rows)] + [(20, "last")]
    assert got[0].asDict().keys() == {"query_idx", "Query", "Ground_Truth"}
    written(tmp_path / "c.csv", [], ["Query", "other", "Ground_Truth"])
    with pytest.raises(ValueError):
        tables.read_evaluation(spark, str(tmp_path))


def test_empty_and_blank(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Query,Ground_Truth\n\n\nq,\"[\n\n]\"\n\n")
    got = tables.read_evaluation(spark, str(tmp_path)).collect()
    assert [(r.query_idx, r.Query, r.Ground_Truth) for r in got] == [(0, "q", "[\n\n]")]
    (tmp_path / "a.csv").write_text("")
    assert tables.read_evaluation(spark, str(tmp_path)).count() == 0
