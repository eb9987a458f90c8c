"""Training-order materialisation: every sequence gets a global slot and is written to its place in fixed-stride shards.

A keyed Feistel network permutes the numbers 0 .. m - 1; numbers it sends beyond m walk on until they come back.  So the
place of a sequence needs no sort, no state and no lookup.  Numbers are given in scan order: each input split owns a
range as long as its texts could need at most (a look at their lengths tells), so texts are encoded once, and numbers
that no sequence takes leave gaps that the permutation spreads evenly.  Places are dealt to shards by equal ranges, and a
shard holds its records in order of their places.  Slots count the records through all shards: a shard's first slot is
the number of records in the shards before it, which the sizes of the files tell.

A shard is a file of records of one stride: header (place, doc_id, piece, number of ids), ids as unsigned 16-bit numbers
padded with zeros, and a line feed, since Spark's text writer writes them (it passes bytes through and commits a task's
file or nothing, so a lost executor leaves no half shard).  A reader finds slot s of a shard at record ``s - first`` and
may start at any slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import sliced
from .word_tokens import encoder

#: Ids of a sequence, records of a shard (about 8.5 MB; a task reads shards whole), rounds of the network.
LENGTH, PER_SHARD, ROUNDS = 512, 1 << 13, 8
#: Ids that one byte of text can make at most: normal forms and lower case may lengthen a text.
IDS_PER_BYTE = 4
NO_ID = np.iinfo(np.int64).min


def record_type(length: int) -> np.dtype:
    return np.dtype([("place", "<i8"), ("doc_id", "<i8"), ("piece", "<u4"), ("n", "<u4"), ("ids", "<u2", (length,)), ("end", "u1")])


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(numbers: np.ndarray, n: int, key: int, backwards: bool = False) -> np.ndarray:
    """The permutation of 0 .. n - 1 that ``key`` chooses, or its inverse."""
    half = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _mix(np.uint64(key & (2**64 - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys[::-1] if backwards else keys:
            if backwards:
                left, right = right ^ (_mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (_mix(right ^ k) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def _records(batches, path: str, length: int, ranges: dict, m: int, key: int, shards: int):
    encode, kind = encoder(path).encode, record_type(length)
    # A split without rows was not counted and owns no numbers.
    number, end = ranges.get(TaskContext.get().partitionId(), (0, 0))
    for batch in sliced(batches, 256):
        # A few texts at a time: the records of many long texts would be copies of all of them.
        for lo, ids_of in _bounded(map(encode, (t or "" for t in batch.column(1).to_pylist()))):
            counts = [-(-len(x) // 4 // length) or 1 for x in ids_of]
            out = np.zeros(sum(counts), kind)
            out["end"] = 10
            out["place"] = slots(np.arange(number, number + len(out)), m, key)
            number += len(out)
            k = 0
            for row, (ids, count) in enumerate(zip(ids_of, counts), lo):
                doc_id, values = batch.column(0)[row].as_py(), np.frombuffer(ids, "<u4")
                out["doc_id"][k:k + count] = NO_ID if doc_id is None else doc_id
                out["piece"][k:k + count] = np.arange(count)
                for at in range(0, len(values), length):
                    part = values[at:at + length]
                    out["n"][k + at // length] = len(part)
                    out["ids"][k + at // length, :len(part)] = part
                k += count
            raw, stride = out.tobytes(), kind.itemsize
            yield pa.RecordBatch.from_arrays(
                [pa.array((out["place"] // -(-m // shards)).astype(np.int32)), pa.array(out["place"].copy()),
                 pa.array([raw[i:i + stride - 1] for i in range(0, len(raw), stride)], pa.binary())],
                ["shard", "place", "record"],
            )
    if number > end:
        raise RuntimeError("an input split has more sequences than its texts can make, or splits changed")


def _bounded(encoded, limit: int = 1 << 22):
    """Lists of encoded texts of about ``limit`` bytes, with the row of the first."""
    held, size, first = [], 0, 0
    for row, ids in enumerate(encoded):
        held.append(ids)
        size += len(ids)
        if size >= limit:
            yield first, held
            held, size, first = [], 0, row + 1
    if held:
        yield first, held


def write_shards(
    docs: DataFrame, tokenizer: str, path: str, key: int, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, per_shard: int = PER_SHARD,
) -> None:
    """Write the shards below ``path``: ``shard=<number>/``, about ``per_shard`` records each.

    A sequence is up to ``length`` consecutive ids of one document; an empty or null text is one sequence of no ids.
    Null document ids are written as the smallest 64-bit number.  Repeated rows are sequences of their own.  An empty
    table writes no shard, and input splits without rows take no numbers.  The tokenizer must have fewer than 65,536 ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    # Two numbers per input split come to the driver, never one per row.
    splits = rows.select(F.spark_partition_id().alias("task"), size.alias("size")).groupBy("task").agg(
        F.sum(F.floor(F.col("size") * IDS_PER_BYTE / length) + 1).alias("most"),
        F.sum(F.floor(F.col("size") / (3 * length)) + 1).alias("likely"),
    ).collect()
    ranges, m = {}, 0
    for task, most, _ in sorted(tuple(r) for r in splits):
        ranges[task] = (m, m + most)
        m += most
    if not m:
        return
    shards = max(1, round(sum(r["likely"] for r in splits) / per_shard))
    records = rows.mapInArrow(
        lambda b: _records(b, tokenizer, length, ranges, m, key, shards), "shard int, place long, record binary"
    )
    dealt = records.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place")
    dealt.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").text(path)


def manifest(spark: SparkSession, path: str, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Shard, first slot and number of records, from the sizes of the files; a row per shard, none per record."""
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return []
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    found = sorted((int(r["path"].rsplit("shard=", 1)[1].split("/")[0]), r["length"]) for r in files.collect())
    out, first = [], 0
    for shard, size in found:
        n = size // record_type(length).itemsize
        out.append((shard, first, n))
        first += n
    return out


def _parse(batches, length: int, firsts: dict, first: int, end: int):
    kind = record_type(length)
    for batch in sliced(batches, 1):
        shard = batch.column(0)[0].as_py()
        records, base = np.frombuffer(batch.column(1)[0].as_buffer(), kind), firsts[shard]
        lo, hi = max(0, first - base), min(len(records), end - base)
        for at in range(lo, hi, 4096):
            part = records[at:min(at + 4096, hi)]
            doc_ids = pa.array(part["doc_id"].copy(), mask=part["doc_id"] == NO_ID)
            ids = [row[:k].tobytes() for row, k in zip(part["ids"], part["n"].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + len(part)) + base), pa.array([shard] * len(part), pa.int32()), pa.array(part["place"].copy()),
                 doc_ids, pa.array(part["piece"].astype(np.int32)), pa.array(part["n"].astype(np.int32)), pa.array(ids, pa.binary())],
                ["slot", "shard", "place", "doc_id", "piece", "n_tokens", "ids"],
            )


def read_shards(spark: SparkSession, path: str, first: int = 0, end: int | None = None, length: int = LENGTH) -> DataFrame:
    """Records of the slots from ``first`` to before ``end``: ``slot``, ``shard``, ``place``, ``doc_id``, ``piece``, ``n_tokens``, ``ids``.

    Only the shards of these slots are read.
    """
    schema = "slot long, shard int, place long, doc_id long, piece int, n_tokens int, ids binary"
    known = manifest(spark, path, length)
    end = sum(n for _, _, n in known) if end is None else end
    wanted = {shard: at for shard, at, n in known if at < end and at + n > first}
    if not wanted:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(path).filter(F.col("shard").between(min(wanted), max(wanted)))
    return files.select(F.col("shard").cast("int"), "content").mapInArrow(lambda b: _parse(b, length, wanted, first, end), schema)


def training_order(
    docs: DataFrame, tokenizer: str, key: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD
) -> DataFrame:
    """``write_shards`` to a new folder below the shared one, read back whole."""
    spark = docs.sparkSession
    path = fresh_path(spark, "llm-shards")
    write_shards(docs, tokenizer, path, key, id_col, text_col, length, per_shard)
    return read_shards(spark, path, length=length)
