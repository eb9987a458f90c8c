"""Best-fit packing by minimum bin slack.

Each bin takes the longest piece left and the combination of available lengths that fills the rest best, found by
subset sums in a bitset.  Pieces of one length are alike, so the search runs on the histogram of lengths: a
combination is used as often as its lengths allow, which empties at least one length each time.  The histogram has at
most ``capacity`` rows and so has the list of combinations, whatever the size of the table.  Pieces then take their
places by rank within their length; ranks come from counts per task and length, so no length gathers in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stored
from .word_tokens import encoder

PLAN_SCHEMA = "length long, first_rank long, end_rank long, copies long, first_bin long, at long"


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """Copies per length with the largest sum within ``room``, long pieces preferred."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, batch = min(counts[length], room // length), 1
        while left:
            take = min(batch, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, batch = left - take, batch * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def combinations(counts: dict[int, int], capacity: int) -> list[tuple]:
    """Rows of ``PLAN_SCHEMA``: which ranks of a length go to which bins and where."""
    left = {x: n for x, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    plan, bins = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        take = fullest(capacity - longest, {x: n for x, n in left.items() if n})
        left[longest] += 1
        take[longest] = take.get(longest, 0) + 1
        times = min(left[x] // c for x, c in take.items())
        at = 0
        for length, copies in sorted(take.items(), reverse=True):
            plan.append((length, used[length], used[length] + times * copies, copies, bins, at))
            used[length] += times * copies
            left[length] -= times * copies
            if not left[length]:
                del left[length]
            at += length * copies
        bins += times
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``length``, ``task``, ``nth`` (rank of a length in its task)."""
    spark = pieces.sparkSession
    by_task = stored(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = spark.createDataFrame(combinations(counts, capacity), PLAN_SCHEMA)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    # The plan depends on the capacity alone, not on the table, so it may be broadcast.
    placed = ranked.join(
        F.broadcast(plan.withColumnRenamed("length", "for_length")),
        (F.col("length") == F.col("for_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")),
    )
    place = F.col("rank") - F.col("first_rank")
    return placed.select(
        *pieces.columns, (F.col("first_bin") + F.floor(place / F.col("copies"))).alias("sequence_id"),
        (F.col("at") + place % F.col("copies") * F.col("length")).alias("offset"),
    )


def _pieces(batches, path: str, capacity: int, end_id: int, with_ids: bool):
    encode, end = encoder(path).encode, np.array([end_id], "<u4").tobytes()
    seen, task, width = [0] * (capacity + 1), TaskContext.get().partitionId(), 4 * capacity
    for batch in sliced(batches):
        rows, out = [], {k: [] for k in ("piece", "start", "length", "crc", "nth", "ids")}
        for row, text in enumerate(batch.column(1).to_pylist()):
            ids = encode(text or "") + end
            for piece, at in enumerate(range(0, len(ids), width)):
                part = ids[at:at + width]
                length = len(part) // 4
                rows.append(row)
                for key, value in zip(out, (piece, at // 4, length, zlib.crc32(part), seen[length], part)):
                    out[key].append(value)
                seen[length] += 1
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out["piece"], pa.int32())]
        columns += [pa.array(out[k], pa.int64()) for k in ("start", "length", "crc", "nth")]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"]
        columns.append(pa.array([task] * len(rows), pa.int32()))
        if with_ids:
            columns.append(pa.array(out["ids"], pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most ``capacity`` tokens.

    ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and with ``with_ids`` the
    ids themselves (little-endian, four bytes each; see ``sequences``).  A document is its ids and ``end_id``, so an
    empty or null text has one id.  Only a document beyond the capacity is cut.  Null ids and repeated rows are
    documents like others.  An empty table has no pieces.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task int"
    schema += ", ids binary" if with_ids else ""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(rows.mapInArrow(lambda b: _pieces(b, tokenizer, capacity, end_id, with_ids), schema), "pieces")
    return pack(pieces, capacity).drop("nth", "task")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids``: the filled sequences, from ``pack_documents(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda held, part: F.concat(held, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
