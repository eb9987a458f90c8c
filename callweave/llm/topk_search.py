"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors lie in blocks of consecutive rows, each with a forward index (the vectors as one matrix) and the greatest and least
value of every term (component).  For a query, the greatest score a block can hold is the sum over its terms of the
greater of query * greatest and query * least.  A query takes its blocks in falling order of this bound, scores a block
through the forward index, and stops as soon as the next bound lies below its k-th score.

Spark pairs groups of blocks with groups of queries, both of bounded size, so no task holds all of either; each pair
returns k rows per query and a last ranking joins them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stored

#: Vectors of a block, blocks of a group, queries of a group.
BLOCK, GROUP, QUERIES = 512, 16, 4096
SCALE = 256


def _quantised(batches, scale: int):
    for batch in sliced(batches):
        ids, vectors = [], []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if vec_id is None or vector is None or None in vector:
                continue
            values = np.asarray(vector, np.float64)
            if np.isfinite(values).all():
                ids.append(vec_id)
                vectors.append(np.floor(values * scale).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "vector"])


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; a shorter one ends in zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, raw in enumerate(vectors):
        values = np.frombuffer(raw, "<i8")
        out[row, :len(values)] = values
    return out


def search_blocks(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, block: int):
    """Query row, vector id and score of the k best rows of each query; ties to the smaller id."""
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    n, m = len(rows), len(queries)
    # Products in double precision are exact while every sum stays within 2**53.
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]) < 2.0**53
    kind = np.float64 if exact else np.int64
    left = queries.astype(kind)
    starts = np.arange(0, n, block)
    index = [rows[s:s + block].astype(kind) for s in starts]
    greatest, least = np.array([x.max(axis=0) for x in index]), np.array([x.min(axis=0) for x in index])
    bounds = np.maximum(left, 0) @ greatest.T + np.minimum(left, 0) @ least.T
    turn = np.argsort(-bounds, axis=1, kind="stable")
    low = -np.iinfo(np.int64).max
    best, names = np.full((m, k), low, np.int64), np.full((m, k), np.iinfo(np.int64).max, np.int64)
    live = np.arange(m)
    for step in range(len(starts)):
        now = turn[live, step]
        going = bounds[live, now] >= best[live, k - 1]  # at an equal bound a smaller id may still come in
        live, now = live[going], now[going]
        if not len(live):
            break
        for b in np.unique(now):
            asked = live[now == b]
            scores = (left[asked] @ index[b].T).astype(np.int64)
            ids = row_ids[starts[b]:starts[b] + block]
            scores[ids[None, :] == query_ids[asked, None]] = low
            every, every_ids = np.concatenate((best[asked], scores), axis=1), np.concatenate((names[asked], np.broadcast_to(ids, scores.shape)), axis=1)
            first = np.lexsort((every_ids, -every), axis=1)[:, :k]
            best[asked], names[asked] = np.take_along_axis(every, first, 1), np.take_along_axis(every_ids, first, 1)
    found = best > low
    return np.nonzero(found)[0], names[found], best[found]


def _pair(key, queries: pa.Table, rows: pa.Table, k: int, block: int) -> pa.Table:
    empty = pa.table({"query_row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    if not queries.num_rows or not rows.num_rows:
        return empty
    a, b = queries.column("vector").to_pylist(), rows.column("vector").to_pylist()
    width = max(len(x) // 8 for x in a + b)
    query_ids, query_rows = queries.column("vec_id").to_numpy(), queries.column("query_row").to_numpy()
    at, ids, scores = search_blocks(_matrix(a, width), query_ids, _matrix(b, width), rows.column("vec_id").to_numpy(), k, block)
    return pa.table({"query_row": query_rows[at], "query_id": query_ids[at], "vec_id": ids, "score": scores})


def top_k_search(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = SCALE,
    block: int = BLOCK, group: int = GROUP, queries_at_once: int = QUERIES,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k rows of highest score for every query row.

    ``is_query`` is a condition on ``vec_id``.  Components become floor(scale * x); the score is the integer inner
    product, a shorter vector counts as ending in zeros, ties go to the smaller id, and rows of the query's own id are
    no candidates.  Rows without id, without vector or with a null or non-finite component take no part.  A repeated
    row is a candidate as often as it is there; a repeated query row is ranked each time.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    ready = rows.mapInArrow(lambda b: _quantised(b, scale), "vec_id long, vector binary")
    ready = stored(ready.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = ready.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = ready.filter(is_query)
    # Groups are dealt by a hash of the row, so their sizes stay near the number asked for, whatever the ids are.
    row_groups, query_groups = max(1, n // (block * group)), max(1, asked.count() // queries_at_once)
    hashed = lambda m: F.pmod(F.xxhash64("row"), F.lit(m))
    candidates = ready.withColumn("g", hashed(row_groups)).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_groups - 1).cast("long"))))
    queries = asked.withColumn("q", hashed(query_groups)).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_groups - 1).cast("long"))))
    queries = queries.withColumnRenamed("row", "query_row")
    found = queries.groupBy("g", "q").cogroup(candidates.groupBy("g", "q")).applyInArrow(
        lambda key, a, b: _pair(key, a, b, k, block), "query_row long, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
