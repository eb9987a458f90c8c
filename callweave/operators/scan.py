"""Ordered positions and running values for groups of any size.

A plain window puts a whole group into one task.  Here rows also carry a block number
that grows with the order; windows run inside ``(keys, block)`` and one small row per
block carries the running value across blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows per block when a block number is derived from a dense index.
BLOCK_ROWS = 4096


def index_block(index: str, rows: int = BLOCK_ROWS) -> Column:
    """Block of a dense per-group index."""
    return F.floor(F.col(index) / rows).cast("long")


def range_blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """Give every row the number of its range partition in the global order.

    Sampled range partitions are of even size whatever the key distribution.  The rows
    are written once, so that later passes see the same block numbers after a task is
    run again.
    """
    placed = df.repartitionByRange(*order).withColumn("block", F.spark_partition_id().cast("long"))
    return materialize(placed, "blocks")


def carried(df: DataFrame, keys: list[str], block: str, total: Column, name: str, combine=F.sum) -> DataFrame:
    """Add ``name``: ``combine`` of ``total`` over all earlier blocks of the group (null in the first)."""
    per_block = df.groupBy(*keys, block).agg(total.alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*keys, block, combine("_total").over(earlier).alias(name))
    return df.join(offsets, [*keys, block])


def positions(df: DataFrame, keys: list[str], order: list[Column], block: str = "block", name: str = "position") -> DataFrame:
    """1-based row number per group in ``order``; ``block`` must grow with it."""
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inside))
    with_offset = carried(numbered, keys, block, F.count("*"), "_before")
    return with_offset.withColumn(
        name, (F.coalesce("_before", F.lit(0)) + F.col("_inside")).cast("long")
    ).drop("_inside", "_before")


def pages(df: DataFrame, keys: list[str], order: list[str], value: Column, rows: int, name: str) -> DataFrame:
    """Ordered lists per group, cut into pages of ``rows`` items: ``(keys, page, name[])``.

    A group that fits in one page comes back as a single list; a larger one as several,
    none of which outgrows a task.
    """
    at = positions(range_blocks(df.select(*keys, *[c for c in order if c not in keys], value.alias("_value")),
                                [*keys, *[c for c in order if c not in keys]]),
                   keys, [F.col(c) for c in order])
    paged = at.withColumn("page", F.floor((F.col("position") - 1) / rows).cast("long"))
    return paged.groupBy(*keys, "page").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "_value"))), lambda s: s["_value"]
        ).alias(name)
    )


def sorted_runs(rows: DataFrame, key: str, order: list[str], build, schema: str) -> DataFrame:
    """One row per value of ``key``, built from its rows in ``order``; null is a value.

    ``rows`` must be partitioned by ``key``.  Spark sorts them, and Arrow cuts the sorted stream where the key changes, so small groups
    cost no object of their own and a task holds a batch and the group that is open at its end.  ``build`` gets whole groups as a
    table, their keys, and the first row of each group with the number of rows behind the last.
    """

    def cuts(ids):
        import numpy as np
        import pyarrow.compute as pc

        a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        return np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def built(parts):
            whole = pa.Table.from_batches(parts)
            ids = whole.column(key).combine_chunks()
            first = np.concatenate(([0], cuts(ids), [len(ids)])).astype(np.int32)
            return build(whole, ids.take(pa.array(first[:-1])), first).to_batches(max_chunksize=10_000)

        held = []
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(key)
            found = cuts(pa.concat_arrays([held[-1].column(key).slice(len(held[-1]) - 1), ids])) - 1 if held else cuts(ids)
            if not len(found):
                held.append(batch)
                continue
            if len(parts := [x for x in (*held, batch.slice(0, found[-1])) if len(x)]):
                yield from built(parts)
            held = [batch.slice(found[-1])]
        if held:
            yield from built(held)

    return rows.sortWithinPartitions(key, *order).mapInArrow(run, schema)
