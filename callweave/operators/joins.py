"""Size-checked broadcasts and per-group top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Estimated bytes up to which a lookup side may be shipped to every task.
BROADCAST_BYTES = 8 << 20
#: Plan nodes whose output Catalyst cannot bound by their input.
UNBOUNDED = ("Generate", "Expand", "InPandas", "InArrow", "Join", "Union", "Range")


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the plan itself bounds ``df`` to ``max_bytes``; no job runs for it.

    Scans, filters, projections and aggregations cannot outgrow their files, so Catalyst's estimate bounds them.  Any
    other plan is left to adaptive execution, which knows the size of a side before it joins it.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(node in plan.toString() for node in UNBOUNDED):
        return df
    return F.broadcast(df) if int(plan.stats().sizeInBytes()) <= max_bytes else df


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    The rank filter lets Spark insert a group limit below the exchange, so every task
    ships at most ``k`` rows per key and a hot key never reaches one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)

