"""Chat update times and recent history kept up to date from arriving messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.chats import MAX_HISTORY_MESSAGES, recent_history

#: State keys per chat, so that a chat with very many messages spreads over tasks.
HISTORY_SHARDS = 16


def message_stream(spark: SparkSession, source: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema.MESSAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source)


def _to_batches(stream: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Write every micro-batch to its own folder; one that runs again replaces itself."""

    def save(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def update_times(spark: SparkSession, source: str, path: str, checkpoint: str, max_files: int | None = None) -> DataFrame:
    """Latest message time per chat; each batch writes only the chats it moved."""
    latest = message_stream(spark, source, max_files).groupBy("chat_id").agg(F.max("created_at").alias("updated_at"))
    _to_batches(latest, path, checkpoint, "update")
    return spark.read.parquet(path).groupBy("chat_id").agg(F.max("updated_at").alias("updated_at"))


def _keep_last(n: int):
    def keep(key, batches, state):
        import json

        import pandas as pd

        held = json.loads(state.get[0]) if state.exists else []
        known = {row[1] for row in held}
        for pdf in batches:
            for at, name, role, content in zip(pdf["at"], pdf["id"], pdf["role"], pdf["content"]):
                if name not in known:
                    held.append([int(at), name, role, content])
                    known.add(name)
            held = sorted(held, key=lambda row: (row[0], row[1]))[-n:]
            known = {row[1] for row in held}
        state.update((json.dumps(held),))
        yield pd.DataFrame({
            "chat_id": [key[0]] * len(held), "shard": [key[1]] * len(held),
            "at": [row[0] for row in held], "id": [row[1] for row in held],
            "role": [row[2] for row in held], "content": [row[3] for row in held],
        })

    return keep


def update_history(
    spark: SparkSession, source: str, path: str, checkpoint: str, n: int = MAX_HISTORY_MESSAGES, max_files: int | None = None
) -> DataFrame:
    """Last ``n`` messages per chat, late ones sorted into their place.

    State holds at most ``n`` messages per chat and shard.  A shard's newest output
    replaces its earlier ones, and the shards of a chat merge by a top-k when read.
    """
    rows = message_stream(spark, source, max_files).select(
        "chat_id", F.pmod(F.xxhash64("id"), F.lit(HISTORY_SHARDS)).alias("shard"),
        F.unix_micros("created_at").alias("at"), "id", "role", "content")
    columns = "chat_id string, shard long, at long, id string, role string, content string"
    kept = rows.groupBy("chat_id", "shard").applyInPandasWithState(
        _keep_last(n), columns, "held string", "update", "NoTimeout")
    _to_batches(kept, path, checkpoint, "update")
    return read_history(spark, path, n)


def read_history(spark: SparkSession, path: str, n: int = MAX_HISTORY_MESSAGES) -> DataFrame:
    written = spark.read.parquet(path)
    newest = written.groupBy("chat_id", "shard").agg(F.max("batch").alias("batch"))
    current = written.join(newest, ["chat_id", "shard", "batch"], "left_semi")
    return recent_history(current.withColumn("created_at", F.timestamp_micros("at")), n).select(
        "chat_id", "id", "role", "content", "created_at", "place")
