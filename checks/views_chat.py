"""Adapter: conversations as chats and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import view
from .views import table

view("messages", """
SELECT conv_id || ':' || turn AS id, cast(conv_id AS VARCHAR) AS chat_id, role, text AS content,
       CASE WHEN role = 'assistant' THEN 'model-' || (turn % 2) END AS model, cast(length(text) // 4 AS INTEGER) AS token_count,
       TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn) AS created_at FROM conversations""")
view("chats", """
SELECT DISTINCT cast(conv_id AS VARCHAR) AS id, 'New Chat' AS title, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60) AS created_at FROM conversations""")


def at(minutes):
    return (F.lit("2024-01-01 00:00:00").cast("timestamp").cast("long") + minutes * 60).cast("timestamp")


def messages(spark, sf):
    chat, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        F.concat_ws(":", chat.cast("string"), turn.cast("string")).alias("id"), chat.cast("string").alias("chat_id"), "role",
        F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("model-"), (turn % 2).cast("string"))).alias("model"),
        F.floor(F.length("text") / 4).cast("int").alias("token_count"), at(chat * 60 + turn).alias("created_at"))


def chats(spark, sf):
    return table(spark, sf, "conversations").select("conv_id").distinct().select(
        F.col("conv_id").cast("string").alias("id"), F.lit("New Chat").alias("title"), at(F.col("conv_id") * 60).alias("created_at"))
