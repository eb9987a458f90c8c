"""Chats and messages: validity, threads, history, totals, deletes and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from .joins import top_k
from .scan import pages

# Message roles, history length, user questions looked back at, first title.
ROLES = ["user", "assistant"]
MAX_HISTORY_MESSAGES = 10
LAST_USER_QUERIES = 3
#: Messages that one thread row holds.
THREAD_MESSAGES = 1000


def valid_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with an allowed role, and the rejected rest."""
    ok = F.coalesce(F.col("role").isin(ROLES), F.lit(False))
    return messages.filter(ok), messages.filter(~ok)


def chat_threads(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Chats with their messages in time order, a long thread over several pages.

    A chat without messages keeps one row with an empty list.
    """
    item = F.struct("id", "role", "content", "created_at")
    rows = pages(messages.withColumnRenamed("id", "message_id").select(
        "chat_id", "created_at", F.col("message_id").alias("id"), "role", "content"),
        ["chat_id"], ["created_at", "id"], item, THREAD_MESSAGES, "messages")
    return chats.withColumnRenamed("id", "chat_id").join(rows, "chat_id", "left").select(
        "chat_id", "title", F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce("messages", F.array().cast(rows.schema["messages"].dataType)).alias("messages"))


def cascade_delete(chats: DataFrame, messages: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats and messages without those of the deleted chats."""
    gone = deleted.select("chat_id").distinct()
    kept = chats.join(gone.withColumnRenamed("chat_id", "id"), "id", "left_anti")
    return kept, messages.join(gone, "chat_id", "left_anti")


def recent_history(messages: DataFrame, n: int = MAX_HISTORY_MESSAGES) -> DataFrame:
    """Last ``n`` messages per chat with their place, oldest first."""
    last = top_k(messages, ["chat_id"], [F.desc("created_at"), F.desc("id")], n, "age")
    # At most n rows per chat are left to turn around.
    from pyspark.sql import Window

    order = Window.partitionBy("chat_id").orderBy(F.desc("age"))
    return last.withColumn("place", F.row_number().over(order).cast("long")).drop("age")


def recent_user_queries(messages: DataFrame, n: int = LAST_USER_QUERIES) -> DataFrame:
    """Last user messages within the recent history."""
    asked = recent_history(messages).filter("role = 'user'")
    return top_k(asked, ["chat_id"], [F.desc("place")], n, "back")


def last_update(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(F.max("created_at").alias("updated_at"))


def token_totals(messages: DataFrame) -> DataFrame:
    """Whitespace tokens per chat."""
    return messages.select("chat_id", fx.word_count(F.col("content")).alias("tokens")).groupBy("chat_id").agg(
        F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("messages"))


def titles(messages: DataFrame) -> DataFrame:
    """Title per chat out of its first user message."""
    first = messages.filter("role = 'user'").groupBy("chat_id").agg(
        F.min_by("content", F.struct("created_at", "id")).alias("content"))
    return first.select("chat_id", fx.chat_title(F.col("content")).alias("title"))


def append_messages(chats: DataFrame, stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats and messages after an append.

    New messages with a known id are ignored, invalid roles rejected.  A chat that had no
    message so far takes its title from the first user message, and every touched chat a
    new update time.
    """
    accepted, _ = valid_messages(incoming)
    fresh = accepted.join(stored.select("id"), "id", "left_anti").dropDuplicates(["id"])
    messages = stored.unionByName(fresh, allowMissingColumns=True)
    first = titles(fresh.join(stored.select("chat_id").distinct(), "chat_id", "left_anti")).select(
        F.col("chat_id").alias("id"), F.col("title").alias("new_title"))
    touched = last_update(fresh).select(F.col("chat_id").alias("id"), F.col("updated_at").alias("new_time"))
    updated = chats.join(first, "id", "left").join(touched, "id", "left").select(
        "id", F.coalesce("new_title", "title").alias("title"), "created_at",
        F.greatest("updated_at", "new_time").alias("updated_at"))
    return updated, messages


def by_recency(chats: DataFrame) -> DataFrame:
    return chats.orderBy(F.desc("updated_at"), "id")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in ``order``: an index in which later rows replace earlier ones."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def registry_union(known: DataFrame, mentioned: DataFrame, key: str = "id") -> DataFrame:
    """Known documents, and a bare row for every id that only clusters mention."""
    extra = mentioned.select(key).distinct().join(known.select(key), key, "left_anti")
    return known.withColumn("known", F.lit(True)).unionByName(
        extra.withColumn("known", F.lit(False)), allowMissingColumns=True)
