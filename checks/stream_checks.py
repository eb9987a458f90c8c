"""Streaming jobs run until their input is used up, against the batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave import schema
from callweave.session import fresh_path
from callweave.streaming import chats as sc
from callweave.streaming import corpus as st

from . import views_chat as vc
from .chat_checks import CALL_COUNTS, HISTORY, call_counts, conv_keyed, ts
from .registry import check


def arriving_calls(spark, sf):
    """Calls as JSON line files; every call arrives twice."""
    path = fresh_path(spark, "arriving")
    calls = conv_keyed(spark, sf).drop("part")
    calls.write.json(path)
    calls.write.mode("append").json(path)
    return path


def later_and_earlier(spark, sf):
    """The same calls in two folders: first those of odd numbers, dated today, then all, the rest dated long before."""
    calls = conv_keyed(spark, sf).drop("part")
    odd = F.split("transcript_id", "#")[0].cast("long") % 2 == 1
    dated = calls.withColumn("timestamp", F.when(odd, F.lit("2024-02-01")).otherwise(F.lit("2023-01-01")).cast("timestamp"))
    path = fresh_path(spark, "dated")
    dated.filter(odd).write.json(f"{path}/first")
    dated.write.json(f"{path}/second")
    return path


def arriving_messages(spark, sf):
    path = fresh_path(spark, "messages")
    rows = vc.messages(spark, sf).withColumn("metadata", F.lit(None).cast("string")).select(*schema.MESSAGE.names)
    rows.repartition(4, "id").write.parquet(path)
    return path


@check("stream_corpus", CALL_COUNTS)
def stream_corpus(spark, sf):
    path, target, checkpoint = later_and_earlier(spark, sf), fresh_path(spark, "corpus"), fresh_path(spark, "checkpoint")
    for arrived in ("first", "{first,second}"):  # the second run sees new files in the same source, older calls and repeats
        st.append_corpus(spark, f"{path}/{arrived}", target, checkpoint)
    return call_counts(spark.read.schema(schema.CALL).parquet(target))


@check("stream_chat_updates", "SELECT chat_id, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM messages GROUP BY 1")
def stream_chat_updates(spark, sf):
    out = sc.update_times(spark, arriving_messages(spark, sf), fresh_path(spark, "times"), fresh_path(spark, "checkpoint"), 2)
    return out.select("chat_id", ts("updated_at").alias("updated_at"))


@check("stream_recent_history", f"SELECT chat_id, id, role, content, place FROM ({HISTORY.format(n=4)})")
def stream_recent_history(spark, sf):
    out = sc.update_history(
        spark, arriving_messages(spark, sf), fresh_path(spark, "history"), fresh_path(spark, "checkpoint"), 4, 2)
    return out.select("chat_id", "id", "role", "content", "place")


@check("stream_graph_upsert", """
SELECT DISTINCT transcript_id || '#' || part AS transcript_id, 'IN_DOMAIN' AS edge, coalesce(domain, 'Unknown') AS target FROM conv_calls
UNION SELECT transcript_id || '#' || part, 'HAS_REASON', coalesce(intent, 'Unknown') FROM conv_calls
UNION SELECT transcript_id || '#' || part, 'HAS_DRIVER', driver FROM conv_drivers""")
def stream_graph_upsert(spark, sf):
    source, path = arriving_calls(spark, sf), fresh_path(spark, "edges")
    st.update_graph(spark, source, path, fresh_path(spark, "checkpoint"), max_files=4)
    return st.stored_edges(spark, path).select("transcript_id", "edge", "target")
