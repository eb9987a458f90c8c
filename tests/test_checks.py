"""Registered queries: every one has an SQL twin or a stated reason, and twins agree."""

import pytest

import __spark_entry__ as entry
from checks import all_checks
from checks.compare import duck, rows_of

SF = "/root/testdata/sf0.001"
#: Iterative clustering and alignments have no SQL twin.
ROWS_ONLY = {"rouge_l", "eval_report_rouge_l"}
SAMPLE = ["graph_edges", "ppr_rank", "dialogue_pairs", "call_string", "bm25_topk", "mmr_select", "cluster_breakdown",
          "retrieval_metrics", "bleu", "chat_threads", "multi_call_questions", "parse_list_cell", "stream_chat_updates"]


def test_every_query_is_covered():
    assert set(all_checks.QUERIES) - set(all_checks.oracle()) == ROWS_ONLY
    assert set(all_checks.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_twins_agree(spark, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck(SF).execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())
