"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and read back as the next stage's ``docs``.  All but the last return the columns of ``documents``.  Nulls count
as empty texts; repeated rows are documents of their own until the near-dedup stage, which leaves one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import bin_packing, line_dedup, near_dedup, passage_dedup, quality
from callweave.llm.common import stored, table


def _with_text(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``rows`` as the columns of ``docs``, with the new text and its length."""
    columns = {c: F.col(f"extra.{c}") for c in docs.columns}
    columns |= {"text": F.col(text)} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return rows.select(*(columns[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged."""
    return quality.keep_good(docs, quality.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without three-line windows that occur earlier."""
    return _with_text(line_dedup.remove_repeated_lines(docs, carry=True), docs, "kept_text")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by SimHash of five-word runs at a Jaccard similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, size=5, similarity=0.8)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of 50 words or more that also occur elsewhere."""
    return _with_text(passage_dedup.remove_repeated_words(docs, words=50, carry=True), docs, "kept")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    return bin_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("suffix_array_dedup", dedup_passages),
    ("best_fit_packing", pack),
]

#: SQL cannot express the classifier, the suffix ties or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
