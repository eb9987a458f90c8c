"""Near-dedup at a Jaccard similarity of word shingles: the SimHash trie proposes pairs, the whole texts decide them.

1. Each distinct text gets a 64-bit SimHash of its shingles.
2. Distinct fingerprints are linked by walks of their binary trie (``simhash_dedup``), one for each of ``TURNS`` rotations of the bits,
   which together meet every pair of at most ``BITS`` differing bits.  First each walk keeps the nearest links that connect a group.
   A link stands for the least and for the greatest text of both fingerprints; texts of one fingerprint are paired with its least and
   its greatest.  What these pairs connect once steps 3 and 4 have decided them needs no further pair, so groups of copies stay cheap.
   A second walk then gives every other pair of texts whose fingerprints are met, in one or in two fingerprints, to the same steps.
3. Each text also has the counts of its different shingles in ``PLACES`` places of the hash.  Two texts share no more shingles than
   the lesser counts add up to, so most pairs that are not similar enough are told without their texts, and no other pair goes.
4. A pair links if the shingle sets of both whole texts are similar enough; linked texts form components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, keyed, release, sliced, stored
from .simhash_dedup import fingerprint, rotated_links, rotated_pairs, run_hashes

#: Differing bits up to which all pairs of fingerprints are met; rotations of the bits.
BITS, TURNS = 15, 4
#: Places among which the counts of a text's shingles are dealt by their hash.
PLACES = 64


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the different runs of ``size`` words; a shorter text is one run, one without words has none."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *run_hashes(text, size)]))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def most(a: bytes, b: bytes) -> float:
    """The greatest similarity that texts with these counts of shingles can have."""
    a, b = (np.frombuffer(x, np.uint8 if len(x) == PLACES else np.uint32).astype(np.int64) for x in (a, b))
    both = int(np.minimum(a, b).sum())
    every = int(a.sum() + b.sum()) - both
    return both / every if every else 1.0


def _prints(batches, size: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 256):
        prints = [fingerprint(text.as_py(), size) for text in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["node", "print"])


def _counted(batches, size: int, prints) -> Iterator[pa.RecordBatch]:
    """What ``prints`` says of each text, and the counts of its shingles."""
    for batch in sliced(batches, 256):
        counts = []
        for text in batch.column(1).cast(pa.binary()):
            count = np.bincount((shingles(text.as_py(), size) % PLACES).astype(np.int64), minlength=PLACES)
            counts.append(count.astype(np.uint8 if count.max() < 256 else np.uint32).tobytes())
        for found in prints([batch], size):
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(counts, pa.binary())], ["node", "print", "counts"])


def _possible(batches, least: float) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        maybe = [most(a, b) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield batch.select([0, 1]).filter(pa.array(maybe, pa.bool_()))


def _similar(batches, size: int, least: float) -> Iterator[pa.RecordBatch]:
    read = lru_cache(16)(lambda text: shingles(text, size))
    for batch in sliced(batches, 64):
        texts = [batch.column(c).cast(pa.binary()) for c in (2, 3)]
        near = [jaccard(read(a.as_py()), read(b.as_py())) >= least for a, b in zip(*texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(near, pa.bool_()))


def near_links(docs: DataFrame, text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``src``, ``dst``: hashes of texts whose shingle sets are similar to at least ``similarity``; they connect all such texts that are met."""
    rows = keyed(docs.select(text_col, F.lit(0).alias("id")), "id", text_col)
    texts = rows.select(F.col("row_hash").alias("node"), "text")
    prints = stored(texts.mapInArrow(lambda b: _counted(b, size, _prints), "node long, print long, counts binary").dropDuplicates(["node"]), "prints")
    ends = stored(prints.groupBy("print").agg(F.min("node").alias("a"), F.max("node").alias("b")), "ends")
    same = prints.join(ends.filter("a < b"), "print").select("node", F.explode(F.array("a", "b")).alias("other"))
    near = rotated_links(ends.select("print"), BITS, TURNS)
    near = near.join(ends.toDF("src", "a", "b"), "src").join(ends.toDF("dst", "c", "d"), "dst")
    near = near.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("c").alias("other")), F.struct(F.col("b").alias("node"), F.col("d").alias("other")))))
    pairs = same.union(near).filter("node <> other")
    pairs = stored(pairs.select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).distinct(), "met")
    found = _decided(pairs, prints, texts, size, similarity)
    release(ends)
    rest = _decided(_apart(prints, found, pairs), prints, texts, size, similarity, "rest-")
    release(prints, pairs)
    return found.union(rest)


def _apart(prints: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """``src``, ``dst``: all pairs of texts whose fingerprints are met, but those that ``found`` connects and those ``known``."""
    placed = prints.select("node", "print").join(components(found).toDF("node", "part"), "node", "left")
    placed = stored(placed.select("print", "node", F.coalesce("part", "node").alias("part")), "placed")
    parts = placed.groupBy("print").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    parts = stored(parts.select("print", F.when(F.col("a") == F.col("b"), F.col("a")).alias("part")), "parts")
    met = rotated_pairs(parts, BITS, TURNS).union(parts.filter("part is null").select("print", "print"))
    both = met.toDF("p", "q").join(placed.toDF("p", "node", "part"), "p").join(placed.toDF("q", "other", "part2"), "q")
    # Texts of one fingerprint meet from both sides.
    both = both.filter("part <> part2 and (p <> q or node < other)")
    return both.select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).join(known, ["src", "dst"], "left_anti")


def _decided(pairs: DataFrame, prints: DataFrame, texts: DataFrame, size: int, similarity: float, label: str = "") -> DataFrame:
    """The pairs whose texts are similar to at least ``similarity``."""
    counts = prints.select("node", "counts")
    both = pairs.join(counts.toDF("src", "a"), "src").join(counts.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")
    pairs = stored(both.mapInArrow(lambda b: _possible(b, similarity), "src long, dst long"), f"{label}pairs")
    met = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    texts = texts.join(met, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(texts, f"{label}texts")
    # The text at the end that more pairs share is joined last, where adaptive execution splits its pairs.
    both = pairs.join(texts.toDF("src", "a"), "src").join(texts.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")
    found = stored(both.mapInArrow(lambda b: _similar(b, size, similarity), "src long, dst long"), f"{label}links")
    release(pairs, texts)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one of each component of links: the one with the smallest id (null last), then the smallest text hash.

    Of repeated rows one stays.  Null counts as empty; texts without words are copies of each other.  All columns of ``docs``
    come back as they were.
    """
    groups = components(near_links(docs, text_col, size, similarity))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("row_hash"))
    # The first row of each distinct text, then of each component.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row_hash")
    firsts = stored(ids.groupBy("row_hash").agg(F.min(order).alias("row")), "firsts")
    named = firsts.join(groups, firsts["row_hash"] == groups["node"], "left")
    winners = named.groupBy(F.coalesce("component", "row_hash").alias("component")).agg(F.min("row").alias("row")).select("row.*")
    # Join and numbering use the same plain keys, so the rows cross one exchange; numbering leaves one of repeated rows.
    keys = ["no_id", "id", "row_hash"]
    rows = docs.select(
        F.col(id_col).cast("long").isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("row_hash"), F.struct(*docs.columns).alias("extra"),
    )
    kept = rows.join(winners.hint("merge"), keys)
    again = Window.partitionBy(*keys).orderBy(F.lit(1))
    return kept.withColumn("nth", F.row_number().over(again)).filter("nth = 1").select("extra.*")
