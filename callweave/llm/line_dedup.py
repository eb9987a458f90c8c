"""Line dedup: windows of three consecutive lines that occur earlier in the table lose their lines.

Each text sends hashes of its overlapping windows; one aggregation with map-side combine finds the first place of every
window that occurs more than once, and a join on the hash, which adaptive execution splits for hot windows, marks the
later places.  Covered lines of a text are merged and cut out where text and marks meet, once.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, release, same_row, sliced, stored, with_extra

#: Consecutive lines of a window.
WINDOW = 3


def _windows(batches, width: int):
    """Two 64-bit hashes of every window of whole lines, and the number of its first line."""
    hash_a, hash_b = xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
    for batch in sliced(batches):
        rows, lines_at, a, b = [], [], [], []
        for row, value in enumerate(batch.column(1).cast(pa.binary())):
            text = value.as_py()
            breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
            n = len(breaks) + 2 - width
            if n < 1:
                continue
            starts = np.concatenate(([0], breaks + 1))[:n].tolist()
            ends = np.concatenate((breaks, [len(text)]))[width - 1:].tolist()
            rows += [row] * n
            lines_at += range(n)
            for s, e in zip(starts, ends):
                part = text[s:e]
                a.append(hash_a(part))
                b.append(hash_b(part))
        if rows:
            index = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(2).take(index), pa.array(lines_at, pa.int32()),
                 *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b))],
                ["doc_id", "row_hash", "line", "hash_a", "hash_b"],
            )


def _without(batches, width: int):
    for batch in sliced(batches):
        kept, n_lines, removed = [], [], []
        texts = batch.column(1).to_pylist()
        for text, firsts in zip(texts, batch.column(2).to_pylist()):
            lines = text.split("\n")
            stay = np.ones(len(lines), bool)
            for first in firsts or ():
                stay[first:first + width] = False
            kept.append("\n".join(compress(lines, stay)) if firsts else text)
            n_lines.append(len(lines))
            removed.append(int((~stay).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64()),
             *batch.columns[4:]],
            ["doc_id", "row_hash", "kept_text", "n_lines", "n_removed", *batch.schema.names[4:]],
        )


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, carry: bool = False) -> DataFrame:
    """``doc_id``, ``row_hash``, ``kept_text``, ``n_lines``, ``n_removed`` for every row of ``docs``, and ``extra`` with ``carry``.

    Lines are what stands between line feeds; null counts as empty, and the empty text is one empty line.  A window is
    ``width`` consecutive lines of one text, compared exactly; a text of fewer lines has none and stays whole.  Places
    are ordered by id (null first), text hash and line; of equal windows the first place stays and all lines of the
    others go, also where windows overlap in one text.  Windows are judged on the input.  Repeated rows count as one
    text, so none of them loses lines to the other.
    """
    rows = keyed(docs, id_col, text_col, carry)
    schema = "doc_id long, row_hash long, line int, hash_a long, hash_b long"
    windows = stored(rows.select("doc_id", "text", "row_hash").mapInArrow(lambda b: _windows(b, width), schema), "windows")
    place = F.struct("doc_id", "row_hash", "line")
    repeated = windows.groupBy("hash_a", "hash_b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = stored(repeated.drop("n"), "repeated")  # a stored side lets adaptive execution split hot windows of the other
    later = windows.join(repeated, ["hash_a", "hash_b"]).filter(~place.eqNullSafe(F.col("first")))
    later = later.groupBy("doc_id", "row_hash").agg(F.collect_list("line").alias("firsts"))
    later = stored(later, "later")
    release(windows)
    # The same join at every size: a broadcast that fits today would be a shuffle tomorrow.
    later = later.hint("merge")
    both = rows.join(later, same_row(rows, later), "left").select(rows["doc_id"], "text", "firsts", rows["row_hash"], *rows.columns[3:])
    schema = "doc_id long, row_hash long, kept_text string, n_lines long, n_removed long"
    return both.mapInArrow(lambda b: _without(b, width), with_extra(schema, rows))
