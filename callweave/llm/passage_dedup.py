"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that also starts somewhere else goes.

Only ties of the suffix array matter here: suffixes that agree on their first ``length`` bytes.  They are found by
blockwise construction, one suffix bucket at a time, with ties resolved by ranks of a cover sample taken beforehand:

* Cover sample.  Each window of ``length`` bytes contains a sampled position, the one whose next eight bytes mix to
  the least value.  As with an arithmetic difference cover, any two suffixes reach the sample after a bounded number
  of bytes, at one common offset.  Being chosen by content, the offset is the same for all suffixes that agree, so a
  suffix is named by one offset and one sample rank, and the sample is some twenty times sparser.
* Buckets.  A bucket holds the suffixes that reach the sample at equal strings (``core``).  Those of one sampled
  position are consecutive starts, so a bucket row is a run of starts, not a suffix.  A bucket of one row is unique.
* Long ties.  A bucket is sorted by the string its whole run covers (``span``).  Equal spans tie on every suffix of the
  run.  Where spans differ, the run is cut into ``STEP`` starts with cores and spans of their own, and what still
  differs is cut into single suffixes, whose ``length`` bytes then are core, left part and right part.

All of this is counting of keys with map-side combine, so no task holds a bucket: a passage in a third of all rows is
as good as any.  The sample crosses an exchange as numbers; texts cross one when differing runs are cut and one when
removed bytes are taken out.  Spans and cores are compared by 128 bits (two 64-bit hashes with different seeds).

``remove_repeated_words`` applies the same to texts of words: each word stands as four bytes of its hash, so ``words`` words in a row
are a string of fixed length however long their letters are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, release, same_row, sliced, stored, with_extra

#: Starts in a run of the second level.
STEP = 22
#: Bytes whose windows are sampled at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 21
#: Fixed odd multipliers that mix eight bytes.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
LOW = np.uint64((1 << 24) - 1)
#: Words, and the bytes that stand for one.
WORD, WORD_BYTES = re.compile(r"[^\x20\x09-\x0D]+"), 4


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` keys, by running minima of blocks from both sides."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width) * width
    padded = np.full(blocks, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    padded = padded.reshape(-1, width)
    right = np.minimum.accumulate(padded, axis=1).ravel()
    left = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1:width - 1 + n])


def sample(text: bytes, length: int, reach: int, at_once: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sampled positions with the first and last start of a window that chooses them.

    A window looks at the ``reach`` positions from its start on; the leftmost of the least ones is chosen.
    """
    for base in range(0, len(text) - length + 1, at_once):
        piece = np.frombuffer(text[base:base + at_once + length - 1] + bytes(8), np.uint8)
        n = len(piece) - 8
        grams = np.ndarray((n,), "<u8", piece, 0, (1,)) * MIX[0]
        grams ^= grams >> np.uint64(29)
        grams *= MIX[1]
        keys = (grams & ~LOW) | np.arange(n, dtype=np.uint64)
        starts = n - length + 1
        chosen = (_least(keys[:starts + reach - 1], reach)[:starts] & LOW).astype(np.int64)
        cut = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut - 1, [starts - 1]))
        yield chosen[first] + base, first + base, last + base


def _sampled(batches, length: int, reach: int):
    """Bucket rows: row key, sampled position, run of starts, and hashes of core and span."""
    small, wide, tail = xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest, length - reach + 1
    for batch in sliced(batches):
        ids, hashes = batch.column(0), batch.column(2).to_numpy()
        index, at, lo, hi, cores, spans = [], [], [], [], [], []
        for row, value in enumerate(batch.column(1).cast(pa.binary())):
            text = value.as_py()
            for a, s, e in sample(text, length, reach):
                index.append(np.full(len(a), row))
                at.append(a), lo.append(s), hi.append(e)
                a, s, e = a.tolist(), s.tolist(), e.tolist()
                cores += [small(text[p:p + tail]) for p in a]
                # The place of the sampled position in the span is part of its identity.
                spans += [wide(text[x:y + length], p - x) for p, x, y in zip(a, s, e)]
        if not index:
            continue
        index = np.concatenate(index)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(index)), pa.array(hashes[index]), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (at, lo, hi)),
             *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cores, spans))],
            ["doc_id", "row_hash", "at", "lo", "hi", "core", "span"],
        )


def _cut_runs(batches, length: int, step: int):
    """Runs of differing spans, cut at fixed offsets from the sampled position into steps of starts.

    A step row holds the bytes left and right of its core: with the core they make up each of its suffixes.
    """
    hash_a, hash_b = xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
    names = ["at", "n", "step", "first", "last", "core1", "core2", "left", "right"]
    for batch in sliced(batches):
        rows, out = [], {k: [] for k in names}
        texts = batch.column(1).cast(pa.binary())
        for row, runs in enumerate(batch.column(3).to_pylist()):
            text = texts[row].as_py()
            for run in runs:
                at, lo, hi = run["at"], run["lo"], run["hi"]
                # Offset o of a start is at - start; step k holds the offsets from k * step on.
                for k in range((at - hi) // step, (at - lo) // step + 1):
                    first, last = max(at - hi, k * step), min(at - lo, k * step + step - 1)
                    begin = at - k * step
                    end = begin - step + 1 + length
                    middle = text[begin:end]  # lies in all windows of the step
                    values = (at, run["n"], k, first, last, hash_a(middle), hash_b(middle), text[at - last:begin], text[end:at - first + length])
                    rows.append(row)
                    for name, value in zip(names, values):
                        out[name].append(value)
        if rows:
            index = pa.array(rows)
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), None, None, pa.binary(), pa.binary()]
            columns = [
                pa.array(np.array(out[k], np.uint64).view(np.int64)) if t is None else pa.array(out[k], t)
                for k, t in zip(names, types)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(2).take(index), *columns],
                                             ["doc_id", "row_hash", *names])


def repeated_starts(rows: DataFrame, length: int, step: int = STEP, of_words: bool = False) -> DataFrame:
    """``doc_id``, ``row_hash``, ``lo``, ``hi``: runs of starts whose ``length`` bytes also start elsewhere.

    ``rows`` are ``keyed``; ``length`` is 16 at least.  With ``of_words`` the strings are those of ``_as_words``.
    """
    reach = length + 1 - max(8, length // 8)
    schema = "doc_id long, row_hash long, at int, lo int, hi int, core long, span long"
    rows = rows.select("doc_id", "text", "row_hash")
    # Words are hashed and sampled by one Python worker a task: a second one would hold its memory until the job ends.
    read = _as_words if of_words else iter
    suffixes = stored(rows.mapInArrow(lambda b: _sampled(read(b), length, reach), schema), "sample")
    # One join tells a suffix row how many rows tie on its span and whether its bucket has other spans.
    spans = suffixes.groupBy("core", "span").agg(F.count("*").alias("n"))
    buckets = spans.groupBy("core").agg(
        F.sum("n").alias("size"), (F.count("*") > 1).alias("mixed"), (F.min("n") == 1).alias("open")
    ).filter("size > 1").drop("size")
    ties = stored(spans.join(buckets, "core"), "ties")  # a stored side lets adaptive execution split hot keys of the other
    repeated = stored(suffixes.join(ties, ["core", "span"]), "buckets")
    release(suffixes)
    place = ["doc_id", "row_hash", "lo", "hi"]
    tied = repeated.filter("n > 1").select(*place)

    # A bucket is cut if one of its spans is alone; its others take part, since a part of them may equal a part of that.
    cut = repeated.filter("mixed and open").groupBy("core", "span").agg(
        F.first("n").alias("n"), F.min(F.struct("doc_id", "row_hash", "at", "lo", "hi")).alias("run")
    )
    runs = cut.groupBy("run.doc_id", "run.row_hash").agg(
        F.collect_list(F.struct("run.at", "run.lo", "run.hi", "n")).alias("runs")
    ).hint("merge")
    rows = rows.mapInArrow(_as_words, "doc_id long, text binary, row_hash long") if of_words else rows
    cut = rows.join(runs, same_row(rows, runs)).select(rows["doc_id"], "text", rows["row_hash"], "runs")
    schema = ("doc_id long, row_hash long, at int, n long, step int, first int, last int, core1 long, core2 long, "
              "left binary, right binary")
    steps = cut.mapInArrow(lambda b: _cut_runs(b, length, step), schema)
    steps = stored(steps.withColumn("side", F.xxhash64("first", "last", "left", "right")), "steps")

    # How often each side of a core occurs, and whether sides of a core differ with one of them alone.
    core = ["step", "core1", "core2"]
    sides = steps.groupBy(*core, "side").agg(F.sum("n").alias("all"))
    differ = sides.groupBy(*core).agg(F.count("*").alias("sides"), F.min("all").alias("least")).filter("sides > 1 and least = 1")
    sides = sides.join(differ.select(*core, F.lit(True).alias("cut")), core, "left").filter("all > 1 or cut")
    judged = stored(steps.join(sides, [*core, "side"]), "sides")
    release(steps)
    by_step = judged.filter("n = 1 and all > 1").select(
        "doc_id", "row_hash", (F.col("at") - F.col("last")).alias("lo"), (F.col("at") - F.col("first")).alias("hi")
    )
    # Single suffixes of the sides that differ, one run for each side; a suffix is its core, place, left and right part.
    single = (
        judged.filter("cut").groupBy(*core, "side")
        .agg(F.first("all").alias("all"), F.min(F.struct("doc_id", "row_hash", "at", "first", "last", "left", "right")).alias("run"))
        .select(*core, "all", "run.*")
        .withColumn("offset", F.explode(F.sequence("first", "last")))
        .withColumn("m", F.col("offset") - F.col("step") * step)
    )
    suffix = [*core, "offset", F.expr("substring(left, length(left) - m + 1, m)"), F.expr(f"substring(right, 1, {step - 1} - m)")]
    single = stored(single.select(
        "doc_id", "row_hash", (F.col("at") - F.col("offset")).alias("lo"), "all",
        F.xxhash64(*suffix).alias("name1"), F.xxhash64(F.lit(1), *suffix).alias("name2"),
    ), "suffixes")
    same = single.groupBy("name1", "name2").agg(F.sum("all").alias("ties")).filter("ties > 1").drop("ties")
    by_suffix = single.filter("all = 1").join(same, ["name1", "name2"]).select("doc_id", "row_hash", "lo", F.col("lo").alias("hi"))
    return tied.union(by_step).union(by_suffix)


def _take_out(batches, length: int, as_text: bool):
    """Merge covered positions and cut them out of whole texts; ``as_text`` keeps whole characters only."""
    for batch in sliced(batches):
        texts = batch.column(1).cast(pa.binary())
        kept, removed = [], []
        for row, runs in enumerate(batch.column(2).to_pylist()):
            text, spans = texts[row].as_py(), _merged(runs or [], length)
            edges = [0, *(x for span in spans for x in span), len(text)]
            left = [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
            kept.append("".join(part.decode(errors="ignore") for part in left) if as_text else b"".join(left))
            removed.append([{"begin": a, "end": b} for a, b in spans])
        spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), pa.array([len(t) for t in texts.to_pylist()], pa.int64()), 
             pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(removed, spans_type), *batch.columns[4:]],
            ["doc_id", "row_hash", "n_bytes", "kept", "removed", *batch.schema.names[4:]],
        )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, step: int = STEP, carry: bool = False
) -> DataFrame:
    """``doc_id``, ``row_hash``, ``n_bytes``, ``kept`` (bytes that remain), ``removed`` (byte ranges) for every row.

    With ``carry`` also ``extra``, and ``kept`` is text: where a cut splits a character, its rest goes too.

    A byte goes when a string of ``length`` bytes that covers it also starts at another place of the table, in the same
    text or another; every place loses it.  Texts are UTF-8 bytes, null counts as empty, matches stay within a text, and
    a text shorter than ``length`` keeps all.  Repeated rows are places of their own, so their texts go.  Null ids are
    rows like others.  A cut may split a character.
    """
    rows = keyed(docs, id_col, text_col, carry)
    starts = stored(repeated_starts(rows, length, step), "starts")
    # The same join at every size: a broadcast that fits today would be a shuffle tomorrow.
    runs = starts.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")).hint("merge")
    both = rows.join(runs, same_row(rows, runs), "left").select(rows["doc_id"], "text", "runs", rows["row_hash"], *rows.columns[3:])
    kind = "string" if carry else "binary"
    schema = f"doc_id long, row_hash long, n_bytes long, kept {kind}, removed array<struct<begin:int,end:int>>"
    return both.mapInArrow(lambda b: _take_out(b, length, carry), with_extra(schema, rows))


def _as_words(batches):
    """Texts as strings of word hashes."""
    hash_of = xxhash.xxh32_intdigest
    for batch in sliced(batches):
        streams = [np.array([hash_of(w) for w in WORD.findall(text.as_py())], "<u4").tobytes() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(streams, pa.binary()), batch.column(2)], ["doc_id", "text", "row_hash"])


def _merged(runs: list[dict], length: int) -> list[list[int]]:
    spans: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + length) for r in runs):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    return spans


def _take_out_words(batches, length: int):
    for batch in sliced(batches):
        kept, removed = [], []
        for text, runs in zip(batch.column(1), batch.column(2).to_pylist()):
            text, n = text.as_py(), 0
            if runs:
                starts = [m.start() for m in WORD.finditer(text)]
                n_words, parts, at = len(starts), [], 0
                starts.append(len(text))
                for lo, hi in _merged(runs, length):
                    # Whole words only; the white space behind a word goes with it.
                    first, end = -(-lo // WORD_BYTES), min(hi // WORD_BYTES, n_words)
                    parts.append(text[at:starts[first]])
                    at = starts[end]
                    n += end - first
                text = "".join(parts) + text[at:]
            kept.append(text)
            removed.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), pa.array(kept, pa.string()), pa.array(removed, pa.int64()), *batch.columns[4:]],
            ["doc_id", "row_hash", "kept", "n_removed", *batch.schema.names[4:]],
        )


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, carry: bool = False) -> DataFrame:
    """``doc_id``, ``row_hash``, ``kept`` (text that remains), ``n_removed`` (words) for every row, and ``extra`` with ``carry``.

    A word goes when ``words`` (8 at least) words in a row that hold it also start at another place of the table, in the same text
    or another, whatever white space stands between them; every place loses them.  Words stand between ASCII white space and count
    as equal when their 32-bit hashes are; null counts as empty, and a text of fewer words keeps all.  Repeated rows are places of
    their own, so their texts go; null ids are rows like others.  White space before the first kept word stays.
    """
    rows = keyed(docs, id_col, text_col, carry)
    length = words * WORD_BYTES
    starts = stored(repeated_starts(rows, length, STEP // WORD_BYTES * WORD_BYTES, of_words=True), "starts")
    runs = starts.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")).hint("merge")
    both = rows.join(runs, same_row(rows, runs), "left").select(rows["doc_id"], "text", "runs", rows["row_hash"], *rows.columns[3:])
    schema = "doc_id long, row_hash long, kept string, n_removed long"
    return both.mapInArrow(lambda b: _take_out_words(b, length), with_extra(schema, rows))
