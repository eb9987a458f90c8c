"""Fill-in-middle transformation: an indexable skip list per text finds both cuts.

The bottom lane of the list has one node per run of consecutive units; every link of a lane carries how many units and how
many code points it passes.  Nodes rise to the next lane by a fixed mix of their number, one in four.  A cut rank is reached by
going down the lanes while the accumulated unit widths allow; the accumulated code-point widths then say where the node
stands in the text, and fewer units than a run are left to pass.  Units are single code points, or the matches of a pattern.

Texts are independent, so nothing is shuffled: draws and hashes are column expressions, the cuts are made in Arrow batches.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, sliced, with_extra

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Units of a bottom node.
RUN = 64


def _towers(n: int) -> np.ndarray:
    """Lanes above the bottom that each of ``n`` nodes reaches: pairs of trailing zero bits of its mixed number."""
    x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    low = x & (~x + np.uint64(1))
    return np.where(x > 0, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) // 2, 32).astype(np.int64)


class SkipList:
    """Express lanes over nodes with a width in units and a width in code points."""

    def __init__(self, units: np.ndarray, chars: np.ndarray):
        self.lanes = [(units.tolist(), chars.tolist(), None)]
        towers, lane = _towers(len(units)), 1
        while len(units) > 4:
            up = np.flatnonzero(towers >= lane)  # node 0 reaches every lane
            if len(up) < len(units):
                units, chars = np.add.reduceat(units, up), np.add.reduceat(chars, up)
                self.lanes.append((units.tolist(), chars.tolist(), up.tolist() + [len(towers)]))
                towers = towers[up]
            lane += 1

    def reach(self, rank: int) -> tuple[int, int]:
        """Units and code points before the last node that starts at or before ``rank`` units."""
        at = passed = chars_passed = 0
        for units, chars, down in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed += units[at]
                chars_passed += chars[at]
                at += 1
            if down:
                at = down[at]
        return passed, chars_passed


class Units:
    """The units of one text and where each of them ends, in code points.

    Without ``unit`` every code point is one.  Else units are the non-empty matches of ``unit`` from left to right; code points
    between two matches belong to the match before, those before the first match to the first.
    """

    def __init__(self, text: str, unit: re.Pattern | None = None, run: int = RUN):
        self.text, self.unit = text, unit
        if unit:
            n, starts = 0, []
            for match in unit.finditer(text):
                if match.end() > match.start():
                    if n % run == 0:
                        starts.append(match.start())
                    n += 1
            starts = np.array([0, *starts[1:], len(text)] if n else [0], np.int64)
        else:
            n = len(text)
            starts = np.append(np.arange(0, n, run), n)
        self.n = n
        widths = np.full(max(len(starts) - 1, 0), run, np.int64)
        if n:
            widths[-1] = n - run * (len(widths) - 1)
        self.lanes = SkipList(widths, np.diff(starts))

    def offset(self, rank: int) -> int:
        """Code points before the unit with number ``rank`` (from 0); all of them from the last unit on."""
        if rank >= self.n:
            return len(self.text) if rank else 0
        passed, chars = self.lanes.reach(rank)
        if not self.unit or passed == rank:
            return chars + (rank - passed)
        matches = (m for m in self.unit.finditer(self.text, chars) if m.end() > m.start())
        return next(m.start() for k, m in enumerate(matches, passed) if k == rank)


def _transformed(batches, unit: str | None, marks: tuple[str, str, str], plain_percent: int, spm_percent: int):
    pattern = re.compile(unit) if unit else None
    first, second, third = marks
    for batch in sliced(batches, 256):
        n_units, forms, prefixes, middles, outputs = [], [], [], [], []
        draws = zip(*(batch.column(f"h{i}").to_pylist() for i in range(1, 5)))
        for value, (h1, h2, h3, h4) in zip(batch.column("text"), draws):
            text = value.as_py()
            units = Units(text, pattern)
            n_units.append(units.n)
            if not units.n or any(mark in text for mark in marks) or h3 % 100 >= 100 - plain_percent:
                forms.append("plain")
                prefixes.append(None)
                middles.append(None)
                outputs.append(text)
                continue
            low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
            a, b = units.offset(low), units.offset(high)
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            prefixes.append(a)
            middles.append(b - a)
            if h4 % 100 < spm_percent:
                forms.append("spm")
                outputs.append("".join((second, suffix, first, prefix, third, middle)))
            else:
                forms.append("psm")
                outputs.append("".join((first, prefix, second, suffix, third, middle)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_hash"), pa.array(n_units, pa.int64()), pa.array(forms, pa.string()),
             pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string()),
             *(batch.column(c) for c in batch.schema.names if c == "extra")],
            ["doc_id", "row_hash", "n", "form", "prefix_chars", "middle_chars", "output",
             *(c for c in batch.schema.names if c == "extra")],
        )


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, unit: str | None = None,
                   plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, carry: bool = False) -> DataFrame:
    """``doc_id``, ``row_hash``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` per row of ``docs`` (``extra`` with ``carry``).

    A text (null counts as empty) of ``n`` units (code points, or see ``Units``) is cut after two numbers of units drawn from the
    hash of ``seed`` and id.  ``psm`` writes prefix, suffix, middle behind their marks, ``spm`` suffix, prefix, middle; ``plain``
    leaves the text as it is, with null lengths: texts without units, texts that hold a mark, and ``plain_percent`` of the rest.
    Draws depend on the id alone: rows under one id, or without id (hashed as an empty id), share theirs, and repeated rows
    come out alike.  Marks must not overlap one another, so that ``restore`` is exact.
    """
    for x in marks:
        for y in marks:
            if not x or (x is not y and x in y) or any(x.endswith(y[:k]) for k in range(1, min(len(x), len(y)))):
                raise ValueError("marks must be non-empty and must not overlap")
    rows = keyed(docs, id_col, text_col, carry)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = rows.select("doc_id", "text", "row_hash", *rows.columns[3:], *draws)
    schema = "doc_id long, row_hash long, n long, form string, prefix_chars long, middle_chars long, output string"
    if carry:
        schema = with_extra(schema, rows.select("doc_id", "text", "row_hash", "extra"))
    return rows.mapInArrow(lambda b: _transformed(b, unit, marks, plain_percent, spm_percent), schema)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` turned into ``output``; marks occur once in a text that is not plain."""
    def after(text: Column, head: Column | None, mark: str) -> Column:
        return F.substring(text, (F.length(head) if head is not None else F.lit(0)) + F.lit(len(mark) + 1), F.length(text))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = after(output, None, first)
        a = F.substring_index(body, second, 1)
        rest = after(body, a, second)
        b = F.substring_index(rest, marks[2], 1)
        return a, b, after(rest, b, marks[2])

    prefix, suffix, middle = parts(marks[0], marks[1])
    suffix_first, prefix_second, middle_last = parts(marks[1], marks[0])
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix_second, middle_last, suffix_first))
        .otherwise(output)
    )
