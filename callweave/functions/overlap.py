"""Longest-common-subsequence scores of token lists (vectorised helpers)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length():
    """Column function: LCS length of two token lists, one machine-word row per token."""

    @F.pandas_udf(T.LongType())
    def length(left, right):
        import pandas as pd

        def one(a, b):
            if a is None or b is None or not len(a) or not len(b):
                return 0
            where: dict = {}
            for i, token in enumerate(a):
                where[token] = where.get(token, 0) | (1 << i)
            full = (1 << len(a)) - 1
            row = full
            for token in b:
                common = row & where.get(token, 0)
                row = ((row + common) | (row - common)) & full
            return len(a) - row.bit_count()

        return pd.Series([one(a, b) for a, b in zip(left, right)])

    return length


def union_lcs_hits():
    """Column function: tokens of the reference lines covered by some candidate line.

    Every reference line is aligned with every candidate line; a token counts while both
    texts still have an unused copy of it.
    """

    @F.pandas_udf(T.LongType())
    def hits(reference, candidate):
        import pandas as pd
        from collections import Counter

        def aligned(ref, cand):
            # One row of bits per candidate token: a zero at bit i says that the LCS grows at reference token i.
            where: dict = {}
            for i, token in enumerate(ref):
                where[token] = where.get(token, 0) | (1 << i)
            full = (1 << len(ref)) - 1
            rows = [full]
            for token in cand:
                row, common = rows[-1], rows[-1] & where.get(token, 0)
                rows.append(((row + common) | (row - common)) & full)
            found, i, j = set(), len(ref), len(cand)
            while i and j:
                if ref[i - 1] == cand[j - 1]:
                    i, j = i - 1, j - 1
                    found.add(i)
                    continue
                low = (1 << i) - 1
                left, up = i - (rows[j - 1] & low).bit_count(), i - 1 - (rows[j] & (low >> 1)).bit_count()
                if left > up:
                    j -= 1
                else:
                    i -= 1
            return found

        def one(refs, cands):
            refs = [list(r) for r in refs if len(r)]
            cands = [list(c) for c in cands if len(c)]
            left = Counter(t for r in refs for t in r)
            right = Counter(t for c in cands for t in c)
            total = 0
            for ref in refs:
                covered = set()
                for cand in cands:
                    covered |= aligned(ref, cand)
                for i in sorted(covered):
                    if left[ref[i]] > 0 and right[ref[i]] > 0:
                        left[ref[i]] -= 1
                        right[ref[i]] -= 1
                        total += 1
            return total

        return pd.Series([one(r, c) for r, c in zip(reference, candidate)])

    return hits
