"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a binary-trie self-join.

The fingerprints form a binary trie.  The join walks pairs of its nodes from the root, adds up the bits in which the
two paths differ, and leaves a pair as soon as the sum exceeds the error budget.

The upper trie is walked by Spark: a subtree of at most ``CELL`` distinct fingerprints is a leaf node (hot prefixes are
cut deeper), and pairs of leaf nodes within the budget are found by one equi-join between the prefixes a node may meet
and the prefixes other nodes have.  Each pair of leaf nodes is then walked on in one task on two sorted arrays of at
most ``CELL`` numbers.  Only distinct fingerprints take part, so copies cost nothing, and a task returns a spanning
forest of its links: no link is lost for the components, and a dense group cannot return all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keyed, sliced, stored

#: Distinct fingerprints of a leaf node; two of these are what one task holds.
CELL = 1 << 16
#: Depth of one refinement of a node, in bits.
STEP = 4
#: Shingles whose bits are counted at once, and node pairs that are walked at once.
SHINGLES_AT_ONCE, PAIRS_AT_ONCE = 1 << 17, 1 << 18
#: A node pair: its two ranges, depth and errors; pairs of small subtrees whose leaves are compared at once.
NODE_PAIR, LEAVES_AT_ONCE = (np.int32, np.int32, np.int32, np.int32, np.uint8, np.uint8), 1 << 12
#: Links of a cell that are sorted by distance at once.
LINKS_AT_ONCE = 1 << 22


def run_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 values of the runs of ``shingle`` words of whole ``text``, repeats included, some at once; a shorter text is one run."""
    words = text.lower().split()  # of bytes: lowers A-Z only, splits at ASCII white space only
    if not words:
        return
    spaced = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES_AT_ONCE):
        yield np.array([digest(spaced[s:e], seed) for s, e in zip(starts[at:at + SHINGLES_AT_ONCE], ends[at:at + SHINGLES_AT_ONCE])], "<u8")


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of whole ``text``: bit b is set when it is set in over half of the shingles' XXH64 values."""
    counts, n = np.zeros(64, np.int64), 0
    for part in run_hashes(text, shingle, seed):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.binary())
            prints = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints)], ["doc_id", "row_hash", "print"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, row_hash long, print long")


def budgets(bits: int, turns: int = 1) -> np.ndarray:
    """Bits in which two paths may differ down to every depth, so that one of ``turns`` rotations keeps each pair of ``bits``.

    Cut into ``turns`` equal windows, any circle of ``bits`` differing bits has a window to start at from which no run of windows holds
    more than its share, so a walk over every rotation may leave a pair of paths as soon as it does.
    """
    width = 64 // turns
    return np.array([bits * -(-depth // width) // turns for depth in range(65)])


def _walk(a: np.ndarray, b: np.ndarray | None, depth: int, error: int, bits: int, allowed: np.ndarray | None = None) -> Iterator[tuple]:
    """Links between sorted unsigned arrays (or within ``a``), as pairs of positions, by walking trie node pairs.

    A node is a range of a sorted array whose numbers share ``depth`` leading bits; ``allowed`` errors down to a depth, else ``bits``.
    """
    allowed = budgets(bits) if allowed is None else allowed
    own = b is None
    other = a if own else b
    stack = [tuple(np.array([x], kind) for x, kind in zip((0, len(a), 0, len(other), depth, error), NODE_PAIR))]
    while stack:
        a0, a1, b0, b1, deep, err = stack.pop()
        if len(a0) > PAIRS_AT_ONCE:
            half = len(a0) // 2
            stack += [tuple(x[:half] for x in (a0, a1, b0, b1, deep, err)), tuple(x[half:] for x in (a0, a1, b0, b1, deep, err))]
            continue
        # Small subtrees: what is left of the walk is a comparison of their few leaves.
        small = ((a1 - a0).astype(np.int64) * (b1 - b0) <= 64) | (deep == 64)
        if small.any():
            yield from _leaves(a, other, a0[small], a1[small], b0[small], b1[small], own, bits)
        a0, a1, b0, b1, deep, err = (x[~small] for x in (a0, a1, b0, b1, deep, err))
        if not len(a0):
            continue
        bit = np.uint64(1) << (63 - deep).astype(np.uint64)
        am = np.searchsorted(a, (a[a0] & ~(bit | (bit - np.uint64(1)))) | bit)
        bm = np.searchsorted(other, (other[b0] & ~(bit | (bit - np.uint64(1)))) | bit)
        am, bm = np.clip(am, a0, a1).astype(np.int32), np.clip(bm, b0, b1).astype(np.int32)
        steps = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am, a1, b0, bm, err + 1)]
        if own:  # of two mirrored pairs one is enough
            same = a0 == b0
            steps[3] = (am, np.where(same, am, a1), b0, bm, err + 1)
        parts = []
        for p0, p1, q0, q1, e in steps:
            live = (p1 > p0) & (q1 > q0) & (e <= allowed[np.minimum(deep + 1, 64)])
            parts.append(tuple(x[live] for x in (p0, p1, q0, q1, deep + 1, e)))
        stack.append(tuple(np.concatenate(x) for x in zip(*parts)))


def _leaves(a, b, a0, a1, b0, b1, own, bits) -> Iterator[tuple]:
    for at in range(0, len(a0), LEAVES_AT_ONCE):
        p0, p1, q0, q1 = (x[at:at + LEAVES_AT_ONCE] for x in (a0, a1, b0, b1))
        sizes = (p1 - p0) * (q1 - q0)
        pair = np.repeat(np.arange(len(p0)), sizes)
        at_pair = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        width = (q1 - q0)[pair]
        i, j = p0[pair] + at_pair // width, q0[pair] + at_pair % width
        near = np.bitwise_count(a[i] ^ b[j]) <= bits
        if own:
            near &= i < j
        yield i[near].astype(np.int32), j[near].astype(np.int32)


class Forest:
    """Union-find over positions that remembers the links which joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        up = self.up
        while len(i):
            ri, rj = self._root(i), self._root(j)
            apart = ri != rj
            i, j, hi, lo = i[apart], j[apart], np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart]
            if not len(i):
                return
            # Each root takes one parent per pass; the links that lost the race come again.
            hi, first = np.unique(hi, return_index=True)
            up[hi] = lo[first]
            self.links.append((i[first], j[first]))

    def _root(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        root = up[x]
        while True:
            above = up[root]
            if (above == root).all():
                up[x] = root
                return root
            root = above


def _cell_links(table: pa.Table, bits: int, turns: int = 1) -> pa.Table:
    side = table.column("side").to_numpy()
    prints = table.column("print").to_numpy().view(np.uint64)
    a, b = np.sort(prints[side == 0]), np.sort(prints[side == 1])
    alone = bool(table.column("alone")[0].as_py())
    forest = Forest(len(a) + len(b))
    every = np.concatenate((a, b))

    def add(found: list) -> None:
        """The nearest of the found links join trees first."""
        i, j = (np.concatenate(x) for x in zip(*found))
        apart = np.bitwise_count(every[i] ^ every[j])
        for distance in range(bits + 1):
            forest.add(i[apart == distance], j[apart == distance])

    found, held = [], 0
    for i, j in _walk(a, None if alone else b, 0, 0, bits, budgets(bits, turns)):
        found.append((i, j if alone else j + len(a)))
        held += len(i)
        if held > LINKS_AT_ONCE:
            add(found)
            found, held = [], 0
    if found:
        add(found)
    every = every.view(np.int64)
    links = [np.concatenate(x) for x in zip(*forest.links)] or [np.array([], np.int64)] * 2
    return pa.table({"src": every[links[0]], "dst": every[links[1]]})


def first_met(apart: np.ndarray, bits: int, turn: int, turns: int) -> np.ndarray:
    """Whether rotation ``turn`` is the first that keeps pairs with these differing bits, as they lie in it; each pair of ``bits`` has one."""
    width = 64 // turns
    inside = np.array([np.bitwise_count(apart << np.uint64(width * k) >> np.uint64(64 - width)) for k in range(turns)], np.int64).reshape(turns, -1)
    share = budgets(bits, turns)[width::width, None]
    keeps = lambda by: (np.cumsum(np.roll(inside, by, axis=0), axis=0) <= share).all(axis=0)
    return reduce(lambda met, by: met & ~keeps(by), range(1, turn + 1), keeps(0))


def _cell_pairs(table: pa.Table, bits: int, turn: int, turns: int) -> Iterator[pa.RecordBatch]:
    """All pairs that are first met in this rotation, without those within a ``part``; null is in none."""
    side, prints = table.column("side").to_numpy(), table.column("print").to_numpy().view(np.uint64)
    order = np.lexsort((prints, side))
    prints, n = prints[order], int((side == 0).sum())
    loose = table.column("part").is_null().to_numpy()[order]
    part = table.column("part").fill_null(0).to_numpy()[order]
    alone = bool(table.column("alone")[0].as_py())
    for i, j in _walk(prints[:n], None if alone else prints[n:], 0, 0, bits, budgets(bits, turns)):
        j = j if alone else j + n
        left = (part[i] != part[j]) | loose[i] | loose[j]
        i, j = i[left], j[left]
        first = first_met(prints[i] ^ prints[j], bits, turn, turns)
        src, dst = (pa.array(prints[x[first]].view(np.int64)) for x in (i, j))
        yield pa.RecordBatch.from_arrays([src, dst], ["src", "dst"])


def _prefix(print_col, depth: int):
    return F.shiftrightunsigned(print_col, 64 - depth) if depth else F.lit(0).cast("long")


def rotated_links(prints: DataFrame, bits: int, turns: int, cell: int = CELL) -> DataFrame:
    """``src``, ``dst``: as ``links``, by one walk for each of ``turns`` rotations of the bits, which budgets of 15 bits and more need.

    Every link of ``bits`` is met by some walk, and each walk keeps the nearest links that connect a group.
    """
    return _rotated(prints, turns, lambda turned, _: links(turned, bits, cell, turns)).distinct()


def rotated_pairs(prints: DataFrame, bits: int, turns: int, cell: int = CELL) -> DataFrame:
    """``src``, ``dst``: all pairs of at most ``bits`` differing bits among distinct ``print`` values, each once, but those within one ``part``.

    A ``part`` is a number, or null for a print all of whose pairs count.  A task gives out its pairs as it meets them.
    """
    def met(turned: DataFrame, turn: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _cell_pairs(pa.Table.from_batches(batches), bits, turn, turns)

        return stored(_met_cells(turned, bits, cell, turns).groupBy("cell").applyInArrow(run, "src long, dst long"), "met")

    return _rotated(prints, turns, met)


def _rotated(prints: DataFrame, turns: int, walk) -> DataFrame:
    """What ``walk`` finds in each rotation of the prints, turned back."""
    turned = lambda c, by: F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, 64 - by)) if by else F.col(c)
    found = None
    for turn, by in enumerate(range(0, 64, 64 // turns)):
        part = walk(prints.withColumn("print", turned("print", by)), turn)
        part = part.select(turned("src", 64 - by if by else 0).alias("src"), turned("dst", 64 - by if by else 0).alias("dst"))
        found = part if found is None else found.union(part)
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def links(prints: DataFrame, bits: int, cell: int = CELL, turns: int = 1) -> DataFrame:
    """``src``, ``dst``: for each connected group of distinct ``print`` values enough links to connect it.

    With several ``turns`` the walk keeps to the budgets of one rotation, and no node lies deeper than its first window.
    """
    rows = _met_cells(prints.select("print"), bits, cell, turns)
    return stored(rows.groupBy("cell").applyInArrow(lambda t: _cell_links(t, bits, turns), "src long, dst long"), "links")


def _met_cells(prints: DataFrame, bits: int, cell: int, turns: int) -> DataFrame:
    """The rows of ``prints`` with every ``cell``, a pair of leaf nodes within the budget, that they lie in, and their ``side`` of it."""
    allowed = budgets(bits, turns)
    # Leaf nodes: the shallowest subtrees of at most `cell` fingerprints.
    rest, depth, leaves, depths = prints, 0, None, []
    while True:
        counts = stored(rest.groupBy(_prefix(F.col("print"), depth).alias("prefix")).agg(F.count("*").alias("n")), "nodes")
        deepest = depth >= 64 // turns
        small = (counts if deepest else counts.filter(F.col("n") <= cell)).select(F.lit(depth).alias("depth"), "prefix")
        leaves = small if leaves is None else leaves.union(small)
        depths.append(depth)
        big = counts.filter(F.col("n") > cell)
        if deepest or big.isEmpty():
            break
        rest = rest.join(big.select("prefix"), _prefix(F.col("print"), depth) == big["prefix"], "left_semi")
        depth += STEP
    leaves = stored(leaves, "leaves")

    # Pairs of leaf nodes: what a node may meet at its own depth, against the ancestors of the deeper or equal ones.
    flips = {d: [0] + [sum(1 << p for p in c) for k in range(1, int(allowed[d]) + 1) for c in combinations(range(d), k)] for d in depths}
    meets = reduce(DataFrame.union, [
        leaves.filter(F.col("depth") == d).select(
            "depth", "prefix", F.explode(F.array(*map(F.lit, flips[d]))).alias("flip")
        ).select("depth", "prefix", F.col("depth").alias("at"), F.col("prefix").bitwiseXOR(F.col("flip")).alias("key"))
        for d in depths
    ])
    above = reduce(DataFrame.union, [
        leaves.filter(F.col("depth") >= d).select(
            F.col("depth").alias("depth2"), F.col("prefix").alias("prefix2"), F.lit(d).alias("at"),
            F.expr(f"shiftright(prefix, depth - {d})").alias("key"),
        ) for d in depths
    ])
    cells = (
        meets.join(above, ["at", "key"])
        .filter("depth < depth2 or prefix <= prefix2")
        .select("depth", "prefix", "depth2", "prefix2", ((F.col("depth") == F.col("depth2")) & (F.col("prefix") == F.col("prefix2"))).alias("alone"))
    )
    cells = stored(cells, "cells")
    sides = cells.select(F.lit(0).alias("side"), "depth", "prefix", F.struct("depth", "prefix", "depth2", "prefix2").alias("cell"), "alone").union(
        cells.filter("not alone").select(F.lit(1), "depth2", "prefix2", F.struct("depth", "prefix", "depth2", "prefix2"), "alone")
    )
    placed = reduce(DataFrame.union, [
        prints.select("*", F.lit(d).alias("depth"), _prefix(F.col("print"), d).alias("prefix")) for d in depths
    ])
    return placed.join(sides, ["depth", "prefix"]).select("cell", "side", "alone", *prints.columns)


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, seed: int = 42,
    cell: int = CELL,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable over links) for every row.

    Two fingerprints link at ``bits`` or fewer differing bits.  A text of fewer words than a shingle is one shingle;
    one without words (null too) has fingerprint zero and links like any other.  Null ids get a row like others and
    never name a component, unless all ids of it are null.  Repeated rows give repeated rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    named = _components(prints, bits, cell)
    return prints.join(named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def _components(prints: DataFrame, bits: int, cell: int) -> DataFrame:
    """``print``, ``component`` (a print of the component), ``component_id`` (its smallest id) per distinct fingerprint."""
    distinct = stored(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct")
    groups = components(links(distinct.select("print"), bits, cell))
    named = distinct.join(groups, distinct["print"] == groups["node"], "left").select(
        "print", "first", F.coalesce("component", "print").alias("component")
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return stored(named.join(least, "component").select("print", "component", "component_id"), "named")
