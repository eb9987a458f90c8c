"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits, in SQL functions only.

Every run of five words is hashed once.  The leading bits of a hash name its bin, the least hash of a bin is kept; an empty bin
copies the bin that its own probing order meets first among those that are filled.  Probing orders depend on the bin alone, so
two documents with the same filled bins copy alike.  Of each bin only the low-order bits are packed; that unequal hashes
agree in them by chance is taken out of the estimate.

All of it happens inside a row.  A text is read in pieces of ``PIECE`` words that overlap by a run less one, and the least hashes so far
are merged with those of the next piece, so a long text needs memory for its letters and the words of one piece.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, release, stored

#: Words of a run, bins of a fingerprint (a power of two), low-order bits kept of a bin (4 or 8).
SIZE, BINS, BITS = 5, 256, 8
#: Words of a piece.
PIECE = 8192
#: ASCII white space.
BLANK = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column, size: int, piece: int) -> Column:
    """Pieces of ``piece`` words and the ``size - 1`` words behind them; none of a text without words."""
    word = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
    cut = rf"(?=((?:{word}){{1,{piece + size - 1}}}+))(?:{word}){{1,{piece}}}+"

    def parts(t: Column) -> Column:
        # So few letters cannot hold more words than a piece.
        one = F.when(F.length(t) <= 2 * piece, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(cut), F.lit(1)))
        return F.when(t == "", F.array().cast("array<string>")).otherwise(one)

    return _let(F.btrim(text, F.lit(BLANK)), parts)


def _run_hashes(part: Column, size: int, first: Column) -> Column:
    """Hashes of the runs of a piece; a text of fewer words is one run, a later piece of fewer has none of its own."""
    words = F.transform(F.split(F.btrim(part, F.lit(BLANK)), r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
        return F.when(F.size(w) >= size, each).when(first, F.transform(F.array(w), lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))

    return _let(words, runs)


def _shift(bins: int) -> int:
    if bins < 2 or bins & (bins - 1):
        raise ValueError("bins must be a power of two")
    return 65 - bins.bit_length()


def least_hashes(text: Column, size: int = SIZE, bins: int = BINS, piece: int = PIECE) -> Column:
    """Per bin its least hash, or the largest number of the bin where no run falls into it; bins in order of signed hashes."""
    shift = _shift(bins)
    none = F.lit([(j << shift) + (1 << shift) - 1 for j in range(-bins // 2, bins // 2)]).cast("array<bigint>")

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (F.shiftright(h, shift) != F.shiftright(F.get(s, i - 1), shift)))

    parts = F.transform(_pieces(text, size, piece), lambda p, i: F.struct(p.alias("part"), i.alias("at")))
    return F.aggregate(
        parts, none, lambda held, p: _let(F.sort_array(F.concat(held, _run_hashes(p["part"], size, p["at"] == 0))), firsts),
    )


def _probes(bins: int) -> list[tuple[int, int]]:
    """Where the probing order of each bin starts and how far it steps; odd steps visit every bin of a power of two."""
    mixed = [zlib.crc32(b"%d" % j) for j in range(bins)]
    return [(m & (bins - 1), m >> 16 & (bins - 1) | 1) for m in mixed]


def densified(least: Column, bins: int = BINS) -> Column:
    """One hash a bin: its own, or that of the first filled bin in its probing order; nulls where no bin is filled."""
    empty = (1 << _shift(bins)) - 1
    starts, steps = (F.lit(list(x)) for x in zip(*_probes(bins)))
    probes = F.arrays_zip(starts.alias("start"), steps.alias("step"))

    def copied(full: Column) -> Column:
        def at(p: Column, t: int) -> Column:
            return F.get(full, (p["start"] + p["step"] * t).bitwiseAND(bins - 1))

        return F.zip_with(full, probes, lambda own, p: F.coalesce(own, *(at(p, t) for t in range(bins))))

    return _let(F.transform(least, lambda h: F.when(h.bitwiseAND(empty) != empty, h)), copied)


def packed(dense: Column, bits: int = BITS) -> Column:
    """The low-order ``bits`` of every bin as hexadecimal digits, in order of bins; the empty string of a text without words."""
    if bits not in (4, 8):
        raise ValueError("bits must be 4 or 8")
    digits = F.lit([format(v, f"0{bits // 4}x") for v in range(1 << bits)])
    return F.array_join(F.transform(dense, lambda h: F.get(digits, h.bitwiseAND((1 << bits) - 1).cast("int"))), "")


def fingerprint(text: Column, size: int = SIZE, bins: int = BINS, bits: int = BITS, piece: int = PIECE) -> Column:
    """The fingerprint of a text (null counts as empty) as ``bins * bits / 4`` hexadecimal digits, or the empty string without words.

    Words stand between ASCII white space and are taken as they are, runs are ``size`` words; a text of fewer is one run.
    """
    return packed(densified(least_hashes(F.coalesce(text, F.lit("")), size, bins, piece), bins), bits)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of the runs of two texts from their fingerprints, 0 to 1.

    Unequal hashes agree in the kept bits with probability 2 to the minus ``bits``; the share of equal bins is corrected for it.  Texts
    without words are alike (1) to one another and to nothing else (0).
    """
    chance = 2.0 ** -bits
    split = lambda fp: F.regexp_extract_all(fp, F.lit("." * (bits // 4)), F.lit(0))
    same = F.size(F.filter(F.zip_with(split(a), split(b), lambda x, y: x == y), lambda e: e)) / F.lit(float(bins))
    corrected = F.greatest((same - chance) / (1 - chance), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(corrected)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``row_hash``, ``fingerprint`` per row of ``docs``; equal texts get equal fingerprints, repeated rows come out alike."""
    return keyed(docs, id_col, text_col).select("doc_id", "row_hash", fingerprint(F.col("text"), size, bins, bits).alias("fingerprint"))


#: Columns that name a text under an id without nulls, so that joins and aggregations share one exchange.
KEY = ["id", "no_id", "row_hash"]


def _links(rows: DataFrame) -> DataFrame:
    """Every key, the next one by falling id (null last, texts under one id by hash; the first behind the last), and a third of its letters."""
    keys = stored(rows.groupBy(*KEY).agg(F.first("n_chars").alias("n_chars")), "keys")
    order = [F.asc("no_id"), F.desc("id"), F.asc("row_hash")]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranged")
    release(keys)
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # One row per range partition.
    total, starts = 0, []
    for p, n in sorted(ranged.groupBy(part.alias("part")).count().collect()):
        starts.append((p, total))
        total += n
    starts = ranged.sparkSession.createDataFrame(starts, "part long, start long")
    placed = ranged.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("pos", F.col("start") + place)
    left = placed.select(*KEY, "pos", F.expr("n_chars div 3").alias("need"))
    right = placed.select(*(F.col(k).alias(f"next_{k}") for k in KEY), F.pmod(F.col("pos") + max(total, 1) - 1, F.lit(max(total, 1))).alias("pos"))
    links = stored(left.join(right, "pos").drop("pos"), "links")
    release(ranged)
    return links


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next one, compared.

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next`` per row.  The next
    document is the one with the next smaller id (null ids last), behind the last one the first.  The edited text has its last
    third (rounded down) replaced by as many first letters of the next document, or all it has.  Repeated rows follow one another; a
    single document follows itself.

    The order is found on keys alone; the text crosses one exchange, and a third of it a second one to the document before.
    """
    rows = keyed(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("no_id"), "row_hash", "text", F.length("text").cast("long").alias("n_chars"),
    )
    links = _links(rows)
    prints = rows.withColumn("fingerprint", fingerprint(F.col("text"), size, bins, bits))
    # All uses below read the same exchange: the filter, always true, keeps its columns alike.
    one = prints.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in ("text", "n_chars", "fingerprint")), F.count("*").alias("copies"))
    one = one.filter("copies > 0 and n_chars >= 0")
    sent = one.toDF(*(f"next_{c}" for c in one.columns))
    sent = sent.join(links.hint("merge"), [f"next_{k}" for k in KEY]).select(
        *KEY, F.expr("substring(next_text, 1, cast(need as int))").alias("head"), "next_fingerprint"
    )
    both = one.join(sent.hint("merge"), KEY)
    last = both.select(*one.columns, "head", "next_fingerprint").withColumn("times", F.lit(1).cast("long"))
    # All copies of a row but one are followed by another copy.
    again = one.filter("copies > 1").select(
        *one.columns, F.expr("substring(text, 1, cast(n_chars div 3 as int))").alias("head"), F.col("fingerprint").alias("next_fingerprint"),
        (F.col("copies") - 1).alias("times"),
    )
    return _compared(last, size, bins, bits).drop("times").union(_repeated(_compared(again, size, bins, bits)))


def _compared(rows: DataFrame, size: int, bins: int, bits: int) -> DataFrame:
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))"), F.col("head"))
    rows = rows.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited"), size, bins, bits))
    return rows.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins, bits).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), bins, bits).alias("near_next"), "times",
    )


def _repeated(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Every row ``times`` times; blocks of copies are dealt to all tasks."""
    blocks = rows.withColumn("block", F.explode(F.expr(f"sequence(0L, (times - 1) div {block})"))).repartition("doc_id", "edited_sha256", "block")
    copies = F.expr(f"sequence(1, cast(least(times - block * {block}, {block}) as int))")
    return blocks.withColumn("copy", F.explode(copies)).drop("times", "block", "copy")
