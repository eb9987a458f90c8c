"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of a fixed number of characters.  Level 0 sorts the distinct blocks and gives each an
integer name; level n + 1 does the same with pairs of adjacent names of level n.  Two texts get the same name at
their last level exactly when they are equal: each level maps its distinct keys one to one to integers.

What scales: a block (or pair) that occurs once cannot be part of two equal texts, so only repeated ones are named.
Level 0 finds them by counting 64-bit hashes, which never loses a repeat; a block that shares its hash with another
block by chance is sorted out by the naming.  The text crosses one exchange, between the hashes of repeated blocks
and the blocks; hot blocks are combined on the map side when counted and split by adaptive execution when joined.
Names are stored before use, so a lost executor cannot change them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, release, stored

#: Characters of a block.
BLOCK = 2048


def _names(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Repeated keys in sorted order with an integer name each."""
    repeated = rows.groupBy(*keys).agg(F.sum("copies").alias("n")).filter("n > 1").drop("n")
    return stored(repeated.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), label)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` for every row of ``docs``.

    Texts are equal when equal after each run of ASCII white space became one space; null counts as empty.  The row
    with the smallest id of a group stays.  Rows with a null id stand behind all others: a group of such rows only
    has a null ``keep_id`` and keeps all of them.  Repeated rows share an id and stay or go together; each counts in
    ``group_size``.  An empty table gives an empty result.
    """
    spaced = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[ \\t-\\r]+", " ")
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), spaced.alias("text")))
    digests = rows.select("doc_id", "row_hash", F.sha2("text", 256).alias("text_sha256"))

    # An empty text is one empty block.
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    )
    blocks = rows.select("doc_id", "row_hash", cut.alias("parts")).select(
        "doc_id", "row_hash", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part")
    )
    hashed = blocks.withColumn("h", F.xxhash64("part"))
    shared = stored(hashed.groupBy("h").agg(F.count("*").alias("seen")).filter("seen > 1").select("h"), "block-hashes")
    level = hashed.join(shared, "h").select("doc_id", "row_hash", "n", "at", "part", F.lit(1).cast("long").alias("copies"))
    level = stored(level, "blocks")
    keys = ["part"]
    roots, depth = None, 0
    while True:
        names = _names(level, keys, "names")
        named = level.join(names, keys).select("doc_id", "row_hash", "n", "at", "name", "copies")
        done = named.filter("n = 1").select("doc_id", "row_hash", F.lit(depth).alias("level"), "name", "copies")
        roots = done if roots is None else roots.union(done)
        pairs = (
            named.filter("n > 1")
            .groupBy("doc_id", "row_hash", "n", F.floor(F.col("at") / 2).cast("int").alias("pair"))
            .agg(
                F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("first"),
                F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("second"),
                # Repeated rows fall together here and go on as one with their number.
                F.sum(F.when(F.col("at") % 2 == 0, F.col("copies"))).alias("copies"),
            )
            # A pair is whole unless it is the odd last one; a text that lost a block has no equal and drops out.
            .filter("first is not null and (second is not null or pair * 2 + 1 = n)")
            .select("doc_id", "row_hash", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("pair").alias("at"),
                    "first", F.coalesce("second", F.lit(-1)).alias("second"), "copies")
        )
        level = stored(pairs, "pairs")
        keys, depth = ["first", "second"], depth + 1
        if level.isEmpty():
            break
    release(shared, level)

    roots = stored(roots, "roots")
    groups = roots.groupBy("level", "name").agg(F.min("doc_id").alias("keep"), F.sum("copies").alias("size"))
    groups = stored(groups, "groups")  # a stored side lets adaptive execution split hot groups of the other
    # Repeated rows have equal roots, so one row per (id, text) is enough to join back.
    found = roots.join(groups, ["level", "name"]).groupBy("doc_id", "row_hash").agg(
        F.first("keep").alias("keep"), F.first("size").alias("size")
    )
    joined = digests.join(
        found.withColumnsRenamed({"doc_id": "found_id", "row_hash": "found_hash"}),
        F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("row_hash") == F.col("found_hash")), "left",
    )
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
