"""Vector search, keyword search, reranking and rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_rows, words
from ..session import materialize
from .joins import bounded_broadcast, top_k
from .scan import sorted_runs

#: Rows of a block, term counts of a block and queries of a page: what one task holds of each.
BLOCK_ROWS, BLOCK_CELLS, PAGE_QUERIES = 20_000, 2_000_000, 2_000
#: Different words of all queries up to which every task gets them; beyond, words meet them by a join.
INDEX_TERMS = 100_000


def _blocked(rows: DataFrame, row_key: str, queries: DataFrame, query_key: str, n_rows: int, n_queries: int, n_cells: int = 0):
    """Groups of rows by ``(block, page)`` and of queries by the same, for a cogroup in which both sides are bounded.

    Rows are dealt to blocks and queries to pages by hash; every block meets every page once, in one task.
    """
    blocks, pages = max(1, -(-n_rows // BLOCK_ROWS), -(-n_cells // BLOCK_CELLS)), max(1, -(-n_queries // PAGE_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumn("_block", F.pmod(F.xxhash64(row_key), F.lit(blocks))).withColumn("_page", every(pages))
    right = queries.withColumn("_page", F.pmod(F.xxhash64(query_key), F.lit(pages))).withColumn("_block", every(blocks))
    return left.groupBy("_block", "_page").cogroup(right.groupBy("_block", "_page"))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None) -> DataFrame:
    """Exact nearest vectors per query: ``(query_id, item_id, score, rank)``.

    A task multiplies a block of vectors with a page of queries and passes on its best ``k`` per query, so no task and
    not the driver holds all of either, and no pair of the rest is shuffled.  Rows and queries without a vector, or with a null or
    a number that is not finite in it, take no part.
    """
    vector = F.col("vector")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vectors, queries = (df.filter(vector.isNotNull() & F.forall(vector.cast("array<double>"), number)) for df in (vectors, queries))

    def matrix(table):
        import numpy as np
        import pyarrow.compute as pc

        column = table.column("vector").combine_chunks()
        if pc.count_distinct(lengths := pc.list_value_length(column)).as_py() > 1:
            raise ValueError("vectors must have one length")
        out = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), lengths[0].as_py())
        size = np.linalg.norm(out, axis=1)
        return out / np.where(size == 0, 1.0, size)[:, None]

    def score(rows, asked):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = []
        # Ties go to the smaller id, so rows come in the order of their ids.
        rows = rows.take(pc.sort_indices(rows, [("item_id", "ascending")], null_placement="at_start"))
        if len(rows) and len(asked):
            items, wanted = matrix(rows), matrix(asked)
            for at in range(0, len(wanted), 64):
                sims = np.round(wanted[at:at + 64] @ items.T, 12)
                for q, line in enumerate(sims, at):
                    keep = np.arange(len(line)) if threshold is None else np.flatnonzero(line >= threshold)
                    if len(keep) > k:
                        cut = np.partition(line[keep], len(keep) - k)[len(keep) - k]
                        keep = keep[line[keep] >= cut]
                    keep = keep[np.argsort(-line[keep], kind="stable")][:k]
                    out.append((np.full(len(keep), q), keep, line[keep]))
        at, keep, sims = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([asked.column("query_id").take(pa.array(at)), rows.column("item_id").take(pa.array(keep)), pa.array(sims)],
                        ["query_id", "item_id", "score"])

    queries = materialize(queries.select("query_id", "vector"), "queries")
    rows = vectors.select("item_id", "vector")
    schema = f"query_id {_type(queries, 'query_id')}, item_id {_type(vectors, 'item_id')}, score double"
    pairs = _blocked(rows, "item_id", queries, "query_id", rows.select("item_id").count(), queries.count())
    return top_k(pairs.applyInArrow(score, schema), ["query_id"], [F.desc("score"), F.asc("item_id")], k)


# --- keyword search ----------------------------------------------------------------


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Term counts ``(doc_id, length, term, tf)`` of whole texts, one row per document in.

    Terms are counted where the document was read, so only counted terms move; with
    ``terms`` everything else is dropped before that.
    """
    tokens = word_rows(docs, ["doc_id"])
    if terms is not None:
        tokens = tokens.join(bounded_broadcast(terms.select("term").distinct()), "term", "left_semi")
    return tokens.groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    return word_rows(queries, ["query_id"]).select("query_id", "term").distinct()


def score_postings(counted: DataFrame, asked: DataFrame, n_docs: int, mean_length: float, k1: float, b: float) -> DataFrame:
    """BM25 sums ``(query_id, doc_id, score)`` from term counts."""
    weighted = counted.groupBy("term").agg(F.count("*").alias("df")).select(
        "term", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    saturation = (F.col("tf") * (k1 + 1)) / (
        F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(mean_length)))
    )
    return (
        counted.join(bounded_broadcast(asked.join(weighted, "term")), "term")
        .groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * saturation).alias("score"))
    )


def _indexer(terms: list[str], mean: float, k1: float, b: float):
    """Builder of index rows ``(doc_id, found)`` from the words of a batch's texts; texts of equal id and length count as one."""

    def index(rows, ids, first):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        found = rows.column("words").combine_chunks()
        size = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        run = np.repeat(np.arange(len(ids)), np.diff(first))
        # One number per id and length; the text of a cell is the first that has it.
        _, text, same = np.unique(np.stack([run, size]), axis=1, return_index=True, return_inverse=True)
        place = pc.fill_null(pc.index_in(found.flatten(), value_set=pa.array(terms, pa.string())), -1).to_numpy(zero_copy_only=False)
        known = place >= 0
        cell, tf = np.unique(np.repeat(same.reshape(-1), size)[known] * max(len(terms), 1) + place[known], return_counts=True)
        text, term = text[cell // max(len(terms), 1)], cell % max(len(terms), 1)
        gain = (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * size[text] / mean))
        ends = np.concatenate(([0], np.cumsum(np.bincount(run[text], minlength=len(ids))))).astype(np.int32)
        cells = pa.StructArray.from_arrays([pa.array(terms, pa.string()).take(pa.array(term)), pa.array(gain)], ["term", "gain"])
        return pa.table([ids, pa.ListArray.from_arrays(pa.array(ends), cells)], ["doc_id", "found"])

    return index


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Best documents per query by BM25 among those that share a term with it.

    Each document's counts of the queries' terms are written once as one row, the index.  A task scores a block of
    documents against a page of queries and passes on its best ``k`` per query, so a word that all documents share
    costs a task some additions and no exchange a row.
    """

    def score(rows, asked):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # Ties go to the smaller id, so rows come in the order of their ids.
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending")], null_placement="at_start"))
        found, terms = rows.column("found").combine_chunks(), pc.unique(asked.column("term"))
        first = np.concatenate(([0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False)))).astype(np.int64)
        cells = found.flatten()
        # Terms that only other pages ask for stand behind the last column.
        place = pc.fill_null(pc.index_in(cells.field("term"), value_set=terms), len(terms)).to_numpy(zero_copy_only=False)
        gain = cells.field("gain").to_numpy(zero_copy_only=False)
        wanted = pc.dictionary_encode(asked.column("query_id"), null_encoding="encode").combine_chunks()
        n = len(wanted.dictionary)
        weight = np.zeros((n, len(terms) + 1))
        weight[wanted.indices.to_numpy(zero_copy_only=False), pc.index_in(asked.column("term"), value_set=terms).to_numpy()] = asked.column("idf").to_numpy()
        wants = (weight > 0).astype(np.float32)
        order, exact, which = np.full((n, k), -np.inf), np.zeros((n, k)), np.full((n, k), -1)
        for lo in range(0, len(rows) if n else 0, 512):
            hi = min(lo + 512, len(rows))
            part = slice(first[lo], first[hi])
            grid = np.zeros((hi - lo, len(terms) + 1))
            grid[np.repeat(np.arange(hi - lo), np.diff(first[lo:hi + 1])), place[part]] = gain[part]
            scores = weight @ grid.T
            rounded = np.where(wants @ (grid > 0).astype(np.float32).T > 0, np.round(scores, 9), -np.inf)
            at = np.flatnonzero((rounded > order[:, -1:]).any(axis=1))
            if len(at):
                order_at = np.concatenate((order[at], rounded[at]), axis=1)
                best = np.argsort(-order_at, axis=1, kind="stable")[:, :k]
                take = lambda x: np.take_along_axis(x, best, axis=1)
                order[at] = take(order_at)
                exact[at] = take(np.concatenate((exact[at], scores[at]), axis=1))
                which[at] = take(np.concatenate((which[at], np.broadcast_to(np.arange(lo, hi), (len(at), hi - lo))), axis=1))
        q, rank = np.nonzero(order > -np.inf)
        return pa.table([wanted.dictionary.take(pa.array(q)), rows.column("doc_id").take(pa.array(which[q, rank])), pa.array(exact[q, rank])],
                        ["query_id", "doc_id", "score"])

    asked = materialize(query_terms(queries), "asked")
    sizes = docs.agg(
        F.count("*").alias("n"), F.avg(F.regexp_count(F.lower("text"), F.lit(r"\p{L}+"))).alias("mean")
    ).first()
    n_docs, mean = sizes["n"] or 0, float(sizes["mean"] or 1.0)
    gain = (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    counted = lambda rows: postings(rows.select("doc_id", "text"), asked).groupBy("doc_id").agg(
        F.collect_list(F.struct("term", gain.alias("gain"))).alias("found"))
    terms = [r["term"] for r in asked.select("term").distinct().limit(INDEX_TERMS + 1).collect()]
    if len(terms) > INDEX_TERMS:
        index = materialize(counted(docs), "index")
    else:
        # Texts are brought together by id once and counted there; those without an id, which make one row, meet as counts.
        texts = docs.filter("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id").select(
            "doc_id", words(F.col("text")).alias("words"))
        found = "array<struct<term:string,gain:double>>"
        index = materialize(
            sorted_runs(texts, "doc_id", [], _indexer(terms, mean, k1, b), f"doc_id {_type(docs, 'doc_id')}, found {found}")
            .filter("size(found) > 0").unionByName(counted(docs.filter("doc_id IS NULL"))), "index")
    idf = index.select(F.explode("found.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select(
        "term", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = materialize(asked.join(idf, "term"), "weighted")
    schema = f"query_id {_type(queries, 'query_id')}, doc_id {_type(docs, 'doc_id')}, score double"
    pages = asked.select("query_id").distinct().count()
    size = index.agg(F.count("*").alias("n"), F.sum(F.size("found")).alias("cells")).first()
    pairs = _blocked(index, "doc_id", asked, "query_id", size["n"], pages, size["cells"] or 0)
    return top_k(pairs.applyInArrow(score, schema), ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], k)


def pair_bm25(
    pairs: DataFrame, utterances: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75
) -> DataFrame:
    """BM25 of given ``(query_id, doc_id)`` pairs, 0 where they share no term.

    ``utterances`` are the text rows of the documents, any number per document; only
    those of paired documents are read on, and they form the corpus of the statistics.
    """
    asked = query_terms(queries)
    wanted = bounded_broadcast(pairs.select("doc_id").distinct())
    terms = materialize(
        word_rows(utterances.join(wanted, "doc_id", "left_semi"), ["doc_id"])
        .groupBy("doc_id", "term").agg(F.count("*").alias("tf")),
        "postings",
    )
    lengths = materialize(terms.groupBy("doc_id").agg(F.sum("tf").alias("length")), "lengths")
    sizes = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    counted = terms.join(bounded_broadcast(asked.select("term").distinct()), "term", "left_semi").join(lengths, "doc_id")
    scores = score_postings(counted, asked, sizes["n"] or 0, sizes["mean"] or 1.0, k1, b)
    return pairs.join(scores, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


# --- rerank and fusion -------------------------------------------------------------


def rerank(retrieved: DataFrame, final_k: int = 5, text: str = "preview", score: str | None = "score") -> DataFrame:
    """Keep the best ``final_k`` of a ranked list by a score column.

    Items without text are dropped first.  Without a score the first items stay, in
    their order.
    """
    kept = retrieved.filter(F.coalesce(F.col(text), F.lit("")) != "")
    order = [F.asc("rank")] if score is None else [F.desc(F.round(score, 9)), F.asc("rank")]
    return top_k(kept, ["query_id"], order, final_k, "final_rank")


def fuse(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ``(query_id, item_id, rank)`` tables."""
    rows = None
    for ranking in rankings:
        part = ranking.select("query_id", "item_id", (1.0 / (constant + F.col("rank"))).alias("gain"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "item_id").agg(F.round(F.sum("gain"), 12).alias("score"))
    return top_k(fused, ["query_id"], [F.desc("score"), F.asc("item_id")], k)


def fuse_legs(legs: dict[str, DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion that also tells the rank of an item in every leg, null where the leg did not find it."""
    rows = None
    for name, ranking in legs.items():
        part = ranking.select("query_id", "item_id", F.lit(name).alias("leg"), F.col("rank").cast("long").alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "item_id").agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"),
        *[F.min(F.when(F.col("leg") == name, F.col("rank"))).alias(f"{name}_rank") for name in legs])
    return top_k(fused, ["query_id"], [F.desc("score"), F.asc("item_id")], k)


def text_vectors(docs: DataFrame) -> DataFrame:
    """Vectors for texts that come without any, one row per component: ``(item_id, term, weight)``.

    Every word is a dimension of its own, weighted by count and rarity; a text's weights have unit length.  A text of
    words that all texts have, or without words, has no component.  Texts are brought together by id once; their words are
    counted, weighted and measured where they lie, unless there are too many words to send their rarity to every task.
    """
    docs = docs.select("item_id", "text")
    texts = docs.filter("item_id is not null").repartition("item_id")
    counts = word_rows(texts, ["item_id"]).groupBy("item_id", "term").agg(F.count("*").alias("tf"))
    # Rows without an id count as one text and have no component.
    nameless = word_rows(docs.filter("item_id is null"), ["item_id"]).select("term").distinct()
    rarity = materialize(counts.select("term").unionByName(nameless).groupBy("term").agg(
        F.log((F.lit(docs.count()) + 1.0) / (F.count("*") + 1.0)).alias("rarity")), "rarity")
    weighted = counts.join(rarity, "term").select("item_id", "term", (F.col("tf") * F.col("rarity")).alias("weight")).filter("weight > 0")
    length = F.sqrt(F.sum(F.col("weight") ** 2).over(Window.partitionBy("item_id")))
    return weighted.withColumn("length", length).filter("length > 0").select("item_id", "term", (F.col("weight") / F.col("length")).alias("weight"))
