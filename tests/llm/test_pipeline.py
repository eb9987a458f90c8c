import corpus_pipeline
from callweave.llm.common import stored


def rows(n):
    text = lambda i: "\n".join(f"Line {k} of text {i} tells of number {i * 7 + k}, and then of {i * k + 3}." for k in range(8))
    return [(i, text(i), "en", "src", len(text(i)), "x", 1) for i in range(n)]


def test_stages_return_the_columns_and_take_odd_rows(spark):
    odd = [(None, None, None, None, None, None, None), (5, rows(6)[5][1], "en", "src", 1, "x", 1), (90, "", "en", None, 0, "y", 2),
           (91, "word " * 3000, "en", "src", 15000, "z", 3), (92, rows(9)[8][1] + "\nOne more line.", "en", "src", 3, "x", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_hash string, extra int"
    docs = spark.createDataFrame(rows(40) + odd, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, ""), name)
        if name == "best_fit_packing":
            assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
            fill = {}
            for r in out.collect():
                fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for parts in fill.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                assert at <= 4096
        else:
            assert out.columns == docs.columns
        docs = out
    kept = {r.doc_id for r in docs.collect()}
    assert 5 in kept and set(range(40)) <= kept


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), name)
        assert docs.collect() == []
