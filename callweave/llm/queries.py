"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .bin_packing import pack_documents
from .byte_bpe import decode, encode
from .common import table
from .doc_fingerprint import edited_and_next
from .exact_dedup import exact_groups
from .fill_in_middle import fill_in_middle, restore
from .html_text import extract
from .importance_resampling import resample
from .line_dedup import remove_repeated_lines
from .passage_dedup import remove_repeats
from .simhash_dedup import near_components
from .topk_search import top_k_search
from .training_order import training_order

#: Key of the training order.
ORDER_KEY = 20240229

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_line_dedup", """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select doc_id, len(l) as n, unnest(l) as line, generate_subscripts(l, 1) as i from d),
win as (
    select doc_id, i, line || chr(10) || lead(line) over w || chr(10) || lead(line, 2) over w as win from lines
    window w as (partition by doc_id order by i)
), later as (
    select doc_id, i from win where win is not null qualify row_number() over (partition by win order by doc_id, i) > 1
), gone as (select distinct doc_id, unnest([i, i + 1, i + 2]) as i from later)
select doc_id, max(n)::bigint as n_lines, count(g.i)::bigint as n_removed,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (where g.i is null), '')) as kept_sha256
from lines left join gone g using (doc_id, i) group by doc_id
""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op2_training_order")
def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = training_order(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ORDER_KEY)
    return records.select("slot", "shard", "place", "doc_id", "piece", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_exact_dedup", """
with d as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents
), g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t) as text_sha256
from d join g using (t)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode(table(spark, sf_dir, "documents"), ranks, pattern)
    return decode(encoded, ranks, pattern, ["doc_id", "n_tokens"]).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


@query("op6_topk_search", """
with v as (
    select vec_id, row_number() over () as r, embedding from embeddings
    where vec_id is not null and embedding is not null
), c as (
    select r, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from v
), bad as (select distinct r from c where x is null or not isfinite(x)),
w as (select r, vec_id, i, floor(256 * x)::bigint as x from c where r not in (select r from bad)),
s as (
    select a.r, a.vec_id as query_id, b.vec_id, sum(a.x * b.x)::bigint as score
    from w a join w b on a.i = b.i and a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by a.r, a.vec_id, b.r, b.vec_id
)
select query_id, (row_number() over (partition by r order by score desc, vec_id))::int as rank, vec_id, score
from s qualify rank <= 5
""")
def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op7_simhash_dedup")
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs)).withColumn("kept", F.col("score") >= 0.5)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=400).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        # A cut may split a character: what is left of it reads as a replacement character.
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


@query("op11_fill_in_middle", """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (
    select doc_id, t, length(t) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
        ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d
), c as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
            when h4 % 100 < 20 then 'spm' else 'psm' end as form from u
), p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a::bigint end as prefix_chars,
    case when form <> 'plain' then (b - a)::bigint end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
        else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
    sha256(t) as restored_sha256
from p
""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op12_importance_resampling", """
with tab as (
    select list(c order by b) as tab from (
        select b, list_reduce([b] || [1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from (select unnest(range(256))::bigint as b)
    )
), d as (
    select 0 as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
    union all
    select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), w as (select side, id, unnest(w) as word from d),
codes as (
    select word, xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(hex(word)), 2), lambda i: ('0x' || substr(hex(word), i, 2))::bigint),
        lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket
    from (select distinct word from w), tab
), f as (select side, id, bucket from w join codes using (word)),
n as (
    select b.bucket, count(*) filter (where side = 0) as s, count(*) filter (where side = 1) as t
    from (select unnest(range(10000)) as bucket) b left join f using (bucket) group by b.bucket
), g as (
    select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from n
), x as (select id, sum(gain)::bigint as weight from f join g using (bucket) where side = 0 group by id),
y as (
    select id as doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
        coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from d left join x using (id) where side = 0
), r as (
    select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from y where n_features >= 20
)
select doc_id, n_features, weight, score, case when rank <= n * 10 // 100 then rank::bigint end as rank from y left join r using (doc_id)
""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, seed=2024,
                    percent=10, least_words=20).select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_document_fingerprints")
def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_and_next(table(spark, sf_dir, "documents"))
