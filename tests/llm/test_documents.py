"""Line dedup, exact dedup, training order, packing and byte BPE against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from callweave.llm import bin_packing, byte_bpe, training_order
from callweave.llm.exact_dedup import exact_groups
from callweave.llm.line_dedup import remove_repeated_lines
from callweave.llm.word_tokens import encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, name string, part int, at int, task int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], SCHEMA)


def odd_rows(seed, n=60):
    rng = random.Random(seed)
    line = lambda: rng.choice(["a", "b b", "", "Été  x", "c\td", "0", "ſ'S"])
    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 9)))) for i in range(n)]
    return rows + [(None, None), (None, "a\nb b\n\n0"), (3, rows[3][1]), (3, rows[3][1]), (3, "other"), (100, ""), (101, None), (102, "long " * 4000)]


# line dedup

def brute_lines(rows, width=3):
    texts = sorted({(-1 if d is None else d, t or "") for d, t in rows})
    order = defaultdict(list)
    for key in texts:
        order[key[0]].append(key)
    first, gone = {}, defaultdict(set)
    for key in texts:
        lines = key[1].split("\n")
        for i in range(len(lines) - width + 1):
            window = tuple(lines[i:i + width])
            if first.setdefault(window, (key, i)) != (key, i):
                gone[key].update(range(i, i + width))
    out = []
    for d, t in rows:
        key = (-1 if d is None else d, t or "")
        lines = key[1].split("\n")
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone[key]), len(lines), len(gone[key])))
    return out


def test_line_dedup(spark):
    # Texts under one id are ordered by hash, so the brute force is held against distinct ids and repeated rows.
    rows = [r for r in odd_rows(1) if r != (3, "other") and r != (None, None)]
    got = [(r.doc_id, r.kept_text, r.n_lines, r.n_removed) for r in remove_repeated_lines(frame(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_lines(rows)))
    assert remove_repeated_lines(frame(spark, rows[:0])).collect() == []
    assert len(remove_repeated_lines(frame(spark, odd_rows(1))).collect()) == len(odd_rows(1))


# exact dedup

@pytest.mark.parametrize("block", [3, 2048])
def test_exact_groups(spark, block):
    rows = odd_rows(2, 120) + [(200 + i, "abc " * 5 + "x" * (i % 3)) for i in range(9)] + [(300, "abc\n" * 5 + " \t"), (301, "abc " * 6)]
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (d, _), t in zip(rows, norm):
        groups[t].append(d)
    want = []
    for (d, _), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        want.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(frame(spark, rows), block=block).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert exact_groups(frame(spark, rows[:0]), block=block).collect() == []


# word tokens and packing

def test_word_ids_are_the_tokenizers():
    rng, own, whole = random.Random(5), encoder(WORDS), Tokenizer.from_file(WORDS)
    signs = ["a", "B", "é", "ſ", "İ", "ß", "Σ", "0", "９", "²", "'s", "'RE", " ", "\n", "\x1c", "\x85", "\xa0", "é", "中", "😀", "<|endoftext|>", "<|", "&&&", "_", "\0", "\xad", "가", "ª"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_tables_are_bounded_by_bytes(monkeypatch):
    from sys import getsizeof

    from callweave.llm import word_tokens

    monkeypatch.setattr(word_tokens, "WORDS", 20_000)
    monkeypatch.setattr(word_tokens, "PARTS", 10_000)
    own, whole = word_tokens.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = [" ".join(f"w{i}x{k}," for i in range(200)) for k in range(5)] + ["a" * 5000 + "1" * 3000, "zz" * 400 + " b", ""]
    for text in texts * 2:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)
    for held, limit in ((own.words, 20_000), (own.parts, 10_000)):
        assert held and max(map(len, held)) <= word_tokens.LONGEST
        assert sum(getsizeof(k) + getsizeof(v) for k, v in held.items()) < limit + 2_000


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(spark, capacity):
    rows, whole = odd_rows(3), Tokenizer.from_file(WORDS)
    packed = bin_packing.pack_documents(frame(spark, rows), WORDS, capacity=capacity, end_id=1, with_ids=True)
    got = packed.collect()
    want = Counter()
    for d, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], "<u4").tobytes()
            want[d, piece, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in bins.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // capacity) + 1
    for r in bin_packing.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(x[2] for x in sorted(bins[r.sequence_id]))
    assert bin_packing.pack_documents(frame(spark, rows[:0]), WORDS).collect() == []


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        take = bin_packing.fullest(room, counts)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        assert sum(x * n for x, n in take.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[x] for x, n in take.items())


# training order

def test_slots_are_a_keyed_permutation():
    for n in (1, 2, 3, 5, 17, 1000, 1025):
        out = training_order.slots(np.arange(n), n, 7)
        assert sorted(out) == list(range(n))
        assert (training_order.slots(out, n, 7, backwards=True) == np.arange(n)).all()
    assert (training_order.slots(np.arange(1000), 1000, 7) != training_order.slots(np.arange(1000), 1000, 8)).any()


def test_training_order_round_trip(spark, tmp_path):
    rows, whole, length = odd_rows(6), Tokenizer.from_file(WORDS), 8
    docs = frame(spark, rows).repartition(3)
    path = str(tmp_path / "shards")
    training_order.write_shards(docs, WORDS, path, key=11, length=length, per_shard=50)
    want = Counter()
    for d, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        for piece in range(-(-len(ids) // length) or 1):
            want[d, piece, np.array(ids[piece * length:(piece + 1) * length], "<u2").tobytes()] += 1
    n = want.total()
    read = lambda *a: training_order.read_shards(spark, path, *a, length=length).collect()
    got = sorted(read(), key=lambda r: r.slot)
    assert Counter((r.doc_id, r.piece, bytes(r.ids)) for r in got) == want
    assert [r.slot for r in got] == list(range(n))
    assert all(a.place < b.place and a.shard <= b.shard for a, b in zip(got, got[1:]))  # slots follow the permuted places
    assert sorted(map(tuple, read(60, 130))) == sorted(map(tuple, got[60:130]))
    stride = training_order.record_type(length).itemsize
    for shard, first, count in training_order.manifest(spark, path, length):
        files = list((tmp_path / "shards" / f"shard={shard}").glob("part-*"))
        assert len(files) == 1 and files[0].stat().st_size == stride * count and got[first].shard == shard
    assert training_order.training_order(docs.limit(0), WORDS, key=1).collect() == []


def test_training_order_with_splits_without_rows(spark, tmp_path):
    rows = [(i, f"text {i} " * 20, "x", 1, 2, 3) for i in range(3000)]
    path = str(tmp_path / "docs")
    # One row group, read by several splits: all but one of them have no rows.
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        docs = spark.read.parquet(path)
        assert docs.rdd.getNumPartitions() > 3
        assert sorted(r.doc_id for r in training_order.training_order(docs, WORDS, key=3).collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    filtered = spark.createDataFrame(rows[:40], SCHEMA).repartitionByRange(8, "doc_id").filter("doc_id between 12 and 20")
    assert sorted(r.doc_id for r in training_order.training_order(filtered, WORDS, key=3).collect()) == list(range(12, 21))
    assert training_order.training_order(filtered.filter("doc_id < 0"), WORDS, key=3).collect() == []


# byte BPE

def test_byte_bpe(spark):
    rng = random.Random(7)
    signs = ["a", "the", "É", "ſ", "İ", "²", "９", "'s", "'LL", " ", "\n", "\x1c", "\x85", "\xa0", "中", "😀", "<|endoftext|>", "##", "\0", "　", "aaaa"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 20)))) for i in range(400)]
    rows += [(None, None), (1, "x" * 30000 + " ab" * 9), (1, "again"), (1, "again")]
    ranks = byte_bpe.read_ranks(open(RANKS, encoding="ascii").read().splitlines())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(frame(spark, rows), RANKS, public_tokenizers.PATTERN)
    got = byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN, ["doc_id", "n_tokens"]).collect()
    want = Counter((d, len(ids := theirs.encode_ordinary(t or "")), tuple(ids), (t or "").encode()) for d, t in rows)
    assert Counter((r.doc_id, r.n_tokens, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.bytes)) for r in got) == want
    assert encoded.limit(0).collect() == []


def test_rank_queue_takes_the_lowest_rank_even_behind_a_higher_one():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 299, b"cd": 310, b"abcd": 305}
    own = byte_bpe.ByteEncoder(ranks, r"\S+")

    def brute(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            _, i = min(pairs)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(8)
    for _ in range(500):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 12)))
        assert own.merge(piece) == brute(piece)
    assert not own.buckets and not any(own.words)


def test_latin_split_is_the_pattern():
    rng, split = random.Random(9), regex.compile(public_tokenizers.PATTERN)
    for _ in range(3000):
        text = "".join(chr(rng.choice([*range(32, 127), 9, 10, 13, 0x85, 0xa0, *range(0xa1, 0x180)])) for _ in range(rng.randint(0, 15)))
        assert byte_bpe.LATIN_SPLIT(text) == split.findall(text)
