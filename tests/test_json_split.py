"""JSON arrays and maps read in ranges against the whole read, at several sizes of a range."""

import json
import random

import pytest

from callweave.sources import corpus
from callweave.sources.json_split import json_map_entries, json_objects

ODD = ["}", "{", "[", "]", '"', "\\", '\\"', "}\"{", ",", ":", "é😀", "\n", "\\\\", "plain words", "a\tb", "}} ]]", ""]


@pytest.fixture
def ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]

    def of(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")

    yield of
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 4 else 3)
    if kind < 2:
        return "".join(rng.choice(ODD) for _ in range(rng.randint(0, 4)))
    if kind == 2:
        return rng.choice([None, True, 1.5, -3])
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(ODD) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def thing(rng):
    return {"id": rng.randrange(99), **{f"k{i}": value(rng) for i in range(rng.randint(0, 4))}}


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_arrays(spark, tmp_path, ranges, size):
    rng, want = random.Random(size), {}
    for name, n, style in (("a", 40, {}), ("b", 25, {"indent": 2}), ("c", 0, {}), ("d", 1, {"ensure_ascii": False}), ("e", 30, {"separators": (",", ":"), "ensure_ascii": False})):
        want[name] = [thing(rng) for _ in range(n)]
        (tmp_path / f"{name}.json").write_text(json.dumps(want[name], **style) + "\n", encoding="utf-8")
    want["one"] = [thing(rng) | {"inner": {"x": {}}, "list": [{}, {"y": 1}]}]
    (tmp_path / "one.json").write_text(json.dumps(want["one"][0], indent=1))
    ranges(size)
    got = {}
    for r in json_objects(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[1][:-5], {})[r.number] = json.loads(r.value)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("size", [64, 1 << 20])
@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_maps(spark, tmp_path, ranges, size, style):
    rng = random.Random(5)
    maps = {"keywords": {f"t{i}{rng.choice(ODD)}": thing(rng) for i in range(20)}, "none": {}, 'odd "field" }': {f"u{i}": thing(rng) for i in range(7)}, "last": {"z": {}}}
    (tmp_path / "map.json").write_text(json.dumps(maps, **style), encoding="utf-8")
    ranges(size)
    got = {(r.outer, r.key): json.loads(r.value) for r in json_map_entries(spark, str(tmp_path)).collect()}
    assert got == {(f, k): v for f, m in maps.items() for k, v in m.items()}


def test_corpus_rows_and_rejects(spark, tmp_path, ranges):
    calls = [{"transcript_id": f"c{i}", "domain": "Retail }", "turns": [{"conversation": [{"speaker": "Agent", "utterance": "hi {" * i}], "sentiment": {"score": 0.5, "label": "x"}}]} for i in range(30)]
    (tmp_path / "calls.json").write_text(json.dumps(calls, indent=1))
    whole = sorted(map(str, corpus.read_corpus(spark, str(tmp_path / "calls.json")).collect()))
    assert len(whole) == 30
    ranges(200)
    assert sorted(map(str, corpus.read_corpus(spark, str(tmp_path / "calls.json")).collect())) == whole
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.jsonl").write_text("\n".join(map(json.dumps, calls)) + '\n\n{"transcript_id": \nnot json\n')
    with pytest.raises(ValueError):
        corpus.lines_to_corpus(spark, str(lines), str(tmp_path / "failed"))
    out = corpus.lines_to_corpus(spark, str(lines), str(tmp_path / "stored"), str(tmp_path / "rejects"))
    assert out.count() == 30 and out.filter("transcript_id is null").isEmpty()
    assert {r.line for r in spark.read.parquet(str(tmp_path / "rejects")).collect()} == {'{"transcript_id": ', "not json"}
