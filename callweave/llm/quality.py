"""Quality classifier from weak labels: overlapping heuristics, an accuracy model, a hashed linear scorer.

1. Labellers look at a whole text and vote good, bad or not at all.
2. Texts with equal votes are alike to the label model, so it needs only how often each pattern of votes occurs: at most
   3 ** len(LABELLERS) counts, whatever the size of the table.  Expectation-maximisation over the counts of all texts
   estimates how often each labeller votes which way on good and on bad texts, and so the chance that a pattern is good.
3. A bounded sample of distinct texts (at most ``sample``) with these chances as labels trains a logistic scorer on hashed
   features, which also judges texts on which labellers are silent or disagree.  It is a priority sample: a text with n
   copies comes in with a chance that grows with n, and weighs n or, if more, what the last text left out stands for.  So
   a text with many copies is one row that weighs as its copies do, and all other texts together weigh as theirs.
4. Every text is scored where it is read.  No text crosses an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, sliced, stored

#: Most texts the scorer is fitted on; its hashed features; passes of both fits.
SAMPLE, FEATURES, ROUNDS = 10_000, 1 << 10, 200
#: Most of the votes of a labeller on good texts that may be bad: labellers are written to fire rarely, and without a bound
#: the fault that two labellers see alike would be taken for the bad class and every other fault for the good one.
FALSE_ALARMS = 0.002
#: Classes of bytes: 0 lower case and beyond ASCII, 1 upper case, 2 digit, 3 space, 4 line end, then signs.
CLASS = np.zeros(256, np.uint8)
for _class, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".", b",;:", b"!", b"?", b"|",
                                 b"%*&$#~^=+\\_@<>", b"\"'`", b"-/", b"()[]{}"), 1):
    CLASS[list(_bytes)] = _class
CLASS[[b for b in range(32) if b not in b"\t\r\n"] + [127]] = 14
LOWER, UPPER, SPACE, LINE, STOP, SHOUT, ASK, BAR, SIGN = 0, 1, 3, 4, 5, 7, 8, 9, 10


@dataclass
class Traits:
    """What labellers look at."""

    words: int
    shares: np.ndarray  # of byte classes
    letters: int
    ends: float  # sentence ends a word
    shouts: float  # exclamation marks a word
    bars: float
    again: float  # share of words equal to the one before
    different: float  # different words a word
    length: float  # bytes a word


def traits(text: str, classes: np.ndarray) -> Traits:
    words = text.split()
    n = max(1, len(words))
    counts = np.bincount(classes, minlength=16)
    seen = counts.sum() - counts[SPACE] - counts[LINE]
    return Traits(
        len(words), counts / max(1, seen), int(counts[LOWER] + counts[UPPER]), (counts[STOP] + counts[SHOUT] + counts[ASK]) / n,
        counts[SHOUT] / n, counts[BAR] / n, sum(map(eq, words, words[1:])) / n, len(set(words)) / n, seen / n,
    )


def _between(value: float, good: float, bad: float) -> int:
    return 1 if value <= good else -1 if value >= bad else 0


#: Each votes 1 (good), -1 (bad) or 0 (silent).
LABELLERS = {
    "signs": lambda t: _between(t.shares[SIGN], 0.02, 0.08) if t.words else 0,
    "capitals": lambda t: _between(t.shares[UPPER] * t.shares.sum() / max(1e-9, t.shares[LOWER] + t.shares[UPPER]), 0.25, 0.5) if t.letters >= 10 else 0,
    "bars": lambda t: _between(t.bars, 0.02, 0.15) if t.words else 0,
    "shouting": lambda t: _between(t.shouts, 0.1, 0.3) if t.words >= 4 else 0,
    "stammer": lambda t: _between(t.again, 0.06, 0.25) if t.words >= 8 else 0,
    "vocabulary": lambda t: (1 if t.different >= 0.3 else -1 if t.different <= 0.08 else 0) if t.words >= 30 else 0,
    "sentences": lambda t: (1 if 0.02 <= t.ends <= 0.4 else -1 if t.ends < 0.002 or t.ends > 0.7 else 0) if t.words >= 30 else 0,
    "word_length": lambda t: (1 if 2 <= t.length <= 16 else -1) if t.words >= 5 else 0,
}


def votes(t: Traits) -> int:
    """The votes as one number in base three."""
    code = 0
    for labeller in LABELLERS.values():
        code = code * 3 + labeller(t) + 1
    return code


def _unpack(codes: np.ndarray) -> np.ndarray:
    """One row per pattern, one column per labeller, 0 bad, 1 silent, 2 good."""
    powers = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return codes[:, None] // powers % 3


def label_chances(codes: np.ndarray, table: np.ndarray, prior: float) -> np.ndarray:
    """Chance of good per pattern.  Silence says nothing, since it mostly tells short texts from long ones."""
    onehot = np.eye(3)[_unpack(codes)][:, :, [0, 2]]
    logs = np.einsum("plv,clv->cp", onehot, np.log(table)) + np.log([1 - prior, prior])[:, None]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit_labels(codes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Chance of good per pattern; chance of a bad or good vote per labeller on bad and good texts; share of good texts.

    Labellers look for different faults, so on a bad text most of them vote good: the start takes texts with any bad
    vote as suspect, which also says which of the two classes is the good one.
    """
    patterns = _unpack(codes)
    good = np.where((patterns == 0).any(axis=1), 0.1, 0.9)
    onehot = np.eye(3)[patterns][:, :, [0, 2]]
    prior, table = 0.5, np.full((2, len(LABELLERS), 2), 0.5)
    for _ in range(rounds):
        weights = np.stack((1 - good, good)) * counts
        prior = (weights[1].sum() + 1) / (counts.sum() + 2)
        held = np.einsum("cp,plv->clv", weights, onehot) + 0.1
        table = held / held.sum(axis=2, keepdims=True)
        table[1, :, 0] = np.minimum(table[1, :, 0], FALSE_ALARMS)
        table[1, :, 1] = 1 - table[1, :, 0]
        before, good = good, label_chances(codes, table, prior)
        if np.abs(good - before).max(initial=0) < 1e-9:
            break
    return good, table, prior


def features(t: Traits, classes: np.ndarray, size: int = FEATURES) -> np.ndarray:
    """Hashed features of unit length: triples of byte-class runs, and the traits in steps."""
    out = np.zeros(size, np.float32)
    if not len(classes):
        return out
    runs = classes[np.concatenate(([True], classes[1:] != classes[:-1]))].astype(np.uint32)
    runs = np.concatenate((np.array([15, 15], np.uint32), runs))
    triples = runs[:-2] * 256 + runs[1:-1] * 16 + runs[2:]
    shift = 33 - size.bit_length()
    np.add.at(out, (np.flatnonzero(c := np.bincount(triples, minlength=4096)).astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(shift), c[c > 0])
    out /= max(1e-9, float(np.sqrt((out * out).sum())))
    steps = np.array([min(15, int(v * 20)) for v in (t.shares[SIGN], t.shares[UPPER], t.bars, t.shouts, t.again, t.different, t.ends)], np.uint32)
    names = 4096 + np.arange(len(steps), dtype=np.uint32) * 16 + steps
    out[(names * np.uint32(2654435769)) >> np.uint32(shift)] += 0.4
    return out


def fit_scorer(
    x: np.ndarray, good: np.ndarray, rounds: int = ROUNDS, rate: float = 2.0, decay: float = 1e-4, copies: np.ndarray | None = None
) -> np.ndarray:
    """Weights and bias of a logistic model for soft labels, by momentum descent with both classes weighing the same.

    A row counts as ``copies`` rows.
    """
    weights = np.zeros(x.shape[1] + 1, np.float64)
    if not len(x):
        return weights
    copies = np.ones(len(x)) if copies is None else copies / copies.mean()
    total = (copies * good).sum(), (copies * (1 - good)).sum()
    balance = copies * (good / max(total[0], 1e-9) + (1 - good) / max(total[1], 1e-9))
    balance /= balance.sum()
    speed = np.zeros_like(weights)
    for _ in range(rounds):
        margin = x @ weights[:-1].astype(np.float32) + weights[-1]
        error = (1 / (1 + np.exp(-margin)) - good) * balance
        gradient = np.append(error.astype(np.float32) @ x, error.sum())
        gradient[:-1] += decay * weights[:-1]
        speed = 0.9 * speed - rate * gradient
        weights += speed
    return weights


@dataclass
class Model:
    weights: np.ndarray
    table: np.ndarray  # chance of a bad and a good vote per class and labeller
    prior: float

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Share of right votes per labeller, on bad and on good texts."""
        return {name: (float(self.table[0, i, 0]), float(self.table[1, i, 1])) for i, name in enumerate(LABELLERS)}


def _read(text: str | None) -> tuple[Traits, np.ndarray]:
    text = text or ""
    classes = CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    return traits(text, classes), classes


def _patterns(batches) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        yield pa.RecordBatch.from_arrays([pa.array([votes(_read(t)[0]) for t in batch.column(0).to_pylist()], pa.int32())], ["code"])


def _examples(batches) -> Iterator[pa.RecordBatch]:
    seen = set()  # of the sample's hashes, so that copies are read once a task
    for batch in sliced(batches):
        names, codes, rows = [], [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if name in seen:
                continue
            seen.add(name)
            t, classes = _read(text.as_py())
            names.append(name)
            codes.append(votes(t))
            rows.append(features(t, classes).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(codes, pa.int32()), pa.array(rows, pa.binary())], ["name", "code", "x"]
        )


def draw(texts: DataFrame, sample: int) -> dict[int, float]:
    """Hash and weight of at most ``sample`` distinct texts, empty ones left out; the weights add up to about all rows.

    Texts come in by rising ``u / copies``, where ``u`` is a second hash between 0 and 1.  Each weighs its copies, or
    ``copies / u`` of the first text left out if that is more.  The driver is sent no more than about ``sample`` rows: counts
    of texts by size of their rank say first up to where they are needed.
    """
    name = F.xxhash64("text").alias("name")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "name"), 11) + 1) / float(1 << 53)
    groups = texts.filter("text <> ''").groupBy(name).agg(F.count("*").alias("copies")).withColumn("rank", u / F.col("copies"))
    groups = stored(groups.withColumn("size", F.floor(F.log2("rank") * 8).cast("int")), "texts")
    enough, upto = 0, None
    for upto, n in sorted(tuple(r) for r in groups.groupBy("size").count().collect()):
        enough += n
        if enough > sample:
            break
    found = [] if upto is None else groups.filter(F.col("size") <= upto).orderBy("rank", "name").limit(sample + 1).collect()
    release(groups)
    least = 1 / found[sample]["rank"] if len(found) > sample else 0.0
    return {r["name"]: max(float(r["copies"]), least) for r in found[:sample]}


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The model for ``docs``; votes of all rows count, at most ``sample`` distinct texts train the scorer."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    found = sorted(tuple(r) for r in texts.mapInArrow(_patterns, "code int").groupBy("code").count().collect())
    codes, counts = np.array([c for c, _ in found], np.int64), np.array([n for _, n in found], np.float64)
    good, table, prior = fit_labels(codes, counts)
    chances = dict(zip(codes.tolist(), good.tolist()))
    drawn = draw(texts, sample)
    names = docs.sparkSession.createDataFrame([(n,) for n in drawn], "name long")
    picked = texts.filter("text <> ''").select(F.xxhash64("text").alias("name"), "text").join(F.broadcast(names), "name", "left_semi")
    rows = picked.mapInArrow(_examples, "name long, code int, x binary").groupBy("name").agg(F.first("code").alias("code"), F.first("x").alias("x"))
    rows = sorted(rows.collect(), key=lambda r: r["name"])
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, FEATURES)
    weights = fit_scorer(x, np.array([chances[r["code"]] for r in rows]), copies=np.array([drawn[r["name"]] for r in rows]))
    return Model(weights, table, prior)


def _score(model: Model, text: str | None) -> tuple[int, float]:
    t, classes = _read(text)
    return votes(t), 1 / (1 + np.exp(-np.clip(features(t, classes) @ model.weights[:-1] + model.weights[-1], -700, 700)))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``label_chance`` (of the label model), ``score`` (of the scorer, 0 to 1) for every row of ``docs``.

    Null counts as empty.  An empty text gets no vote and no feature, so both numbers are what the model expects of any
    text.  Rows are scored one by one, so null ids and repeated rows are rows like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [_score(model, t) for t in batch.column(1).to_pylist()]
            chances = label_chances(np.array([c for c, _ in out], np.int64), model.table, model.prior)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chances), pa.array([float(s) for _, s in out], pa.float64())],
                ["doc_id", "label_chance", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, label_chance double, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns.  Texts without a word stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = [not (t or "").strip() or _score(model, t)[1] >= threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
