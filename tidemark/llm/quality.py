"""Quality from weak labels.

Heuristic labellers vote good (1), junk (-1) or nothing (0) on a text's figures.
Expectation-maximisation over the counts of all vote patterns of the whole corpus
(at most 3^8, whatever the corpus has) estimates each labeller's accuracy on good
and on junk texts and the share of good ones.  The posterior probabilities label
a bounded sample of documents (SAMPLE rows, those whose id hash is under a bound),
on which a linear scorer over hashed features is trained: byte trigrams and the
figures' ranges.  The scorer then judges every document.

Null texts are empty.  An empty or blank text has no figures to speak of: all
labellers abstain and its score is the scorer's for no features but the ranges.
Rows alike in text have equal scores, one for each row; ties at KEEP stay.  A text
of any length is judged whole; its figures need a few times its size.  Without
documents the result is empty.  Of the columns only the id and the text are read;
score() and keep_good() give all back, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_key, text_of
from .minhash import runs

SAMPLE = 3000
GRAMS = 4096
RANGES = 16
ROUNDS = 60
KEEP = 0.5
FALSE_JUNK = 0.002
#: Labellers: a figure, and from where on a text is junk by it, up to where good (or the other way round).
LABELLERS = [
    ("symbols", 0.035, 0.012),
    ("capitals", 0.30, 0.12),
    ("shouts", 0.08, 0.02),
    ("pipes", 0.10, 0.02),
    ("stutter", 0.12, 0.03),
    ("sameness", 0.72, 0.55),
    ("endless", 0.985, 0.965),
    ("lines", 0.45, 0.25),
]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "*#$%&@^~|<>{}[]\\=+_`"]] = True


def figures(text: bytes) -> list[float]:
    """One figure for each labeller, in 0 to 1, larger for worse texts; of a text without words, zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(LABELLERS)
    data = np.frombuffer(text, np.uint8)
    letters = np.count_nonzero(((data | 32) >= 97) & ((data | 32) <= 122))
    capitals = np.count_nonzero((data >= 65) & (data <= 90))
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    stutter = sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)
    distinct = len(set(words))
    expected = n if n < 50 else 50 * (n / 50) ** 0.75
    return [
        np.count_nonzero(SYMBOLS[data]) / len(data),
        capitals / max(1, letters),
        text.count(b"!!") / n,
        words.count(b"|") / n,
        stutter,
        max(0.0, 1 - distinct / expected) if n >= 20 else 0.0,
        1 - (text.count(b".") + text.count(b"?") + text.count(b"!")) / n if n >= 20 else 0.0,
        1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0,
    ]


def votes(row: list[float]) -> list[int]:
    if not any(row):
        return [0] * len(row)
    return [-1 if x >= junk else 1 if x <= good else 0 for x, (_, junk, good) in zip(row, LABELLERS, strict=True)]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """The posterior of good for each pattern, accuracies (labeller x [on good, on junk]), the share of good.

    Given the class, votes are taken to be independent; each labeller has a probability
    of voting junk, nothing and good on either class, so one that knows a single kind of
    junk is not outvoted by those that know other kinds.  An accuracy is the share of
    right votes among the votes of that class.  It starts from: any junk vote tells.  On
    good texts a labeller is held to at most FALSE_JUNK junk votes; otherwise the two
    classes that explain the votes best might be two kinds of junk.
    """
    cast = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)  # pattern x labeller x vote
    prior = np.array([[0.02, 0.5, 2.0], [1.0, 1.0, 1.0]])  # on good: a junk vote is rare
    posterior = 1 / (1 + np.exp(-(2.0 - 4.0 * (patterns == -1).sum(1))))
    share = 0.5
    for _ in range(rounds):
        tell = np.stack([(counts * posterior) @ cast.reshape(len(cast), -1), (counts * (1 - posterior)) @ cast.reshape(len(cast), -1)])
        tell = tell.reshape(2, -1, 3) + prior[:, None, :]
        tell /= tell.sum(2, keepdims=True)
        tell[0, :, 0] = np.minimum(tell[0, :, 0], FALSE_JUNK)
        share = min(0.999, max(0.001, float((counts * posterior).sum() / counts.sum())))
        odds = np.log(share / (1 - share)) + (cast * (np.log(tell[0]) - np.log(tell[1]))).sum((1, 2))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    accuracy = np.stack([tell[0, :, 2] / (tell[0, :, 2] + tell[0, :, 0]), tell[1, :, 0] / (tell[1, :, 0] + tell[1, :, 2])], 1)
    return posterior, accuracy, share


def features(text: bytes, row: list[float]) -> np.ndarray:
    """GRAMS hashed trigrams (square roots of counts, of length 1), then for each figure its range and whether it is junk."""
    out = np.zeros(GRAMS + len(LABELLERS) * RANGES, np.float32)
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(data) >= 3:
        code = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)
        grams = np.sqrt(np.bincount(code >> np.uint32(20), minlength=GRAMS))
        out[:GRAMS] = grams / np.sqrt((grams**2).sum())
    for k, (x, (_, junk, good)) in enumerate(zip(row, LABELLERS, strict=True)):
        low, high = sorted((junk, good))
        place = int(np.clip(4 + 8 * (x - low) / (high - low), 0, RANGES - 1))
        out[GRAMS + k * RANGES + place] = 1
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Weights and, last, the intercept of a logistic scorer, by full-batch Adam on soft labels (fixed rounds, no randomness)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ (p - y).astype(np.float32) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w.astype(np.float32)


def _voted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """pattern (string of votes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(["".join("-0+"[v + 1] for v in votes(figures(t or b""))) for t in texts], pa.string())], ["pattern"])

    return docs.select(text_col).mapInArrow(lean(run), "pattern string")


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, dict]:
    """The scorer's weights, and what was estimated of the labellers."""
    counted = {r.pattern: r["count"] for r in _voted(docs, id_col, text_col).groupBy("pattern").count().collect()}  # at most 3^8 rows
    if not counted:
        return np.zeros(GRAMS + len(LABELLERS) * RANGES + 1, np.float32), {"share": 1.0, "accuracy": {}}
    patterns = np.array([["-0+".index(c) - 1 for c in p] for p in sorted(counted)])
    posterior, accuracy, share = expectation_maximisation(patterns, np.array([counted[p] for p in sorted(counted)]))
    soft = dict(zip(sorted(counted), posterior.tolist(), strict=True))
    total = sum(counted.values())
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), text_key(text_col)), F.lit(1 << 40))
    bound = (1 << 40) if total <= sample else int((1 << 40) * sample / total)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]
            rows = [figures(t) for t in texts]
            x = [features(t, r) for t, r in zip(texts, rows, strict=True)]
            y = [soft["".join("-0+"[v + 1] for v in votes(r))] for r in rows]
            at = [np.flatnonzero(v) for v in x]
            yield pa.RecordBatch.from_arrays([pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([v[a].tobytes() for v, a in zip(x, at, strict=True)], pa.binary()), pa.array(y, pa.float64())], ["at", "x", "y"])

    # Rows alike in id and text fall in or out together, so they count once; twice the sample is the most that is taken.
    chosen = docs.where(place < bound).select(place.alias("_place"), text_of(text_col).alias("_text")).dropDuplicates(["_place"]).orderBy("_place").limit(2 * sample)
    rows = chosen.select("_text").mapInArrow(lean(vectors), "at binary, x binary, y double")
    held = sorted((bytes(r.at), bytes(r.x), r.y) for r in rows.collect())  # sorted, so that their order tells nothing
    x = np.zeros((len(held), GRAMS + len(LABELLERS) * RANGES), np.float32)
    for i, (at, values, _) in enumerate(held):
        x[i, np.frombuffer(at, "<i4")] = np.frombuffer(values, np.float32)
    names = [n for n, *_ in LABELLERS]
    return train(x, np.array([y for *_, y in held])), {"share": share, "accuracy": dict(zip(names, accuracy.tolist(), strict=True))}


def score(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """docs' columns and, last, score_col (double): the probability that the text is good.  No column of docs may have that name."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for low, high in runs(batch.column(at), 8 << 20):
                part = batch.slice(low, high - low)
                texts = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                odds = [float(features(t, figures(t)) @ w[:-1] + w[-1]) for t in texts]
                scores = pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, score_col])

    from pyspark.sql import types as T

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """docs without those scored under keep; columns as they were."""
    weights, _ = fit(docs, id_col=id_col, text_col=text_col)
    name = f"score_{uuid.uuid4().hex}"  # no column of docs has such a name
    return score(docs, weights, text_col=text_col, score_col=name).where(F.col(name) >= keep).drop(name)
