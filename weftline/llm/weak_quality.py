"""Quality classifier from weak labels.

Seven heuristic labellers vote good, bad or nothing on each document. A two-class label model (Dawid and Skene's)
estimates by expectation-maximisation how accurate each is, from the counts of vote patterns over all documents; no
gold label is used. Posterior labels of a seeded sample of about `SAMPLE` documents (a documented bound on training
rows, not on what is scored) train a linear scorer over hashed words and word shapes, which scores every document.

The driver gets a row for each vote pattern, at most 3 ** 7, and the hashed counts of the sample's documents.

Edge cases: a null or empty text, or one of white space only, has no words, scores 0 and is rejected; very long texts
are scored whole; a labeller with equal claims to both votes says bad, and a score of the threshold itself is kept;
repeated rows score alike; an empty table gives no rows; other columns stay as they are, but `scored` puts its own in the
place of one named quality_score, which `accepted` doesn't.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

#: The feature of a word that equals the one before it.
AGAIN = b"word again"
SAMPLE, DIMENSIONS, SEED, THRESHOLD = 2000, 1 << 14, 11, 0.5
LABELLERS = ("case", "symbols", "separators", "repetition", "lines", "stopwords", "plain")
GOOD, NOTHING, BAD = 1, 0, -1
#: Common function words of the four languages of the corpus.
STOPWORDS = frozenset(b"the of and to in a is that for on with as by this be are from or an it was de la le les et des en un une du que qui dans pour par sur el los las y der die und das den von zu mit ist ein eine nicht auf".split())
#: A word as prose has it: letters of one word with a mark after it at most.
_PLAIN = re.compile(rb"[(\"']?[A-Z\x80-\xff]?[a-z\x80-\xff'-]*[.,;:?!)\"']?")
_SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"9"))


def votes(text: bytes) -> tuple[int, ...]:
    """A vote of each labeller on a whole text, in the order of LABELLERS."""
    words = text.split()
    if not words:
        return (BAD,) * len(LABELLERS)
    n = len(words)
    letters = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(letters[65:91].sum()), int(letters[97:123].sum())
    marks = int(letters[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 126]].sum())
    bars = words.count(b"|")
    lines = [x for x in text.split(b"\n") if x.strip()]
    fresh = words[:1] + [b for a, b in zip(words, words[1:], strict=False) if a != b]
    again = 1 - len(fresh) / n
    common_words = sum(map(STOPWORDS.__contains__, fresh)) / n

    def vote(good: bool, bad: bool) -> int:
        return BAD if bad else GOOD if good else NOTHING

    plain = sum(1 for w in fresh if _PLAIN.fullmatch(w)) / n
    return (
        vote(False, upper > 0.5 * (upper + lower) and upper + lower > 20),
        vote(False, marks > 0.3 * n),
        vote(False, bars > 0.1 * n),
        vote(False, n >= 20 and again > 0.15),
        vote(False, len(lines) > 3 and len(set(lines)) < 0.5 * len(lines)),
        vote(common_words > 0.08, n >= 30 and common_words < 0.02),
        vote(plain > 0.85, plain < 0.6),
    )


class LabelModel:
    """Two classes; for each labeller the chance of each vote in each class."""

    def __init__(self, patterns: list[tuple[int, ...]], counts: list[int], rounds: int = 100, tolerance: float = 1e-9):
        grid, weight = np.array(patterns), np.array(counts, float)
        hot = np.stack([grid == v for v in (BAD, NOTHING, GOOD)], axis=2).astype(float)
        good = 1 / (1 + np.exp(-grid.sum(axis=1, dtype=float)))
        for _ in range(rounds):
            self.prior = np.array([(weight * (1 - good)).sum(), (weight * good).sum()]) + 1
            self.prior /= self.prior.sum()
            self.chance = np.stack([np.einsum("p,plv->lv", weight * w, hot) + np.array([2.0, 1, 1] if k == 0 else [1.0, 1, 2]) for k, w in enumerate((1 - good, good))])
            self.chance /= self.chance.sum(axis=2, keepdims=True)
            before, good = good, self.posterior(grid)
            if np.abs(good - before).max() < tolerance:
                break

    def posterior(self, grid: np.ndarray) -> np.ndarray:
        """Chance of good for each row of votes."""
        grid = np.atleast_2d(grid)
        log = np.log(self.prior)[:, None] + sum(np.log(self.chance[:, k, :])[:, grid[:, k] + 1] for k in range(grid.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def _slots(word: bytes, dimensions: int) -> tuple[int, int]:
    shape = word
    for pattern, mark in _SHAPES:
        shape = pattern.sub(mark, shape)
    return zlib.crc32(word) % dimensions, zlib.crc32(b"shape " + shape) % dimensions


def hashed(text: bytes, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and shares of a text's words, word shapes and words equal to the one before."""
    words = text.split()
    slots = np.array([s for w in words for s in _slots(w, dimensions)] + [zlib.crc32(AGAIN) % dimensions] * sum(map(bytes.__eq__, words, words[1:])), np.int64)
    found, counts = np.unique(slots, return_counts=True)
    return found, counts / max(len(words), 1)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], dimensions: int = DIMENSIONS, epochs: int = 30, rate: float = 2.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad; the last weight is the bias."""
    weights, squares = np.zeros(dimensions + 1), np.full(dimensions + 1, 1e-2)
    order = np.random.default_rng(SEED)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            slots, shares, label = rows[k]
            error = 1 / (1 + math.exp(-max(-50.0, min(50.0, float(weights[slots] @ shares) + weights[-1])))) - label
            step = np.append(error * shares, error * 0.1) + decay * np.append(weights[slots], 0.0)
            at = np.append(slots, dimensions)
            squares[at] += step * step
            weights[at] -= rate * 0.1 * step / np.sqrt(squares[at])
    return weights


class Scorer(dict):
    """A word's weight, worked out once; the table is emptied when it is full."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.bias, self.again = weights, float(weights[-1]), float(weights[zlib.crc32(AGAIN) % (len(weights) - 1)])

    def __missing__(self, word: bytes) -> float:
        if len(self) >= 150_000:
            self.clear()
        a, b = _slots(word, len(self.weights) - 1)
        self[word] = value = float(self.weights[a] + self.weights[b])
        return value

    def score(self, text: bytes) -> float:
        words = text.split()
        if not words:
            return 0.0
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, (math.fsum(map(self.__getitem__, words)) + self.again * sum(map(bytes.__eq__, words, words[1:]))) / len(words) + self.bias))))


def _voted(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def pattern(texts: pd.Series) -> pd.Series:
        return pd.Series(["".join("-0+"[v + 1] for v in votes(x or b"")) for x in texts])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("pattern", pattern("text"))


def label_model(docs: DataFrame) -> tuple[LabelModel, int] | None:
    """The model of the vote patterns of all documents, and the number of documents; None for an empty table."""
    found = sorted((r["pattern"], r["count"]) for r in _voted(docs).groupBy("pattern").count().collect())
    if not found:
        return None
    return LabelModel([tuple("-0+".index(c) - 1 for c in p) for p, _ in found], [n for _, n in found]), sum(n for _, n in found)


def fit_scorer(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights of the scorer."""
    model = label_model(docs)
    if model is None:
        return None
    model, n = model

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            pairs = [hashed(x) for x in texts]
            labels = [float(model.posterior(np.array([votes(x)]))[0]) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in pairs], pa.list_(pa.int64())), pa.array([b for _, b in pairs], pa.list_(pa.float64())), pa.array(labels)], names=["doc_id", "slots", "shares", "label"])

    luck = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40))
    chosen = docs.where(luck < int((1 << 40) * min(1.0, sample / n))).select("doc_id", F.col("text").cast("binary").alias("text"))
    got = chosen.mapInArrow(rows, "doc_id long, slots array<long>, shares array<double>, label double").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["label"], r["slots"]))
    return train([(np.array(r["slots"], np.int64), np.array(r["shares"]), r["label"]) for r in got])


def scored(docs: DataFrame, sample: int = SAMPLE, name: str = "quality_score") -> DataFrame:
    """All columns of the documents and the score, which takes the place of a column of that name."""
    weights = fit_scorer(docs, sample)
    if weights is None:
        return docs.withColumn(name, F.lit(0.0))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(weights)
        for texts in batches:
            yield pd.Series([scorer.score(x or b"") for x in texts], dtype="float64")
        del scorer
        common.give_back()

    return docs.withColumn(name, score(F.col("text").cast("binary")))


def accepted(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with their own columns only."""
    name = common.fresh("score")[0]
    return scored(docs, sample, name).where(F.col(name) >= threshold).drop(name)


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, score and kept for every document."""
    score = F.col("quality_score")
    return scored(docs.select("doc_id", "text")).select("doc_id", F.round(score, 6).alias("score"), (score >= THRESHOLD).alias("kept"))
