"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken in Arrow batches. Trees are fitted on a bounded sample of
labelled documents (``labelled.SAMPLE_ROWS``): features are cut into quantile bins, every level of a
tree is grown from histograms of gradients, and each tree is complete, so a forest is three arrays
(feature, threshold, leaf value) that numpy walks for all rows and trees at once.

Null and empty texts have all statistics 0 and get a score like any other. Without labels every score
is 0.5. Repeated rows score alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import islice, pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import fold, texts_of, unpacked, with_found
from turnwise.llm.labelled import SAMPLE_ROWS, sample_documents

CUT = 0.3
FOLDS, HELD_OUT = 5, 0
TREES, DEPTH, BINS, RATE, RIDGE = 80, 4, 64, 0.15, 1.0
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)

FEATURES = (
    "words", "word_length", "distinct_words", "distinct_pairs", "equal_neighbours", "most_common_word", "capitals",
    "digits", "stops", "symbols", "shouts", "bars", "lines", "repeated_lines", "other_bytes",
)


def statistics(text: bytes) -> list[float]:
    """The features of one text, shares where possible."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = sum(map(len, words))
    return [
        float(np.log1p(n)), chars / n, len(set(words)) / n, (len(set(pairwise(words))) + 1) / n,
        sum(map(eq, words, islice(words, 1, None))) / n, max(Counter(words).values()) / n,
        float(seen[65:91].sum()) / chars, float(seen[48:58].sum()) / chars, float(seen[46] + seen[44]) / n,
        float(seen[SYMBOLS].sum()) / n, float(seen[33]) / n, float(seen[124]) / n, len(lines) / n,
        1 - len(set(lines)) / len(lines), float(seen[128:].sum()) / chars,
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees as arrays: inner nodes by tree and position, then leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of every row."""
        total = np.full(len(x), self.start)
        if self.feature.size:
            trees = np.arange(len(self.feature))
            rows = np.arange(len(x))[:, None]
            at = np.zeros((len(x), len(trees)), np.int64)
            for _ in range(int(np.log2(self.value.shape[1]))):
                at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
            total += self.value[trees, at - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_forest(
    x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE
) -> Forest:
    """Boosted trees for the logistic loss. One class or no rows: the prior alone, as a forest without trees."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    prior = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    start = float(np.log(prior / (1 - prior))) if len(y) else 0.0
    empty = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves))
    if len(set(y.tolist())) < 2:
        return Forest(*empty, start)
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    feature, threshold, value = [], [], []
    total = np.full(n, start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        tree_f, tree_t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width = 1 << level
            base = width - 1
            local = at - base
            best = np.full(width, 1e-6)
            choice = np.zeros(width, np.int64)
            cut = np.full(width, bins, np.int64)
            for f in range(k):
                cell = local * bins + binned[:, f]
                gs = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (ga - gs) ** 2 / (ha - hs + RIDGE) - ga**2 / (ha + RIDGE)
                gain[:, len(edges[f]):] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best
                best = np.where(better, gain[np.arange(width), top], best)
                choice, cut = np.where(better, f, choice), np.where(better, top, cut)
            for node in range(width):
                tree_f[base + node] = choice[node]
                if cut[node] < bins:
                    tree_t[base + node] = edges[choice[node]][cut[node]]
            right = binned[np.arange(n), choice[local]] > cut[local]
            at = 2 * at + 1 + right
        leaf = at - inner
        out = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        total += out[leaf]
        feature.append(tree_f)
        threshold.append(tree_t)
        value.append(out)
    return Forest(np.array(feature), np.array(threshold), np.array(value), start)


def with_statistics(docs: DataFrame) -> DataFrame:
    def make():
        def work(rows: pa.StructArray) -> pa.Array:
            return pa.array([statistics(t) for t in texts_of(rows)], pa.list_(pa.float64()))

        return work

    return with_found(docs, make, "array<double>")


def train(docs: DataFrame, labels: DataFrame, training: Column, rows: int = SAMPLE_ROWS) -> Forest:
    """A forest from the labelled documents where ``training`` holds; at most ``rows`` of them reach the driver."""
    sample = with_statistics(sample_documents(docs, labels, "quality", training, rows))
    got = sample.select(F.col("row.doc_id").alias("i"), F.col("row.quality").alias("y"), F.col("found").alias("x"))
    got = got.groupBy("i", "y").agg(F.min("x").alias("x")).orderBy("i").collect()  # repeated rows count once
    x = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))
    return fit_forest(x, np.array([r["y"] for r in got], float))


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """``row`` and the score as ``found``."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def make():
        model = sent.value

        def work(rows: pa.StructArray) -> pa.Array:
            x = np.array([statistics(t) for t in texts_of(rows)], float).reshape(-1, len(FEATURES))
            return pa.array(model.score(x))

        return work

    return with_found(docs, make, "double")


def training_rows() -> Column:
    return fold("doc_id", FOLDS) != HELD_OUT


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    forest = train(docs, labels, training_rows())
    out = scored(docs.select("doc_id", "text"), forest)
    return out.select(
        F.col("row.doc_id").alias("doc_id"), (fold("row.doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.col("found").alias("score"), (F.col("found") >= CUT).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns."""
    return unpacked(scored(docs, train(docs, labels, training_rows())).where(F.col("found") >= CUT))
