"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a bounded sample of labelled rows go to the driver, which grows
complete trees level by level on binned features; their split features, thresholds
and leaves are flat arrays, and a batch of documents walks all trees by numpy
indexing. Every document is scored in one Arrow pass, without a shuffle.

Defined results: null text counts as empty, empty texts get the score of their
statistics (all zero); rows without a usable label don't train; with no training rows
the score is 0.5, with a single class near that class; a document labelled twice
trains as good only if all its labels say so; repeated rows are scored each.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, crc_mod_py, table

#: Labelled rows that train, at most; taken in the order of a hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 60, 4, 48, 0.2, 1.0, 8

_CLASSES = ["", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", "#*$%&<>", ".,;:?'\"-()", "!", "|"]
_LUT = np.zeros(256, np.uint8)
for _k, _cs in enumerate(_CLASSES):
    _LUT[[ord(c) for c in _cs]] = _k
_LUT[128:] = len(_CLASSES)
N_CLASSES = len(_CLASSES) + 1


def statistics(text: str) -> list[float]:
    """The features of one text; every one is 0 for an empty text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(raw)
    share = np.bincount(_LUT[raw], minlength=N_CLASSES) / max(n, 1)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    nw, nl = len(words), len(lines)
    twins = sum(map(operator.eq, words, words[1:]))
    return [math.log1p(n), *share.tolist(), len(text) / max(nw, 1), len(set(words)) / max(nw, 1), twins / max(nw, 1), 1 - len(set(lines)) / nl if nl else 0.0, math.log1p(nw / max(nl, 1))]


class BoostedTrees:
    """Logistic boosting; trees as flat arrays of 2**DEPTH - 1 splits and 2**DEPTH leaves."""

    def __init__(self, base: float):
        self.base, self.feature, self.cut, self.leaf = base, np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if not len(y):
            return cls(0.0)
        p = (y.sum() + 0.5) / (len(y) + 1)
        model = cls(float(np.log(p / (1 - p))))
        if y.min() == y.max():
            return model
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(cuts, x.T, strict=True)], 1)
        z, found = np.full(len(y), model.base), []
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-z))
            feature, at, leaf, where = model._tree(binned, cuts, q - y, q * (1 - q))
            z += leaf[where]
            found.append((feature, [cuts[f][b] if b < len(cuts[f]) else np.inf for f, b in zip(feature, at, strict=True)], leaf))
        model.feature, model.cut, model.leaf = (np.array(a) for a in zip(*found, strict=True))
        return model

    @staticmethod
    def _tree(binned, cuts, grad, hess):
        n, width = binned.shape
        feature, at = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS + 1)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            k = 2**level
            best = np.full(k, 1e-9)
            for f in range(width):
                key = node * (BINS + 1) + binned[:, f]
                g, h, c = (np.cumsum(np.bincount(key, w, k * (BINS + 1)).reshape(k, -1), 1) for w in (grad, hess, None))
                right_g, right_h, right_c = (a[:, -1:] - a for a in (g, h, c))
                gain = g**2 / (h + RIDGE) + right_g**2 / (right_h + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                gain[(c < LEAST) | (right_c < LEAST)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(k), b]
                better = top > best
                best[better] = top[better]
                feature[k - 1 : 2 * k - 1][better] = f
                at[k - 1 : 2 * k - 1][better] = b[better]
            spot = k - 1 + node
            node = 2 * node + (binned[np.arange(n), feature[spot]] > at[spot])
        g, h = (np.bincount(node, w, 2**DEPTH) for w in (grad, hess))
        return feature, at, -RATE * g / (h + RIDGE), node

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if len(self.leaf):
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
            node = np.zeros((len(x), len(self.leaf)), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
            z += self.leaf[trees, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-z))


def labelled_sample(labels: DataFrame, label_col: str, folds: int, held: int, rows: int) -> DataFrame:
    """(key, y) of at most ``rows`` training rows: known label, id's remainder not ``held``."""
    y = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held))
    y = y.groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    return y.orderBy(F.xxhash64("key"), "key").limit(rows)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> BoostedTrees:
    sample = labelled_sample(labels, "quality", 4, 2, sample_rows)
    d = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"))
    pairs = d.join(F.broadcast(sample), d["i"] == sample["key"]).select("i", "t", "y")  # bounded by sample_rows

    def fn(c):
        return {"i": c["i"], "y": c["y"], "x": ([statistics(t or "") for t in c["t"].to_pylist()], pa.list_(pa.float64()))}

    got = sorted((r["i"], r["y"], r["x"]) for r in arrow_map(pairs, fn, "i long, y int, x array<double>").collect())
    return BoostedTrees.fit(np.array([r[2] for r in got]), np.array([r[1] for r in got], float))


def score_quality(docs: DataFrame, model: BoostedTrees, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def fn(c):
        s = sent.value.score(np.array([statistics(t or "") for t in c["t"].to_pylist()]))
        held = [i is not None and crc_mod_py(i, 4) == 2 for i in c["i"].to_pylist()]
        return {"doc_id": c["i"], "held_out": (held, pa.bool_()), "score": (s, pa.float64()), "predicted": ((s >= threshold).astype(np.int32), pa.int32())}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")), fn, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
