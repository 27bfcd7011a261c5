"""Toxicity by nearest labelled examples under exact cosine of weighted TF-IDF.

A bounded sample of labelled rows (so many of either class, in hash order) is indexed:
terms are lower-cased words and their first four letters, and all terms of the sample
span the vectors. A term's weight is its IDF times sqrt(1 + chi-square of term and label
over the sample): a term that goes with the label weighs more, and none is left out.
Postings are grouped in blocks of examples, and each (term, block) keeps its largest
weight, so a query's score in a block has an upper bound (the few commonest terms are a
dense table instead, and known exactly). Blocks are scored from the highest bound on
until no bound reaches the k-th best cosine: the neighbours are exact. Votes are weighted by
cosine, and a logistic map fitted on leave-one-out votes, weighted back to the
classes' true shares, makes them probabilities.

Defined results: null text counts as empty; a text without any term of the sample gets the
base rate of such texts; ties in cosine go to the lower example number; with no
training rows the score is the 0.0 of "never seen toxic"; repeated rows are scored
each. Evidence (the nearest examples' ids) comes with every score.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, crc_mod_py, spread, table, written

#: Labelled rows of either class that are indexed, at most.
SAMPLE_ROWS = 3000
#: The commonest terms whose weights are a dense table (for speed; results are the same with any number).
DENSE = 1024
NEIGHBOURS = 15
BLOCK = 64
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> dict[str, int]:
    """Term -> count: whole words, and words' first four letters."""
    counts: dict[str, int] = {}
    for w in _WORD.findall(text.lower()):
        counts[w] = counts.get(w, 0) + 1
    for w, n in list(counts.items()):
        if len(w) > 4:
            p = "^" + w[:4]
            counts[p] = counts.get(p, 0) + n
    return counts


class Index:
    """Block-max inverted index over the examples' unit vectors."""

    def __init__(self, terms: list[str], idf: list[float], ids: list[int], labels: list[int], vectors: list[dict[int, int]]):
        self.term, self.idf = {t: i for i, t in enumerate(terms)}, np.array(idf, float)
        rows = [self.unit(v) for v in vectors]
        # neighbours share their heaviest term that a block of examples has: near each other, so that bounds differ between blocks
        df = np.bincount(np.concatenate([t for t, _ in rows]), minlength=len(terms)) if rows else np.zeros(len(terms))
        heavy = [w * (df[t] >= BLOCK) for t, w in rows]
        order = sorted(range(len(ids)), key=lambda k: (int(rows[k][0][heavy[k].argmax()]) if len(heavy[k]) else -1, k))
        self.ids, self.labels = np.array([ids[k] for k in order], np.int64), np.array([labels[k] for k in order], float)
        rows = [rows[k] for k in order]
        self.blocks = -(-len(ids) // BLOCK)
        doc = np.repeat(np.arange(len(ids)), [len(t) for t, _ in rows])
        term = np.concatenate([t for t, _ in rows]) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in rows]) if rows else np.zeros(0)
        # the commonest terms' weights are a dense table, all others' are postings
        often = np.argsort(-df, kind="stable")[:DENSE]
        often = often[df[often] * 16 >= max(len(ids), 1)]
        self.place = np.full(len(terms), -1, np.int64)
        self.place[often] = np.arange(len(often))
        self.dense, rare = np.zeros((len(often), len(ids))), self.place[term] < 0
        self.dense[self.place[term[~rare]], doc[~rare]] = weight[~rare]
        doc, term, weight = doc[rare], term[rare], weight[rare]
        slot = term * max(self.blocks, 1) + doc // BLOCK
        by = np.argsort(slot, kind="stable")
        slot = slot[by]
        self.doc, self.weight = doc[by].astype(np.int32), weight[by]
        # only the (term, block) pairs that occur: their postings' start, largest weight and block, by term
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        self.start = np.concatenate([first, [len(slot)]]).astype(np.int64)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.block = (slot[first] % max(self.blocks, 1)).astype(np.int32)
        self.of_term = np.searchsorted(slot[first] // max(self.blocks, 1), np.arange(len(terms) + 1)).astype(np.int64)
        self.rows, self.blank, self.scale = rows, 0.0, (0.0, 1.0)

    def weighted(self, t: np.ndarray, n: np.ndarray):
        """The unit vector of terms, sorted, and their counts."""
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / np.sqrt((w * w).sum()) if len(t) else w

    def unit(self, counts: dict[int, int]):
        t = np.array(sorted(counts), np.int64)
        return self.weighted(t, np.array([counts[k] for k in t.tolist()], float))

    def vector(self, text: str):
        counts = terms_of(text)
        t = np.fromiter(map(self.term.get, counts, repeat(-1)), np.int64, len(counts))
        n = np.fromiter(counts.values(), float, len(counts))
        by = np.argsort(t, kind="stable")[np.count_nonzero(t < 0) :]
        return self.weighted(t[by], n[by])

    def common(self, vectors: list) -> np.ndarray:
        """By vector and example, the part of the cosine that the terms of the dense table make."""
        q = np.zeros((len(vectors), len(self.dense)))
        for k, (t, w) in enumerate(vectors):
            at = self.place[t]
            q[k, at[at >= 0]] = w[at >= 0]
        return q @ self.dense

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int = -1, common: np.ndarray | None = None):
        """The k nearest examples, exactly: blocks by falling bound until no bound reaches the k-th."""
        if not len(t) or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        part = self.common([(t, w)])[0] if common is None else common
        rare = self.place[t] < 0
        pairs, n = spread(self.of_term[t[rare]], self.of_term[t[rare] + 1])
        w, block = np.repeat(w[rare], n), self.block[pairs]
        bound = np.maximum.reduceat(part, np.arange(0, len(part), BLOCK)) + np.bincount(block, self.most[pairs] * w, self.blocks)
        order = np.argsort(-bound, kind="stable")
        docs, cos, done, step = np.zeros(0, np.int64), np.zeros(0), 0, 24
        while done < len(order):
            least = np.partition(cos, -k)[-k] if len(cos) >= k else 0.0
            todo = order[done : done + step]
            todo = todo[bound[todo] >= max(least - 1e-12, 1e-15)]
            if not len(todo):
                break
            wanted = np.zeros(self.blocks, bool)
            wanted[todo] = True
            mine = np.flatnonzero(wanted[block])
            at, n = spread(self.start[pairs[mine]], self.start[pairs[mine] + 1])
            got = part + np.bincount(self.doc[at], self.weight[at] * np.repeat(w[mine], n), len(self.ids))
            d = np.flatnonzero(np.repeat(wanted, BLOCK)[: len(got)] & (got > 0))
            d = d[d != without]
            docs, cos = np.concatenate([docs, d]), np.concatenate([cos, got[d]])
            done, step = done + step, step * 2
        if len(cos) > k:
            some = np.flatnonzero(cos >= np.partition(cos, -k)[-k] - 1e-11)
            docs, cos = docs[some], cos[some]
        by = np.lexsort((docs, -np.round(cos, 12)))[:k]
        return docs[by], cos[by]

    def all_nearest(self, vectors: list, leave_out: bool = False):
        """nearest() of every vector; leave_out: vector k is example k, which is no neighbour of itself."""
        for a in range(0, len(vectors), 256):
            some = vectors[a : a + 256]
            for k, ((t, w), c) in enumerate(zip(some, self.common(some), strict=True)):
                yield self.nearest(t, w, without=a + k if leave_out else -1, common=c)

    def vote(self, docs: np.ndarray, cos: np.ndarray) -> float:
        w = cos * cos
        return float((w @ self.labels[docs] + 0.005) / (w.sum() + 0.05)) if len(docs) else -1.0

    def calibrate(self, share: float) -> None:
        """share: the true share of label 1 among labelled rows."""
        if not len(self.ids) or self.labels.min() == self.labels.max():
            self.scale = None
            self.blank = float(self.labels.mean()) if len(self.ids) else 0.0
            return
        weigh = np.where(self.labels == 1, share / self.labels.mean(), (1 - share) / (1 - self.labels.mean()))
        votes = np.array([self.vote(*x) for x in self.all_nearest(self.rows, True)])
        none = votes < 0
        self.blank = float((weigh[none] @ self.labels[none] + share * 2) / (weigh[none].sum() + 2))
        x, y, weigh = np.log(votes[~none] / (1 - votes[~none])), self.labels[~none], weigh[~none]
        a, b = 0.0, 1.0
        for _ in range(50):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
            g = np.array([(weigh * (p - y)).sum(), (weigh * (p - y) * x).sum() + 0.01 * (b - 1)])
            h = weigh * p * (1 - p)
            m = np.array([[h.sum() + 1e-6, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 0.01]])
            da, db = np.linalg.solve(m, g)
            a, b = a - np.clip(da, -2, 2), b - np.clip(db, -1, 1)
        self.scale = (float(a), float(max(b, 0.05)))

    def score(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        out = []
        for docs, cos in self.all_nearest([self.vector(t) for t in texts]):
            v = self.vote(docs, cos)
            if v < 0 or self.scale is None:
                out.append((self.blank, []))
                continue
            z = self.scale[0] + self.scale[1] * np.log(v / (1 - v))
            out.append((float(1 / (1 + np.exp(-z))), self.ids[docs[:3]].tolist()))
        return out


def build_index(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Index:
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0))
    y = y.groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    share = y.agg(F.avg("y")).first()[0] or 0.0
    pick = lambda v: y.where(F.col("y") == v).orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    sample = pick(1).unionByName(pick(0))
    d = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"))
    rows = d.join(F.broadcast(sample), d["i"] == sample["key"]).select("i", "t", "y")  # twice sample_rows rows at most

    def found(c):
        got = [terms_of(t or "") for t in c["t"].to_pylist()]
        return {"i": c["i"], "y": c["y"], "terms": ([list(g) for g in got], pa.list_(pa.string())), "n": ([list(g.values()) for g in got], pa.list_(pa.int32()))}

    bags = written(arrow_map(rows, found, "i long, y int, terms array<string>, n array<int>"), "toxic-sample")
    total, pos = bags.agg(F.count("*"), F.sum("y")).first()
    if not total:
        index = Index([], [], [], [], [])
        index.calibrate(0.0)
        return index
    pos, neg = pos or 0, total - (pos or 0)
    df = bags.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("y").alias("a"))
    top = df.orderBy(F.desc("df"), "term").toArrow()  # the terms of twice sample_rows rows at most
    terms, n, a = top["term"].to_pylist(), top["df"].to_numpy().astype(float), top["a"].to_numpy().astype(float)
    chi = total * (a * (neg - (n - a)) - (n - a) * (pos - a)) ** 2 / (max(pos, 1) * max(neg, 1) * n * np.maximum(total - n, 1))
    idf = np.log(1 + total / n) * np.sqrt(1 + chi)
    number = {t: k for k, t in enumerate(terms)}
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def vectors(c):
        pairs = [[(sent.value[t], n) for t, n in zip(ts, ns, strict=True) if t in sent.value] for ts, ns in zip(c["terms"].to_pylist(), c["n"].to_pylist(), strict=True)]
        return {"i": c["i"], "y": c["y"], "t": ([[p[0] for p in x] for x in pairs], pa.list_(pa.int32())), "n": ([[p[1] for p in x] for x in pairs], pa.list_(pa.int32()))}

    got = arrow_map(bags, vectors, "i long, y int, t array<int>, n array<int>").toArrow().combine_chunks()
    ids, labels, t, n = (got[c].combine_chunks() for c in ("i", "y", "t", "n"))
    key = lambda k: (ids[k].as_py(), labels[k].as_py(), t[k].as_py(), n[k].as_py())
    order = sorted(range(len(ids)), key=key)
    index = Index(terms, idf, [ids[k].as_py() for k in order], [labels[k].as_py() for k in order], (dict(zip(t[k].as_py(), n[k].as_py(), strict=True)) for k in order))
    index.calibrate(share)
    index.rows = []
    return index


def score_toxicity(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by SAMPLE_ROWS

    def fn(c):
        got = sent.value.score([t or "" for t in c["t"].to_pylist()])
        held = [i is not None and crc_mod_py(i, 5) == 0 for i in c["i"].to_pylist()]
        return {
            "doc_id": c["i"], "held_out": (held, pa.bool_()), "score": ([g[0] for g in got], pa.float64()),
            "predicted": ([int(g[0] >= threshold) for g in got], pa.int32()), "evidence": ([g[1] for g in got], pa.list_(pa.int64())),
        }

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")), fn, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, build_index(docs, table(spark, sf_dir, "labels")))
