"""Language ID by cross-parsing entropy.

Per language a suffix automaton of a bounded sample of labelled text; a text is parsed
greedily into the longest phrases that occur in that sample, and the language whose
normalised phrase count (phrases times log2 of the sample's length, per letter) is
least wins. Every letter of a sample has its own code, transition tables hold only
their language's letters (dense ones for alphabets, sorted ones for larger scripts), and all segments of an Arrow batch move through all languages'
tables together, one character per numpy step. Letters that no sample holds share a code.

Texts are lower-cased; characters that are no letters end up as single blanks. A text
is parsed whole, in segments of SEGMENT characters that phrases don't cross.

Defined results: ``und`` with score 0.0 for null or letterless text, and for any text
when no labelled text exists; ties go to the language that sorts first; repeated rows
are predicted each.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, crc_mod, crc_mod_py, table

#: Labelled rows per language that may enter the sample; characters of all samples together, and of one.
SAMPLE_ROWS, TOTAL_CHARS, LANGUAGE_CHARS = 48, 200_000, 40_000
#: Lengths of texts that are taken for the sample first.
GOOD_CHARS = (300, 4000)
SEGMENT = 512
#: Columns of a dense table at most; an alphabet beyond has sorted transitions, so memory does not grow with it.
DENSE_WIDTH = 128
_GAP = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings, by state."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in codes:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


def dense(step: list[dict[int, int]], width: int) -> np.ndarray:
    """Transitions as a table of width columns; -1 where there is none."""
    table = np.full((len(step), width), -1, np.int32)
    for s, to in enumerate(step):
        for c, t in to.items():
            table[s, c] = t * width
    return table.ravel()


def sparse(step: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Transitions as sorted keys (state * width + code) and their targets."""
    got = sorted((s * width + c, t) for s, to in enumerate(step) for c, t in to.items())
    return np.array([k for k, _ in got], np.int64), np.array([t for _, t in got], np.int32), width


class CrossParser:
    """Counts phrases of texts under every language's sample."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = sorted({c for s in samples.values() for c in s} - {" "})
        self.code = {" ": 0} | {c: k + 1 for k, c in enumerate(letters)}  # beyond: letters of no sample
        self.lut = np.full(max(map(ord, self.code)) + 2, len(self.code), np.int32)
        self.lut[[ord(c) for c in self.code]] = list(self.code.values())
        # by language, a code's column in its table: the blank's and its own letters', and an empty one for all others
        self.column, self.wide, tables = np.zeros((len(self.langs), len(self.code) + 1), np.int32), {}, []
        for j, x in enumerate(self.langs):
            mine = np.unique(np.append(self.codes(samples[x]), 0))
            self.column[j] = len(mine)
            self.column[j, mine] = np.arange(len(mine))
            step, width = suffix_automaton(self.column[j, self.codes(samples[x])].tolist()), len(mine) + 1
            if width > DENSE_WIDTH:
                self.wide[j] = sparse(step, width)
            tables.append(dense(step, width) if j not in self.wide else np.zeros(0, np.int32))
        self.narrow = [j for j in range(len(self.langs)) if j not in self.wide]
        self.base = np.cumsum([0, *map(len, tables)])[:-1].astype(np.int32)[:, None]
        self.base[list(self.wide)] = 0
        self.next = np.concatenate([np.where(t < 0, t, t + b) for t, b in zip(tables, self.base[:, 0], strict=True)]) if tables else np.zeros(0, np.int32)
        self.bits = np.array([math.log2(max(len(samples[x]), 2)) for x in self.langs])

    def codes(self, text: str) -> np.ndarray:
        a = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        return self.lut[np.minimum(a, len(self.lut) - 1)]

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after one letter each, by language; -1 where there is none."""
        if not self.wide:
            return self.next[state + c]
        state = np.broadcast_to(state, c.shape)
        out = np.empty(c.shape, np.int32)
        out[self.narrow] = self.next[state[self.narrow] + c[self.narrow]]
        for j, (keys, targets, width) in self.wide.items():
            k = state[j].astype(np.int64) * width + c[j]
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            out[j] = np.where(keys[at] == k, targets[at], -1)
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases by text and language."""
        parts, owner = [], []
        for k, t in enumerate(texts):
            c = self.codes(t)
            for s in range(0, len(c), SEGMENT):
                parts.append(c[s : s + SEGMENT])
                owner.append(k)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not parts:
            return out
        order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
        size = np.array([len(parts[k]) for k in order])
        grid = np.zeros((SEGMENT, len(order)), np.int32)
        for col, k in enumerate(order):
            grid[: len(parts[k]), col] = parts[k]
        n_lang = len(self.langs)
        state = np.repeat(self.base, len(order), 1)
        count = np.ones((n_lang, len(order)), np.int64)
        for j in range(int(size[0])):
            n = int(np.searchsorted(-size, -j, "left"))  # segments longer than j
            c = self.column[:, grid[j, :n]]
            to = self.step(state[:, :n], c)
            miss = to < 0
            if miss.any():
                fresh = self.step(self.base, c)
                count[:, :n] += miss if j else 0
                unknown = fresh < 0
                fresh = np.where(unknown, self.base, fresh)
                count[:, :n] += miss & unknown
                to = np.where(miss, fresh, to)
            state[:, :n] = to
        np.add.at(out, np.array(owner)[order], count.T)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        texts = [plain(t or "") for t in texts]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        texts = [t if any(map(str.isalpha, t)) else "" for t in texts]
        length = np.array([len(t) for t in texts])
        rate = self.phrases(texts) * self.bits / np.maximum(length, 1)[:, None]
        best = rate.argmin(1)
        away = (rate - rate.min(1, keepdims=True)) * np.minimum(length, 100)[:, None] * math.log(2)
        sure = 1 / np.exp(-np.minimum(away, 700)).sum(1)
        return [(self.langs[b], float(s)) if n else ("und", 0.0) for b, s, n in zip(best, sure, length, strict=True)]


def train(docs: DataFrame) -> CrossParser:
    d = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"), F.col("lang").alias("lang"))
    d = d.where(F.col("t").isNotNull() & F.col("lang").isNotNull() & F.col("i").isNotNull() & (crc_mod("i", 5) != 0))
    good = F.char_length("t").between(*GOOD_CHARS)
    w = Window.partitionBy("lang").orderBy("late", F.xxhash64("i"), "i")
    pick = d.select("i", "lang", (~good).cast("int").alias("late")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= SAMPLE_ROWS).select(F.col("i").alias("key"), "k", "late")
    rows = d.join(F.broadcast(pick), d["i"] == pick["key"]).select("lang", "k", "t").collect()  # SAMPLE_ROWS a language
    by: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        by.setdefault(r["lang"], []).append(plain(r["t"]))
    most = min(LANGUAGE_CHARS, TOTAL_CHARS // max(len(by), 1))
    return CrossParser({x: " ".join(ts)[:most] for x, ts in by.items() if any(ts)})


def identify(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by TOTAL_CHARS

    def fn(c):
        got = sent.value.predict(c["t"].to_pylist())
        held = [i is not None and crc_mod_py(i, 5) == 0 for i in c["i"].to_pylist()]
        return {"doc_id": c["i"], "held_out": (held, pa.bool_()), "lang_pred": ([g[0] for g in got], pa.string()), "score": ([g[1] for g in got], pa.float64())}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")), fn, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
