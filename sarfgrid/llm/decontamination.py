"""Benchmark decontamination by pigeonhole edit matching.

A test item of n normal characters may differ by e = n * ERROR_PERCENT / 100 edits. Cut
into e + 1 pieces, at least one piece is in any such match unchanged: an Aho-Corasick
automaton over all pieces finds the places, and Myers' bit-parallel edit distance
decides on the text around them. Texts are compared as lower-cased words with single
blanks between them, so case, punctuation and white space don't hide a match.

Items go to the tasks in blocks of BLOCK_CHARS characters, whatever their number; the
documents are read once a block and never shuffled unless there are several blocks.

Defined results: a null or wordless text matches nothing, and neither does a null or
wordless item; items too short for an edit must occur exactly; equal items are reported
under each of their ids; repeated documents are reported each; a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, tidy

ERROR_PERCENT = 5
#: Characters of the items that one automaton holds.
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def best_match(item: str, text: str, most: int) -> tuple[int, int] | None:
    """Myers: least edit distance of item to a substring of text, and the first such end; None beyond most."""
    m = len(item)
    at: dict[str, int] = {}
    for k, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (~(xh | plus) & full), plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | (~(xv | ph) & full), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], percent: int = ERROR_PERCENT):
        import ahocorasick

        by: dict[str, list[int]] = defaultdict(list)
        for i, t in items:
            if normal(t):
                by[normal(t)].append(i)
        self.items = [(t, len(t) * percent // 100, sorted(ids, key=lambda i: (i is None, i))) for t, ids in by.items()]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (t, e, _) in enumerate(self.items):
            cuts = [len(t) * j // (e + 1) for j in range(e + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[t[a:b]].append((k, a))
        self.automaton = ahocorasick.Automaton()
        for p, places in pieces.items():
            self.automaton.add_word(p, (len(p), places))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[list[int], int, int]]:
        """(item ids, distance, end in the normal text) of every item found."""
        t = normal(text)
        if not t or not self.items:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(t):
            for k, off in places:
                starts[k].add(end + 1 - size - off)
        out = []
        for k, places in starts.items():
            item, e, ids = self.items[k]
            best, reach = None, -1
            spans: list[list[int]] = []
            for s in sorted(places):  # windows that overlap are searched once
                a, b = max(0, s - e), s + len(item) + e
                if a <= reach:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
                reach = spans[-1][1]
            for a, b in spans:
                found = best_match(item, t[a:b], e)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], a + found[1])
                    if not best[0]:
                        break
            if best:
                out.append((ids, *best))
        return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = ERROR_PERCENT, id_col="doc_id", text_col="text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The contaminated documents: doc_id, contaminated (true), n_items, item_ids, distance (least)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("t IS NOT NULL")
    chars = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    found = None
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).collect()  # near block_chars characters
        sent = spark.sparkContext.broadcast(([tuple(r) for r in mine], percent))
        got = docs.mapInArrow(_searcher(sent), "doc_id long, text_sha256 string, item_ids array<long>, distance int").withColumn("block", F.lit(k))
        found = got if found is None else found.unionByName(got)
    if blocks > 1:  # rows of one id and text match alike: merged over the blocks, and given back as often as they came
        row = ["doc_id", "text_sha256"]
        found = found.groupBy(*row, "block").agg(F.count("*").alias("n"), F.first("item_ids").alias("item_ids"), F.first("distance").alias("distance"))
        found = found.groupBy(*row).agg(F.max("n").alias("n"), F.flatten(F.collect_list("item_ids")).alias("item_ids"), F.min("distance").alias("distance"))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return found.select("doc_id", F.lit(True).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), F.sort_array("item_ids").alias("item_ids"), "distance")


def _searcher(sent):
    def run(batches):
        matcher = Matcher(*sent.value)
        for b in batches:
            ids, hashes, items, distance = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = matcher.matches(t)
                if got:
                    ids.append(i)
                    hashes.append(hashlib.sha256(t.encode()).hexdigest())
                    items.append([x for g in got for x in g[0]])
                    distance.append(min(g[1] for g in got))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string()), pa.array(items, pa.list_(pa.int64())), pa.array(distance, pa.int32())], names=["doc_id", "text_sha256", "item_ids", "distance"])
        tidy()

    return run


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
