"""URL filters: rules first, else host word segmentation with multinomial naive Bayes.

Host and path are cut out by string functions; of the rules that fit, the longest
decides. Urls without a rule are judged by naive Bayes over the words of host and
path: labels and path parts are split at signs, and letter runs are segmented by a
unigram Viterbi over word counts of the pages' own text. The rule-decided urls are the
training data. Counts cover all pages and all words; the driver, and every task by a
broadcast, holds the words that are part of a letter run of some url (no other can be
asked for) and the tokens of the rule-decided urls.

Defined results: a null url, or one without ``://``, has empty host and path, no rule,
and gets the classes' prior verdict; ties in naive Bayes allow; with no training rows
every url without a rule is allowed; repeated rows are judged each.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, written

#: rule -> verdict; a rule is host and path together.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
MAX_WORD = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = re.compile(r"[a-z]+")


def with_rules(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule and its verdict (null without a rule)."""
    cut = r"^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract("url", f"(?s){cut}", k), F.lit(""))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):  # a longer rule comes later and so wins
        host, _, path = r.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, rules[r]).otherwise(verdict)
    return df.withColumns({"rule": rule, "ruled": verdict})


def word_counts(texts: DataFrame, col: str, markup: bool = False) -> DataFrame:
    """word, n over all rows; words are runs of a-z of 2 to MAX_WORD letters."""
    t = F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"<[^>]*>", " ") if markup else F.col(col)
    words = texts.select(F.explode(F.split(F.lower(t), r"[^a-z]+")).alias("word"))
    return words.where(F.length("word").between(2, MAX_WORD)).groupBy("word").agg(F.count("*").alias("n"))


class Segmenter:
    """Unigram Viterbi; letters that no word covers cost more than any word."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """total: the count of all words, where counts leaves some out."""
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.letter = math.log(total) + 2
        self.split = lru_cache(100_000)(self._split)

    def __reduce__(self):
        return _segmenter, (self.cost, self.letter)

    def _split(self, run: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for j in range(1, len(run) + 1):
            c, k = best[j - 1] + self.letter, j - 1
            for i in range(max(0, j - MAX_WORD), j - 1):
                w = self.cost.get(run[i:j])
                if w is not None and best[i] + w < c:
                    c, k = best[i] + w, i
            best.append(c)
            back.append(k)
        out, j = [], len(run)
        while j:
            out.append(run[back[j] : j])
            j = back[j]
        return tuple(reversed(out))


def _segmenter(cost, letter):
    s = Segmenter({})
    s.cost, s.letter = cost, letter
    return s


def tokens(host: str, path: str, segmenter: Segmenter) -> list[str]:
    """Host tokens (h:) and path tokens (p:), letter runs segmented; numbers are one token."""
    out = []
    for kind, text in (("h", host), ("p", path.lower())):
        for part in re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7f]+", text):
            out += [f"{kind}:{w}" for w in (segmenter.split(part) if part.isascii() and part.isalpha() else ("0",) if part.isdigit() else (part,))]
    return out


def url_parts(pages: DataFrame) -> DataFrame:
    """part: the distinct strings of 2 to MAX_WORD letters within letter runs of hosts and paths."""

    def fn(c):
        runs = {r for h, p in zip(c["host"].to_pylist(), c["path"].to_pylist(), strict=True) for text in (h, p.lower()) for r in _RUN.findall(text)}
        return {"part": (list({r[i:j] for r in runs for i in range(len(r)) for j in range(i + 2, min(len(r), i + MAX_WORD) + 1)}), pa.string())}

    return arrow_map(with_rules(pages, {}).select("host", "path"), fn, "part string").distinct()


def train_words(pages: DataFrame) -> Segmenter:
    counts = written(word_counts(pages, "html", markup=True), "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = url_parts(pages)
    known = counts.join(parts, counts["word"] == parts["part"], "left_semi").collect()  # words that urls hold
    return Segmenter({r["word"]: r["n"] for r in known}, total)


def train_bayes(ruled: DataFrame, segmenter: Segmenter) -> dict:
    """Log odds (block against allow) of every token and of the classes."""
    sent = ruled.sparkSession.sparkContext.broadcast(segmenter)
    known = ruled.where("ruled IS NOT NULL").groupBy("host", "path", "ruled").agg(F.count("*").alias("n"))

    def fn(c):
        return {"ruled": c["ruled"], "n": c["n"], "tokens": ([tokens(h, p, sent.value) for h, p in zip(c["host"].to_pylist(), c["path"].to_pylist(), strict=True)], pa.list_(pa.string()))}

    bags = arrow_map(known, fn, "ruled string, n long, tokens array<string>")
    block = F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0))
    classes = known.agg(block.alias("b"), F.sum("n").alias("n")).first()
    if not classes["n"]:
        return {"prior": -1.0, "odds": {}}
    got = bags.select("ruled", "n", F.explode("tokens").alias("token")).groupBy("token").agg(block.alias("b"), F.sum("n").alias("n"))
    sums = got.agg(F.sum("b"), F.sum("n"), F.count("*")).first()
    nb, na, v = sums[0] or 0, (sums[1] or 0) - (sums[0] or 0), sums[2]
    odds = {r["token"]: math.log((r["b"] + 1) / (nb + v)) - math.log((r["n"] - r["b"] + 1) / (na + v)) for r in got.collect()}
    prior = math.log((classes["b"] + 1) / (classes["n"] - classes["b"] + 1))
    return {"prior": prior, "odds": odds}


def judge(ruled: DataFrame, segmenter: Segmenter, bayes: dict) -> DataFrame:
    """page_id, host, path, rule, verdict and the naive Bayes log odds."""
    sent = ruled.sparkSession.sparkContext.broadcast((segmenter, bayes["prior"], bayes["odds"]))

    def fn(c):
        seg, prior, odds = sent.value
        z = [prior + sum(odds.get(t, 0.0) for t in tokens(h, p, seg)) for h, p in zip(c["host"].to_pylist(), c["path"].to_pylist(), strict=True)]
        verdict = [r or ("block" if x > 0 else "allow") for r, x in zip(c["ruled"].to_pylist(), z, strict=True)]
        return {"page_id": c["page_id"], "host": c["host"], "path": c["path"], "rule": c["rule"], "verdict": (verdict, pa.string()), "log_odds": (z, pa.float64())}

    return arrow_map(ruled, fn, "page_id long, host string, path string, rule string, verdict string, log_odds double")


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    ruled, segmenter = with_rules(pages), train_words(pages)
    return judge(ruled, segmenter, train_bayes(ruled, segmenter))
