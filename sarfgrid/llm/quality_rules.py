"""Quality rules of documents and of their hosts, in DataFrame functions only.

Per document: words, characters, symbols, repeated lines and words in repeated 5-word
windows, all computed inside the row (no explode, no shuffle of text). Per host: the
failures of the base rule are summed, the rate is shrunk towards an empirical beta
prior (method of moments over all hosts), and hosts whose shrunk rate is above
``max_rate`` are rejected with all their documents.

Defined results: null or empty text has no words and fails the base rule; a null host
brings no verdict (the base rule alone decides); repeated rows are judged each; extra
columns are not looked at. The prior is two numbers, the only thing the driver reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, table, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is rejected beyond this shrunk failure rate.
MAX_RATE = 0.5
#: Bounds of the prior's weight in documents.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0


def let(value: Column, body) -> Column:
    """body(value), with value computed once even when body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur at least twice in the array."""

    def of_hashes(h):
        starts = F.sequence(F.lit(0), F.size(h) - F.lit(WINDOW))
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])), of_windows)

    def of_windows(g):
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))), of_sorted)
        )

    def of_sorted(s):
        again = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["g"] == x["g"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["g"] == x["g"])))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def covered(p):
        steps = F.transform(p, lambda x, j: F.when(j == F.size(p) - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(p, j + 1) - x)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def document_stats(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", carry: tuple[str, ...] = ()) -> DataFrame:
    t = F.coalesce(F.col("t"), F.lit(""))
    words = F.array_remove(F.split(t, WORD_BREAK), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w):
        return F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words"))

    carried = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("string")
    df = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("t"), docs[host_col].alias("host"), carried.alias("carried"))
    return df.select(
        "doc_id",
        "host",
        "carried",
        let(words, of_words).alias("w"),
        F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    ).select(
        "doc_id", "host", "carried", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words",
        ((F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("w.n_words"))).alias("base_failed"),
    )


def host_verdicts(stats: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """host, n, failed, rate (shrunk) and host_kept."""
    hosts = stats.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    m = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("q")).first()
    mean = (m["f"] / m["n"]) if m["n"] else 0.0
    spread = max((m["q"] or 0.0) / m["n"] - mean * mean, 0.0) if m["n"] else 0.0
    weight = min(max(mean * (1 - mean) / spread - 1, LEAST_WEIGHT), MOST_WEIGHT) if spread > 0 else MOST_WEIGHT
    rate = (F.col("failed") + mean * weight) / (F.col("n") + weight)
    return hosts.withColumn("rate", rate).withColumn("host_kept", rate <= max_rate)


def quality_rules(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", max_rate: float = MAX_RATE, carry: tuple[str, ...] = ()) -> DataFrame:
    """The stats of every document, base_failed and kept; and its columns named in carry, as the struct carried."""
    stats = written(document_stats(docs, id_col, text_col, host_col, carry), "quality-rules")
    hosts = host_verdicts(stats, max_rate).select(F.col("host").alias("h"), "host_kept")
    out = stats.join(hosts, stats["host"] == hosts["h"], "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"), *(["carried"] if carry else []))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2, w3, w4) AS k FROM g WHERE w4 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + o.k) AS n FROM c CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) AS o WHERE c.k > 1 GROUP BY doc_id),
s AS (SELECT doc_id, host, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS failed FROM b WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT sum(failed) / sum(n) AS mean, greatest(sum(failed * failed / n) / sum(n) - (sum(failed) / sum(n)) ** 2, 0) AS spread FROM h),
p AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 2.0), 1000.0) ELSE 1000.0 END AS weight FROM m),
v AS (SELECT host, (failed + mean * weight) / (n + weight) <= 0.5 AS host_kept FROM h CROSS JOIN p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_kept, true) AS kept
FROM b LEFT JOIN v USING (host)
"""
