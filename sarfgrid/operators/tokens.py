"""Token tables: documents to ordered words, and work done once a distinct word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..functions import text as tx


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, surface."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tx.word_tokenize(F.col(text_col))).alias("pos", "surface"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line, pos, surface; lines count from 1, words from 1 in their line."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("k", "row"))
    return rows.select("doc_id", (F.col("k") + 1).alias("line"), F.posexplode(tx.word_tokenize(F.col("row"))).alias("p", "surface")).select("doc_id", "line", (F.col("p") + 1).alias("pos"), "surface")


def arabic_vocabulary(docs: DataFrame) -> DataFrame:
    """surface, n: distinct transliterated a-z words that begin with a letter. Rules run on these rows, not on every token."""
    w = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    # the count stands in the surface, so that no rule on it is pushed below the aggregate, to every token
    s = w.select(F.when(F.col("n") > 0, ar.transliterate(F.col("w"))).alias("surface"), "n")
    return s.where(F.col("surface").rlike("^" + ar.LETTER))


def split_clitic(surface, protected: list[str]):
    """struct(clitic, rest): one vocalised leading particle, unless the bare word is protected."""
    bare = ar.strip_diacritics(surface)
    clitic = F.regexp_extract(surface, f"^(و{ar.FATHA}|ب{ar.KASRA}|ل{ar.KASRA}|ك{ar.FATHA}).", 1)
    keep = bare.isin(*protected) if protected else F.lit(False)
    clitic = F.when(keep, "").otherwise(clitic)
    return F.struct(clitic.alias("clitic"), F.substr(surface, F.length(clitic) + 1).alias("rest"))
