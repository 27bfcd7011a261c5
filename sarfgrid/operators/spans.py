"""Span maps: half-open intervals of a raw text against those of its normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arabic as ar


def normalization_spans(words: DataFrame, surface: str = "surface") -> DataFrame:
    """One row a letter: surface, k, raw_start, raw_end, norm_start, norm_end, op (IDENTITY, REPLACE, EXPAND), for hamza and shadda."""
    cells = F.regexp_extract_all(F.col(surface), F.lit(f"(?s){ar.LETTER}{ar.MARK}*|."), 0)
    norm = F.transform(cells, lambda x: ar.normalize_shadda(ar.normalize_hamza(x)))
    ends = lambda a: F.transform(a, lambda x, i: F.aggregate(F.slice(a, 1, i + 1), F.lit(0), lambda s, y: s + F.length(y)))
    w = words.select(surface, cells.alias("cells"), norm.alias("norm")).select(surface, "cells", "norm", ends(F.col("cells")).alias("re"), ends(F.col("norm")).alias("ne"))
    rows = w.select(surface, F.posexplode(F.arrays_zip("cells", "norm", "re", "ne")).alias("k", "x")).select(surface, "k", "x.*")
    op = F.when(F.col("cells") == F.col("norm"), "IDENTITY").when(F.length("cells") == F.length("norm"), "REPLACE").otherwise("EXPAND")
    return rows.select(surface, "k", (F.col("re") - F.length("cells")).alias("raw_start"), F.col("re").alias("raw_end"), (F.col("ne") - F.length("norm")).alias("norm_start"), F.col("ne").alias("norm_end"), op.alias("op"))


def project(spans: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Raw intervals (key, start, end) to normal ones: the hull of all entries they overlap, by key."""
    s = spans.withColumnRenamed(key, "s_key")
    j = queries.join(s, (queries[key] == s["s_key"]) & (F.col("raw_start") < F.col("end")) & (F.col("start") < F.col("raw_end")))
    return j.groupBy(key, "start", "end").agg(F.min("norm_start").alias("norm_start"), F.max("norm_end").alias("norm_end"))
