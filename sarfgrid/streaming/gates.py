"""The word gate over a stream of documents: the same columns as in batch, counted by event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..functions import syllable
from ..functions import text as tx


def gate_counts(stream: DataFrame, time_col: str, text_col: str, window: str = "10 minutes", lateness: str = "20 minutes") -> DataFrame:
    """start, verdict, n: late rows count until the watermark passes; state is one counter a window and verdict."""
    words = stream.withWatermark(time_col, lateness).select(F.col(time_col).alias("t"), F.explode(tx.word_tokenize(F.col(text_col))).alias("w"))
    verdict = syllable.word_gate(syllable.slots(syllable.classes(ar.normalize(F.col("w")))))
    return words.select("t", verdict.alias("verdict")).groupBy(F.window("t", window).alias("win"), "verdict").agg(F.count("*").alias("n")).select(F.col("win.start").alias("start"), "verdict", "n")
