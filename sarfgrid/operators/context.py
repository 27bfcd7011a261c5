"""Ordered context of a token as window functions over its document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def govern_mood(tokens: DataFrame, jussive: list[str], subjunctive: list[str], negation: list[str], preceders: list[str]) -> DataFrame:
    """mood that the word before governs; a negation behind certain words governs nothing. Needs doc_id, pos, surface."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    s1, s2 = F.lag("surface", 1).over(w), F.lag("surface", 2).over(w)
    free = s1.isin(*negation) & F.coalesce(s2.isin(*preceders), F.lit(False))
    return tokens.withColumn("mood", F.when(free, None).when(s1.isin(*jussive), "JUSSIVE").when(s1.isin(*subjunctive), "SUBJUNCTIVE"))


def carry_speaker(turns: DataFrame) -> DataFrame:
    """For every turn the last other-role text length before it, and turns since. Needs conv_id, turn, role, text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    user_turn = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return turns.select("conv_id", "turn", "role", F.lag(F.length("text"), 1).over(w).cast("long").alias("prev_len"), (F.col("turn") - user_turn).alias("since_user"))


def resolve_subject(tokens: DataFrame) -> DataFrame:
    """Ambiguous verbs resolved by a feminine subject at most three words on, unless a clause begins before it; a joined verb takes over what the verb before it was given.

    Needs doc_id, pos, elig (ambiguous verb), fem (feminine subject), bnd (clause begins), joined (verb with a conjunction), other (a person that rules the subject out).
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    nxt = lambda c, k: F.coalesce(F.lead(c, k).over(w), F.lit(False))
    ahead = nxt("fem", 1) | (~nxt("bnd", 1) & (nxt("fem", 2) | (~nxt("bnd", 2) & nxt("fem", 3))))
    t = tokens.withColumn("_a", F.col("elig") & ahead)
    t = t.withColumn("_ev", F.when(F.col("_a"), True).when(~F.col("elig") & F.col("bnd") & F.col("other"), False))
    carried = F.last("_ev", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn("resolved", F.col("_a") | (F.col("elig") & F.col("joined") & F.coalesce(carried, F.lit(False)))).drop("_a", "_ev")
