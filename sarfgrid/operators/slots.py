"""Typed slots, claims and stage traces as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def slot(slot_id: str, sort: str, value: Column, candidates: Column | None = None) -> Column:
    """struct(slot_id, sort, state, value, candidates): several candidates leave the slot AMBIGUOUS and keep them, none and no value UNKNOWN."""
    cand = candidates if candidates is not None else F.array().cast("array<string>")
    state = F.when(F.size(cand) > 1, "AMBIGUOUS").when(value.isNull() & (F.size(cand) == 0), "UNKNOWN").otherwise("KNOWN")
    held = F.when(F.size(cand) > 1, None).otherwise(F.coalesce(value.cast("string"), F.get(cand, F.lit(0))))
    return F.struct(F.lit(slot_id).alias("slot_id"), F.lit(sort).alias("sort"), state.alias("state"), held.alias("value"), cand.alias("candidates"))


def claim_digest(kind: str, slots: Column, length: int = 16) -> Column:
    """A content id of a claim: sha-256 over its slots in order of their ids."""
    parts = F.transform(F.array_sort(slots, lambda a, b: F.when(a["slot_id"] < b["slot_id"], -1).when(a["slot_id"] > b["slot_id"], 1).otherwise(0)), lambda s: F.concat_ws("=", s["slot_id"], F.coalesce(s["value"], F.lit("?"))))
    return F.substring(F.sha2(F.concat(F.lit(kind + "|"), F.array_join(parts, "|")), 256), 1, length)


def ordered_distinct_union(*lists: Column) -> Column:
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def stop_at_first(trace: DataFrame, key: str, order: str, status: str, stop: str = "BATIL") -> DataFrame:
    """The stages of each key up to its first stop, that one included."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.max((F.col(status) == stop).cast("int")).over(w)
    return trace.withColumn("_stopped", F.coalesce(stopped, F.lit(0))).where("_stopped = 0").drop("_stopped")


def trace_summary(trace: DataFrame, key: str) -> DataFrame:
    """licensed (rank 4 and more), highest_rank and last_stage by key; columns stage, rank."""
    return trace.groupBy(key).agg(F.sum((F.col("rank") >= 4).cast("long")).alias("licensed"), F.max("rank").alias("highest_rank"), F.max("stage").alias("last_stage"))
