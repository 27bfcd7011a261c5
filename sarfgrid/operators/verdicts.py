"""Verdict algebra: three-valued gates, where a later stage never upgrades an earlier one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITY = {"ACCEPT": 0, "DEFER": 1, "BLOCK": 2}


def worst(*verdicts: Column) -> Column:
    """BLOCK over DEFER over ACCEPT; null defers."""
    rank = F.greatest(*[F.when(v == "BLOCK", 2).when(v == "ACCEPT", 0).otherwise(1) for v in verdicts]) if len(verdicts) > 1 else F.when(verdicts[0] == "BLOCK", 2).when(verdicts[0] == "ACCEPT", 0).otherwise(1)
    return F.when(rank == 2, "BLOCK").when(rank == 0, "ACCEPT").otherwise("DEFER")


def compose(upstream: Column, gate: Column) -> Column:
    """What an upstream verdict and a gate's verdict make together: LICENSED, DEFERRED, BLOCKED or RESIDUAL."""
    up, tq = F.upper(F.trim(F.coalesce(upstream, F.lit("DEFERRED")))), F.upper(F.trim(F.coalesce(gate, F.lit("DEFERRED"))))
    up, tq = F.when(up == "", "DEFERRED").otherwise(up), F.when(tq == "", "DEFERRED").otherwise(tq)
    blocked = tq.isin("BLOCKED", "BLOCK", "REJECTED", "FORBIDDEN_LEAP")
    return (
        F.when(up.isin("BLOCKED", "BLOCK") | blocked, "BLOCKED")
        .when(up.isin("DEFERRED", "DEFER"), "DEFERRED")
        .when(up == "RESIDUAL", "RESIDUAL")
        .when(up.isin("ACCEPTED", "LICENSED", "ACCEPT", "COMPLETE") & tq.isin("LICENSED", "RESIDUAL"), tq)
        .otherwise("DEFERRED")
    )


def stage_status(blocker: Column, defect: Column, unmet: Column, rank: Column) -> Column:
    """Status of a stage: blocker none/WARNING/BLOCKER, defect none/MINOR/INVALIDATING, a condition unmet, rank 0 to 4."""
    return F.when((blocker == "BLOCKER") | (defect == "INVALIDATING"), "BATIL").when((defect == "MINOR") | (blocker == "WARNING"), "FASID").when(unmet | (rank < 4), "DEFERRED").otherwise("SAHIH")
