"""Evaluation: gold comparison, contract probes, snapshot diffs, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gold_mismatches(results: DataFrame, gold: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, compared, mismatches; a null gold field is not compared."""
    g = gold.select(F.col(key).alias("g_key"), *[F.col(f).alias("g_" + f) for f in fields])
    j = results.join(g, results[key] == g["g_key"])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("got"), F.col("g_" + f).cast("string").alias("want")) for f in fields])).alias("c")
    rows = j.select(cells).select("c.*").where("want IS NOT NULL")
    return rows.groupBy("field").agg(F.count("*").alias("compared"), F.sum((~F.col("got").eqNullSafe(F.col("want"))).cast("long")).alias("mismatches"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (ADDED, REMOVED, CHANGED) and the changed fields, joined by commas."""
    a = old.select(F.col(key).alias("ka"), *[F.col(f).alias("a_" + f) for f in fields])
    b = new.select(F.col(key).alias("kb"), *[F.col(f).alias("b_" + f) for f in fields])
    changed = F.concat_ws(",", *[F.when(~F.col("a_" + f).eqNullSafe(F.col("b_" + f)), F.lit(f)) for f in fields])
    j = a.join(b, a["ka"] == b["kb"], "full")
    kind = F.when(F.col("ka").isNull(), "ADDED").when(F.col("kb").isNull(), "REMOVED").when(changed != "", "CHANGED")
    return j.select(F.coalesce("ka", "kb").alias(key), kind.alias("change"), F.when(kind == "CHANGED", changed).otherwise("").alias("fields")).where("change IS NOT NULL")


def violations(rows: DataFrame, checks: dict) -> DataFrame:
    """check, n: rows that break each named condition (true is good; null breaks), in one pass."""
    sums = rows.agg(*[F.sum((~F.coalesce(c, F.lit(False))).cast("long")).alias(n) for n, c in checks.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(n, F.lit(0)).alias("n")) for n in checks])).alias("x")).select("x.*")


def probe(fields: dict, contracts: list[tuple[str, str, str | None]]):
    """All contracts of a row hold. contracts: field, op (eq, not_eq, is_none, not_none, contains, starts_with), value."""
    def one(f, op, v):
        c = fields[f]
        return {"eq": c == v, "not_eq": c != v, "is_none": c.isNull(), "not_none": c.isNotNull(), "contains": F.contains(c, F.lit(v)), "starts_with": F.startswith(c, F.lit(v))}[op]

    return reduce(lambda a, b: a & b, [F.coalesce(one(*x), F.lit(False)) for x in contracts])


def consensus(forms: DataFrame, key: str, fields: list[str], least: int = 2) -> DataFrame:
    """key, each field where all its forms agree, verdict: ACCEPT with every field agreed by at least ``least`` forms, DEFER otherwise."""
    agreed = [F.when(F.count_distinct(f) == 1, F.min(f)).alias(f) for f in fields]
    g = forms.groupBy(key).agg(F.count("*").alias("forms"), *agreed)
    ok = F.col("forms") >= least
    for f in fields:
        ok = ok & F.col(f).isNotNull()
    return g.withColumn("verdict", F.when(ok, "ACCEPT").otherwise("DEFER"))


def table_digest(rows: DataFrame, fields: list[str]) -> DataFrame:
    """n and an order-free digest of a table: the sum of its rows' hashes, so no task sees all rows and repeated rows count."""
    row = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("?")) for f in fields])
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))


def integrity(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """check, n: repeated keys and missing fields, as n minus distinct and null counts."""
    sums = rows.agg((F.count(key) - F.count_distinct(key)).alias("repeated_key"), *[F.sum(F.col(c).isNull().cast("long")).alias("missing_" + c) for c in required])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in sums.columns])).alias("x")).select("x.*")


def registry_faults(owners: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """key, fault: DUPLICATE where a key has several owners, DANGLING where a use has none."""
    twice = owners.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("DUPLICATE").alias("fault"))
    o = owners.select(F.col(key).alias("o_key"))
    dangling = uses.select(key).distinct().join(o, F.col(key) == F.col("o_key"), "left_anti").select(key, F.lit("DANGLING").alias("fault"))
    return twice.unionByName(dangling)


def agreement_of_runs(runs: DataFrame, key: str, run: str, fields: list[str]) -> DataFrame:
    """n, stable, missing: keys whose fields are the same in all runs, and keys that some run lacks."""
    total = runs.agg(F.count_distinct(run).alias("runs"))
    g = runs.groupBy(key).agg(F.count_distinct(run).alias("seen"), F.count_distinct(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("?")).alias(f) for f in fields])).alias("kinds"))
    j = g.join(F.broadcast(total))  # one row
    return j.agg(F.count("*").alias("n"), F.sum(((F.col("kinds") == 1) & (F.col("seen") == F.col("runs"))).cast("long")).alias("stable"), F.sum((F.col("seen") < F.col("runs")).cast("long")).alias("missing"))
