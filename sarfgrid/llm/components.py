"""Connected components of an edge table, by contraction in Spark.

Each round every vertex hooks to its least neighbour, two pointer jumps follow, edges
are renamed and loops and repeats dropped; the vertices left at least halve. Rounds
are written to the shared folder, so lost executors cost one round at most; a round's files
go when the next one's stand. Nothing but a row count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, scratch, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a long, b long); root is the component's least vertex."""
    before = set(scratch())
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "cc-edges")
    members = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "cc-parents")
        up = p.select(F.col("a").alias("x"), F.col("p").alias("y"))
        p = p.join(up, p["p"] == up["x"]).select("a", F.col("y").alias("p"))
        up = p.select(F.col("a").alias("x"), F.col("p").alias("y"))
        p = written(p.join(up, p["p"] == up["x"]).select("a", F.col("y").alias("p")), "cc-jumps")
        if members is None:
            members = written(p.select(F.col("a").alias("v"), F.col("p").alias("root")), "cc-members")
        else:
            q = p.select(F.col("a").alias("x"), "p")
            members = written(members.join(q, members["root"] == q["x"], "left").select("v", F.coalesce("p", "root").alias("root")), "cc-members")
        pa, pb = p.select(F.col("a").alias("x"), F.col("p").alias("pa")), p.select(F.col("a").alias("x"), F.col("p").alias("pb"))
        e = e.join(pa, e["a"] == pa["x"]).drop("x")
        e = e.join(pb, e["b"] == pb["x"]).where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
        e = written(e.distinct(), "cc-edges")
        mine = [x for x in scratch() if x not in before]
        old = [x for x in mine if "/cc-members" in x][:-1] + [x for x in mine if "/cc-edges" in x][:-1]
        release(e.sparkSession, [*old, *(x for x in mine if "/cc-parents" in x or "/cc-jumps" in x)])
    if members is None:
        return e.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return members
