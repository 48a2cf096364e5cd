"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import discard, written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): for each id of an edge, the smallest id reachable from it.

    Alternating large-star and small-star steps; each is a map-side minimum per node and a join, so a hub's
    edges are never gathered. A pass that changes nothing ends the loop; the number of passes grows with the
    logarithm of the longest path.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    first = edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct()
    seen = Observation()
    now = written(first.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    sums = seen.get
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least(F.col("u"), F.col("m")).alias("m"))
        large = now.join(hub, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        seen, before = Observation(), now
        now = written(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
        discard(before)
        if seen.get == sums or not seen.get["n"]:
            break
        sums = seen.get
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
