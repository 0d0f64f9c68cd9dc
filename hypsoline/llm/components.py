"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has an edge, with the smallest node it can reach.

    Every round moves neighbours to the smallest node nearby, first those larger than a node, then those smaller;
    the edges end as stars, after O(log^2 n) rounds. Each round is written to the shared folder. Minima are combined
    before the shuffle; the joins have one row a key on one side, so that Spark can split a hot key. Null ends and
    loops are left out; repeated edges count once.
    """
    ab = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    ab, before = cut(ab), None
    while True:
        now = ab.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return ab.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                ab.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
        both = ab.unionByName(ab.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pull = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        ab = cut(pull.where("u <> v").distinct())
