"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014. Every
round is two aggregations with map-side combining and two joins whose one side
is unique by key, so a hub of many links is split by adaptive execution instead
of meeting in one task. Each round is written to the shared folder, and the one
before it removed; only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators.storage import forgotten, stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges``: the least node it is linked with.

    Self-links, repeated links and nulls on either side are ignored. Nodes may
    be of any ordered type. Raises if ``most_rounds`` rounds don't settle it
    (rounds grow with the logarithm of the longest chain).
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))  # both skip nulls
    e = stored(e.where("a <> b").distinct(), "links")
    before = _mark(e)
    for _ in range(most_rounds if before[0] else 0):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        old, e = e, stored(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        now = _mark(e)
        forgotten(old)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"{most_rounds} rounds did not settle the components")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
