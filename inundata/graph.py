"""Connected components of an edge table, wholly in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.storage import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", limit: int = 200) -> DataFrame:
    """(node, component): every node of an edge with the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), so
    the number of rounds grows with the logarithm of the longest path. Minima
    are pre-aggregated before each shuffle and saved: the joins in which hubs
    meet their edges then have shuffles of their own, which adaptive execution
    splits. Nulls and self-loops link
    nothing; an empty table gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v")
    cur, last = scratch.save(pairs.distinct(), "edges"), None
    for _ in range(limit if cur.take(1) else 0):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, "large")
        scratch.drop(low)
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        nxt = scratch.save(small.where("u <> v").distinct(), "small")
        n, total, lows = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum((F.col("v")).cast("decimal(38,0)"))).first()
        scratch.drop(cur)
        scratch.drop(large)
        scratch.drop(low)
        cur = nxt
        if (n, total, lows) == last:
            break
        last = (n, total, lows)
    else:
        if last is not None:
            raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
