"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelog.session import written


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) with v the least of u and its partners, for each u."""
    return pairs.groupBy("u").agg(F.min("v").alias("low"))


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the least node that links lead to.

    Each round brings every node nearer to the least one around it; the rounds grow with the logarithm
    of the longest chain. A node with very many links is summed up before the shuffle, and its rows
    split by adaptive joins. Rounds are cut by written tables, so a lost executor costs one round.
    """
    edges = written(_clean(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    state = None
    for _ in range(most_rounds):
        # Large star: partners above u go to the least around u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _star(both).select(F.col("u").alias("w"), F.least("low", "u").alias("low"))
        large = both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        # Small star: u and its lower partners go to the least of them.
        large = _clean(large)
        low = _star(large).select(F.col("u").alias("w"), "low")
        small = large.join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = written(_clean(small.unionByName(low.select(F.col("w").alias("u"), F.col("low").alias("v")))), "links")
        now = edges.agg(F.count(F.lit(1)), *(F.sum(F.col(c).cast("decimal(20,0)")) for c in ("v", "u")), F.countDistinct("v")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links have no stable components after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _clean(pairs: DataFrame) -> DataFrame:
    """Each pair once, the larger node first, no loops."""
    return pairs.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
