"""Connected classes of links, by rounds of joins on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginspark.workspace import Workspace


def _least(pairs: DataFrame, by: str, other: str) -> DataFrame:
    """``pairs`` with ``low``, the least of each ``by`` and all its others."""
    low = pairs.groupBy(by).agg(F.min(other).alias("low"))
    return pairs.join(low, by).withColumn("low", F.least("low", by))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its greater neighbours to its least neighbour."""
    both = links.select("a", "b").union(links.select("b", "a").toDF("a", "b"))
    return _least(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    met = _least(down, "a", "b")
    moved = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
    return moved.where("a <> b")


def connected(links: DataFrame, ws: Workspace) -> DataFrame:
    """``(node, root)`` for every end of ``links(a, b)`` that is not its class's
    least, which is the root.  Large and small stars alternate until the links
    are stars; every round keeps at most one row per former link, a node's least
    neighbour is a partial aggregate, and rounds grow with the logarithm of the
    longest chain."""
    stars, mark = links.where("a <> b"), None
    while True:
        stars = ws.save(_small_star(_large_star(stars)).distinct(), "stars")
        now = stars.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
        if now == mark:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
