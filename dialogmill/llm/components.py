"""Connected components of a link table, by alternating star operations; no group is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import discard, settled


def _large_star(links: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the smallest node among it and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Hangs a node and its smaller neighbours on the smallest of them."""
    down = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in a link that isn't its own; null ends don't link.

    Every round is a written table, so that a lost executor costs one round at most.
    """
    stars = settled(_small_star(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")), "links")
    state = None
    for _ in range(max_rounds):
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state, before = now, stars
        stars = settled(_small_star(_large_star(before)), "links")
        discard(before)
    raise RuntimeError(f"no end after {max_rounds} rounds")
