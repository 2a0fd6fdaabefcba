"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import checkpointed


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of the component.

    Each round only takes minima per node, so a hub's neighbours are never gathered in one place.
    Rows with a null end and loops say nothing and are left out. An empty table gives an empty one.
    """
    stars = checkpointed(_down(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")))
    said = _digest(stars)
    for _ in range(most_rounds):
        both = stars.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(stars.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        lowest = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(lowest, "u")
        hung = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        stars = checkpointed(_down(hung))
        now = _digest(stars)
        if now == said:
            break
        said = now
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    roots = stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, its smaller end as a."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
