"""Cutting lineage in the folder that all executors share, and components of links."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of checkpoints that all executors share: the session's spark.checkpoint.dir; only a local master may be without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder that all executors share."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def components(pairs: DataFrame, one: str, many: str) -> DataFrame:
    """(many, part): a name of the component of pairs (one, many) that each `many` is in.

    Rounds hang every node's larger neighbours on its smallest one, then all of its neighbours on the smallest of
    them, until the stars stay as they are: about as many rounds as the logarithm of the largest diameter. Minima
    only are taken for each node, so that a hub's neighbours never meet in one place.
    """
    named = pairs.select(F.concat(F.lit("1:"), F.col(one).cast("string")).alias("x"), F.concat(F.lit("2:"), F.col(many).cast("string")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    stars, before = checkpointed(_ordered(named, "x", "y")), None
    while (now := _said(stars)) != before:
        before = now
        ends = stars.select("x", "y").unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = ends.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        larger = _ordered(ends.where("y > x").join(least, "x"), "y", "m")
        lowest = larger.groupBy("y").agg(F.min("x").alias("m"))
        hung = larger.join(lowest, "y")
        stars = checkpointed(_ordered(hung.select("x", "m").unionByName(hung.select(F.col("y").alias("x"), "m")), "x", "m"))
    named = stars.groupBy("y").agg(F.min("x").alias("part")).unionByName(stars.select(F.col("x").alias("y"), F.col("x").alias("part")).distinct())
    return named.where("startswith(y, '2:')").select(F.substring("y", 3, 1 << 30).cast(pairs.schema[many].dataType).alias(many), "part")


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges (x, y), x the smaller end, without repeats and loops."""
    return edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x < y").distinct()


def _said(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first())
