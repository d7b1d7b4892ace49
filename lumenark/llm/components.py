"""Connected components of an edge table by alternating stars; nothing but two counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import saved


def _starred(e: DataFrame, small: bool) -> DataFrame:
    """One star operation on edges (a > b)."""
    near = e if small else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lows = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    j = near.join(lows, "a")
    moved = j.where(F.col("b") != F.col("low")) if small else j.where(F.col("b") > F.col("a"))
    out = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if small:
        out = out.unionByName(lows.select("a", F.col("low").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node with an edge; label is the smallest node of its component. edges: a, b, of a type that can be ordered."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = saved(spark, e, "edges")
    mark = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        e = saved(spark, _starred(_starred(e, small=False), small=True), "edges")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
