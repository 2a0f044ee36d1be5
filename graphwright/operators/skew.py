"""Joins of an uneven large side to a side that is unique per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the sampled rows; so at most 1/HOT_SHARE keys can be hot.
HOT_SHARE = 0.002
#: Rows (expected) looked at to find hot keys.  Only the plan depends on them, never the result.
HOT_SAMPLE = 200_000
#: Up to so many rows even a key that holds them all is no burden for one task, and no search is made.
SMALL = 2_000_000


def hot_keys(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Heavy keys of ``df`` (at most 1/HOT_SHARE of them), found on a sample; used to lay out work, not to choose rows."""
    part = df if rows <= HOT_SAMPLE else df.sample(HOT_SAMPLE / rows, seed=7)
    least = max(100, int(min(rows, HOT_SAMPLE) * HOT_SHARE))
    return part.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(*keys)


def join_to_unique(big: DataFrame, unique: DataFrame, keys: list[str], rows: int, how: str = "left") -> DataFrame:
    """``big`` joined to ``unique`` (one row per key) without sending a hot key to one task.

    Hot keys are at most 1/HOT_SHARE; their rows of ``unique`` are therefore a
    bounded table and are broadcast, and the hot rows of ``big`` stay where
    they are.  All other rows take a shuffled join.  Null keys never match.
    """
    if rows <= SMALL:
        return big.join(unique, keys, how)
    hot = [tuple(r) for r in hot_keys(big, keys, rows).collect()]
    if not hot:
        return big.join(unique, keys, how)
    spark = big.sparkSession
    flag = F.broadcast(spark.createDataFrame(hot, big.select(*keys).schema).withColumn("_hot", F.lit(True)))
    big = big.join(flag, keys, "left")
    few = unique.join(F.broadcast(spark.createDataFrame(hot, big.select(*keys).schema)), keys, "left_semi")
    a = big.filter(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(few), keys, how)
    b = big.filter(F.col("_hot").isNull()).drop("_hot").join(unique, keys, how)
    return a.unionByName(b)
