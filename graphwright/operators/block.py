"""Candidate pairs by blocking keys, with the channels that found them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright import config
from graphwright.functions.similarity import cosine


def identifier_keys(ids: Column) -> Column:
    """``ns:value`` of every identifier."""
    return F.flatten(F.transform(F.map_entries(ids), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(":"), v))))


def name_keys(names: Column, prefix: int = config.PERSON_PREFIX, tokens: bool = True) -> Column:
    """Whole name, its first ``prefix`` characters if it is that long, and its words."""
    one = lambda n: F.concat(F.array(F.concat(F.lit("name:"), n)), F.when(F.length(n) >= prefix, F.array(F.concat(F.lit("pfx:"), F.substring(n, 1, prefix)))).otherwise(F.array().cast("array<string>")), F.transform(F.split(n, " "), lambda t: F.concat(F.lit("tok:"), t)) if tokens else F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(names, one)))


def block_keys(entities: DataFrame, channels: dict[str, Column], key: str = "source_key") -> DataFrame:
    """(key, channel, bk) of all channels."""
    parts = [entities.select(F.col(key).alias("k"), F.lit(c).alias("channel"), F.explode(keys).alias("bk")) for c, keys in channels.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def block_pairs(keys: DataFrame, max_block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(left, right, channels) of the pairs that share a block, and the blocks left out as too large.

    Without ``max_block`` no block is left out.  The size of a block counts its
    rows before duplicates are removed.  AQE splits a
    block that is hot.  ``sorted_pairs`` puts the result in the order of keys.
    """
    sizes = keys.groupBy("channel", "bk").agg(F.count("*").alias("members"))
    dropped = sizes.filter(F.col("members") > max_block) if max_block is not None else sizes.limit(0)
    kept = keys.distinct()
    if max_block is not None:
        kept = kept.join(dropped.select("channel", "bk"), ["channel", "bk"], "left_anti")
    a, b = kept.select("channel", "bk", F.col("k").alias("left")), kept.select("channel", "bk", F.col("k").alias("right"))
    pairs = a.join(b, ["channel", "bk"]).filter("left < right").groupBy("left", "right").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    return pairs, dropped


def knn_pairs(vectors: DataFrame, queries: DataFrame, k: int = 10, block: str | None = "label") -> DataFrame:
    """(left, right) of every query's ``k`` nearest vectors by cosine within its block (all vectors without one), folded to unordered pairs.

    ``vectors`` and ``queries`` have (key, vec, label); ties go to the smaller key; a vector is not its own neighbour.
    Without a block every query meets every vector; each task keeps its own ``k`` nearest, and only those are shuffled.
    """
    by = [F.col(block).alias("_b")] if block else []
    q = queries.select(F.col("key").alias("q"), F.col("vec").alias("qv"), *by)
    v = vectors.select(F.col("key").alias("v"), F.col("vec").alias("vv"), *by)
    both = q.join(v, "_b") if block else v.crossJoin(q)
    sims = both.filter("q <> v").select("q", "v", cosine(F.col("qv"), F.col("vv")).alias("sim")).filter("sim is not null")
    near = sims.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "v"))).filter(F.col("n") <= k)
    return near.select(F.least("q", "v").alias("left"), F.greatest("q", "v").alias("right")).distinct()


def sorted_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs in the order of their keys."""
    return pairs.orderBy("left", "right")
