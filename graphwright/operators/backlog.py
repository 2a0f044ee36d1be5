"""Review backlog: deadlines, depth, inversion, starvation and backpressure.

Items: item_id, source, entity_type, priority, value, snapshot_ref, enqueued_at.
``now`` is a parameter, so that results can be reproduced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphwright import config


def with_sla(items: DataFrame, now: str) -> DataFrame:
    """Adds deadline, breach (strictly after the deadline), age in hours (never negative) and rank; unknown priorities have the last deadline and no rank.

    Null sources and types become ``unknown``; a null ``enqueued_at`` gives a
    null age and no breach.
    """
    hours = F.when(F.col("priority") == "P1", config.SLA_HOURS["P1"]).when(F.col("priority") == "P2", config.SLA_HOURS["P2"]).otherwise(config.SLA_HOURS["P3"])
    at = F.to_timestamp(F.lit(now))
    rank = F.when(F.col("priority") == "P1", config.RANK["P1"]).when(F.col("priority") == "P2", config.RANK["P2"]).when(F.col("priority") == "P3", config.RANK["P3"]).otherwise(0)
    out = items.withColumn("source", F.coalesce("source", F.lit("unknown"))).withColumn("entity_type", F.coalesce("entity_type", F.lit("unknown")))
    out = out.withColumn("deadline", F.col("enqueued_at") + F.make_dt_interval(F.lit(0), hours))
    age = F.greatest(F.lit(0.0), (F.unix_micros(at) - F.unix_micros("enqueued_at")) / 3.6e9)
    return out.withColumn("breach", F.coalesce(at > F.col("deadline"), F.lit(False))).withColumn("age_hours", F.when(F.col("enqueued_at").isNotNull(), age)).withColumn("rank", rank)


def counts(items: DataFrame, column: str) -> DataFrame:
    return items.groupBy(column).agg(F.count("*").alias("n"))


def metrics(sla: DataFrame) -> DataFrame:
    """Depth, oldest age and breaches in total and per source, type and priority: one pass over grouping sets."""
    cols = [F.col(c) for c in ("source", "entity_type", "priority")]
    by = F.when(F.grouping("source") == 0, "source").when(F.grouping("entity_type") == 0, "entity_type").when(F.grouping("priority") == 0, "priority").otherwise("all")
    out = sla.groupingSets([[], *[[c] for c in cols]], *cols).agg(by.alias("by"), F.count("*").alias("depth"), F.max("age_hours").alias("max_age_hours"), F.count_if("breach").alias("breaches"))
    return out.select("by", F.coalesce(*cols).alias("value"), "depth", "max_age_hours", "breaches")


def source_backlog(sla: DataFrame) -> DataFrame:
    """Per source: depth, oldest age, breaches, and depth per priority."""
    per = [F.count_if(F.col("priority") == p).alias(p.lower()) for p in config.SLA_HOURS]
    return sla.groupBy("source").agg(F.count("*").alias("depth"), F.max("age_hours").alias("max_age_hours"), F.count_if("breach").alias("breaches"), *per)


def cluster_backlog(sla: DataFrame) -> DataFrame:
    """Per snapshot reference: size, greatest value, any breach; items without one are left out."""
    return sla.filter("snapshot_ref is not null").groupBy("snapshot_ref").agg(F.count("*").alias("size"), F.max("value").alias("max_value"), F.bool_or("breach").alias("any_breach"))


def priority_inversion(sla: DataFrame) -> DataFrame:
    """Breaching items that rank above the least rank among items in time; none if no item is in time."""
    least = sla.filter(~F.col("breach")).agg(F.min("rank").alias("least"))
    return sla.filter("breach").crossJoin(F.broadcast(least)).filter("rank > least").drop("least")


def starving(sla: DataFrame) -> DataFrame:
    """Breaching items of high value."""
    return sla.filter(F.col("breach") & (F.col("value") >= config.HIGH_VALUE))


def backpressure(sla: DataFrame) -> DataFrame:
    """(source, depth, breaches, signal) of the sources that must slow down.

    QUARANTINE from 75 items or 5 breaches, THROTTLE from 25 items.  Above 100
    items in all the largest source (then the smallest name) is throttled too.
    """
    per = sla.groupBy("source").agg(F.count("*").alias("depth"), F.count_if("breach").alias("breaches"))
    own = F.when((F.col("depth") >= config.QUARANTINE_DEPTH) | (F.col("breaches") >= config.QUARANTINE_BREACHES), "QUARANTINE").when(F.col("depth") >= config.THROTTLE_DEPTH, "THROTTLE")
    total = per.agg(F.sum("depth").alias("_total"), F.min(F.struct(-F.col("depth"), F.col("source"))).alias("_top"))
    out = per.crossJoin(F.broadcast(total)).withColumn("signal", own)
    extra = F.when((F.col("_total") > config.TOTAL_DEPTH) & (F.col("source") == F.col("_top.source")), "THROTTLE")
    return out.withColumn("signal", F.coalesce("signal", extra)).filter("signal is not null").select("source", "depth", "breaches", "signal")


def pending(items: DataFrame, handled: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` unhandled items in order of insertion."""
    return items.join(handled.select("item_id"), "item_id", "left_anti").orderBy("seq").limit(limit)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Idempotent enqueue: the first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
