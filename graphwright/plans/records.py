"""Identity of stored assertion records: their seeds, new ids for old rows, and successors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions.hashing import derived_id, fact_key, record_seed
from graphwright.functions.text import json_string
from graphwright.plans.planner import _complete

#: Columns of a stored record that its identity rests on.
IDENTITY = ("value", "value_json", "object_identity", "valid_from", "valid_to", "source_type", "locator", "evidence_refs")


def assertion_fact_key() -> Column:
    """Key of the slot of a stored row."""
    return fact_key(F.col("subject_identity"), F.col("predicate"))


def assertion_record_seed() -> Column:
    """Seed of a stored row: the same as the planner's for the claim that it holds."""
    value = F.coalesce("value_json", json_string(F.col("value")))
    return record_seed(assertion_fact_key(), value, *[F.col(c) for c in IDENTITY[2:]])


def backfill_record_ids(rows: DataFrame) -> DataFrame:
    """Adds ``fact`` and ``record_id``, computed from the stored row alone; columns that rows lack count as null."""
    return _complete(rows).withColumn("fact", assertion_fact_key()).withColumn("record_id", derived_id("assertion", assertion_record_seed()))


def backfill_collisions(rows: DataFrame, old_id: str = "assertion_id") -> DataFrame:
    """(record_id, old_ids, least_id): new ids that more than one old id maps to; these rows must merge, renaming alone would double an id."""
    b = backfill_record_ids(rows).groupBy("record_id").agg(F.count_distinct(old_id).alias("old_ids"), F.min(old_id).alias("least_id"))
    return b.filter("old_ids > 1")


def next_records(prior: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(successors, replays) of records (assertion_id, ...) under ``changes`` (assertion_id, recorded_at and any of IDENTITY).

    A successor is ACTIVE with an id of its own, no pointer, no epoch and no
    source candidates.  A column that ``changes`` has replaces the prior one
    where it is not null.  Changes that leave the seed as it is are replays.
    """
    prior = _complete(prior)
    given = [c for c in changes.columns if c not in ("assertion_id", "recorded_at")]
    new = changes.select("assertion_id", F.col("recorded_at").alias("_at"), *[F.col(c).alias(f"_{c}") for c in given])
    j = prior.withColumn("_old", assertion_record_seed()).join(new, "assertion_id")
    if "value" in given:
        j = j.withColumn("value_json", F.when(F.col("_value").isNull(), F.col("value_json")))
    for c in given:
        j = j.withColumn(c, F.coalesce(f"_{c}", c))
    j = j.withColumn("_new", assertion_record_seed()).withColumn("recorded_at", F.col("_at")).withColumn("prior_id", F.col("assertion_id"))
    done = j.filter(~F.col("_new").eqNullSafe(F.col("_old"))).withColumn("assertion_id", derived_id("assertion", F.col("_new"))).withColumn("status", F.lit("ACTIVE"))
    none = lambda t: F.lit(None).cast(t)
    done = done.withColumn("superseded_at", none("timestamp")).withColumn("superseded_by", none("string")).withColumn("curation_epoch", F.lit(0).cast("bigint")).withColumn("source_candidate_ids", F.array().cast("array<string>"))
    drop = ["_old", "_new", "_at", *[f"_{c}" for c in given]]
    return done.drop(*drop), j.filter(F.col("_new").eqNullSafe(F.col("_old"))).select("prior_id")
