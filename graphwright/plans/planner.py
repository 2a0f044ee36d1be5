"""Mutation plans compiled from routed candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright import config
from graphwright.functions.hashing import derived_id, fact_key, record_seed
from graphwright.functions.text import iso_utc, json_string


#: Columns that candidates may leave out, with their types.
OPTIONAL = {
    "identity_id": "string", "subject_identity": "string", "predicate": "string", "value": "string", "value_json": "string", "object_identity": "string", "valid_from": "string", "valid_to": "string", "source_type": "string", "locator": "string", "producer": "string",
    "evidence_refs": "array<struct<evidence_id:string,relationship:string>>", "trace_id": "string", "entity_type": "string", "display_name": "string", "scores": "struct<extraction_confidence:double,source_reliability:double,identity_confidence:double,policy_risk:double>",
}


def _complete(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items() if c not in df.columns])


def record_id(rows: DataFrame) -> Column:
    """Identifier of the record that a row (subject_identity, predicate, value or value_json, object_identity, valid_from, valid_to, source_type, locator, evidence_refs) claims."""
    fact = fact_key(F.col("subject_identity"), F.col("predicate"))
    value = F.coalesce("value_json", json_string(F.col("value")))
    return derived_id("assertion", record_seed(fact, value, *[F.col(c) for c in ("object_identity", "valid_from", "valid_to", "source_type", "locator", "evidence_refs")]))


def operations(routed: DataFrame) -> DataFrame:
    """Operations of the automatic candidates, one plan per batch.

    ``routed`` has batch_id, input_seq, candidate_id, candidate_kind, route,
    created_at and what it has of OPTIONAL.  Entities create an identity;
    attributes and relations attach an assertion, whose id is that of its
    record (the candidate is not part of it), and are deferred (no row) where
    subject, value or object is unknown.  A batch without automatic rows has
    no plan.  ``op_index`` counts in input order.
    """
    auto = _complete(routed.filter("route = 'AUTO'"))
    kind, has = F.col("candidate_kind"), lambda c: F.col(c).isNotNull()
    attach = ((kind == "attribute_assertion") & has("subject_identity") & (has("value") | has("value_json"))) | ((kind == "relation") & has("subject_identity") & has("object_identity"))
    op = F.when((kind == "entity") & has("identity_id"), "CREATE_IDENTITY").when(attach, "ATTACH_ASSERTION")
    ops = auto.withColumn("op_type", op).filter("op_type is not null")
    ops = ops.withColumn("op_index", F.row_number().over(Window.partitionBy("batch_id").orderBy("input_seq", "candidate_id")) - 1)
    ops = ops.withColumn("operation_id", derived_id("operation", F.concat_ws(":", "candidate_id", "op_type")))
    ops = ops.withColumn("assertion_id", F.when(F.col("op_type") == "ATTACH_ASSERTION", record_id(ops)))
    return ops.select("batch_id", "op_index", "operation_id", "op_type", "candidate_id", "assertion_id", F.lit("ACTIVE").alias("status"), "created_at", *OPTIONAL)


def plan_ids(ops: DataFrame, snapshot: str, policy: str) -> DataFrame:
    """(batch_id, plan_id, candidate_ids, snapshot_version, policy_version)."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("op_index", "candidate_id"))), lambda x: x["candidate_id"])
    p = ops.groupBy("batch_id").agg(ids.alias("candidate_ids"))
    seed = F.concat(F.array_join("candidate_ids", "|"), F.lit(f"@{snapshot}#{policy}"))
    return p.select("batch_id", derived_id("plan", seed).alias("plan_id"), "candidate_ids", F.lit(snapshot).alias("snapshot_version"), F.lit(policy).alias("policy_version"))


def preconditions(ops: DataFrame, snapshot: str) -> DataFrame:
    """(batch_id, pre_index, kind, subject, expected): the snapshot first, then one guard per operation in order."""
    guards = ops.select("batch_id", (F.col("op_index") + 1).alias("pre_index"), F.when(F.col("op_type") == "CREATE_IDENTITY", "entity_version").otherwise("assertion_absent").alias("kind"), F.when(F.col("op_type") == "CREATE_IDENTITY", F.col("identity_id")).otherwise(F.col("subject_identity")).alias("subject"), F.when(F.col("op_type") == "CREATE_IDENTITY", F.lit("0")).otherwise(F.col("assertion_id")).alias("expected"))
    first = ops.select("batch_id").distinct().select("batch_id", F.lit(0).alias("pre_index"), F.lit("snapshot_version").alias("kind"), F.lit(None).cast("string").alias("subject"), F.lit(snapshot).alias("expected"))
    return first.unionByName(guards)


def duplicate_mints(ops: DataFrame, plan: str = "plan_id", minted: str = "assertion_id") -> DataFrame:
    """All rows whose minted id occurs more than once in their plan; counted first, so no plan gathers in one task."""
    twice = ops.groupBy(plan, minted).agg(F.count("*").alias("mints")).filter("mints > 1")
    return ops.join(twice, [plan, minted])


def plan_evidence(ops: DataFrame, plan: str = "plan_id") -> DataFrame:
    """(plan, evidence_ids): distinct evidence of ``evidence_refs`` in the order of first use over the operations."""
    e = ops.select(plan, "op_index", F.posexplode("evidence_refs.evidence_id").alias("pos", "evidence_id")).filter("evidence_id is not null").groupBy(plan, "evidence_id").agg(F.min(F.struct("op_index", "pos")).alias("at"))
    return e.groupBy(plan).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"))


def as_of(assertions: DataFrame, epoch: Column | int | None = None, at: Column | None = None, superseded: bool = False, revoked: bool = False) -> DataFrame:
    """Assertions visible at an epoch and a transaction time; superseded and revoked ones are hidden unless asked for.

    With ``at`` an assertion counts as live if it was recorded by then and not
    yet superseded, whatever its status is today.
    """
    out = assertions
    if epoch is not None:
        out = out.filter(F.col("curation_epoch") <= epoch)
    if at is not None:
        return out.filter((F.col("recorded_at") <= at) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > at) | F.lit(superseded)))
    hidden = [s for s, show in (("SUPERSEDED", superseded), ("REVOKED", revoked)) if not show]
    return out.filter(~F.col("status").isin(*hidden)) if hidden else out


def payloads(ops: DataFrame) -> DataFrame:
    """Adds ``payload`` and ``reversal_data`` as JSON: what an operation writes, and what takes it back besides its lineage.

    An identity is revoked by reference, with the operation that made it as the
    reason; an assertion is retracted: status SUPERSEDED since the moment it
    was recorded, and no successor.
    """
    at = iso_utc(F.col("created_at"))
    entity = F.to_json(F.struct("identity_id", "entity_type", F.lit("ACTIVE").alias("status"), "display_name", at.alias("created_at")))
    period = F.struct("valid_from", "valid_to").alias("valid_period")
    origin = F.struct(F.col("source_type").alias("source"), F.col("locator").alias("source_ref"), F.col("producer").alias("actor")).alias("provenance")
    record = F.to_json(F.struct("assertion_id", "subject_identity", "predicate", F.col("value").alias("object_value"), "object_identity", "status", period, at.alias("recorded_at"), "evidence_refs", F.col("producer").alias("authority"), origin, "trace_id", F.array("candidate_id").alias("source_candidate_ids")))
    revoke = F.struct("identity_id", F.concat(F.lit("rollback of CREATE_IDENTITY "), "operation_id").alias("reason")).alias(config.INVERSE_PAYLOAD_KEY)
    retract = F.struct("assertion_id", "subject_identity", F.lit("SUPERSEDED").alias("new_status"), at.alias("superseded_at")).alias(config.INVERSE_PAYLOAD_KEY)
    new = F.col("op_type") == "CREATE_IDENTITY"
    back = F.when(new, F.to_json(F.struct(revoke, "identity_id", "candidate_id"))).otherwise(F.to_json(F.struct(retract, "candidate_id")))
    return ops.withColumn("payload", F.when(new, entity).otherwise(record)).withColumn("reversal_data", back)
