"""Audit records, their references, and replay."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright import config
from graphwright.functions.hashing import derived_id
from graphwright.operators.route import score_vector


def audit_records(operations: DataFrame, now: str | None, decided_by: str = config.DEFAULT_DECIDED_BY, policy: str = config.DEFAULT_POLICY) -> DataFrame:
    """One record per planned operation with the scores and evidence of its candidate; the clock is read once for all (``now`` or the time of the call)."""
    at = F.to_timestamp(F.lit(now)) if now else F.lit(dt.datetime.now(dt.UTC).replace(tzinfo=None))
    return operations.select(
        derived_id("audit", F.concat("operation_id", F.lit(":audit"))).alias("audit_id"), "plan_id", "operation_id", "op_type", F.lit(decided_by).alias("decided_by"), score_vector(F.col("scores")).alias("score_vector"),
        F.coalesce("evidence_refs.evidence_id", F.array().cast("array<string>")).alias("evidence_ids"), F.lit(policy).alias("policy_version"), "trace_id", at.alias("recorded_at"),
    )


def refs(records: DataFrame, column: str, name: str) -> DataFrame:
    """(audit_id, name): the reference table of an array column, without repeats and nulls."""
    return records.select("audit_id", F.explode(column).alias(name)).filter(F.col(name).isNotNull()).distinct()


def baseline_kind(adviser: Column, abstained: Column, final: Column, conservative: str = "CONFLICT") -> Column:
    """Without an adviser, or with one that abstained, the baseline is the final kind; else the conservative one."""
    return F.when(adviser.isNull() | F.coalesce(abstained, F.lit(False)), final).otherwise(F.lit(conservative))


def replay(records: DataFrame, recompute: Column, stored: str) -> DataFrame:
    """Adds ``reproduced`` and, where it is false, ``divergence``: the decision is computed again from the captured inputs."""
    out = records.withColumn("replayed", recompute)
    same = F.col("replayed").eqNullSafe(F.col(stored))
    return out.withColumn("reproduced", same).withColumn("divergence", F.when(~same, F.concat(F.lit("stored "), F.coalesce(F.col(stored), F.lit("null")), F.lit(", replayed "), F.coalesce("replayed", F.lit("null")))))


def er_audit_id(trace: Column, left: Column, right: Column, action: Column, plan: Column) -> Column:
    """Content address of an identity decision."""
    none = lambda c: F.coalesce(c, F.lit(""))
    return derived_id("audit", F.concat(F.lit("semantic:"), none(trace), F.lit(":"), left, F.lit(":"), right, F.lit(":"), action, F.lit(":"), none(plan)))


def assertion_audit_id(trace: Column, kind: Column, plan: Column, assertion_ids: Column) -> Column:
    """Content address of an evolution decision."""
    none = lambda c: F.coalesce(c, F.lit(""))
    return derived_id("audit", F.concat(F.lit("semantic:assertion:"), none(trace), F.lit(":"), kind, F.lit(":"), none(plan), F.lit(":"), F.array_join(F.coalesce(assertion_ids, F.array().cast("array<string>")), ",")))


def resolve_plan_id(explicit: Column, review: Column, execution: Column) -> Column:
    """Plan that a decision led to: the explicit one, else the review's, else the execution's."""
    return F.coalesce(explicit, review, execution)


def affected_refs(targets: Column, left: Column, right: Column) -> Column:
    """What an identity decision touched: its trigger's targets, else the two ends."""
    return F.when(F.coalesce(F.size(targets), F.lit(0)) > 0, targets).otherwise(F.array(left, right))


def assertion_affected_refs(targets: Column, assertion_ids: Column) -> Column:
    """What an evolution decision touched: its trigger's targets, then the assertions that these leave out."""
    none = F.array().cast("array<string>")
    t = F.coalesce(targets, none)
    return F.concat(t, F.array_except(F.coalesce(assertion_ids, none), t))


def captured_evidence(own: Column, assessed: Column) -> Column:
    """Evidence block that a replay needs: the one given, else the first of the assessments that is not null."""
    return F.coalesce(own, F.get(F.filter(assessed, lambda x: x.isNotNull()), F.lit(0)))


def semantic_records(decisions: DataFrame, versions: Column, now: str, kind: str = "ER") -> DataFrame:
    """Audit rows of decisions with everything that a replay needs.

    ER decisions have trace_id, left, right, baseline, final, plan_id,
    trigger_targets, inputs; ASSERTION decisions trace_id, baseline, final,
    plan_id, assertion_ids, operation_ids, source_candidate_ids,
    trigger_targets, inputs.  Ids are content addresses, so that a decision
    recorded twice has one id.
    """
    c = F.col
    er = kind == "ER"
    some = lambda n: F.coalesce(c(n), F.array().cast("array<string>")).alias(n)
    lists = [F.array().cast("array<string>").alias(n) for n in ("assertion_ids", "operation_ids", "source_candidate_ids")] if er else [some(n) for n in ("assertion_ids", "operation_ids", "source_candidate_ids")]
    ident = er_audit_id(c("trace_id"), c("left"), c("right"), c("final"), c("plan_id")) if er else assertion_audit_id(c("trace_id"), c("final"), c("plan_id"), c("assertion_ids"))
    refs_ = affected_refs(c("trigger_targets"), c("left"), c("right")) if er else assertion_affected_refs(c("trigger_targets"), c("assertion_ids"))
    return decisions.select(ident.alias("audit_id"), F.lit(kind).alias("decision_kind"), "trace_id", refs_.alias("affected_refs"), F.coalesce("baseline", "final").alias("baseline"), "final", "plan_id", *lists, versions.alias("versions"), F.to_json("inputs").alias("replay_inputs"), F.to_timestamp(F.lit(now)).alias("recorded_at"))


def read_semantic(records: DataFrame, er_schema: str, assertion_schema: str) -> DataFrame:
    """Adds ``er`` and ``assertion``, the replay inputs read by the schema of their kind; ER records have no references."""
    er = F.col("decision_kind") == "ER"
    out = records.withColumn("er", F.when(er, F.from_json("replay_inputs", er_schema))).withColumn("assertion", F.when(F.col("decision_kind") == "ASSERTION", F.from_json("replay_inputs", assertion_schema)))
    for n in ("assertion_ids", "operation_ids"):
        out = out.withColumn(n, F.when(er, F.array().cast("array<string>")).otherwise(F.col(n)))
    return out


def evolution_decisions(decisions: DataFrame) -> DataFrame:
    """(trigger_id, kind, review_required, has_conflict, plan_id, assertion_ids) of planned evolutions: what their audit compares."""
    return decisions.select("trigger_id", "kind", "review_required", F.col("conflict").isNotNull().alias("has_conflict"), "plan_id", "assertion_ids")


def metric_snapshot(matcher: DataFrame, clusters: DataFrame, curation: DataFrame) -> DataFrame:
    """One row with the three metric bundles as structs; each input has one row."""
    one = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    return one(matcher, "matcher").crossJoin(F.broadcast(one(clusters, "clusters"))).crossJoin(F.broadcast(one(curation, "curation")))
