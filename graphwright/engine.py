"""One call from candidates to a plan: validate, route, plan, audit.  Nothing is written but the audit rows, and these only if asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright import config
from graphwright.operators import audit, route, validate
from graphwright.plans import planner
from graphwright.sources.store import AppendOnlyTable


@dataclass(frozen=True)
class Curation:
    """What a run gives: outcomes of all candidates; plans, operations with payloads, guards and audit rows of those that apply by themselves."""

    outcomes: DataFrame
    plans: DataFrame
    operations: DataFrame
    preconditions: DataFrame
    audit: DataFrame


def curate(candidates: DataFrame, graph: str | None = None, snapshot: str = config.DEFAULT_SNAPSHOT, policy: str = config.DEFAULT_POLICY, now: str | None = None, decided_by: str = config.DEFAULT_DECIDED_BY, sink: AppendOnlyTable | None = None) -> Curation:
    """Curate batches of candidates (columns of validation, routing and ``planner.OPTIONAL``; ``batch_id`` and ``input_seq`` optional).

    Invalid candidates never reach the routing: their outcome has neither route
    nor identity.  Without ``batch_id`` all candidates are one batch; a batch is
    one plan and must be of a size that one plan can have.  Without
    ``input_seq`` the order is that of candidate ids.  With a ``sink`` the audit
    rows are appended to it.
    """
    c = candidates
    c = c if "batch_id" in c.columns else c.withColumn("batch_id", F.lit("batch"))
    c = c if "input_seq" in c.columns else c.withColumn("input_seq", F.lit(0))
    checked = validate.validate(c, graph)
    routed = route.route_candidates(validate.accepted(checked))
    keys = ["candidate_id", "batch_id", "input_seq"]
    fine = routed.select(*keys, F.lit(True).alias("valid"), F.lit(None).cast("string").alias("failure_kind"), "reasons", "disposition", "route", "identity_id", "create_new_identity")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("disposition", "string"), ("route", "string"), ("identity_id", "string"), ("create_new_identity", "boolean"))]
    outcomes = fine.unionByName(checked.filter("not valid").select(*keys, "valid", "failure_kind", "reasons", *none))
    ends = routed.withColumn("subject_identity", F.when(F.col("candidate_kind") != "entity", F.col("identity_id")))
    ends = ends.withColumn("object_identity", F.when((F.col("candidate_kind") == "relation") & route.is_identity(F.col("object")), F.col("object"))) if "object" in ends.columns else ends
    ops = planner.payloads(planner.operations(ends))
    plans = planner.plan_ids(ops, snapshot, policy).join(planner.plan_evidence(ops, "batch_id"), "batch_id", "left")
    rows = audit.audit_records(ops.join(plans.select("batch_id", "plan_id"), "batch_id"), now, decided_by, policy)
    if sink is not None:
        sink.append(rows)
    return Curation(outcomes, plans, ops, planner.preconditions(ops, snapshot), rows)
