"""Applying a plan under its guards."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions.hashing import derived_id
from graphwright.plans.planner import duplicate_mints
from graphwright.sources.store import AppendOnlyTable, StaleEpochError

SUPPORTED = ("CREATE_IDENTITY", "ATTACH_ASSERTION", "REVOKE_IDENTITY", "RESTORE_IDENTITY")
#: With the retraction of assertions, for stores that change a status.
WITH_RETRACT = (*SUPPORTED, "RETRACT_ASSERTION")
LOG_SCHEMA = "execution_id string, plan_id string, batch_id string, outcome string, new_epoch bigint, operation_ids array<string>, failed array<struct<kind:string,subject:string,expected:string>>, unsupported_types array<string>, error string, is_compensation boolean, executed_by string, recorded_at timestamp"


@dataclass(frozen=True)
class Execution:
    """Outcome of one execution: EMPTY, UNSUPPORTED_OPERATION, ERROR, STALE or COMMITTED."""

    plan_id: str
    outcome: str
    epoch: int | None
    detail: str
    execution_id: str = ""
    batch_id: str | None = None


def batch_id(plan: Column) -> Column:
    """Identifier of the batch that a plan compiles to: the same for every replay."""
    return derived_id("batch", plan)


def execution_id(plan: Column, outcome: Column, epoch: Column, compensation: bool = False) -> Column:
    """Content address of an execution; repeats with the same outcome share it."""
    kind = "comp" if compensation else "exec"
    return derived_id("execution", F.concat(plan, F.lit(f":{kind}:"), outcome, F.coalesce(F.concat(F.lit(":"), epoch.cast("string")), F.lit(""))))


def unsupported_types(ops: DataFrame, supported: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """(plan_id, types): sorted distinct operation types outside the supported set."""
    return ops.filter(~F.col("op_type").isin(*supported)).groupBy("plan_id").agg(F.array_sort(F.collect_set("op_type")).alias("types"))


def outcomes(plans: DataFrame, ops: DataFrame, epoch: int, present: DataFrame, supported: tuple[str, ...] = SUPPORTED, compensation: bool = False) -> DataFrame:
    """What executing each plan of (plan_id, snapshot_version) next would come to: EMPTY, UNSUPPORTED_OPERATION, ERROR, STALE or COMMITTED, in this order.

    ERROR: one assertion is minted twice.  STALE: the plan's snapshot is not
    ``epoch``, or an assertion of (subject_identity, assertion_id) in
    ``present``, history included, is there already.  A committed plan makes
    the epoch after ``epoch``.  Plans are judged one by one.
    """
    size = ops.groupBy("plan_id").agg(F.count("*").alias("operations"))
    attach = ops.filter("op_type = 'ATTACH_ASSERTION'")
    twice = attach.groupBy("plan_id", "assertion_id").agg(F.count("*").alias("k")).filter("k > 1").groupBy("plan_id").agg(F.min("assertion_id").alias("twice"))
    there = attach.join(present.select("subject_identity", "assertion_id").distinct(), ["subject_identity", "assertion_id"], "left_semi").groupBy("plan_id").agg(F.count("*").alias("there"))
    j = plans.select("plan_id", "snapshot_version").join(size, "plan_id", "left").join(unsupported_types(ops, supported), "plan_id", "left").join(twice, "plan_id", "left").join(there, "plan_id", "left")
    stale = ~F.col("snapshot_version").eqNullSafe(F.lit(str(epoch))) | F.col("there").isNotNull()
    what = F.when(F.col("operations").isNull(), "EMPTY").when(F.col("types").isNotNull(), "UNSUPPORTED_OPERATION").when(F.col("twice").isNotNull(), "ERROR").when(stale, "STALE").otherwise("COMMITTED")
    j = j.withColumn("outcome", what).withColumn("new_epoch", F.when(F.col("outcome") == "COMMITTED", F.lit(epoch + 1).cast("bigint")))
    reached = F.col("outcome") == "COMMITTED"
    return j.select("plan_id", "outcome", execution_id(F.col("plan_id"), F.col("outcome"), F.col("new_epoch"), compensation).alias("execution_id"), F.when(reached, batch_id(F.col("plan_id"))).alias("batch_id"), "new_epoch", F.coalesce("operations", F.lit(0)).cast("bigint").alias("operations"), F.coalesce("types", F.array().cast("array<string>")).alias("unsupported_types"))


def execute(ops: DataFrame, plan_id: str, snapshot_epoch: int, store: AppendOnlyTable, log: AppendOnlyTable | None = None, now: str | None = None, supported: tuple[str, ...] = SUPPORTED, compensation: bool = False, executed_by: str = "auto") -> Execution:
    """Refuse an empty, unsupported, self-conflicting or stale plan; else append its rows as the next epoch.

    ``ops`` has plan_id, op_index, op_type, assertion_id and the columns of the
    store.  Guards: the snapshot is the published epoch, and no attached
    assertion is there already, history included.  A compensation attaches what
    was there before, so that it replaces the record and is not refused.  The
    attempt is appended to ``log`` (LOG_SCHEMA) whatever comes of it.
    """
    spark, mine = ops.sparkSession, ops.filter(F.col("plan_id") == plan_id)
    ids = [r.operation_id for r in mine.select("op_index", "operation_id").orderBy("op_index").collect()] if "operation_id" in ops.columns else []

    def done(outcome: str, epoch: int | None = None, error: str | None = None, failed: list = (), types: list = ()) -> Execution:
        row = spark.range(1).select(execution_id(F.lit(plan_id), F.lit(outcome), F.lit(epoch).cast("bigint"), compensation).alias("x"), F.when(F.lit(outcome in ("COMMITTED", "STALE") and not failed), batch_id(F.lit(plan_id))).alias("b")).first()
        if log is not None:
            at = dt.datetime.fromisoformat(now) if now else dt.datetime.now(dt.UTC).replace(tzinfo=None)
            log.append(spark.createDataFrame([(row.x, plan_id, row.b, outcome, epoch, [] if outcome == "EMPTY" else ids, list(failed), list(types), error, compensation, executed_by, at)], LOG_SCHEMA))
        return Execution(plan_id, outcome, epoch, error or "", row.x, row.b)

    if mine.isEmpty():
        return done("EMPTY", error="no operations")
    bad = unsupported_types(mine, supported).first()
    if bad:
        return done("UNSUPPORTED_OPERATION", error=", ".join(bad.types), types=bad.types)
    attach = mine.filter("op_type = 'ATTACH_ASSERTION'")
    twice = [r.assertion_id for r in duplicate_mints(attach).select("assertion_id").distinct().orderBy("assertion_id").limit(20).collect()]
    if twice:
        return done("ERROR", error=f"minted more than once: {', '.join(twice)}", failed=[("assertion_absent", None, x) for x in twice])
    if store.published() != snapshot_epoch:
        return done("STALE", error="the snapshot is not the published epoch", failed=[("snapshot_version", None, str(snapshot_epoch))])
    there = store.read().filter("op_type = 'ATTACH_ASSERTION'").select("assertion_id")
    known = [] if compensation else [r.assertion_id for r in attach.join(there, "assertion_id", "left_semi").select("assertion_id").orderBy("assertion_id").limit(20).collect()]
    if known:
        return done("STALE", error="an assertion is there already", failed=[("assertion_absent", None, x) for x in known])
    try:
        return done("COMMITTED", store.append(mine, snapshot_epoch))
    except StaleEpochError as e:
        return done("STALE", error=str(e))


def records_for_plan(log: DataFrame, plan_id: str) -> DataFrame:
    """Execution records of a plan in order of insertion."""
    return log.filter(F.col("plan_id") == plan_id).orderBy("epoch", "seq")


def current_assertions(log: DataFrame) -> DataFrame:
    """Latest row per assertion of a committed log: retraction changes the status, nothing is deleted."""
    return log.groupBy("assertion_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "assertion_id"]), F.struct("epoch", "op_index")).alias("_r")).select("assertion_id", "_r.*")


def entity_versions(log: DataFrame) -> DataFrame:
    """(subject_identity, version): committed operations on a subject; each commit that touches it raises its version by one."""
    touched = log.select(F.coalesce("subject_identity", "identity_id").alias("subject_identity"), "epoch").filter("subject_identity is not null").distinct()
    return touched.groupBy("subject_identity").agg(F.count("*").alias("version"))
