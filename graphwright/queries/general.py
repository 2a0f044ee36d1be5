"""Queries p3 (orphan references) and p4 (timestamps)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphwright.operators import orphans, timestamps
from graphwright.session import table


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return orphans.parent_rows(table(spark, d, "evolution_results"), table(spark, d, "curation_triggers"), table(spark, d, "plan_operations"), table(spark, d, "candidates"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(table(spark, d, "assertion_audit"), _parents(spark, d)).select("audit_id", "field", "ref_id", "reason").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(table(spark, d, "assertion_audit"), _parents(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = timestamps.normalise_timestamps(table(spark, d, "normalized_entities"), table(spark, d, "source_registry"))
    return out.filter("utc_micros is not null").select("row_id", "field", "utc_micros")


def p4_shapes(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.shape_report(table(spark, d, "normalized_entities"), table(spark, d, "source_registry"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_shapes": p4_shapes}

_REFS = r"""
refs AS (
  SELECT DISTINCT audit_id, recorded_at, field, regexp_replace(r, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS ref_id FROM (
    SELECT audit_id, recorded_at, 'plan_id' AS field, plan_id AS r FROM assertion_audit
    UNION ALL SELECT audit_id, recorded_at, 'trace_id', trace_id FROM assertion_audit
    UNION ALL SELECT audit_id, recorded_at, 'operation_ids', unnest(operation_ids) FROM assertion_audit
    UNION ALL SELECT audit_id, recorded_at, 'source_candidate_ids', unnest(source_candidate_ids) FROM assertion_audit)
  WHERE r IS NOT NULL AND regexp_replace(r, '[\s\p{Z}]+', '', 'g') <> ''),
parents AS (
  SELECT 'plan_id' AS field, plan.plan_id AS ref_id, stored_at, removed_at FROM evolution_results
  UNION ALL SELECT 'trace_id', trace_id, stored_at, removed_at FROM curation_triggers
  UNION ALL SELECT 'operation_ids', operation_id, stored_at, removed_at FROM plan_operations
  UNION ALL SELECT 'source_candidate_ids', candidate_id, stored_at, removed_at FROM candidates),
judged AS (
  SELECT r.audit_id, r.field, r.ref_id, r.recorded_at,
    CASE WHEN count(p.ref_id) = 0 THEN 'missing'
         WHEN r.recorded_at IS NULL THEN NULL
         WHEN bool_and(p.stored_at > r.recorded_at AND p.stored_at IS NOT NULL) THEN 'late'
         WHEN count(*) FILTER (WHERE p.stored_at <= r.recorded_at) > 0
          AND count(*) FILTER (WHERE p.stored_at <= r.recorded_at AND (p.removed_at IS NULL OR p.removed_at > r.recorded_at)) = 0 THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN parents p ON p.field = r.field AND p.ref_id = r.ref_id
  GROUP BY r.audit_id, r.field, r.ref_id, r.recorded_at)
"""

SQL = {
    "p3_found": f"WITH {_REFS} SELECT DISTINCT audit_id, field, ref_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_report": f"""WITH {_REFS} SELECT field, strftime(recorded_at, '%Y-%m') AS month, count(*) AS "references",
      count(*) FILTER (WHERE reason = 'missing') AS missing, count(*) FILTER (WHERE reason = 'late') AS late,
      count(*) FILTER (WHERE reason = 'deleted') AS deleted FROM judged GROUP BY ALL""",
}
