"""Schemas of the record tables and the strict reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


SCORES = "struct<extraction_confidence:double,source_reliability:double,identity_confidence:double,policy_risk:double>"
EVIDENCE = "array<struct<evidence_id:string,relationship:string>>"
SCHEMAS = {
    "candidates": f"candidate_id string, candidate_kind string, graph_id string, producer string, semantic_key string, trace_id string, contract_version string, scores {SCORES}, evidence_refs {EVIDENCE}, created_at timestamp, stored_at timestamp, removed_at timestamp",
    "normalized_entities": "row_id bigint, source_key string, graph_id string, entity_type string, normalized_names array<string>, identifiers map<string,array<string>>, affiliations array<string>, neighbors array<string>, attributes map<string,string>, valid_from string, valid_to string, source_reliability double, embedding array<double>, stored_at timestamp",
    "pair_features": "left string, right string, name_similarity double, identifier_agreement double, temporal_compatible double, geographic_distance double, shared_affiliations double, attribute_rarity double, source_reliability double, embedding_similarity double, neighborhood_compatibility double, mutually_exclusive double",
    "clusters": "cluster_id string, version bigint, graph_id string, entity_type string, members array<string>, committed_at timestamp",
    "profiles": "profile_id string, version string, graph_id string, entity_type string, source string, identity_authority_mode string, er_mode string, required_evidence_count int, false_merge_cost_class string, allowable_auto_actions array<string>",
    "plan_operations": "plan_id string, op_index bigint, operation_id string, op_type string, payload string, reversal_data string",
    "assertions": f"assertion_id string, subject_identity string, predicate string, object_value string, object_identity string, status string, recorded_at timestamp, superseded_at timestamp, superseded_by string, evidence_refs {EVIDENCE}, curation_epoch bigint, trace_id string, source_candidate_ids array<string>",
    "review_items": "item_id string, kind string, source string, entity_type string, priority string, value double, snapshot_ref string, payload string, enqueued_at timestamp, seq bigint",
    "review_history": "item_id string, action string, actor string, at timestamp, payload string",
    "triggers": "trigger_id string, trigger_kind string, identity_ids array<string>, evidence_ids array<string>, reason string, trace_id string, snapshot_version string, stored_at timestamp",
    "audit": "audit_id string, decision_kind string, trace_id string, baseline_kind string, final_kind string, plan_id string, assertion_ids array<string>, operation_ids array<string>, replay_inputs string, recorded_at timestamp",
}


def struct(name: str) -> T.StructType:
    """Schema of a record table (needs a running session)."""
    return T.StructType.fromDDL(SCHEMAS[name])


def read_strict(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A record table with exactly its fields; unknown fields are refused, unreadable text rows raise when read."""
    want = struct(name)
    found = spark.read.format(fmt).load(path) if fmt == "parquet" else spark.read.schema(want).option("mode", "FAILFAST").format(fmt).load(path)
    unknown = sorted(set(found.columns) - set(want.names))
    if unknown:
        raise ValueError(f"unknown fields in {name}: {', '.join(unknown)}")
    return found.select([c for c in want.names if c in found.columns])
