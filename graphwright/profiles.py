"""Curation profiles as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphwright import config

SCHEMA = "profile_id string, version string, graph_id string, entity_type string, source string, identity_authority_mode string, er_mode string, required_evidence_count int, false_merge_cost_class string, ontology_promotion_allowed boolean, allowable_auto_actions array<string>, review_priority string"


def builtin_profiles(spark: SparkSession) -> DataFrame:
    """The profiles that come with the engine; ``decide.resolve_profiles`` falls back to ``default``."""
    rows = [(i, "1", None, None, source, authority, mode, 1, cost, False, sorted(actions), priority) for i, source, authority, mode, cost, actions, priority in config.PROFILES]
    return spark.createDataFrame(rows, SCHEMA)


def client_authoritative(spark: SparkSession, profile_id: str = "client_authoritative", graph_id: str | None = None, entity_type: str | None = None, source: str | None = None, cost: str = "HIGH") -> DataFrame:
    """A profile whose identities belong to a client: links are proposed, never made."""
    return spark.createDataFrame([(profile_id, "1", graph_id, entity_type, source, "CLIENT_AUTHORITATIVE", "ADVISORY", 1, cost, False, [], "P1")], SCHEMA)
