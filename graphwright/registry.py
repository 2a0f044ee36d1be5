"""Named extension points: Column and DataFrame callables that callers can add or replace."""

from __future__ import annotations

from collections.abc import Callable

from graphwright.functions import hashing, similarity
from graphwright.operators import block, decide, features, normalize, validate

PORTS = ("validator", "normalizer", "type_hook", "identity_rule", "blocking_channel", "pair_producer", "vector_index", "feature_extractor", "matcher", "cluster_constraint", "id_factory", "clock", "sink", "trigger_queue", "dependency_index", "evidence_lookup", "adviser", "metric_provider")
_CALLABLES: dict[tuple[str, str], Callable] = {}


def register(port: str, name: str, call: Callable) -> None:
    """Add or replace a callable; an unknown port is refused."""
    if port not in PORTS:
        raise KeyError(f"unknown port {port}; one of {', '.join(PORTS)}")
    _CALLABLES[port, name] = call


def lookup(port: str, name: str) -> Callable:
    if (port, name) not in _CALLABLES:
        raise KeyError(f"no {port} named {name}")
    return _CALLABLES[port, name]


def names(port: str) -> list[str]:
    return sorted(n for p, n in _CALLABLES if p == port)


for _port, _name, _call in (
    ("validator", "rules", validate.validate), ("normalizer", "default", normalize.normalize_entities), ("identity_rule", "strong_identifier", features.identity_signals), ("blocking_channel", "identifier", block.identifier_keys),
    ("blocking_channel", "name", block.name_keys), ("pair_producer", "blocks", block.block_pairs), ("vector_index", "brute_force", block.knn_pairs), ("feature_extractor", "default", features.pair_features), ("matcher", "rules/1", features.rule_score),
    ("matcher", "calibrated", features.calibrated_scores), ("cluster_constraint", "default", decide.cluster_violations), ("id_factory", "derived", hashing.derived_id), ("id_factory", "random", hashing.random_id), ("feature_extractor", "jaro_winkler", similarity.jaro_winkler),
):
    register(_port, _name, _call)
