"""Thresholds, weights and small tables as plain data."""

from __future__ import annotations

SUPPORTED_KINDS = ("entity", "relation", "attribute_assertion", "artifact")
INSTALLED_VERSION = "2.3.0"
# Severities of failures.
SEVERITY = {"BAD_DATA": 2, "UNSUPPORTED_ONTOLOGY": 1, "TRANSIENT_FAULT": 0}
# Confidence thresholds of routing.
CONFIDENCE = {"auto_extraction": 0.95, "auto_source": 0.90, "auto_identity": 0.95, "auto_risk": 0.20, "human_risk": 0.5, "assess_extraction": 0.80}
ROUTES = {"AUTO": 0, "LLM_ASSESS": 1, "HUMAN": 2}
# Weights of the rule matcher, in the order in which they are summed.
RULE_WEIGHTS = {
    "attribute_rarity": 2.0, "embedding_similarity": 1.0, "identifier_agreement": 6.0, "mutually_exclusive": -8.0, "name_similarity": 3.0, "neighborhood_compatibility": 1.5,
    "shared_affiliations": 0.5, "source_reliability": 0.5, "temporal_compatible": 1.0,
}
RULE_INTERCEPT = -2.5
# Risk budgets (1 - p) by false-merge cost class, and the risk from which a pair is kept apart.
RISK = {"LOW": (0.10, 0.40), "STANDARD": (0.02, 0.25), "HIGH": (0.002, 0.10)}
RETAIN_RISK = 0.90
# Hours to answer by priority, ranks, and backpressure limits.
SLA_HOURS = {"P1": 24, "P2": 168, "P3": 720}
RANK = {"P1": 3, "P2": 2, "P3": 1}
QUARANTINE_DEPTH, QUARANTINE_BREACHES, THROTTLE_DEPTH, TOTAL_DEPTH, HIGH_VALUE = 75, 5, 25, 100, 0.7
# Namespaces that identify, and types on which others do.
STRONG_NAMESPACES = ("doi", "vin")
SCOPED_NAMESPACES = {
    "orcid": (("person", "people", "human", "individual", "agent", "author", "coauthor", "creator", "contributor", "researcher", "scholar", "academic", "scientist", "investigator", "editor", "reviewer", "inventor"), True),
    "issn": (("journal", "serial", "periodical"), False),
    "isbn": (("book", "monograph", "bookedition"), False),
}
# Operation types and what undoes them.
INVERSE = {
    "CREATE_IDENTITY": "REVOKE_IDENTITY", "REVOKE_IDENTITY": "RESTORE_IDENTITY", "RESTORE_IDENTITY": "REVOKE_IDENTITY", "ATTACH_ASSERTION": "RETRACT_ASSERTION", "RETRACT_ASSERTION": "ATTACH_ASSERTION",
    "MERGE_IDENTITIES": "SPLIT_IDENTITY", "SPLIT_IDENTITY": "MERGE_IDENTITIES", "REASSIGN_ASSERTION": "REASSIGN_ASSERTION",
}
# Legal moves of an ontology term.
ONTOLOGY_MOVES = {"PROPOSED": ("APPROVED", "DEPRECATED"), "APPROVED": ("OBSERVED", "DEPRECATED"), "OBSERVED": ("DEPRECATED",), "DEPRECATED": ()}
REVIEW_ACTIONS = ("APPROVE", "REJECT", "EDIT", "SPLIT", "RELABEL", "LINK", "MERGE_ELSEWHERE", "SAME_CONCEPT_DIFFERENT_SCOPE")
PERSON_PREFIX = 4
EARTH_KM = 6371.0088
#: Samples, gain in precision: what a second arm needs before it may raise a threshold.
GATE_SAMPLES, GATE_GAIN = 30, 0.01
EVIDENCE_CHARS = 500
# Profiles that come with the engine: id, source they are pinned to, identity authority, resolution mode, cost of a false merge, actions they may take alone, priority of their reviews.
PROFILES = (
    ("default", None, "OPEN", "ACTIVE", "STANDARD", ("AUTO_LINK", "RETAIN_SEPARATE"), "P3"),
    ("projection_consumer", "projection", "OPEN", "INERT", "LOW", (), "P3"),
    ("client_authoritative", None, "CLIENT_AUTHORITATIVE", "ADVISORY", "HIGH", (), "P1"),
)
# Advisers: template, version, what they may recommend, and what they say when they cannot tell.
ADVISERS = {
    "identity": ("identity_resolution", "identity/1", ("same", "different", "insufficient_evidence"), "insufficient_evidence"),
    "assertion": ("assertion_relation", "assertion/1", ("supports", "contradicts", "supersedes", "insufficient"), "insufficient"),
    "conflict": ("conflict_comparison", "conflict/1", ("prefer_subject", "prefer_other", "preserve_both", "route_review", "gather_more_evidence"), "preserve_both"),
    "concept_evolution": ("concept_evolution", "concept_evolution/1", ("merge", "split", "relabel", "same_concept_different_scope", "no_change", "insufficient"), "insufficient"),
    "ontology_evolution": ("ontology_evolution", "ontology_evolution/1", ("propose_candidate", "promotion_rationale", "no_proposal", "insufficient"), "insufficient"),
}
# Versions of a prompt without and with evidence text.
PROMPT_VERSION, PROMPT_VERSION_EVIDENCE = "1", "2+evidence"
# Fixed value: key of the payload that undoes an operation, in its reversal data.
INVERSE_PAYLOAD_KEY = "inverse_payload"
# Kinds of evolution that review actions lead to.
REVIEW_KINDS = {"SPLIT": "SPLIT", "RELABEL": "RELABEL", "LINK": "MERGE", "MERGE_ELSEWHERE": "MERGE", "SAME_CONCEPT_DIFFERENT_SCOPE": "RELABEL"}
DEFAULT_SNAPSHOT, DEFAULT_POLICY, DEFAULT_DECIDED_BY = "0", "1", "auto"
