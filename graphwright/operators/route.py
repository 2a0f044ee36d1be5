"""Confidence routing of valid candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright import config
from graphwright.functions.hashing import GRAPH_ID, identity_id

SCORES = ("extraction_confidence", "source_reliability", "identity_confidence", "policy_risk")


def score_vector(scores: Column) -> Column:
    """Map of the scores that are present, in a fixed order."""
    entries = [x for f in SCORES for x in (F.lit(f), scores[f])]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def confidence_route(scores: Column, disposition: Column) -> Column:
    """AUTO, LLM_ASSESS or HUMAN.

    A new identity excuses an absent identity score, never a low one.  Null
    scores otherwise pass no threshold; a null risk counts as none.
    """
    c = config.CONFIDENCE
    at_least = lambda f, t: F.coalesce(scores[f] >= t, F.lit(False))
    risk = F.coalesce(scores["policy_risk"], F.lit(0.0))
    identity = F.when(scores["identity_confidence"].isNull(), disposition == "NEW_IDENTITY").otherwise(scores["identity_confidence"] >= c["auto_identity"])
    auto = at_least("extraction_confidence", c["auto_extraction"]) & at_least("source_reliability", c["auto_source"]) & (risk <= c["auto_risk"]) & identity
    return F.when(risk >= c["human_risk"], "HUMAN").when(auto, "AUTO").when(at_least("extraction_confidence", c["assess_extraction"]), "LLM_ASSESS").otherwise("HUMAN")


def escalate(a: Column, b: Column) -> Column:
    """The more conservative of two routes."""
    rank = F.create_map(*[x for k, v in config.ROUTES.items() for x in (F.lit(k), F.lit(v))])
    return F.when(rank[a] >= rank[b], a).otherwise(b)


def is_identity(ref: Column) -> Column:
    """Whether a reference is a canonical identity (and not an alias that must be resolved first); false for null."""
    return F.coalesce(ref.rlike(r"^kg://[a-z][a-z0-9_-]*/identity/[0-9A-Z]{26}$"), F.lit(False))


def identity_disposition(kind: Column, subject: Column, object_: Column) -> Column:
    """NEW_IDENTITY for entities; for attributes and relations RESOLVED_EXISTING if all their ends are identities, else UNRESOLVED; RESOLVED_EXISTING for what has no ends."""
    known = F.when(kind == "relation", is_identity(subject) & is_identity(object_)).otherwise(is_identity(subject))
    return F.when(kind == "entity", "NEW_IDENTITY").when(kind.isin("relation", "attribute_assertion"), F.when(known, "RESOLVED_EXISTING").otherwise("UNRESOLVED")).otherwise("RESOLVED_EXISTING")


def route_candidates(candidates: DataFrame) -> DataFrame:
    """Adds ``disposition``, ``route``, ``identity_id`` (minted for automatic entities, the subject where all ends are known) and ``create_new_identity``.

    The disposition is decided before the route.  ``subject`` and ``object``
    are optional columns; without them no end is known.  An unresolved end
    floors the route at LLM_ASSESS.
    """
    kind, none = F.col("candidate_kind"), F.lit(None).cast("string")
    subject, object_ = (F.col(c) if c in candidates.columns else none for c in ("subject", "object"))
    base = candidates.withColumn("disposition", identity_disposition(kind, subject, object_))
    route = confidence_route(F.col("scores"), F.col("disposition"))
    floored = F.when(F.col("disposition") == "UNRESOLVED", escalate(route, F.lit("LLM_ASSESS"))).otherwise(route)
    new = (F.col("route") == "AUTO") & (kind == "entity")
    # valid candidates have well-formed graphs; the check keeps an error from rows that a reordered filter has yet to drop
    minted = F.when(new & F.col("graph_id").rlike(GRAPH_ID), identity_id(F.col("graph_id"), F.col("candidate_id"))).when(kind.isin("relation", "attribute_assertion") & (F.col("disposition") == "RESOLVED_EXISTING"), subject)
    return base.withColumn("route", floored).withColumn("identity_id", minted).withColumn("create_new_identity", F.coalesce(new, F.lit(False)))
