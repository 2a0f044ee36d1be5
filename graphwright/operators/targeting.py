"""What new evidence touches: joins over dependency tables, never a scan of the graph.

Every function gives rows with ``at``, the place of a target in the order in
which the dependencies are followed; ``in_order`` keeps the first of each target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _at(*cols) -> F.Column:
    """Places compare like texts of equal width."""
    return F.concat_ws(".", *[F.lpad(c.cast("string"), 8, "0") for c in cols])


def in_order(touched: DataFrame, by: str) -> DataFrame:
    """(by, pos, target): each target once, at the first of its places."""
    first = touched.filter("target is not null").groupBy(by, "target").agg(F.min("at").alias("at"))
    return first.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("at", "target")) - 1).alias("pos"), "target")


def affected_by_evidence(evidence: DataFrame, support: DataFrame, owner: DataFrame, by: str = "evidence_id") -> DataFrame:
    """(by, at, target): assertions that evidence supports, each followed by the identity that owns it where one is known.

    ``evidence`` has evidence_id and optionally ``by`` and pos; ``support``
    evidence_id, assertion_id and optionally n, the place of the assertion;
    ``owner`` one identity_id per assertion_id.
    """
    e = evidence if "pos" in evidence.columns else evidence.withColumn("pos", F.lit(0))
    s = support if "n" in support.columns else support.withColumn("n", F.lit(0))
    hit = e.select(*dict.fromkeys([by, "evidence_id"]), "pos").join(s.select("evidence_id", "assertion_id", "n"), "evidence_id").join(owner.select("assertion_id", "identity_id"), "assertion_id", "left")
    place = lambda k: F.concat_ws(".", _at(F.col("pos"), F.col("n")), "assertion_id", F.lit(str(k)))
    both = F.array(F.struct(place(0).alias("at"), F.col("assertion_id").alias("target")), F.struct(place(1).alias("at"), F.col("identity_id").alias("target")))
    return hit.select(by, F.explode(both).alias("x")).select(by, "x.at", "x.target").filter("target is not null")


def affected_by_entity(keys: DataFrame, alias: DataFrame, known: DataFrame) -> DataFrame:
    """(key, identity): by alias; a key that is no alias but a known identity stands for itself."""
    by_alias = keys.join(alias, "key").select("key", F.col("identity_id").alias("identity"))
    own = keys.join(alias.select("key"), "key", "left_anti").join(known.select(F.col("identity_id").alias("key")).distinct(), "key", "left_semi")
    return by_alias.unionByName(own.select("key", F.col("key").alias("identity"))).distinct()


def affected_by_candidate(candidates: DataFrame, alias: DataFrame, support: DataFrame, owner: DataFrame) -> DataFrame:
    """(candidate_id, pos, target): identities that the candidate's keys (semantic_key, then ``keys`` if it has them) are aliases of, then what its evidence touches."""
    c = candidates if "keys" in candidates.columns else candidates.withColumn("keys", F.array().cast("array<string>"))
    keys = c.select("candidate_id", F.posexplode(F.concat(F.array("semantic_key"), F.coalesce("keys", F.array().cast("array<string>")))).alias("pos", "key"))
    named = keys.join(alias, "key").select("candidate_id", F.concat(F.lit("0."), _at(F.col("pos"))).alias("at"), F.col("identity_id").alias("target"))
    ev = c.select("candidate_id", F.posexplode("evidence_refs.evidence_id").alias("pos", "evidence_id"))
    far = affected_by_evidence(ev, support, owner, "candidate_id").withColumn("at", F.concat(F.lit("1."), "at"))
    return in_order(named.unionByName(far), "candidate_id")


def affected_by_trigger(triggers: DataFrame, support: DataFrame, owner: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """(trigger_id, pos, target): everything that triggers touch, once each.

    In order: identities that they name (by alias, else as named), assertions,
    concepts (like identities), and what their evidence touches.  Of several
    rows of a trigger each counts; arrays that ``triggers`` lacks are empty.
    """
    none = F.array().cast("array<string>")
    col = lambda c: F.coalesce(F.col(c), none) if c in triggers.columns else none
    t = triggers.select("trigger_id", col("identity_ids").alias("i"), col("assertion_ids").alias("a"), col("concept_keys").alias("c"), col("evidence_ids").alias("e"))
    spread = lambda c, k: t.select("trigger_id", F.posexplode(c).alias("pos", "key")).select("trigger_id", "key", F.concat(F.lit(f"{k}."), _at(F.col("pos"))).alias("at"))
    named = spread("i", 0).unionByName(spread("c", 2))
    if alias is not None:
        named = named.join(alias, "key", "left").withColumn("key", F.coalesce("identity_id", "key"))
    named = named.unionByName(spread("a", 1), allowMissingColumns=True).select("trigger_id", "at", F.col("key").alias("target"))
    ev = t.select("trigger_id", F.posexplode("e").alias("pos", "evidence_id")).groupBy("trigger_id", "evidence_id").agg(F.min("pos").alias("pos"))
    far = affected_by_evidence(ev, support, owner, "trigger_id").withColumn("at", F.concat(F.lit("3."), "at"))
    return in_order(named.unionByName(far), "trigger_id")
