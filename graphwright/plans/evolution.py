"""Re-curation: triggers, routing of new evidence, supersession, merges, splits, and the ontology life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright import config
from graphwright.functions.hashing import derived_id, identity_id, trigger_id
from graphwright.functions.text import iso_utc


def build_triggers(rows: DataFrame) -> DataFrame:
    """Adds the content-addressed ``derived_trigger_id`` of (trigger_kind, identity_ids, evidence_ids, snapshot_version)."""
    empty = F.array().cast("array<string>")
    return rows.withColumn("derived_trigger_id", trigger_id(F.col("trigger_kind"), [F.coalesce("identity_ids", empty), F.coalesce("evidence_ids", empty)], F.coalesce("snapshot_version", F.lit(""))))


def enqueue(queue: DataFrame, new: DataFrame, key: str = "derived_trigger_id") -> DataFrame:
    """The new rows whose key is not queued yet, the first of each key."""
    fresh = new.join(queue.select(key), key, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).filter("_n = 1").drop("_n")


def merge_evidence(a: Column, b: Column) -> Column:
    """First-seen union."""
    return F.array_distinct(F.concat(a, b))


def route_assertion(relationship: Column, supersession_allowed: Column) -> Column:
    """CORROBORATION, SUPERSESSION or CONFLICT for new evidence on a known fact."""
    return F.when(relationship == "SUPPORTS", "CORROBORATION").when((relationship == "SUPERSEDES") & supersession_allowed, "SUPERSESSION").otherwise("CONFLICT")


def supersession_chain(records: DataFrame) -> DataFrame:
    """Adds ``superseded_by``, ``superseded_at`` and ``status``: each record of a fact is superseded by the next one.

    ``records`` has fact, assertion_id, value, recorded_at.  A record with the
    value of the one before it changes nothing and supersedes nothing.
    """
    w = Window.partitionBy("fact").orderBy("recorded_at", "assertion_id")
    changed = records.withColumn("_before", F.lag(F.struct("value")).over(w)).filter(F.col("_before").isNull() | ~F.col("_before.value").eqNullSafe(F.col("value"))).drop("_before")
    out = changed.withColumn("superseded_by", F.lead("assertion_id").over(w)).withColumn("superseded_at", F.lead("recorded_at").over(w))
    return out.withColumn("status", F.when(F.col("superseded_by").isNull(), "ACTIVE").otherwise("SUPERSEDED"))


def supersession_errors(pairs: DataFrame) -> DataFrame:
    """Rows (old_id, new_id, old_fact, new_fact, old_status) that may not supersede, with the reason."""
    why = F.when(F.col("old_id") == F.col("new_id"), "self").when(F.col("old_fact") != F.col("new_fact"), "cross-fact").when(F.col("old_status") != "ACTIVE", "not active")
    return pairs.withColumn("reason", why).filter("reason is not null")


def superseded_pointer(payload: Column) -> Column:
    """Successor that a stored retraction names in its JSON payload; null for none, an error for one that names itself."""
    own, p = F.get_json_object(payload, "$.assertion_id"), F.get_json_object(payload, "$.superseded_by")
    text = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), "$.superseded_by", "variant")) == "STRING", F.lit(False))
    return F.when(text & own.eqNullSafe(p), F.raise_error(F.concat(F.lit("a record that supersedes itself: "), p)).cast("string")).when(text, p)


def operation_id(trigger: Column, op_type: Column, target: Column) -> Column:
    """Identifier of an operation that a trigger leads to."""
    return derived_id("operation", F.concat(F.lit("recur:"), trigger, F.lit(":"), op_type, F.lit(":"), target))


def plan_id(trigger: Column, kind: Column) -> Column:
    """Identifier of the plan of a kind that a trigger leads to."""
    return derived_id("plan", F.concat(F.lit("recur:"), trigger, F.lit(":"), kind))


def plan_assertions(rows: DataFrame, snapshot: str = config.DEFAULT_SNAPSHOT, policy: str = config.DEFAULT_POLICY, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations, decisions, refused) for new records against the known ones of their facts.

    ``rows`` has trigger_id, trigger_evidence, recommendation,
    supersession_allowed, new_evidence, and of both records id, subject,
    predicate (old_id, new_id, ...), old_status and new_recorded_at.  SUPPORTS
    attaches the new record; SUPERSEDES, where allowed, attaches it and retracts
    the old one, which stays as SUPERSEDED with its successor; everything else
    attaches it, keeps both as UNRESOLVED and asks for review.  A record may
    not supersede itself, one of another fact, or one that is not ACTIVE:
    such rows are refused with the reason, or raise with ``strict``.
    """
    r = rows.withColumn("kind", route_assertion(F.upper("recommendation"), F.coalesce("supersession_allowed", F.lit(False))))
    why = F.when(F.col("old_id") == F.col("new_id"), "self").when(~(F.col("old_subject").eqNullSafe(F.col("new_subject")) & F.col("old_predicate").eqNullSafe(F.col("new_predicate"))), "cross-fact").when(~F.col("old_status").eqNullSafe("ACTIVE"), "not active")
    r = r.withColumn("refused", F.when(F.col("kind") == "SUPERSESSION", why))
    if strict:
        r = r.withColumn("refused", F.when(F.col("refused").isNotNull(), F.raise_error(F.concat(F.lit("supersession refused: "), "refused")).cast("string")))
    refused = r.filter("refused is not null").select("trigger_id", "old_id", "new_id", "refused")
    ok = r.filter("refused is null").withColumn("plan_id", plan_id(F.col("trigger_id"), F.col("kind")))
    at = iso_utc(F.col("new_recorded_at"))
    retract = F.to_json(F.struct(F.col("old_id").alias("assertion_id"), F.col("old_subject").alias("subject_identity"), F.lit("SUPERSEDED").alias("new_status"), at.alias("superseded_at"), F.col("new_id").alias("superseded_by")))
    undo = F.to_json(F.struct(F.struct(F.col("new_id").alias("assertion_id"), F.col("new_subject").alias("subject_identity"), F.lit("SUPERSEDED").alias("new_status"), at.alias("superseded_at")).alias(config.INVERSE_PAYLOAD_KEY), "trigger_id"))
    redo = F.to_json(F.struct(F.struct(F.col("old_id").alias("assertion_id"), F.col("old_subject").alias("subject_identity"), F.col("old_predicate").alias("predicate"), F.lit("ACTIVE").alias("status")).alias(config.INVERSE_PAYLOAD_KEY), "trigger_id"))
    record = F.to_json(F.struct(F.col("new_id").alias("assertion_id"), F.col("new_subject").alias("subject_identity"), F.col("new_predicate").alias("predicate"), F.lit("ACTIVE").alias("status"), at.alias("recorded_at")))
    step = lambda i, t, target, payload, reversal: F.struct(F.lit(i).alias("op_index"), F.lit(t).alias("op_type"), F.col(target).alias("assertion_id"), payload.alias("payload"), reversal.alias("reversal_data"))
    steps = F.array_compact(F.array(step(0, "ATTACH_ASSERTION", "new_id", record, undo), F.when(F.col("kind") == "SUPERSESSION", step(1, "RETRACT_ASSERTION", "old_id", retract, redo))))
    ops = ok.select("plan_id", "trigger_id", F.explode(steps).alias("x")).select("plan_id", "trigger_id", "x.*")
    ops = ops.withColumn("operation_id", operation_id(F.col("trigger_id"), F.col("op_type"), F.col("assertion_id")))
    conflict = F.col("kind") == "CONFLICT"
    none = F.array().cast("array<string>")
    decisions = ok.select(
        "trigger_id", "kind", "plan_id", F.lit(snapshot).alias("snapshot_version"), F.lit(policy).alias("policy_version"), merge_evidence(F.coalesce("trigger_evidence", none), F.coalesce("new_evidence", none)).alias("evidence_ids"), conflict.alias("review_required"),
        F.when(conflict, F.struct(F.array("old_id", "new_id").alias("assertion_ids"), F.lit("UNRESOLVED").alias("status"))).alias("conflict"), F.when(F.col("kind") == "SUPERSESSION", F.array("old_id", "new_id")).otherwise(F.array("new_id")).alias("assertion_ids"),
        F.col("new_subject").alias("subject"),
    )
    return ops, decisions, refused


def relabel(rows: DataFrame) -> DataFrame:
    """Additive labels (trigger_id, assertion_id, subject_identity): one ATTACH_ASSERTION each; nothing is renamed."""
    kind = F.lit("ATTACH_ASSERTION")
    return rows.select(plan_id(F.col("trigger_id"), F.lit("RELABEL")).alias("plan_id"), "trigger_id", F.lit(0).alias("op_index"), kind.alias("op_type"), "assertion_id", "subject_identity", operation_id(F.col("trigger_id"), kind, F.col("assertion_id")).alias("operation_id"))


def trigger_provenance(trigger: DataFrame, policy: str = config.DEFAULT_POLICY, matcher: str | None = None, adviser: str | None = None) -> DataFrame:
    """Adds ``provenance``: what every operation of a trigger (trigger_id, trigger_kind, trace_id, evidence_ids) is stamped with."""
    none = lambda x: F.lit(x).cast("string")
    return trigger.withColumn("provenance", F.struct("trigger_id", "trigger_kind", "trace_id", F.array_distinct(F.coalesce("evidence_ids", F.array().cast("array<string>"))).alias("evidence_ids"), none(matcher).alias("matcher_version"), none(adviser).alias("adviser_version"), none(policy).alias("policy_version")))


def merge_operations(survivors: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, into, merged, operation_id): all members but the survivor are merged into it."""
    m = members.groupBy("cluster_id").agg(F.array_sort(F.collect_set("member")).alias("all"))
    out = m.join(survivors, "cluster_id").filter(F.size("all") > 1)
    merged = F.array_except("all", F.array("survivor"))
    return out.select("cluster_id", F.col("survivor").alias("into"), merged.alias("merged"), derived_id("operation", F.concat(F.lit("recur:"), "cluster_id", F.lit(":MERGE_IDENTITIES:"), "survivor")).alias("operation_id"))


def split_operations(splits: DataFrame) -> DataFrame:
    """A SPLIT row and one REASSIGN row per moved assertion of (identity_id, new_identity, assertion_ids)."""
    one = splits.select("identity_id", F.lit(0).alias("op_index"), F.lit("SPLIT_IDENTITY").alias("op_type"), F.col("new_identity").alias("target"), F.lit(None).cast("string").alias("assertion_id"))
    each = splits.select("identity_id", "new_identity", F.posexplode(F.array_distinct("assertion_ids")).alias("p", "assertion_id")).select("identity_id", (F.col("p") + 1).alias("op_index"), F.lit("REASSIGN_ASSERTION").alias("op_type"), F.col("new_identity").alias("target"), "assertion_id")
    return one.unionByName(each)


def legal_history(history: Column) -> Column:
    """Whether a term's states form a legal path from PROPOSED; empty and null ones do not."""
    moves = F.create_map(*[x for k, v in config.ONTOLOGY_MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    steps = F.zip_with(F.slice(history, 1, F.greatest(F.size(history) - 1, F.lit(0))), F.slice(history, 2, F.greatest(F.size(history) - 1, F.lit(0))), lambda a, b: F.coalesce(F.array_contains(moves[a], b), F.lit(False)))
    return F.coalesce((F.size(history) > 0) & (F.get(history, F.lit(0)) == "PROPOSED") & F.forall(steps, lambda x: x), F.lit(False))


def may_promote(history: Column) -> Column:
    return legal_history(history) & (F.try_element_at(history, F.lit(-1)) == "APPROVED")


def review_plans(decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """(item_id, action, status, kind, plan_id, error): reviewers' decisions through the planners of the automatic path.

    ``decisions`` has item_id, action and what an edit names (members, into);
    ``proposals`` one row per item: trigger_id, proposed_kind, proposed_plan,
    merge_members, split_source, split_into, label_assertion,
    promotion_candidate.  REJECT is recorded without a plan; APPROVE plans the
    proposed kind, or passes the proposed plan on, or is recorded; EDIT plans
    the proposed kind with what it names; the other actions plan their own
    kind.  Status is PLANNED, RECORDED_NO_PLAN or ERROR: a merge needs two
    members, a split a source and targets, a relabelling a label, a promotion a
    candidate.  Decisions on unknown items give no row.
    """
    own = F.create_map(*[F.lit(x) for kv in config.REVIEW_KINDS.items() for x in kv])
    d = decisions.select("item_id", "action", *[F.col(c) if c in decisions.columns else F.lit(None).cast("array<string>").alias(c) for c in ("members", "into")]).join(proposals, "item_id")
    act = F.col("action")
    kind = F.when(act.isin("APPROVE", "EDIT"), F.col("proposed_kind")).otherwise(own[act])
    j = d.withColumn("kind", F.when(act != "REJECT", kind))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    members, into = F.coalesce("members", "merge_members"), F.when(act == "EDIT", F.coalesce("into", "split_into")).otherwise(F.col("split_into"))
    needs = (
        F.when((F.col("kind") == "MERGE") & (n(members) < 2), "MERGE requires at least two members").when((F.col("kind") == "SPLIT") & (F.col("split_source").isNull() | (n(into) < 1)), "SPLIT requires split_source and split_into")
        .when((F.col("kind") == "RELABEL") & F.col("label_assertion").isNull(), "RELABEL requires a label_assertion").when((F.col("kind") == "PROMOTION") & F.col("promotion_candidate").isNull(), "PROMOTION requires a promotion_candidate")
        .when(~F.col("kind").isin("MERGE", "SPLIT", "RELABEL", "PROMOTION"), F.concat(F.lit("no review routing for evolution kind "), "kind"))
    )
    known = F.coalesce(act.isin(*config.REVIEW_ACTIONS), F.lit(False))
    error = F.when(~known, "unroutable review action").when((act == "EDIT") & F.col("kind").isNull(), "cannot EDIT a proposal without a proposed_kind").otherwise(needs)
    j = j.withColumn("error", F.when(act.isNull() | (act != "REJECT"), error))
    planned = F.when(F.col("error").isNotNull(), None).when(F.col("kind").isNotNull(), plan_id(F.col("trigger_id"), F.col("kind"))).when(act == "APPROVE", F.col("proposed_plan"))
    j = j.withColumn("plan_id", planned)
    status = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("plan_id").isNotNull(), "PLANNED").otherwise("RECORDED_NO_PLAN")
    return j.select("item_id", "action", status.alias("status"), F.when(F.col("error").isNull(), F.col("kind")).alias("kind"), "plan_id", "error")


def promotion(terms: DataFrame) -> DataFrame:
    """(term_id, plan_id, operation_id, op_type) for approved ontology terms (term_id, trigger_id, history); others give no row.  Nothing undoes a promotion."""
    seed = F.concat(F.lit("promote_ontology:"), "trigger_id", F.lit(":"), "term_id")
    ok = terms.filter(may_promote(F.col("history")))
    return ok.select("term_id", derived_id("plan", seed).alias("plan_id"), derived_id("operation", seed).alias("operation_id"), F.lit("PROMOTE_ONTOLOGY_TERM").alias("op_type"))


def promote_candidates(candidates: DataFrame) -> DataFrame:
    """CREATE_IDENTITY rows for entity candidates (candidate_id, graph_id, trigger_id, identity_id or null) that become canonical."""
    minted = F.coalesce("identity_id", identity_id(F.col("graph_id"), F.concat(F.lit("promote:"), "candidate_id")))
    c = candidates.withColumn("identity_id", minted)
    op = operation_id(F.col("trigger_id"), F.lit("CREATE_IDENTITY"), F.col("identity_id"))
    return c.select(plan_id(F.col("trigger_id"), F.lit("PROMOTION")).alias("plan_id"), "trigger_id", F.lit("CREATE_IDENTITY").alias("op_type"), "identity_id", op.alias("operation_id"))


def transition(history: Column, to: Column) -> Column:
    """History of a term after a legal move; an illegal one raises."""
    after = F.concat(history, F.array(to))
    return F.when(legal_history(after), after).otherwise(F.raise_error(F.concat(F.lit("illegal move to "), to)).cast("array<string>"))
