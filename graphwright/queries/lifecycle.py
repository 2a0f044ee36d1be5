"""Queries of the engine, record identity, compensation, execution, evolution, review, advisers and audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphwright import config, engine, profiles
from graphwright.functions import hashing
from graphwright.operators import advise, audit, backlog, decide, evaluate, features, normalize, review, route, targeting
from graphwright.plans import compensate, evolution, executor, planner, records
from graphwright.queries.curation import _RISK, _fact, _routed, _token
from graphwright.session import table

NOW = "2025-06-01 00:00:00"
_text = lambda c: F.col(c).cast("string")


def _known(col: str, seed: str):
    """A made-up reference: an identity for half of the rows, an alias for the others."""
    half = F.substring(F.sha2(F.concat(F.lit(seed), F.col(col)), 256), 1, 1) < "8"
    return F.when(half, F.concat(F.lit("kg://g1/identity/"), hashing.derive_token(F.concat(F.lit(seed), F.col(col))))).otherwise(F.concat(F.lit("Type:ns:"), F.col(col)))


def _latest(candidates):
    """One row per candidate: the one stored last."""
    order = [F.desc_nulls_last("stored_at"), F.desc_nulls_last("removed_at"), *[F.asc_nulls_last(c) for c in ("candidate_kind", "graph_id", "semantic_key", "producer")]]
    return candidates.filter("candidate_id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("candidate_id").orderBy(*order))).filter("_n = 1").drop("_n")


def _candidates(spark, d):
    c = _latest(table(spark, d, "candidates")).select("candidate_id", "candidate_kind", "graph_id", "producer", "contract_version", "trace_id", "scores", "evidence_refs", "created_at")
    value = F.substring(F.sha2("candidate_id", 256), 1, 6)
    return c.select("*", _known("candidate_id", "s").alias("subject"), _known("candidate_id", "o").alias("object"), F.lit("status").alias("predicate"), value.alias("value"), F.coalesce("trace_id", F.lit("none")).alias("batch_id"), F.lit("cand").alias("source_type"), F.col("candidate_id").alias("locator"))


def curate_outcomes(spark, d):
    out = engine.curate(_candidates(spark, d)).outcomes
    return out.select("candidate_id", "valid", "failure_kind", "disposition", "route", "identity_id", "create_new_identity")


def curate_operations(spark, d):
    return engine.curate(_candidates(spark, d)).operations.select("batch_id", "op_index", "operation_id", "op_type", "candidate_id", F.get_json_object("reversal_data", "$.inverse_payload.identity_id").alias("revokes"), F.get_json_object("reversal_data", "$.inverse_payload.assertion_id").isNotNull().alias("retracts"))


def curate_audit(spark, d):
    a = engine.curate(_candidates(spark, d), now=NOW).audit
    return a.select("audit_id", "operation_id", "trace_id", F.size("score_vector").alias("scores"), F.size("evidence_ids").alias("evidence"), F.unix_micros("recorded_at").alias("recorded_at"))


def _stored(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("old_"), _text("o_orderkey")).alias("assertion_id"), F.concat(F.lit("customer/"), _text("o_custkey")).alias("subject_identity"), F.lit("order_status").alias("predicate"), F.col("o_orderstatus").alias("value"), F.lit("orders").alias("source_type"), F.when(F.col("o_orderkey") % 3 != 0, _text("o_orderkey")).alias("locator"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.concat(F.lit("ev_"), _text("o_orderkey")).alias("evidence_id"), F.lit("SUPPORTS").alias("relationship")))).alias("evidence_refs"), F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("valid_from"), F.col("o_orderdate").alias("recorded_at"), F.lit("ACTIVE").alias("status"), "o_orderkey",
    )


def record_ids(spark, d):
    return records.backfill_record_ids(_stored(spark, d)).select("assertion_id", "fact", "record_id")


def next_records(spark, d):
    change = table(spark, d, "orders").select(F.concat(F.lit("old_"), _text("o_orderkey")).alias("assertion_id"), F.col("o_orderdate").alias("recorded_at"), F.when(F.col("o_orderkey") % 4 == 0, "F").alias("value"))
    new, same = records.next_records(_stored(spark, d), change)
    return new.select("prior_id", "assertion_id", "status").unionByName(same.select("prior_id", F.lit(None).cast("string").alias("assertion_id"), F.lit("REPLAY").alias("status")))


def _planned(spark, d):
    ops = planner.payloads(planner.operations(_routed(spark, d)))
    return ops.withColumn("plan_id", F.col("batch_id"))


def compensation_payloads(spark, d):
    done, _, _ = compensate.compensate(_planned(spark, d), 7)
    j = lambda p: F.get_json_object("payload", f"$.{p}")
    return done.select("plan_id", "op_index", "operation_id", "op_type", "undoes", j("assertion_id").alias("assertion_id"), j("new_status").alias("new_status"), j("superseded_at").alias("superseded_at"), F.get_json_object("reversal_data", "$.original_payload.object_value").alias("restores"))


def compensation_guards(spark, d):
    return compensate.compensate(_planned(spark, d), "7")[1]


def plan_evidence(spark, d):
    e = planner.plan_evidence(_planned(spark, d))
    return e.select("plan_id", F.array_join("evidence_ids", ",").alias("evidence_ids"))


def execution_outcomes(spark, d):
    p = table(spark, d, "plan_operations").filter("plan_id is not null")
    ops = p.select("plan_id", "op_index", "op_type", F.col("operation_id").alias("assertion_id"), F.lit("s").alias("subject_identity"))
    plans = p.select("plan_id").distinct().unionByName(table(spark, d, "evolution_results").select("plan.plan_id").filter("plan_id is not null").distinct()).distinct()
    plans = plans.withColumn("snapshot_version", F.when(F.substring(F.sha2("plan_id", 256), 1, 1) < "c", "4").otherwise("3"))
    there = ops.filter(F.substring(F.sha2("assertion_id", 256), 1, 1) == "0").select("subject_identity", "assertion_id").distinct()
    out = executor.outcomes(plans, ops, 4, there, executor.WITH_RETRACT)
    return out.withColumn("unsupported_types", F.array_join("unsupported_types", ","))


def _evolving(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    side = lambda n, key: [F.concat(F.lit("as_"), key.cast("string")).alias(f"{n}_id"), F.concat(F.lit("customer/"), (F.col("o_custkey") + F.when(key % 11 == 0, 1).otherwise(0)).cast("string")).alias(f"{n}_subject"), F.lit("order_status").alias(f"{n}_predicate")]
    return o.select(
        F.concat(F.lit("trg_"), k.cast("string")).alias("trigger_id"), F.array(F.concat(F.lit("ev_"), (k % 7).cast("string"))).alias("trigger_evidence"), F.array(F.lit("ev_1"), F.concat(F.lit("ev_"), k.cast("string"))).alias("new_evidence"), F.element_at(F.array(*map(F.lit, ("supports", "supersedes", "contradicts", "insufficient"))), (k % 4 + 1).cast("int")).alias("recommendation"),
        (k % 3 != 0).alias("supersession_allowed"), *side("old", k), *side("new", F.when(k % 13 == 0, k).otherwise(k + 1)), F.when(k % 17 == 0, "SUPERSEDED").otherwise("ACTIVE").alias("old_status"), F.col("o_orderdate").alias("new_recorded_at"),
    )


def evolution_operations(spark, d):
    return evolution.plan_assertions(_evolving(spark, d))[0].select("plan_id", "op_index", "operation_id", "op_type", "assertion_id", F.get_json_object("payload", "$.superseded_by").alias("superseded_by"), F.get_json_object("reversal_data", "$.inverse_payload.status").alias("restores"))


def evolution_decisions(spark, d):
    e = evolution.plan_assertions(_evolving(spark, d))[1]
    return audit.evolution_decisions(e).join(e.select("trigger_id", F.array_join("evidence_ids", ",").alias("evidence_ids")), "trigger_id").withColumn("assertion_ids", F.array_join("assertion_ids", ","))


def evolution_refused(spark, d):
    return evolution.plan_assertions(_evolving(spark, d))[2]


def superseded_pointers(spark, d):
    ops = evolution.plan_assertions(_evolving(spark, d))[0].filter("op_type = 'RETRACT_ASSERTION'")
    return ops.select("operation_id", evolution.superseded_pointer(F.col("payload")).alias("successor"))


def merge_plans(spark, d):
    e = table(spark, d, "evolution_results").filter("kind = 'MERGE' and plan.cluster_id is not null").select(F.col("plan.cluster_id").alias("cluster_id"), F.explode("plan.members").alias("member")).filter("member is not null").distinct()
    ent = table(spark, d, "normalized_entities").filter("source_key is not null").groupBy("source_key").agg(F.max("source_reliability").alias("reliability"))
    m = e.join(ent, e.member == ent.source_key, "left").select("cluster_id", "member", "reliability", F.lit(0).alias("identifiers"))
    out = evolution.merge_operations(decide.select_survivor(m), m)
    return out.select("cluster_id", "into", F.array_join("merged", ",").alias("merged"), "operation_id")


def review_plans(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(n, F.lit(len(xs))) + 1).cast("int"))
    names = lambda n: F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.concat(F.lit("m"), i.cast("string")))
    dec = e.select(k.alias("item_id"), pick((*config.REVIEW_ACTIONS, "ODD"), k).alias("action"), F.when(k % 4 == 0, names(k % 3)).alias("members"), F.when(k % 6 == 0, F.array(F.lit("x"))).alias("into"))
    pro = e.select(
        k.alias("item_id"), F.concat(F.lit("trg_"), k.cast("string")).alias("trigger_id"), pick(("MERGE", "SPLIT", "RELABEL", "PROMOTION", "CONFLICT", None), F.floor(k / 9)).alias("proposed_kind"), F.when(k % 2 == 0, F.concat(F.lit("pl_"), k.cast("string"))).alias("proposed_plan"), F.when(k % 5 != 0, names(k % 4)).alias("merge_members"),
        F.when(k % 7 != 0, "src").alias("split_source"), F.when(k % 8 != 0, F.array(F.lit("y"))).alias("split_into"), F.when(k % 11 != 0, "label").alias("label_assertion"), F.when(k % 13 != 0, "cand").alias("promotion_candidate"),
    )
    return evolution.review_plans(dec, pro)


def ontology_promotions(spark, d):
    p = table(spark, d, "part")
    h = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("PROPOSED"), F.lit("APPROVED"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("PROPOSED"))).otherwise(F.array(F.lit("PROPOSED"), F.lit("APPROVED"), F.lit("OBSERVED")))
    t = p.select(hashing.ontology_term_id(F.lit("g1"), F.lit("class"), F.concat(F.lit("part "), _text("p_partkey"))).alias("term_id"), F.concat(F.lit("trg_"), _text("p_size")).alias("trigger_id"), h.alias("history"))
    return evolution.promotion(t)


def _questions(spark, d):
    m = table(spark, d, "match_results").filter("left_key is not null and right_key is not null")
    some = F.col("match_id") % 3 == 0
    ids = F.when(F.col("match_id") % 4 != 0, F.array(F.concat(F.lit("ev_"), (F.col("match_id") % 10).cast("string")), F.lit("ev_x")))
    return m.select("match_id", F.lit("identity").alias("kind"), F.col("left_key").alias("subject"), F.col("right_key").alias("other"), ids.alias("evidence_ids"), F.when(some, F.array(F.lit("[ev] line"))).alias("evidence_context"), F.when(F.col("match_id") % 5 == 0, F.array(F.lit("said"))).alias("context"), "link_kind")


def adviser_requests(spark, d):
    r = advise.requests(_questions(spark, d), "identity")
    return r.select("match_id", "prompt_version", F.sha2("prompt", 256).alias("prompt_hash"), "request_hash")


def adviser_assessments(spark, d):
    q = _questions(spark, d)
    asked = advise.requests(q, "identity").groupBy("request_hash").agg(F.min("match_id").alias("n"))
    n = F.col("n")
    good = F.concat(F.lit('{"recommendation": "'), F.when(n % 2 == 0, "same").otherwise("different"), F.lit('", "confidence": '), F.when(n % 3 == 0, "1.5").when(n % 3 == 1, "0.25").otherwise("true"), F.lit(', "evidence_ids": ["ev_x", 7, "ev_other"], "contradictions": ["a"]}'))
    text = F.when(n % 10 == 9, "no json").when(n % 10 == 8, '{"recommendation": "perhaps"}').when(n % 10 == 7, "[1]").otherwise(good)
    fix = asked.select("request_hash", text.alias("text"), F.lit("m").alias("model_id"), F.lit("1").alias("model_version"), F.when(n % 10 == 6, "timeout").alias("error"))
    a = advise.assess(q, fix, "identity")
    return a.select("match_id", "abstained", "recommendation", "confidence", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.size("contradictions").alias("contradictions"), "model_id")


def semantic_audit_ids(spark, d):
    m = table(spark, d, "match_results").filter("left_key is not null and right_key is not null")
    action = F.coalesce(decide.risk_route(F.col("probability"), F.col("calibration_key.consequence_class")), F.lit("REJECT"))
    rows = m.select("match_id", F.concat(F.lit("tr_"), (F.col("match_id") % 100).cast("string")).alias("trace_id"), F.col("left_key").alias("left"), F.col("right_key").alias("right"), action.alias("baseline"), action.alias("final"), F.when(F.col("match_id") % 2 == 0, F.concat(F.lit("pl_"), _text("match_id"))).alias("plan_id"), F.when(F.col("match_id") % 3 == 0, F.array(F.lit("t1"), F.lit("t2"))).alias("trigger_targets"), F.struct("match_id", "probability").alias("inputs"))
    r = audit.semantic_records(rows, F.struct(F.lit("rules/1").alias("matcher_version")), NOW)
    back = audit.read_semantic(r, "match_id bigint, probability double", "x string")
    return back.select("audit_id", "final", F.array_join("affected_refs", ",").alias("affected_refs"), F.col("er.match_id").alias("match_id"), F.col("assertion").isNull().alias("is_er"))


def assertion_audit_ids(spark, d):
    a = table(spark, d, "assertion_audit").filter("audit_id is not null and final_kind is not null").dropDuplicates(["audit_id"])
    rows = a.select("trace_id", F.col("baseline_kind").alias("baseline"), F.col("final_kind").alias("final"), "plan_id", "assertion_ids", "operation_ids", "source_candidate_ids", F.when(F.col("trigger_id").isNotNull(), F.array("trigger_id")).alias("trigger_targets"), F.struct(F.col("audit_id").alias("source")).alias("inputs"))
    r = audit.semantic_records(rows, F.struct(F.lit("1").alias("policy_version")), NOW, "ASSERTION")
    return audit.read_semantic(r, "x string", "source string").select(F.col("assertion.source").alias("source"), "audit_id", F.array_join("affected_refs", ",").alias("affected_refs"))


def builtin_profiles(spark, d):
    p = profiles.builtin_profiles(spark)
    ok = decide.auto_link_permitted(F.col("identity_authority_mode"), F.col("er_mode"), F.col("allowable_auto_actions"))
    return p.select("profile_id", "source", "identity_authority_mode", "er_mode", "false_merge_cost_class", "review_priority", F.array_join("allowable_auto_actions", ",").alias("actions"), ok.alias("may_link"))


def calibrated_scores(spark, d):
    m = table(spark, d, "match_results").filter("match_id is not null")
    f = m.select("match_id", F.col("calibration_key.consequence_class").alias("cost"), "feature_vector.*")
    models = spark.createDataFrame([("HIGH", {"name_similarity": 2.0, "identifier_agreement": 5.0}, -3.0), ("LOW", {"name_similarity": 4.0}, -1.0)], "cost string, weights map<string,double>, intercept double")
    out = features.calibrated_scores(f, models, ["cost"], {"name_similarity": 3.0, "mutually_exclusive": -8.0}, -2.0)
    return out.select("match_id", F.round("probability", 6).alias("probability"))


def calibration_keys(spark, d):
    m = table(spark, d, "match_results").filter("left_key is not null and right_key is not null")
    k = features.calibration_key(F.lit("g"), F.lit("t"), F.col("left_key"), F.col("right_key"), F.col("matcher_version"), F.lit("LOW"))
    return m.select(k.alias("k")).groupBy(F.col("k.source_pair.a").alias("a"), F.col("k.source_pair.b").alias("b"), F.col("k.matcher_version").alias("version")).agg(F.count("*").alias("n"))


def er_metrics(spark, d):
    m = table(spark, d, "match_results").filter("probability is not null").select("match_id", "probability", F.col("link_kind").eqNullSafe("SAME_AS").alias("is_match"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("member"), F.col("label").alias("gc"), (F.col("label") * 3 + F.col("vec_id") % 3).alias("pc"))
    out = evaluate.er_metrics(m, v.select(F.col("pc").alias("cluster_id"), "member"), v.select(F.col("gc").alias("cluster_id"), "member"), m.select((F.col("match_id") % 5 == 0).alias("abstained")), 0.9)
    return out.select("count", *[F.round(c, 6).alias(c) for c in out.columns if c != "count"])


def pending_triggers(spark, d):
    t = table(spark, d, "curation_triggers").filter("trigger_id is not null").groupBy("trigger_id").agg(F.min("stored_at").alias("at"))
    items = t.select(F.col("trigger_id").alias("item_id"), F.struct("at", "trigger_id").alias("seq"))
    done = table(spark, d, "evolution_results").filter("trigger_id is not null").select(F.col("trigger_id").alias("item_id")).distinct()
    return backlog.pending(items, done, 50).select("item_id")


def review_views(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("item_id"), F.when(F.col("event_id") % 4 == 0, "broken {").otherwise(F.concat(F.lit('{"proposed_action": "LINK", "risk": '), F.round("value", 2).cast("string"), F.lit(', "source": "src'), (F.col("event_id") % 9).cast("string"), F.lit('"}'))).alias("payload"))
    return review.item_views(e).select("item_id", "proposed_action", "case_source", F.round("risk", 4).alias("risk"), "trace_id")


def affected_by_candidate(spark, d):
    c = _latest(table(spark, d, "candidates")).select("candidate_id", "semantic_key", F.filter("evidence_refs", lambda e: e["evidence_id"].isNotNull()).alias("evidence_refs"))
    alias = table(spark, d, "candidates").filter("semantic_key is not null").select(F.col("semantic_key").alias("key")).distinct().withColumn("identity_id", F.concat(F.lit("id:"), "key"))
    res = table(spark, d, "evolution_results").select(F.explode("evidence_ids").alias("evidence_id"), "trigger_id").filter("evidence_id is not null and trigger_id is not null").select("evidence_id", F.col("trigger_id").alias("assertion_id")).distinct()
    own = table(spark, d, "curation_triggers").filter("trigger_id is not null").groupBy(F.col("trigger_id").alias("assertion_id")).agg(F.min("trace_id").alias("identity_id")).filter("identity_id is not null")
    return targeting.affected_by_candidate(c, alias, res, own)


def affected_by_entity(spark, d):
    keys = table(spark, d, "clusters").select(F.explode("members").alias("key")).filter("key is not null").distinct()
    alias = table(spark, d, "normalized_entities").filter("source_key is not null and entity_type in ('Concept', 'Paper')").select(F.col("source_key").alias("key")).distinct().withColumn("identity_id", F.concat(F.lit("id:"), "key"))
    known = table(spark, d, "match_results").select(F.col("left_key").alias("identity_id")).filter("identity_id is not null")
    return targeting.affected_by_entity(keys, alias, known)


def orcids(spark, d):
    c = table(spark, d, "customer")
    raw = F.concat(F.lit(" https://orcid.org/0000-"), F.lpad(_text("c_custkey"), 4, "0"), F.lit("-000"), F.when(F.col("c_custkey") % 2 == 0, "x").otherwise("7"), F.lit(" "))
    return c.select("c_custkey", normalize.normalize_identifier(F.lit("orcid"), raw).alias("orcid"), normalize.normalize_identifier(F.lit("isbn"), F.concat(F.lit("  ISBN "), _text("c_custkey"))).alias("isbn"), normalize.typed_float(F.when(F.col("c_custkey") % 3 == 0, "true").when(F.col("c_custkey") % 3 == 1, _text("c_acctbal")).otherwise('"7"')).alias("number"))


def dispositions(spark, d):
    c = _candidates(spark, d)
    return c.groupBy("candidate_kind", route.identity_disposition(F.col("candidate_kind"), F.col("subject"), F.col("object")).alias("disposition")).agg(F.count("*").alias("n"))


def current_assertions(spark, d):
    p = table(spark, d, "plan_operations").filter("operation_id is not null and stored_at is not null").select(F.col("operation_id").alias("assertion_id"), F.unix_micros("stored_at").alias("epoch"), F.coalesce("op_index", F.lit(0)).alias("op_index"), "op_type")
    return executor.current_assertions(p).select("assertion_id", "epoch", "op_index")


QUERIES = {f.__name__: f for f in (
    curate_outcomes, curate_operations, curate_audit, record_ids, next_records, compensation_payloads, compensation_guards, plan_evidence, execution_outcomes, evolution_operations, evolution_decisions, evolution_refused, superseded_pointers, merge_plans, review_plans,
    ontology_promotions, adviser_requests, adviser_assessments, semantic_audit_ids, assertion_audit_ids, builtin_profiles, calibrated_scores, calibration_keys, er_metrics, pending_triggers, review_views, affected_by_candidate, affected_by_entity, orcids, dispositions, current_assertions,
)}

_REF = lambda s: f"CASE WHEN substr(sha256('{s}' || candidate_id), 1, 1) < '8' THEN 'kg://g1/identity/' || " + _token(f"'{s}' || candidate_id") + f" ELSE 'Type:ns:' || candidate_id END"
_CUR = rf"""
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY stored_at DESC NULLS LAST, removed_at DESC NULLS LAST, candidate_kind NULLS LAST, graph_id NULLS LAST, semantic_key NULLS LAST, producer NULLS LAST) AS nn FROM candidates WHERE candidate_id IS NOT NULL) WHERE nn = 1),
v AS (SELECT *, coalesce(trace_id, 'none') AS batch_id, substr(sha256('s' || candidate_id), 1, 1) < '8' AS ks, substr(sha256('o' || candidate_id), 1, 1) < '8' AS ko, {_REF("s")} AS subject, candidate_kind IS NULL OR candidate_kind NOT IN ('entity', 'relation', 'attribute_assertion', 'artifact') AS b1,
  NOT coalesce(regexp_matches(graph_id, '^[a-z][a-z0-9_-]*$'), false) OR producer IS NULL OR regexp_replace(producer, '[\s\p{{Z}}]', '', 'g') = ''
  OR NOT coalesce(regexp_matches(contract_version, '^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$') AND split_part(contract_version, '.', 1)::BIGINT = 2 AND split_part(contract_version, '.', 2)::BIGINT <= 3, false) AS b2 FROM c),
r AS (SELECT *, CASE candidate_kind WHEN 'entity' THEN 'NEW_IDENTITY' WHEN 'artifact' THEN 'RESOLVED_EXISTING' WHEN 'relation' THEN CASE WHEN ks AND ko THEN 'RESOLVED_EXISTING' ELSE 'UNRESOLVED' END ELSE CASE WHEN ks THEN 'RESOLVED_EXISTING' ELSE 'UNRESOLVED' END END AS disposition FROM v WHERE NOT b1 AND NOT b2),
q AS (SELECT *, CASE WHEN coalesce(scores.policy_risk, 0) >= 0.5 THEN 'HUMAN' WHEN coalesce(scores.extraction_confidence >= 0.95, false) AND coalesce(scores.source_reliability >= 0.9, false) AND coalesce(scores.policy_risk, 0) <= 0.2
  AND CASE WHEN scores.identity_confidence IS NULL THEN disposition = 'NEW_IDENTITY' ELSE scores.identity_confidence >= 0.95 END THEN 'AUTO' WHEN coalesce(scores.extraction_confidence >= 0.8, false) THEN 'LLM_ASSESS' ELSE 'HUMAN' END AS base FROM r),
f AS (SELECT *, CASE WHEN disposition = 'UNRESOLVED' AND base = 'AUTO' THEN 'LLM_ASSESS' ELSE base END AS route FROM q),
g AS (SELECT *, route = 'AUTO' AND candidate_kind = 'entity' AS fresh, CASE WHEN route = 'AUTO' AND candidate_kind = 'entity' THEN 'kg://' || graph_id || '/identity/' || {_token("candidate_id")} WHEN candidate_kind IN ('relation', 'attribute_assertion') AND disposition = 'RESOLVED_EXISTING' THEN subject END AS identity_id FROM f),
o AS (SELECT *, CASE WHEN candidate_kind = 'entity' THEN 'CREATE_IDENTITY' ELSE 'ATTACH_ASSERTION' END AS op_type FROM g WHERE route = 'AUTO' AND candidate_kind <> 'artifact' AND (candidate_kind = 'entity' OR disposition = 'RESOLVED_EXISTING')),
p AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY candidate_id) - 1 AS op_index, 'op_' || {_token("candidate_id || ':' || op_type")} AS operation_id FROM o)
"""
_SEED = _fact("'customer/' || o_custkey", "'order_status'") + """ || chr(0) || 'record' || chr(0) || '"' || {value} || '"' || chr(0) || 'null' || chr(0) || '{{"valid_from":' || CASE WHEN o_orderkey % 5 = 0 THEN '"' || strftime(o_orderdate, '%Y-%m-%d') || '"' ELSE 'null' END || ',"valid_to":null}}' || chr(0)
  || '["orders",' || CASE WHEN o_orderkey % 3 <> 0 THEN '"' || o_orderkey || '"' ELSE 'null' END || ']' || chr(0) || CASE WHEN o_orderkey % 2 = 0 THEN '[["ev_' || o_orderkey || '","SUPPORTS"]]' ELSE '[]' END"""
_OPS = """o AS (SELECT 'b' || o_custkey AS plan, o_orderkey AS k, 'cand_o_' || o_orderkey AS cand, 'customer/' || o_custkey AS subject, o_orderstatus AS value, o_orderdate AS made FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus IS NOT NULL),
ops AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY k, cand) - 1 AS i FROM o)"""
_AS = f"""{_fact("subject", "'order_status'")} || chr(0) || 'record' || chr(0) || '"' || value || '"' || chr(0) || 'null' || chr(0) || '{{"valid_from":null,"valid_to":null}}' || chr(0) || '["orders","' || k || '"]' || chr(0) || '[["ev_' || k || '","SUPPORTS"]]'"""
_EVO = """x AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey ELSE o_orderkey + 1 END AS n, o_orderkey % 4 AS r, CASE WHEN o_orderkey % 4 = 0 THEN 'CORROBORATION' WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 <> 0 THEN 'SUPERSESSION' ELSE 'CONFLICT' END AS kind FROM orders),
y AS (SELECT *, CASE WHEN kind <> 'SUPERSESSION' THEN NULL WHEN k = n THEN 'self' WHEN (k % 11 = 0) <> (n % 11 = 0) THEN 'cross-fact' WHEN k % 17 = 0 THEN 'not active' END AS why FROM x)"""
_EVOP = """z AS (SELECT *, 0 AS i, 'ATTACH_ASSERTION' AS t, 'as_' || n AS a FROM y WHERE why IS NULL UNION ALL SELECT *, 1, 'RETRACT_ASSERTION', 'as_' || k FROM y WHERE why IS NULL AND kind = 'SUPERSESSION')"""
_PLAN = lambda trg, kind: "'pl_' || " + _token(f"'recur:' || {trg} || ':' || {kind}")
_Q = f"""q AS (SELECT match_id, left_key, right_key, CASE WHEN match_id % 4 <> 0 THEN ['ev_' || (match_id % 10), 'ev_x'] ELSE [] END AS ids, match_id % 3 = 0 AS shown, CASE WHEN match_id % 3 = 0 THEN '2+evidence' ELSE '1' END AS pv FROM match_results WHERE left_key IS NOT NULL AND right_key IS NOT NULL),
p AS (SELECT *, '{advise.INSTRUCTION}' || chr(10) || CASE WHEN shown THEN '{advise.NOTICE}' || chr(10) ELSE '' END || 'kind: identity' || chr(10) || 'subject: ' || left_key || chr(10) || 'other: ' || right_key || chr(10) || 'evidence_ids: ' || array_to_string(ids, ', ') || chr(10)
  || CASE WHEN shown THEN '[ev] line' || chr(10) ELSE '' END || CASE WHEN match_id % 5 = 0 THEN 'context: said' || chr(10) ELSE '' END || 'allowed_recommendations: different, insufficient_evidence, same' AS prompt FROM q),
h AS (SELECT *, sha256('identity_resolution' || chr(0) || pv || chr(0) || prompt || chr(0) || array_to_string(ids, chr(10)) || chr(0)) AS rh FROM p)"""

SQL = {
    "curate_outcomes": f"""WITH {_CUR} SELECT candidate_id, true AS valid, NULL::VARCHAR AS failure_kind, disposition, route, identity_id, fresh AS create_new_identity FROM g
      UNION ALL SELECT candidate_id, false, CASE WHEN b2 THEN 'BAD_DATA' ELSE 'UNSUPPORTED_ONTOLOGY' END, NULL, NULL, NULL, NULL FROM v WHERE b1 OR b2""",
    "curate_operations": f"WITH {_CUR} SELECT batch_id, op_index, operation_id, op_type, candidate_id, CASE WHEN fresh THEN identity_id END AS revokes, NOT fresh AS retracts FROM p",
    "curate_audit": f"""WITH {_CUR} SELECT 'au_' || {_token("operation_id || ':audit'")} AS audit_id, operation_id, trace_id, (scores.extraction_confidence IS NOT NULL)::INT + (scores.source_reliability IS NOT NULL)::INT + (scores.identity_confidence IS NOT NULL)::INT + (scores.policy_risk IS NOT NULL)::INT AS scores,
      coalesce(len(evidence_refs), 0) AS evidence, epoch_us(TIMESTAMP '2025-06-01 00:00:00') AS recorded_at FROM p""",
    "record_ids": f"SELECT 'old_' || o_orderkey AS assertion_id, {_fact(chr(39) + 'customer/' + chr(39) + ' || o_custkey', chr(39) + 'order_status' + chr(39))} AS fact, 'as_' || {_token(_SEED.format(value='o_orderstatus'))} AS record_id FROM orders",
    "next_records": f"""SELECT 'old_' || o_orderkey AS prior_id, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'F' THEN 'as_' || {_token(_SEED.format(value="'F'"))} END AS assertion_id, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'F' THEN 'ACTIVE' ELSE 'REPLAY' END AS status FROM orders""",
    "compensation_payloads": f"""WITH {_OPS}, u AS (SELECT *, 'op_' || {_token("cand || ':ATTACH_ASSERTION'")} AS undoes FROM ops) SELECT 'pl_' || {_token("plan || ':compensate'")} AS plan_id, row_number() OVER (PARTITION BY plan ORDER BY i DESC) - 1 AS op_index, 'op_' || {_token("undoes || ':compensate'")} AS operation_id, 'RETRACT_ASSERTION' AS op_type,
      undoes, 'as_' || {_token(_AS)} AS assertion_id, 'SUPERSEDED' AS new_status, strftime(made, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS superseded_at, value AS restores FROM u""",
    "compensation_guards": f"""WITH {_OPS} SELECT 'pl_' || {_token("plan || ':compensate'")} AS plan_id, 'snapshot_version' AS kind, subject, '7' AS expected FROM (SELECT plan, min('op_' || {_token("cand || ':ATTACH_ASSERTION'")}) AS subject FROM ops GROUP BY plan)""",
    "plan_evidence": f"WITH {_OPS} SELECT plan AS plan_id, string_agg('ev_' || k, ',' ORDER BY i) AS evidence_ids FROM ops GROUP BY 1",
    "execution_outcomes": f"""WITH s AS (SELECT *, op_type NOT IN ('CREATE_IDENTITY', 'ATTACH_ASSERTION', 'REVOKE_IDENTITY', 'RESTORE_IDENTITY', 'RETRACT_ASSERTION') AS odd FROM plan_operations WHERE plan_id IS NOT NULL),
      pl AS (SELECT plan_id FROM s UNION SELECT plan.plan_id FROM evolution_results WHERE plan.plan_id IS NOT NULL),
      n AS (SELECT plan_id, count(*) AS operations, array_to_string(list_sort(list_distinct(list(op_type) FILTER (WHERE odd))), ',') AS types, count(*) FILTER (WHERE op_type = 'ATTACH_ASSERTION' AND operation_id IN (SELECT operation_id FROM s WHERE substr(sha256(operation_id), 1, 1) = '0')) AS there FROM s GROUP BY 1),
      w AS (SELECT DISTINCT plan_id FROM (SELECT plan_id, operation_id FROM s WHERE op_type = 'ATTACH_ASSERTION' GROUP BY 1, 2 HAVING count(*) > 1)),
      o AS (SELECT pl.plan_id, coalesce(operations, 0) AS operations, coalesce(types, '') AS unsupported_types, CASE WHEN operations IS NULL THEN 'EMPTY' WHEN types <> '' THEN 'UNSUPPORTED_OPERATION' WHEN w.plan_id IS NOT NULL THEN 'ERROR' WHEN there > 0 OR substr(sha256(pl.plan_id), 1, 1) >= 'c' THEN 'STALE' ELSE 'COMMITTED' END AS outcome FROM pl LEFT JOIN n ON n.plan_id = pl.plan_id LEFT JOIN w ON w.plan_id = pl.plan_id)
      SELECT plan_id, outcome, 'ex_' || {_token("plan_id || ':exec:' || outcome || CASE WHEN outcome = 'COMMITTED' THEN ':5' ELSE '' END")} AS execution_id, CASE WHEN outcome = 'COMMITTED' THEN 'mb_' || {_token("plan_id")} END AS batch_id, CASE WHEN outcome = 'COMMITTED' THEN 5 END AS new_epoch, operations, unsupported_types FROM o""",
    "evolution_operations": f"""WITH {_EVO}, {_EVOP} SELECT {_PLAN("'trg_' || k", "kind")} AS plan_id, i AS op_index, 'op_' || {_token("'recur:trg_' || k || ':' || t || ':' || a")} AS operation_id, t AS op_type, a AS assertion_id, CASE WHEN i = 1 THEN 'as_' || n END AS superseded_by, CASE WHEN i = 1 THEN 'ACTIVE' END AS restores FROM z""",
    "evolution_decisions": f"""WITH {_EVO} SELECT 'trg_' || k AS trigger_id, kind, kind = 'CONFLICT' AS review_required, kind = 'CONFLICT' AS has_conflict, {_PLAN("'trg_' || k", "kind")} AS plan_id, CASE WHEN kind = 'SUPERSESSION' THEN 'as_' || k || ',' ELSE '' END || 'as_' || n AS assertion_ids,
      'ev_' || (k % 7) || CASE WHEN k % 7 = 1 THEN '' ELSE ',ev_1' END || CASE WHEN k = k % 7 OR k = 1 THEN '' ELSE ',ev_' || k END AS evidence_ids FROM y WHERE why IS NULL""",
    "evolution_refused": f"WITH {_EVO} SELECT 'trg_' || k AS trigger_id, 'as_' || k AS old_id, 'as_' || n AS new_id, why AS refused FROM y WHERE why IS NOT NULL",
    "superseded_pointers": f"""WITH {_EVO}, {_EVOP} SELECT 'op_' || {_token("'recur:trg_' || k || ':' || t || ':' || a")} AS operation_id, 'as_' || n AS successor FROM z WHERE i = 1""",
    "merge_plans": f"""WITH m AS (SELECT DISTINCT plan.cluster_id AS cluster_id, unnest(plan.members) AS member FROM evolution_results WHERE kind = 'MERGE' AND plan.cluster_id IS NOT NULL), r AS (SELECT source_key, max(source_reliability) AS rel FROM normalized_entities GROUP BY 1),
      k AS (SELECT m.*, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(rel, -1) DESC, member) AS n FROM m LEFT JOIN r ON r.source_key = m.member WHERE member IS NOT NULL), s AS (SELECT cluster_id, min(member) FILTER (WHERE n = 1) AS "into", string_agg(member, ',' ORDER BY member) FILTER (WHERE n > 1) AS merged FROM k GROUP BY 1)
      SELECT cluster_id, "into", merged, 'op_' || {_token("'recur:' || cluster_id || ':MERGE_IDENTITIES:' || " + chr(34) + "into" + chr(34))} AS operation_id FROM s WHERE merged IS NOT NULL""",
    "review_plans": f"""WITH e AS (SELECT event_id AS k, (['APPROVE', 'REJECT', 'EDIT', 'SPLIT', 'RELABEL', 'LINK', 'MERGE_ELSEWHERE', 'SAME_CONCEPT_DIFFERENT_SCOPE', 'ODD'])[1 + event_id % 9] AS action, (['MERGE', 'SPLIT', 'RELABEL', 'PROMOTION', 'CONFLICT', NULL])[1 + (event_id // 9) % 6] AS pk FROM events),
      j AS (SELECT *, CASE WHEN action IN ('APPROVE', 'EDIT') THEN pk WHEN action = 'SPLIT' THEN 'SPLIT' WHEN action IN ('RELABEL', 'SAME_CONCEPT_DIFFERENT_SCOPE') THEN 'RELABEL' WHEN action IN ('LINK', 'MERGE_ELSEWHERE') THEN 'MERGE' END AS kd, CASE WHEN k % 4 = 0 THEN k % 3 + 1 WHEN k % 5 <> 0 THEN k % 4 + 1 ELSE 0 END AS mem FROM e),
      f AS (SELECT *, CASE WHEN action = 'REJECT' THEN NULL WHEN action = 'ODD' THEN 'unroutable review action' WHEN action = 'EDIT' AND kd IS NULL THEN 'cannot EDIT a proposal without a proposed_kind' WHEN kd = 'MERGE' AND mem < 2 THEN 'MERGE requires at least two members'
        WHEN kd = 'SPLIT' AND (k % 7 = 0 OR (k % 8 = 0 AND NOT (action = 'EDIT' AND k % 6 = 0))) THEN 'SPLIT requires split_source and split_into' WHEN kd = 'RELABEL' AND k % 11 = 0 THEN 'RELABEL requires a label_assertion' WHEN kd = 'PROMOTION' AND k % 13 = 0 THEN 'PROMOTION requires a promotion_candidate' WHEN kd = 'CONFLICT' THEN 'no review routing for evolution kind CONFLICT' END AS error FROM j),
      g AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN kd IS NOT NULL THEN {_PLAN("'trg_' || k", "kd")} WHEN action = 'APPROVE' AND k % 2 = 0 THEN 'pl_' || k END AS plan_id FROM f)
      SELECT k AS item_id, action, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN plan_id IS NOT NULL THEN 'PLANNED' ELSE 'RECORDED_NO_PLAN' END AS status, CASE WHEN error IS NULL THEN kd END AS kind, plan_id, error FROM g""",
    "ontology_promotions": f"""WITH t AS (SELECT 'ot_' || substr(sha256('g1::class::part ' || p_partkey), 1, 24) AS term_id, 'trg_' || p_size AS trg FROM part WHERE p_size % 3 = 0) SELECT term_id, 'pl_' || {_token("'promote_ontology:' || trg || ':' || term_id")} AS plan_id, 'op_' || {_token("'promote_ontology:' || trg || ':' || term_id")} AS operation_id, 'PROMOTE_ONTOLOGY_TERM' AS op_type FROM t""",
    "adviser_requests": f"WITH {_Q} SELECT match_id, pv AS prompt_version, sha256(prompt) AS prompt_hash, rh AS request_hash FROM h",
    "adviser_assessments": f"""WITH {_Q}, n AS (SELECT rh, min(match_id) AS n FROM h GROUP BY 1), j AS (SELECT h.match_id, h.ids, n.n, n.n % 10 >= 6 AS bad FROM h JOIN n ON n.rh = h.rh)
      SELECT match_id, bad AS abstained, CASE WHEN bad THEN 'insufficient_evidence' WHEN n % 2 = 0 THEN 'same' ELSE 'different' END AS recommendation, CASE WHEN NOT bad THEN CASE n % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 END END AS confidence,
        CASE WHEN bad THEN array_to_string(ids, ',') WHEN len(ids) > 0 THEN 'ev_x' ELSE '' END AS evidence_ids, CASE WHEN bad THEN 0 ELSE 1 END AS contradictions, CASE WHEN n % 10 = 6 THEN 'unavailable' ELSE 'm' END AS model_id FROM j""",
    "semantic_audit_ids": f"""WITH m AS (SELECT *, calibration_key.consequence_class AS cost FROM match_results WHERE left_key IS NOT NULL AND right_key IS NOT NULL), a AS (SELECT *, coalesce({_RISK}, 'REJECT') AS final FROM m)
      SELECT 'au_' || {_token("'semantic:tr_' || (match_id % 100) || ':' || left_key || ':' || right_key || ':' || final || ':' || CASE WHEN match_id % 2 = 0 THEN 'pl_' || match_id ELSE '' END")} AS audit_id, final, CASE WHEN match_id % 3 = 0 THEN 't1,t2' ELSE left_key || ',' || right_key END AS affected_refs, match_id, true AS is_er FROM a""",
    "assertion_audit_ids": f"""WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY audit_id) AS n FROM assertion_audit WHERE audit_id IS NOT NULL AND final_kind IS NOT NULL) WHERE n = 1)
      SELECT audit_id AS source, 'au_' || {_token("'semantic:assertion:' || coalesce(trace_id, '') || ':' || final_kind || ':' || coalesce(plan_id, '') || ':' || coalesce(array_to_string(assertion_ids, ','), '')")} AS audit_id,
        array_to_string(list_concat(CASE WHEN trigger_id IS NOT NULL THEN [trigger_id] ELSE [] END, [x for x, i in coalesce(assertion_ids, []) if x IS DISTINCT FROM trigger_id AND list_position(assertion_ids, x) = i]), ',') AS affected_refs FROM a""",
    "builtin_profiles": """SELECT * FROM (VALUES ('default', NULL, 'OPEN', 'ACTIVE', 'STANDARD', 'P3', 'AUTO_LINK,RETAIN_SEPARATE', true), ('projection_consumer', 'projection', 'OPEN', 'INERT', 'LOW', 'P3', '', false), ('client_authoritative', NULL, 'CLIENT_AUTHORITATIVE', 'ADVISORY', 'HIGH', 'P1', '', false))
      t(profile_id, source, identity_authority_mode, er_mode, false_merge_cost_class, review_priority, actions, may_link)""",
    "calibrated_scores": """WITH z AS (SELECT match_id, CASE calibration_key.consequence_class WHEN 'HIGH' THEN -3 + coalesce(feature_vector.identifier_agreement * 5, 0) + coalesce(feature_vector.name_similarity * 2, 0) WHEN 'LOW' THEN -1 + coalesce(feature_vector.name_similarity * 4, 0) ELSE -2 + coalesce(feature_vector.mutually_exclusive * -8, 0) + coalesce(feature_vector.name_similarity * 3, 0) END AS z FROM match_results WHERE match_id IS NOT NULL)
      SELECT match_id, round(1 / (1 + exp(-z)), 6) AS probability FROM z""",
    "calibration_keys": r"""WITH k AS (SELECT CASE WHEN contains(left_key, '/') THEN regexp_replace(left_key, '/[^/]*$', '') ELSE left_key END AS l, CASE WHEN contains(right_key, '/') THEN regexp_replace(right_key, '/[^/]*$', '') ELSE right_key END AS r, matcher_version AS version FROM match_results WHERE left_key IS NOT NULL AND right_key IS NOT NULL) SELECT least(l, r) AS a, greatest(l, r) AS b, version, count(*) AS n FROM k GROUP BY 1, 2, 3""",
    "er_metrics": """WITH g AS (SELECT match_id, probability AS p, coalesce(link_kind = 'SAME_AS', false) AS y FROM match_results WHERE probability IS NOT NULL), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p >= 0.9 AND y) AS tp, count(*) FILTER (WHERE p >= 0.9 AND NOT y) AS fp, count(*) FILTER (WHERE p < 0.9 AND y) AS fn, count(*) FILTER (WHERE p < 0.9 AND NOT y) AS tn, avg(abs(p - y::INT)) AS ce, count(*) FILTER (WHERE match_id % 5 = 0) AS ab FROM g),
      v AS (SELECT vec_id, label AS gc, label * 3 + vec_id % 3 AS pc FROM embeddings), k AS (SELECT (SELECT count(*) FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.gc = b.gc AND a.pc = b.pc) AS bp, (SELECT count(*) FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.pc = b.pc) AS pp, (SELECT count(*) FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.gc = b.gc) AS gp)
      SELECT n AS count, round(tp / nullif(tp + fp, 0), 6) AS pairwise_precision, round(tp / nullif(tp + fn, 0), 6) AS pairwise_recall, round(fp / nullif(fp + tn, 0), 6) AS false_merge_rate, round(fn / nullif(fn + tp, 0), 6) AS false_split_rate, round(ce, 6) AS calibration_error, round(bp / nullif(pp, 0), 6) AS cluster_precision, round(bp / nullif(gp, 0), 6) AS cluster_recall, round(ab / nullif(n, 0), 6) AS abstention_rate FROM c, k""",
    "pending_triggers": """WITH t AS (SELECT trigger_id, min(stored_at) AS at FROM curation_triggers WHERE trigger_id IS NOT NULL GROUP BY 1) SELECT trigger_id AS item_id FROM t WHERE trigger_id NOT IN (SELECT trigger_id FROM evolution_results WHERE trigger_id IS NOT NULL) ORDER BY t.at NULLS FIRST, trigger_id LIMIT 50""",
    "review_views": """SELECT event_id::VARCHAR AS item_id, CASE WHEN event_id % 4 <> 0 THEN 'LINK' END AS proposed_action, CASE WHEN event_id % 4 <> 0 THEN 'src' || (event_id % 9) END AS case_source, CASE WHEN event_id % 4 <> 0 THEN round(value, 2) END AS risk, NULL::VARCHAR AS trace_id FROM events""",
    "affected_by_candidate": """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY stored_at DESC NULLS LAST, removed_at DESC NULLS LAST, candidate_kind NULLS LAST, graph_id NULLS LAST, semantic_key NULLS LAST, producer NULLS LAST) AS n FROM candidates WHERE candidate_id IS NOT NULL) WHERE n = 1),
      ev AS (SELECT candidate_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT candidate_id, [x.evidence_id for x in evidence_refs if x.evidence_id IS NOT NULL] AS l FROM c)),
      sup AS (SELECT DISTINCT e, trigger_id AS s FROM (SELECT unnest(evidence_ids) AS e, trigger_id FROM evolution_results) WHERE e IS NOT NULL AND trigger_id IS NOT NULL), own AS (SELECT trigger_id AS s, min(trace_id) AS i FROM curation_triggers WHERE trigger_id IS NOT NULL GROUP BY 1 HAVING min(trace_id) IS NOT NULL),
      u AS (SELECT candidate_id, '0.00000000' AS place, 'id:' || semantic_key AS target FROM c WHERE semantic_key IS NOT NULL UNION ALL SELECT candidate_id, '1.' || lpad(pos::VARCHAR, 8, '0') || '.00000000.' || sup.s || '.0', sup.s FROM ev JOIN sup ON sup.e = ev.e
        UNION ALL SELECT candidate_id, '1.' || lpad(pos::VARCHAR, 8, '0') || '.00000000.' || sup.s || '.1', own.i FROM ev JOIN sup ON sup.e = ev.e JOIN own ON own.s = sup.s), f AS (SELECT candidate_id, target, min(place) AS place FROM u GROUP BY 1, 2)
      SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY place, target) - 1 AS pos, target FROM f""",
    "affected_by_entity": """WITH k AS (SELECT DISTINCT x AS key FROM clusters, unnest(members) AS u(x) WHERE x IS NOT NULL), a AS (SELECT DISTINCT source_key AS key FROM normalized_entities WHERE entity_type IN ('Concept', 'Paper') AND source_key IS NOT NULL)
      SELECT key, 'id:' || key AS identity FROM k WHERE key IN (SELECT key FROM a) UNION ALL SELECT key, key FROM k WHERE key NOT IN (SELECT key FROM a) AND key IN (SELECT left_key FROM match_results WHERE left_key IS NOT NULL)""",
    "orcids": """SELECT c_custkey, '0000' || lpad(c_custkey::VARCHAR, 4, '0') || '000' || CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE '7' END AS orcid, 'isbn ' || c_custkey AS isbn, CASE WHEN c_custkey % 3 = 1 THEN c_acctbal END AS number FROM customer""",
    "dispositions": f"""WITH {_CUR} SELECT candidate_kind, CASE candidate_kind WHEN 'entity' THEN 'NEW_IDENTITY' WHEN 'relation' THEN CASE WHEN ks AND ko THEN 'RESOLVED_EXISTING' ELSE 'UNRESOLVED' END WHEN 'attribute_assertion' THEN CASE WHEN ks THEN 'RESOLVED_EXISTING' ELSE 'UNRESOLVED' END ELSE 'RESOLVED_EXISTING' END AS disposition, count(*) AS n FROM v GROUP BY 1, 2""",
    "current_assertions": """WITH p AS (SELECT operation_id AS assertion_id, epoch_us(stored_at) AS epoch, coalesce(op_index, 0) AS op_index FROM plan_operations WHERE operation_id IS NOT NULL AND stored_at IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY assertion_id ORDER BY epoch DESC, op_index DESC) AS n FROM p) SELECT assertion_id, epoch, op_index FROM r WHERE n = 1""",
}
