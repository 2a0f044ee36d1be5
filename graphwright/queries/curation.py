"""Queries of validation, routing, identity, plans, re-curation, review and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.functions import hashing
from graphwright.operators import advise, audit, backlog, decide, evaluate, route, targeting, validate
from graphwright.plans import compensate, evolution, planner, records
from graphwright.session import table

NOW, LATER = "2024-01-31 00:00:00", "2030-01-01 00:00:00"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates")


def validate_candidates(spark, d):
    v = validate.validate(_ids(spark, d))
    return v.groupBy("valid", "failure_kind", F.array_join("reasons", "; ").alias("reasons")).agg(F.count("*").alias("n"))


def version_rule(spark, d):
    c = _ids(spark, d).select("contract_version").distinct()
    return c.select("contract_version", validate.version_compatible(F.col("contract_version")).alias("minor_ok"), validate.version_compatible(F.col("contract_version"), exact=True).alias("exact_ok"))


def route_candidates(spark, d):
    r = route.route_candidates(validate.accepted(validate.validate(_ids(spark, d))))
    return r.select("candidate_id", "disposition", "route", "identity_id", F.size(route.score_vector(F.col("scores"))).alias("scores_present"))


def derived_ids(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", hashing.derived_id("operation", F.col("s_name")).alias("op_id"), hashing.identity_id(F.concat(F.lit("g"), F.col("s_nationkey").cast("string")), F.col("s_name")).alias("identity"))


def fact_keys(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return li.select("l_suppkey", "l_partkey", hashing.fact_key(F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")), F.concat(F.lit("SUPPLIES/"), F.col("l_partkey").cast("string"))).alias("fact"))


def trigger_ids(spark, d):
    return evolution.build_triggers(table(spark, d, "curation_triggers")).select("trigger_id", "trigger_kind", "stored_at", "derived_trigger_id").distinct()


def trigger_queue(spark, d):
    t = evolution.build_triggers(table(spark, d, "curation_triggers")).withColumn("seq", F.struct("stored_at", "trigger_id"))
    first = backlog.first_per_key(t, "derived_trigger_id", "seq")
    return first.groupBy("trigger_kind").agg(F.count("*").alias("queued"))


def _routed(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("batch"), "o_orderkey", "o_orderstatus", "o_orderdate")
    return c.select(
        F.concat(F.lit("b"), F.col("batch").cast("string")).alias("batch_id"), F.col("o_orderkey").alias("input_seq"), F.concat(F.lit("cand_o_"), F.col("o_orderkey").cast("string")).alias("candidate_id"), F.lit("attribute_assertion").alias("candidate_kind"),
        F.when(F.col("o_orderkey") % 7 == 0, "HUMAN").otherwise("AUTO").alias("route"), F.lit(None).cast("string").alias("identity_id"), F.concat(F.lit("customer/"), F.col("batch").cast("string")).alias("subject_identity"), F.lit("order_status").alias("predicate"),
        F.col("o_orderstatus").alias("value"), F.lit(None).cast("string").alias("object_identity"), F.col("o_orderdate").alias("created_at"),
        F.lit("orders").alias("source_type"), F.col("o_orderkey").cast("string").alias("locator"), F.array(F.struct(F.concat(F.lit("ev_"), F.col("o_orderkey").cast("string")).alias("evidence_id"), F.lit("SUPPORTS").alias("relationship"))).alias("evidence_refs"),
    )


def plan_operations_built(spark, d):
    return planner.operations(_routed(spark, d)).select("batch_id", "op_index", "operation_id", "op_type", "candidate_id", "assertion_id", "status")


def plan_ids(spark, d):
    p = planner.plan_ids(planner.operations(_routed(spark, d)), "snap-1", "policy-1")
    return p.select("batch_id", "plan_id", F.size("candidate_ids").alias("candidates"))


def plan_preconditions(spark, d):
    return planner.preconditions(planner.operations(_routed(spark, d)), "snap-1").select("batch_id", "pre_index", "kind", "subject", "expected")


def duplicate_mint_guard(spark, d):
    return planner.duplicate_mints(table(spark, d, "plan_operations"), "plan_id", "operation_id").groupBy("plan_id", "operation_id").agg(F.max("mints").alias("mints"))


def record_backfill_collisions(spark, d):
    li = table(spark, d, "lineitem")
    text = lambda *c: F.concat_ws("/", *[F.col(x).cast("string") for x in c])
    rows = li.select(text("l_orderkey", "l_linenumber", "l_partkey").alias("assertion_id"), F.concat(F.lit("supplier/"), text("l_suppkey")).alias("subject_identity"), F.lit("SUPPLIES").alias("predicate"), F.concat(F.lit("part/"), text("l_partkey")).alias("object_identity"), F.lit("lineitem").alias("source_type"))
    return records.backfill_collisions(rows)


def compensation_plan(spark, d):
    return compensate.compensation(table(spark, d, "plan_operations"))[0]


def not_compensable(spark, d):
    return compensate.compensation(table(spark, d, "plan_operations"))[1]


def _items(spark, d):
    e = table(spark, d, "events")
    prio = F.when(F.col("event_type") == "error", "P1").when(F.col("event_type") == "purchase", "P2").otherwise("P3")
    items = e.select(F.col("event_id").alias("item_id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), F.col("event_type").alias("entity_type"), prio.alias("priority"), (F.col("value") / 500).alias("value"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("snapshot_ref"), F.col("ts").cast("timestamp").alias("enqueued_at"))
    return backlog.with_sla(items, NOW)


def sla_breaches(spark, d):
    return _items(spark, d).groupBy("priority").agg(F.count_if("breach").alias("breaches"), F.count("*").alias("n"))


def backlog_metrics(spark, d):
    return backlog.metrics(_items(spark, d)).withColumn("max_age_hours", F.round("max_age_hours", 4))


def source_backlog(spark, d):
    return backlog.source_backlog(_items(spark, d)).withColumn("max_age_hours", F.round("max_age_hours", 4))


def cluster_backlog(spark, d):
    return backlog.cluster_backlog(_items(spark, d)).withColumn("max_value", F.round("max_value", 6))


def priority_inversion(spark, d):
    return backlog.priority_inversion(_items(spark, d)).groupBy("priority").agg(F.count("*").alias("n"))


def starving_high_value(spark, d):
    return backlog.starving(_items(spark, d)).select("item_id", "priority")


def backpressure(spark, d):
    return backlog.backpressure(_items(spark, d))


def affected_by_trigger(spark, d):
    t = table(spark, d, "curation_triggers")
    res = table(spark, d, "evolution_results")
    support = res.select(F.explode("evidence_ids").alias("evidence_id"), "superseded_assertions").select("evidence_id", F.explode("superseded_assertions").alias("assertion_id")).filter("assertion_id is not null").distinct()
    aud = table(spark, d, "assertion_audit").select(F.explode("assertion_ids").alias("assertion_id"), "plan_id").filter("plan_id is not null").groupBy("assertion_id").agg(F.min("plan_id").alias("identity_id"))
    return targeting.affected_by_trigger(t, support, aud)


def asof_assertions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("fact"), F.col("o_orderkey").alias("assertion_id"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("recorded_at"))
    chain = evolution.supersession_chain(o)
    seen = planner.as_of(chain, at=F.to_timestamp(F.lit("1996-06-30 00:00:00")))
    return seen.groupBy("value").agg(F.count("*").alias("live"))


def supersession_chain(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("fact"), F.col("o_orderkey").alias("assertion_id"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("recorded_at"))
    return evolution.supersession_chain(o).select("fact", "assertion_id", "superseded_by", "status")


def evolution_route(spark, d):
    c = _ids(spark, d).select(F.explode("evidence_refs.relationship").alias("relationship"), F.col("scores.source_reliability").alias("r"))
    return c.select("relationship", evolution.route_assertion(F.col("relationship"), F.col("r") >= 0.8).alias("kind")).groupBy("relationship", "kind").agg(F.count("*").alias("n"))


def ontology_paths(spark, d):
    states = F.array(F.lit("PROPOSED"), F.lit("APPROVED"), F.lit("OBSERVED"), F.lit("DEPRECATED"))
    p = table(spark, d, "part").select("p_partkey", F.transform(F.sequence(F.lit(0), (F.col("p_size") % 4).cast("int")), lambda i: F.get(states, F.when(F.col("p_partkey") % 5 == 0, F.lit(3) - i).when(F.col("p_partkey") % 5 == 1, F.least(i * 2, F.lit(3))).when(F.col("p_partkey") % 5 == 2, F.when(i == 0, F.lit(0)).otherwise(F.lit(3))).otherwise(i))).alias("history"))
    return p.select("p_partkey", F.array_join("history", ">").alias("path"), evolution.legal_history(F.col("history")).alias("legal"), evolution.may_promote(F.col("history")).alias("promotable"))


def render_evidence(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("ev_"), F.col("doc_id").cast("string")).alias("evidence_id"), F.when(F.col("text").isNull(), "ABSENT").otherwise("PRESENT").alias("status"), "text")
    rel = F.when(F.col("doc_id") % 3 == 0, "SUPPORTS").when(F.col("doc_id") % 3 == 1, "CONTRADICTS")
    asked = table(spark, d, "documents").select(F.concat(F.lit("r"), F.pmod("doc_id", F.lit(97)).cast("string")).alias("request_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("ev_"), (F.col("doc_id") * 2).cast("string")).alias("evidence_id"), rel.alias("relationship"))
    r = advise.render_evidence(asked, docs)
    return r.select("request_id", F.sha2(F.array_join("context", "\n"), 256).alias("rendered_hash"), F.size("rendered_ids").alias("found"), F.size("unresolved_ids").alias("unresolved"), "truncated")


def adviser_fold(spark, d):
    m = table(spark, d, "match_results")
    base = m.select(F.col("match_id").alias("pair_id"), decide.risk_route(F.col("probability"), F.col("calibration_key.consequence_class")).alias("baseline"), (F.col("match_id") % 3 != 0).alias("auto_allowed"), F.when(F.col("match_id") % 7 == 0, "INERT").otherwise("ACTIVE").alias("er_mode")).filter("baseline is not null")
    said = m.select(F.col("match_id").alias("pair_id"), F.when(F.col("link_kind") == "SAME_AS", "same").when(F.col("link_kind").isNull(), "different").otherwise("insufficient_evidence").alias("recommendation"), (F.col("match_id") % 5 == 0).alias("abstained"))
    return decide.fold_assessments(base, said).groupBy("baseline", "final", "consulted").agg(F.count("*").alias("n"))


def review_metrics(spark, d):
    r = table(spark, d, "evolution_results").select(F.when(F.col("review_required"), "RECORDED").otherwise("PLANNED").alias("status"), F.when(F.col("kind") == "CONFLICT", "REJECT").otherwise("APPROVE").alias("action"), F.col("removed_at").isNotNull().alias("rolled_back"), ((F.unix_micros(F.coalesce("removed_at", F.to_timestamp(F.lit(LATER)))) - F.unix_micros("stored_at")) / 3.6e9).alias("age_hours"))
    out = evaluate.curation_metrics(r)
    return out.select("reviewed", *[F.round(c, 6).alias(c) for c in ("review_yield", "agreement", "rollback_frequency", "mean_age_hours")])


def replay_check(spark, d):
    m = table(spark, d, "match_results")
    action = decide.risk_route(F.col("probability"), F.col("calibration_key.consequence_class"))
    return audit.replay(m, decide.link_kind(action), "link_kind").groupBy("reproduced").agg(F.count("*").alias("n"))


def audit_refs(spark, d):
    a = table(spark, d, "assertion_audit")
    return audit.refs(a, "assertion_ids", "assertion_id").groupBy("audit_id").agg(F.count("*").alias("refs"))


QUERIES = {f.__name__: f for f in (
    validate_candidates, version_rule, route_candidates, derived_ids, fact_keys, trigger_ids, trigger_queue, plan_operations_built, plan_ids, plan_preconditions, duplicate_mint_guard, record_backfill_collisions, compensation_plan,
    not_compensable, sla_breaches, backlog_metrics, source_backlog, cluster_backlog, priority_inversion, starving_high_value, backpressure, affected_by_trigger, asof_assertions, supersession_chain, evolution_route, ontology_paths,
    render_evidence, adviser_fold, review_metrics, replay_check, audit_refs,
)}

_TOKEN = "array_to_string([substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', 1 + ('0b' || substr(b, 1 + 5 * i, 5))::INT, 1) for i in range(26)], '')"


def _token(seed: str) -> str:
    bits = f"'00' || array_to_string([lpad(bin(strpos('0123456789abcdef', substr(sha256({seed}), h, 1)) - 1), 4, '0') for h in range(1, 33)], '')"
    one = "substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', 1 + list_sum([2 ** (4 - k) * substr(x.b, 1 + 5 * i + k, 1)::INT for k in range(5)])::INT, 1)"
    return f"(SELECT array_to_string([{one} for i in range(26)], '') FROM (SELECT {bits} AS b) x)"


def _fact(subject: str, predicate: str) -> str:
    return f"'fact_' || substr(sha256({subject} || chr(0) || {predicate}), 1, 32)"


_VALID = r"""
v AS (SELECT *, list_filter([
  CASE WHEN candidate_kind IS NULL OR candidate_kind NOT IN ('entity', 'relation', 'attribute_assertion', 'artifact') THEN 'unsupported kind' END,
  CASE WHEN NOT coalesce(regexp_matches(graph_id, '^[a-z][a-z0-9_-]*$'), false) THEN 'malformed graph id' END,
  CASE WHEN producer IS NULL OR regexp_replace(producer, '[\s\p{Z}]', '', 'g') = '' THEN 'blank producer' END,
  CASE WHEN NOT coalesce(regexp_matches(contract_version, '^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$') AND split_part(contract_version, '.', 1)::BIGINT = 2 AND split_part(contract_version, '.', 2)::BIGINT <= 3, false) THEN 'incompatible version' END], lambda x: x IS NOT NULL) AS reasons FROM candidates)
"""
_ROUTED = f"""
WITH {_VALID},
r AS (SELECT *, scores.policy_risk AS risk, CASE candidate_kind WHEN 'entity' THEN 'NEW_IDENTITY' WHEN 'artifact' THEN 'RESOLVED_EXISTING' ELSE 'UNRESOLVED' END AS disposition FROM v WHERE len(reasons) = 0),
q AS (SELECT *, CASE WHEN coalesce(risk, 0) >= 0.5 THEN 'HUMAN'
  WHEN coalesce(scores.extraction_confidence >= 0.95, false) AND coalesce(scores.source_reliability >= 0.9, false) AND coalesce(risk, 0) <= 0.2
    AND CASE WHEN scores.identity_confidence IS NULL THEN disposition = 'NEW_IDENTITY' ELSE scores.identity_confidence >= 0.95 END THEN 'AUTO'
  WHEN coalesce(scores.extraction_confidence >= 0.8, false) THEN 'LLM_ASSESS' ELSE 'HUMAN' END AS base FROM r),
f AS (SELECT *, CASE WHEN disposition = 'UNRESOLVED' AND base = 'AUTO' THEN 'LLM_ASSESS' ELSE base END AS route FROM q)
"""
_AS = f"""'fact_' || substr(sha256(subject || chr(0) || 'order_status'), 1, 32) || chr(0) || 'record' || chr(0) || '"' || value || '"' || chr(0) || 'null' || chr(0) || '{{"valid_from":null,"valid_to":null}}' || chr(0) || '["orders","' || input_seq || '"]' || chr(0) || '[["ev_' || input_seq || '","SUPPORTS"]]'"""
_OPS = f"""
o AS (SELECT 'b' || o_custkey AS batch_id, o_orderkey AS input_seq, 'cand_o_' || o_orderkey AS candidate_id, 'customer/' || o_custkey AS subject, o_orderstatus AS value FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus IS NOT NULL),
ops AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY input_seq, candidate_id) - 1 AS op_index FROM o)
"""
_ITEMS = """
i AS (SELECT event_id AS item_id, 'src' || (user_id % 20) AS source, event_type AS entity_type, CASE event_type WHEN 'error' THEN 'P1' WHEN 'purchase' THEN 'P2' ELSE 'P3' END AS priority,
  value / 500 AS value, 'k' || (props::JSON ->> '$.k') AS snapshot_ref, ts FROM events),
s AS (SELECT *, CASE priority WHEN 'P1' THEN 3 WHEN 'P2' THEN 2 ELSE 1 END AS rank, greatest(0.0, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 3.6e9) AS age,
  TIMESTAMP '2024-01-31 00:00:00' > ts + to_hours(CASE priority WHEN 'P1' THEN 24 WHEN 'P2' THEN 168 ELSE 720 END) AS breach FROM i)
"""
_INVERSE = "CASE op_type WHEN 'CREATE_IDENTITY' THEN 'REVOKE_IDENTITY' WHEN 'REVOKE_IDENTITY' THEN 'RESTORE_IDENTITY' WHEN 'RESTORE_IDENTITY' THEN 'REVOKE_IDENTITY' WHEN 'ATTACH_ASSERTION' THEN 'RETRACT_ASSERTION' WHEN 'RETRACT_ASSERTION' THEN 'ATTACH_ASSERTION' WHEN 'MERGE_IDENTITIES' THEN 'SPLIT_IDENTITY' WHEN 'SPLIT_IDENTITY' THEN 'MERGE_IDENTITIES' WHEN 'REASSIGN_ASSERTION' THEN 'REASSIGN_ASSERTION' END"
_CHAIN = """
a AS (SELECT o_custkey AS fact, o_orderkey AS assertion_id, o_orderstatus AS value, o_orderdate AS recorded_at, lag(o_orderstatus) OVER w AS before, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT fact, assertion_id, value, recorded_at, lead(assertion_id) OVER w AS superseded_by, lead(recorded_at) OVER w AS superseded_at FROM a WHERE n = 1 OR before IS DISTINCT FROM value WINDOW w AS (PARTITION BY fact ORDER BY recorded_at, assertion_id))
"""
_RISK = """CASE WHEN 1 - probability <= CASE cost WHEN 'LOW' THEN 0.10 WHEN 'STANDARD' THEN 0.02 WHEN 'HIGH' THEN 0.002 END THEN 'AUTO_LINK'
  WHEN 1 - probability <= CASE cost WHEN 'LOW' THEN 0.40 WHEN 'STANDARD' THEN 0.25 WHEN 'HIGH' THEN 0.10 END THEN 'LLM_ASSESS'
  WHEN 1 - probability >= 0.90 THEN 'RETAIN_SEPARATE' WHEN cost IN ('LOW', 'STANDARD', 'HIGH') THEN 'GATHER_MORE_EVIDENCE' END"""

SQL = {
    "validate_candidates": f"""WITH {_VALID} SELECT len(reasons) = 0 AS valid,
      CASE WHEN list_contains(reasons, 'malformed graph id') OR list_contains(reasons, 'blank producer') OR list_contains(reasons, 'incompatible version') THEN 'BAD_DATA' WHEN len(reasons) > 0 THEN 'UNSUPPORTED_ONTOLOGY' END AS failure_kind,
      array_to_string(reasons, '; ') AS reasons, count(*) AS n FROM v GROUP BY 1, 2, 3""",
    "version_rule": r"""SELECT DISTINCT contract_version, coalesce(regexp_matches(contract_version, '^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$') AND split_part(contract_version, '.', 1) = '2' AND split_part(contract_version, '.', 2)::INT <= 3, false) AS minor_ok, coalesce(contract_version = '2.3.0', false) AS exact_ok FROM candidates""",
    "route_candidates": f"""{_ROUTED} SELECT candidate_id, disposition, route, CASE WHEN route = 'AUTO' AND candidate_kind = 'entity' THEN 'kg://' || graph_id || '/identity/' || {_token("candidate_id")} END AS identity_id,
      (scores.extraction_confidence IS NOT NULL)::INT + (scores.source_reliability IS NOT NULL)::INT + (scores.identity_confidence IS NOT NULL)::INT + (scores.policy_risk IS NOT NULL)::INT AS scores_present FROM f""",
    "derived_ids": f"SELECT s_suppkey, 'op_' || {_token('s_name')} AS op_id, 'kg://g' || s_nationkey || '/identity/' || {_token('s_name')} AS identity FROM supplier",
    "fact_keys": f"SELECT DISTINCT l_suppkey, l_partkey, {_fact(chr(39) + 'supplier/' + chr(39) + ' || l_suppkey', chr(39) + 'SUPPLIES/' + chr(39) + ' || l_partkey')} AS fact FROM lineitem",
    "trigger_ids": """SELECT DISTINCT trigger_id, trigger_kind, stored_at, 'trg_' || substr(sha256(concat_ws('::', trigger_kind, array_to_string(list_sort(coalesce(identity_ids, [])), '|'), array_to_string(list_sort(coalesce(evidence_ids, [])), '|'), coalesce(snapshot_version, ''))), 1, 24) AS derived_trigger_id FROM curation_triggers""",
    "trigger_queue": """WITH t AS (SELECT *, concat_ws('::', trigger_kind, array_to_string(list_sort(coalesce(identity_ids, [])), '|'), array_to_string(list_sort(coalesce(evidence_ids, [])), '|'), coalesce(snapshot_version, '')) AS k FROM curation_triggers)
      SELECT trigger_kind, count(*) AS queued FROM (SELECT trigger_kind, row_number() OVER (PARTITION BY k ORDER BY stored_at, trigger_id) AS n FROM t) WHERE n = 1 GROUP BY 1""",
    "plan_operations_built": f"""WITH {_OPS} SELECT batch_id, op_index, 'op_' || {_token("candidate_id || ':ATTACH_ASSERTION'")} AS operation_id, 'ATTACH_ASSERTION' AS op_type, candidate_id,
      'as_' || {_token(_AS)} AS assertion_id, 'ACTIVE' AS status FROM ops""",
    "plan_ids": f"""WITH {_OPS}, p AS (SELECT batch_id, string_agg(candidate_id, '|' ORDER BY op_index) || '@snap-1#policy-1' AS seed, count(*) AS candidates FROM ops GROUP BY 1) SELECT batch_id, 'pl_' || {_token("seed")} AS plan_id, candidates FROM p""",
    "plan_preconditions": f"""WITH {_OPS} SELECT DISTINCT batch_id, 0 AS pre_index, 'snapshot_version' AS kind, NULL::VARCHAR AS subject, 'snap-1' AS expected FROM ops
      UNION ALL SELECT batch_id, op_index + 1, 'assertion_absent', subject, 'as_' || {_token(_AS)} FROM ops""",
    "duplicate_mint_guard": "SELECT plan_id, operation_id, count(*) AS mints FROM plan_operations WHERE plan_id IS NOT NULL AND operation_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "record_backfill_collisions": f"""WITH g AS (SELECT l_suppkey AS s, l_partkey AS p, count(DISTINCT l_orderkey || '/' || l_linenumber || '/' || l_partkey) AS old_ids, min(l_orderkey || '/' || l_linenumber || '/' || l_partkey) AS least_id FROM lineitem GROUP BY 1, 2)
      SELECT 'as_' || {_token(_fact("'supplier/' || s", "'SUPPLIES'") + """ || chr(0) || 'record' || chr(0) || 'null' || chr(0) || '"part/' || p || '"' || chr(0) || '{"valid_from":null,"valid_to":null}' || chr(0) || '["lineitem",null]' || chr(0) || '[]'""")} AS record_id, old_ids, least_id FROM g WHERE old_ids > 1""",
    "compensation_plan": f"""WITH p AS (SELECT DISTINCT plan_id, op_index, operation_id, op_type FROM plan_operations)
      SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY op_index DESC, operation_id DESC, op_type DESC) - 1 AS op_index, 'op_' || {_token("operation_id || ':compensate'")} AS operation_id, {_INVERSE} AS op_type, operation_id AS undoes FROM p WHERE {_INVERSE} IS NOT NULL""",
    "not_compensable": f"SELECT DISTINCT plan_id, op_index, operation_id, op_type FROM plan_operations WHERE {_INVERSE} IS NULL",
    "sla_breaches": f"WITH {_ITEMS} SELECT priority, count(*) FILTER (WHERE breach) AS breaches, count(*) AS n FROM s GROUP BY 1",
    "backlog_metrics": f"""WITH {_ITEMS} SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(entity_type) = 0 THEN 'entity_type' WHEN grouping(priority) = 0 THEN 'priority' ELSE 'all' END AS "by",
      coalesce(source, entity_type, priority) AS value, count(*) AS depth, round(max(age), 4) AS max_age_hours, count(*) FILTER (WHERE breach) AS breaches FROM s GROUP BY GROUPING SETS ((), (source), (entity_type), (priority))""",
    "source_backlog": f"""WITH {_ITEMS} SELECT source, count(*) AS depth, round(max(age), 4) AS max_age_hours, count(*) FILTER (WHERE breach) AS breaches, count(*) FILTER (WHERE priority = 'P1') AS p1, count(*) FILTER (WHERE priority = 'P2') AS p2, count(*) FILTER (WHERE priority = 'P3') AS p3 FROM s GROUP BY 1""",
    "cluster_backlog": f"WITH {_ITEMS} SELECT snapshot_ref, count(*) AS size, round(max(value), 6) AS max_value, bool_or(breach) AS any_breach FROM s WHERE snapshot_ref IS NOT NULL GROUP BY 1",
    "priority_inversion": f"WITH {_ITEMS} SELECT priority, count(*) AS n FROM s WHERE breach AND rank > (SELECT min(rank) FROM s WHERE NOT breach) GROUP BY 1",
    "starving_high_value": f"WITH {_ITEMS} SELECT item_id, priority FROM s WHERE breach AND value >= 0.7",
    "backpressure": f"""WITH {_ITEMS}, p AS (SELECT source, count(*) AS depth, count(*) FILTER (WHERE breach) AS breaches FROM s GROUP BY 1),
      q AS (SELECT *, sum(depth) OVER () AS total, row_number() OVER (ORDER BY depth DESC, source) AS n FROM p),
      z AS (SELECT source, depth, breaches, CASE WHEN depth >= 75 OR breaches >= 5 THEN 'QUARANTINE' WHEN depth >= 25 THEN 'THROTTLE' WHEN total > 100 AND n = 1 THEN 'THROTTLE' END AS signal FROM q) SELECT * FROM z WHERE signal IS NOT NULL""",
    "affected_by_trigger": """WITH t AS (SELECT trigger_id, coalesce(identity_ids, []) AS i, coalesce(evidence_ids, []) AS e FROM curation_triggers),
      ev AS (SELECT trigger_id, x AS e, min(pos) AS pos FROM (SELECT trigger_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM t) GROUP BY 1, 2),
      sup AS (SELECT DISTINCT e, s FROM (SELECT unnest(evidence_ids) AS e, superseded_assertions AS l FROM evolution_results), unnest(l) AS b(s) WHERE s IS NOT NULL),
      own AS (SELECT s, min(plan_id) AS plan_id FROM (SELECT unnest(assertion_ids) AS s, plan_id FROM assertion_audit WHERE plan_id IS NOT NULL) GROUP BY 1),
      u AS (SELECT trigger_id, '0.' || lpad((generate_subscripts(i, 1) - 1)::VARCHAR, 8, '0') AS place, unnest(i) AS target FROM t
        UNION ALL SELECT ev.trigger_id, '3.' || lpad(pos::VARCHAR, 8, '0') || '.00000000.' || sup.s || '.0', sup.s FROM ev JOIN sup ON sup.e = ev.e
        UNION ALL SELECT ev.trigger_id, '3.' || lpad(pos::VARCHAR, 8, '0') || '.00000000.' || sup.s || '.1', own.plan_id FROM ev JOIN sup ON sup.e = ev.e JOIN own ON own.s = sup.s),
      f AS (SELECT trigger_id, target, min(place) AS place FROM u WHERE target IS NOT NULL GROUP BY 1, 2)
      SELECT trigger_id, row_number() OVER (PARTITION BY trigger_id ORDER BY place, target) - 1 AS pos, target FROM f""",
    "asof_assertions": f"WITH {_CHAIN} SELECT value, count(*) AS live FROM c WHERE recorded_at <= TIMESTAMP '1996-06-30 00:00:00' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '1996-06-30 00:00:00') GROUP BY 1",
    "supersession_chain": f"WITH {_CHAIN} SELECT fact, assertion_id, superseded_by, CASE WHEN superseded_by IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status FROM c",
    "evolution_route": """WITH c AS (SELECT e.relationship AS relationship, scores.source_reliability AS r FROM candidates, unnest(evidence_refs) AS u(e))
      SELECT relationship, CASE WHEN relationship = 'SUPPORTS' THEN 'CORROBORATION' WHEN relationship = 'SUPERSEDES' AND r >= 0.8 THEN 'SUPERSESSION' ELSE 'CONFLICT' END AS kind, count(*) AS n FROM c GROUP BY 1, 2""",
    "ontology_paths": """WITH h AS (SELECT p_partkey, array_to_string([(['PROPOSED', 'APPROVED', 'OBSERVED', 'DEPRECATED'])[1 + CASE p_partkey % 5 WHEN 0 THEN 3 - i WHEN 1 THEN least(i * 2, 3) WHEN 2 THEN CASE WHEN i = 0 THEN 0 ELSE 3 END ELSE i END] for i in range(0, 1 + p_size % 4)], '>') AS path FROM part)
      SELECT p_partkey, path, path IN ('PROPOSED', 'PROPOSED>APPROVED', 'PROPOSED>DEPRECATED', 'PROPOSED>APPROVED>OBSERVED', 'PROPOSED>APPROVED>DEPRECATED', 'PROPOSED>APPROVED>OBSERVED>DEPRECATED') AS legal, path = 'PROPOSED>APPROVED' AS promotable FROM h""",
    "render_evidence": r"""WITH q AS (SELECT 'r' || (doc_id % 97) AS request_id, doc_id AS pos, doc_id * 2 AS k, CASE doc_id % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'CONTRADICTS' ELSE 'UNKNOWN' END AS rel FROM documents),
      j AS (SELECT q.request_id, q.pos, '[ev_' || q.k || '] relationship=' || rel || ', availability=' || CASE WHEN d.doc_id IS NULL THEN 'UNKNOWN: not found in evidence lookup' WHEN d.text IS NULL THEN 'ABSENT: reason=UNSPECIFIED'
          ELSE 'PRESENT: "' || replace(replace(replace(replace(substr(text, 1, 500), '\', '\\'), '"', '\"'), chr(13), '\r'), chr(10), '\n') || CASE WHEN length(text) > 500 THEN '...' ELSE '' END || '"' END AS line, d.doc_id IS NOT NULL AS known, coalesce(length(text) > 500, false) AS cut
        FROM q LEFT JOIN documents d ON d.doc_id = q.k)
      SELECT request_id, sha256(string_agg(line, chr(10) ORDER BY pos)) AS rendered_hash, count(*) FILTER (WHERE known) AS found, count(*) FILTER (WHERE NOT known) AS unresolved, bool_or(cut) AS truncated FROM j GROUP BY 1""",
    "adviser_fold": f"""WITH m AS (SELECT *, calibration_key.consequence_class AS cost FROM match_results), b AS (SELECT *, {_RISK} AS baseline FROM m), c AS (SELECT *, baseline = 'LLM_ASSESS' AND match_id % 5 <> 0 AS consulted FROM b WHERE baseline IS NOT NULL)
      SELECT baseline, CASE WHEN NOT consulted THEN baseline WHEN link_kind IS NULL THEN 'RETAIN_SEPARATE' WHEN link_kind <> 'SAME_AS' THEN 'GATHER_MORE_EVIDENCE' WHEN match_id % 3 <> 0 THEN 'AUTO_LINK' WHEN match_id % 7 = 0 THEN 'RETAIN_SEPARATE' ELSE 'PROPOSE_LINK' END AS final, consulted, count(*) AS n FROM c GROUP BY 1, 2, 3""",
    "review_metrics": """SELECT count(*) AS reviewed, round(count(*) FILTER (WHERE NOT coalesce(review_required, false)) / count(*), 6) AS review_yield, round(count(*) FILTER (WHERE kind <> 'CONFLICT' OR kind IS NULL) / count(*), 6) AS agreement,
      round(count(*) FILTER (WHERE removed_at IS NOT NULL) / count(*), 6) AS rollback_frequency, round(avg((epoch_us(coalesce(removed_at, TIMESTAMP '2030-01-01 00:00:00')) - epoch_us(stored_at)) / 3.6e9), 6) AS mean_age_hours FROM evolution_results""",
    "replay_check": f"""WITH m AS (SELECT *, calibration_key.consequence_class AS cost FROM match_results) SELECT (CASE WHEN {_RISK} = 'AUTO_LINK' THEN 'SAME_AS' END) IS NOT DISTINCT FROM link_kind AS reproduced, count(*) AS n FROM m GROUP BY 1""",
    "audit_refs": "SELECT audit_id, count(DISTINCT a) AS refs FROM assertion_audit, unnest(assertion_ids) AS u(a) WHERE a IS NOT NULL AND audit_id IS NOT NULL GROUP BY 1",
}
