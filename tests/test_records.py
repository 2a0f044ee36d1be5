"""Schemas, registry, review queue, payloads and routed evidence."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from graphwright import engine, registry, schema
from graphwright.operators import advise, audit, contract, evaluate, review, validate
from graphwright.plans import compensate, evolution, executor, planner, records
from graphwright.sources import store


def test_strict_reader(spark, tmp_path):
    spark.range(1).selectExpr("cast(id as string) cluster_id", "id version").write.parquet(str(tmp_path / "a"))
    assert schema.read_strict(spark, str(tmp_path / "a"), "clusters").columns == ["cluster_id", "version"]
    spark.range(1).selectExpr("cast(id as string) cluster_id", "1 odd").write.parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="odd"):
        schema.read_strict(spark, str(tmp_path / "b"), "clusters")


def test_registry():
    assert registry.lookup("matcher", "rules/1")
    with pytest.raises(KeyError):
        registry.register("nothing", "x", print)
    with pytest.raises(KeyError):
        registry.lookup("matcher", "none")


def test_review_queue(spark, tmp_path):
    ddl = "item_id string, priority string, kind string, source string, seq bigint"
    items = spark.createDataFrame([("a", "P1", "k", "s", 1), ("b", None, None, None, 2)], ddl)
    up = review.upsert(items, spark.createDataFrame([("b", "P2", "k", "s", 3), ("c", "P3", "k", "s", 4)], ddl))
    assert sorted((r.item_id, r.priority, r.seq) for r in up.collect()) == [("a", "P1", 1), ("b", "P2", 3), ("c", "P3", 4)]
    now = dt.datetime(2026, 8, 21, 12)
    q = review.Queue(spark, str(tmp_path / "q"))
    assert review.main(q, ["list"]) == (0, ["no pending review items"])
    q.enqueue(spark.createDataFrame([("a", "MERGE", "P1", '{"proposed_action": "LINK"}', now - dt.timedelta(hours=48)), ("b", "SPLIT", "P3", "broken", now)], "item_id string, kind string, priority string, payload string, enqueued_at timestamp").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("entity_type", "string"), ("value", "double"), ("snapshot_ref", "string"))]))
    code, lines = review.main(q, ["list", "1"], now)
    assert code == 0 and "a  kind=MERGE  proposed=LINK" in lines[1]
    assert review.main(q, ["show", "zz"])[0] == 1 and review.main(q, ["odd"])[0] == 2 and review.main(q, ["resolve", "a", "ODD", "me"])[0] == 2
    assert review.main(q, ["resolve", "a", "EDIT", "me", "[1]"])[0] == 2 and review.main(q, ["resolve", "a", "EDIT", "me"])[0] == 2 and review.main(q, ["resolve", "zz", "APPROVE", "me"])[0] == 1
    assert "queue depth: 2" in review.main(q, ["backlog"], now)[1] and "breaches: 1" in review.main(q, ["backlog"], now)[1]
    assert review.main(q, ["resolve", "a", "EDIT", "me", '{"members": ["x", "y"]}'], now) == (0, ["resolved a: EDIT by me"])
    assert review.main(q, ["resolve", "a", "APPROVE", "me"], now)[0] == 1 and review.main(q, ["history", "a"])[1][0] == "1 decision(s) for a:" and review.main(q, ["history", "b"])[1] == ["no decisions recorded for b"]
    assert [r.item_id for r in q.pending().collect()] == ["b"]


def test_payloads_and_compensation(spark):
    ddl = "plan_id string, op_index int, operation_id string, op_type string, identity_id string, candidate_id string, assertion_id string, subject_identity string, value string, status string, created_at timestamp"
    at = dt.datetime(2025, 1, 1, 1, 2, 3, 400)
    rows = [("p", 0, "op_a", "ATTACH_ASSERTION", None, "c", "as_1", "s", 'v"', "ACTIVE", at), ("p", 1, "op_b", "CREATE_IDENTITY", "i", "c", None, None, None, "ACTIVE", None), ("p", 2, "op_c", "PROMOTE_ONTOLOGY_TERM", None, None, None, None, None, None, None), ("only", 0, "op_d", "PROMOTE_ONTOLOGY_TERM", None, None, None, None, None, None, None)]
    ops = planner.payloads(planner._complete(spark.createDataFrame(rows, ddl)))
    got = {r.operation_id: (json.loads(r.payload), json.loads(r.reversal_data)) for r in ops.collect()}
    assert got["op_a"][1]["inverse_payload"] == {"assertion_id": "as_1", "subject_identity": "s", "new_status": "SUPERSEDED", "superseded_at": "2025-01-01T01:02:03.000400+00:00"}
    assert got["op_b"][1]["inverse_payload"] == {"identity_id": "i", "reason": "rollback of CREATE_IDENTITY op_b"}
    done, guards, rest = compensate.compensate(ops, "7", spark.createDataFrame([("p", "snapshot_version", "g1")], "plan_id string, kind string, subject string"))
    back = done.orderBy("op_index").collect()
    assert [(r.op_type, r.undoes) for r in back] == [("REVOKE_IDENTITY", "op_b"), ("RETRACT_ASSERTION", "op_a")] and sorted(r.operation_id for r in rest.collect()) == ["op_c", "op_d"]
    assert [(r.kind, r.subject, r.expected) for r in guards.collect()] == [("snapshot_version", "g1", "7")]
    assert json.loads(back[1].reversal_data)["inverse_payload"]["object_value"] == 'v"'
    for bad in ('{"inverse_payload": null, "candidate_id": "c"}', '{"inverse_payload": "x"}', '{"candidate_id": "c"}', None):
        with pytest.raises(Exception, match="inverse_payload"):
            compensate.compensate(ops.withColumn("reversal_data", F.lit(bad)), 7)[0].collect()
    old = compensate.compensate(ops.withColumn("reversal_data", F.lit('{"assertion_id": "x"}')), 7, legacy=True)[0]
    assert {r.payload for r in old.collect()} == {'{"assertion_id": "x"}'}


def test_evolution_plans(spark):
    ddl = "trigger_id string, trigger_evidence array<string>, new_evidence array<string>, recommendation string, supersession_allowed boolean, old_id string, old_subject string, old_predicate string, new_id string, new_subject string, new_predicate string, old_status string, new_recorded_at timestamp"
    at = dt.datetime(2025, 1, 1)
    row = lambda t, rec, old="o", new="n", ok=True, status="ACTIVE", pred="p": (t, ["e1"], ["e1", "e2"], rec, ok, old, "s", "p", new, "s", pred, status, at)
    rows = [row("a", "supports"), row("b", "supersedes"), row("c", "supersedes", ok=False), row("d", "supersedes", new="o"), row("e", "supersedes", pred="q"), row("f", "supersedes", status="SUPERSEDED"), row("g", None, ok=None)]
    ops, dec, no = evolution.plan_assertions(spark.createDataFrame(rows, ddl))
    assert {(r.trigger_id, r.refused) for r in no.collect()} == {("d", "self"), ("e", "cross-fact"), ("f", "not active")}
    assert sorted((r.trigger_id, r.op_type, r.assertion_id) for r in ops.collect()) == [("a", "ATTACH_ASSERTION", "n"), ("b", "ATTACH_ASSERTION", "n"), ("b", "RETRACT_ASSERTION", "o"), ("c", "ATTACH_ASSERTION", "n"), ("g", "ATTACH_ASSERTION", "n")]
    assert {r.trigger_id: (r.kind, r.review_required, r.evidence_ids) for r in dec.collect()} == {"a": ("CORROBORATION", False, ["e1", "e2"]), "b": ("SUPERSESSION", False, ["e1", "e2"]), "c": ("CONFLICT", True, ["e1", "e2"]), "g": ("CONFLICT", True, ["e1", "e2"])}
    with pytest.raises(Exception, match="supersession refused: self"):
        evolution.plan_assertions(spark.createDataFrame(rows[3:4], ddl), strict=True)[2].collect()
    t = spark.createDataFrame([("t", "trg", ["PROPOSED", "APPROVED"]), ("u", "trg", ["PROPOSED"])], "term_id string, trigger_id string, history array<string>")
    assert [r.term_id for r in evolution.promotion(t).collect()] == ["t"]
    assert t.filter("term_id = 'u'").select(evolution.transition(F.col("history"), F.lit("APPROVED")).alias("h")).first().h == ["PROPOSED", "APPROVED"]
    with pytest.raises(Exception, match="illegal move"):
        t.filter("term_id = 'u'").select(evolution.transition(F.col("history"), F.lit("OBSERVED"))).collect()


def test_record_identity(spark):
    ddl = "assertion_id string, subject_identity string, predicate string, value string, object_identity string, valid_from string, source_type string, locator string, evidence_refs array<struct<evidence_id:string,relationship:string>>"
    rows = [("a", "s", "p", 'größe "x"\n', None, "2015", "src", "7", [("e", "SUPPORTS"), ("f", None)]), ("b", "s", "p", None, "kg://o", None, None, None, None), ("c", "s", "p", None, "kg://o", None, None, None, []), ("d", "s", "p", "😀", None, None, "src", None, None)]
    df = spark.createDataFrame(rows, ddl)
    got = {r.assertion_id: r.record_id for r in records.backfill_record_ids(df).collect()}
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))

    def want(value, obj, frm, origin, ev):
        fact = "fact_" + hashlib.sha256(b"s\0p").hexdigest()[:32]
        seed = "\0".join([fact, "record", dump(value), dump(obj), dump({"valid_from": frm, "valid_to": None}), dump(origin), dump(ev)])
        n = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:16], "big")
        return "as_" + "".join("0123456789ABCDEFGHJKMNPQRSTVWXYZ"[n >> 5 * k & 31] for k in reversed(range(26)))

    assert got["a"] == want('größe "x"\n', None, "2015", ["src", "7"], [["e", "SUPPORTS"], ["f", None]]) and got["d"] == want("😀", None, None, ["src", None], [])
    assert got["b"] == got["c"] == want(None, "kg://o", None, None, [])
    assert [(r.old_ids, r.least_id) for r in records.backfill_collisions(df).collect()] == [(2, "b")]
    at = dt.datetime(2025, 1, 1)
    new, same = records.next_records(df, spark.createDataFrame([("a", at, "other"), ("d", at, "😀")], "assertion_id string, recorded_at timestamp, value string"))
    r = new.first()
    assert (r.prior_id, r.assertion_id, r.status, r.source_candidate_ids) == ("a", want("other", None, "2015", ["src", "7"], [["e", "SUPPORTS"], ["f", None]]), "ACTIVE", []) and [x.prior_id for x in same.collect()] == ["d"]


def test_curate(spark, tmp_path):
    ddl = "candidate_id string, candidate_kind string, graph_id string, producer string, contract_version string, scores struct<extraction_confidence:double,source_reliability:double,identity_confidence:double,policy_risk:double>, subject string, object string, predicate string, value string, evidence_refs array<struct<evidence_id:string,relationship:string>>, trace_id string, created_at timestamp"
    good, at = (0.99, 0.99, 0.99, 0.0), dt.datetime(2025, 1, 1)
    me = "kg://g1/identity/" + "0" * 26
    row = lambda i, k, sub=None, obj=None, val=None, g="g1", s=good: (i, k, g, "p", "2.3.0", s, sub, obj, "year", val, [("e1", "SUPPORTS")], "t", at)
    rows = [row("c1", "entity"), row("c2", "attribute_assertion", me, None, "2015"), row("c3", "relation", me, "Type:ns:x"), row("c4", "relation", me, me), row("c5", "entity", g="BAD!"), row("c6", "artifact"), row("c7", "attribute_assertion", me), row("c8", "entity", s=(0.9, 0.99, 0.99, 0.0))]
    df = spark.createDataFrame(rows, ddl)
    sink = store.AppendOnlyTable(spark, str(tmp_path / "audit"), "audit_id string, plan_id string, operation_id string, evidence_ids array<string>, trace_id string", unique="audit_id", refs={"evidence_ids": "evidence_id"})
    out = engine.curate(df, now="2026-07-17 00:00:00", sink=sink)
    got = {r.candidate_id: (r.valid, r.disposition, r.route, r.create_new_identity) for r in out.outcomes.collect()}
    assert got == {"c1": (True, "NEW_IDENTITY", "AUTO", True), "c2": (True, "RESOLVED_EXISTING", "AUTO", False), "c3": (True, "UNRESOLVED", "LLM_ASSESS", False), "c4": (True, "RESOLVED_EXISTING", "AUTO", False), "c5": (False, None, None, None), "c6": (True, "RESOLVED_EXISTING", "AUTO", False), "c7": (True, "RESOLVED_EXISTING", "AUTO", False), "c8": (True, "NEW_IDENTITY", "LLM_ASSESS", False)}
    ops = out.operations.orderBy("op_index").collect()
    assert [(r.candidate_id, r.op_type) for r in ops] == [("c1", "CREATE_IDENTITY"), ("c2", "ATTACH_ASSERTION"), ("c4", "ATTACH_ASSERTION")] and out.plans.first().evidence_ids == ["e1"]
    assert sink.read().count() == 3 and {r.evidence_id for r in sink.read_refs("evidence_ids").collect()} == {"e1"}
    with pytest.raises(store.DuplicateKeyError):
        engine.curate(df, now="2026-07-17 00:00:00", sink=sink)
    assert engine.curate(df.filter("candidate_id = 'c5'")).plans.count() == 0 and engine.curate(df.limit(0)).outcomes.count() == 0


def test_advisers(spark):
    q = spark.createDataFrame([(i, "identity", "a", "b", ["e1", "e2"], None, None) for i in range(1)], "n int, kind string, subject string, other string, evidence_ids array<string>, evidence_context array<string>, context array<string>")
    r = advise.requests(q, "identity").first()
    assert r.prompt.split("\n")[1:] == ["kind: identity", "subject: a", "other: b", "evidence_ids: e1, e2", "allowed_recommendations: different, insufficient_evidence, same"] and r.prompt_version == "1"
    assert r.request_hash == hashlib.sha256("\0".join(["identity_resolution", "1", r.prompt, "e1\ne2", ""]).encode()).hexdigest()
    fix = spark.createDataFrame([(r.request_hash, '{"recommendation": "same", "confidence": 2, "evidence_ids": ["e2", "zz", 1]}')], "request_hash string, text string")
    a = advise.assess(q, fix, "identity").first()
    assert (a.abstained, a.recommendation, a.confidence, a.evidence_ids) == (False, "same", 1.0, ["e2"])
    failed = advise.assess(q, fix.withColumn("error", F.lit("timeout")), "identity").first()
    assert failed.abstained and failed.recommendation == "insufficient_evidence" and failed.model_id == "unavailable" and "timeout" in failed.rationale
    with pytest.raises(Exception, match="no recorded answer"):
        advise.assess(q, fix.limit(0), "identity").collect()


def test_executions(spark, tmp_path):
    ddl = "plan_id string, op_index int, operation_id string, op_type string, assertion_id string, subject_identity string"
    ops = spark.createDataFrame([("p", 0, "o1", "ATTACH_ASSERTION", "a1", "s"), ("q", 0, "o2", "ATTACH_ASSERTION", "a1", "s"), ("r", 0, "o3", "MERGE_IDENTITIES", None, None), ("s", 0, "o4", "ATTACH_ASSERTION", "x", "s"), ("s", 1, "o5", "ATTACH_ASSERTION", "x", "s")], ddl)
    table = store.AppendOnlyTable(spark, str(tmp_path / "t"), ops.schema)
    log = store.AppendOnlyTable(spark, str(tmp_path / "log"), executor.LOG_SCHEMA)
    run = lambda p, e, **k: executor.execute(ops, p, e, table, log, "2026-01-01 00:00:00", **k)
    first = run("p", 0)
    assert [first.outcome, run("p", 0).outcome, run("q", 1).outcome, run("r", 1).outcome, run("s", 1).outcome, run("none", 1).outcome] == ["COMMITTED", "STALE", "STALE", "UNSUPPORTED_OPERATION", "ERROR", "EMPTY"]
    rows = executor.records_for_plan(log.read(), "p").collect()
    assert [(r.outcome, r.new_epoch) for r in rows] == [("COMMITTED", 1), ("STALE", None)] and rows[0].batch_id == first.batch_id and rows[0].execution_id == first.execution_id != rows[1].execution_id
    plans = spark.createDataFrame([(p, "1") for p in ("p", "q", "r", "s", "none")], "plan_id string, snapshot_version string")
    there = table.read().select("subject_identity", "assertion_id")
    assert {r.plan_id: r.outcome for r in executor.outcomes(plans, ops, 1, there).collect()} == {"p": "STALE", "q": "STALE", "r": "UNSUPPORTED_OPERATION", "s": "ERROR", "none": "EMPTY"}
    memory = store.MemoryTable(spark, ops.schema, unique="operation_id")
    assert memory.append(ops) == 1 and memory.read().count() == 5
    with pytest.raises(store.DuplicateKeyError):
        memory.append(ops)
    with pytest.raises(store.StaleEpochError):
        memory.append(ops, expected=0)


def test_contracts(spark):
    c = spark.createDataFrame([("a", "entity", "g1", "p", "2.3.0"), ("b", "odd", "G!", "", "9")], "candidate_id string, candidate_kind string, graph_id string, producer string, contract_version string")
    assert contract.validator_faults(validate.validate, c) == []
    assert len(contract.validator_faults(lambda d: validate.validate(d).withColumn("valid", F.lit(True)).filter("candidate_id = 'b'"), c)) == 2
    f = spark.createDataFrame([("a", "b", 1.0)], "left string, right string, name_similarity double")
    assert contract.matcher_faults(lambda d: d.withColumn("probability", F.col("name_similarity")), f) == [] and contract.matcher_faults(lambda d: d.withColumn("probability", F.lit(2.0)), f)


def test_semantic_audit(spark):
    d = spark.createDataFrame([("t", "a", "b", None, "AUTO_LINK", None, None, (0.5,))], "trace_id string, left string, right string, baseline string, final string, plan_id string, trigger_targets array<string>, inputs struct<p:double>")
    rows = [audit.semantic_records(d, F.struct(F.lit("rules/1").alias("matcher_version")), "2026-07-17 00:00:00").first() for _ in range(2)]
    assert rows[0] == rows[1] and json.loads(rows[0].replay_inputs) == {"p": 0.5} and rows[0].affected_refs == ["a", "b"] and rows[0].baseline == "AUTO_LINK"
    one = spark.range(1).select(audit.captured_evidence(F.lit(None).cast("string"), F.array(F.lit(None), F.lit("x"))).alias("e"), audit.assertion_affected_refs(F.array(F.lit("t")), F.array(F.lit("t"), F.lit("u"))).alias("r"), audit.resolve_plan_id(F.lit(None), F.lit("r"), F.lit("x")).alias("p")).first()
    assert (one.e, one.r, one.p) == ("x", ["t", "u"], "r")
    g = spark.createDataFrame([(0.9, True)], "probability double, is_match boolean")
    k = spark.createDataFrame([(1, "a")], "cluster_id int, member string")
    r = spark.createDataFrame([("PLANNED", "APPROVE", False, 1.0)], "status string, action string, rolled_back boolean, age_hours double")
    s = audit.metric_snapshot(evaluate.matcher_metrics(g), evaluate.cluster_precision_recall(k, k), evaluate.curation_metrics(r)).first()
    assert s.matcher.precision == 1.0 and s.clusters.precision is None and s.curation.agreement == 1.0
