"""Validation, routing, plans, review, resolution and stores on small frames with null, tie and boundary rows."""

import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from graphwright import config
from graphwright.functions import hashing, similarity, text
from graphwright.operators import advise, backlog, block, decide, evaluate, features, normalize, route, targeting, validate
from graphwright.plans import compensate, evolution, executor, planner
from graphwright.sources import store


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(v for v, _ in cols.values())], ", ".join(f"{k} {t}" for k, (_, t) in cols.items())) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def token(seed):
    n = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:16], "big")
    return "".join(hashing.DIGITS[n >> 5 * k & 31] for k in reversed(range(26)))


@pytest.mark.parametrize("seed", ["", "a", "cand:1", "größe 語", "x" * 5000])
def test_token(spark, seed):
    assert one(spark, hashing.derive_token(F.col("s")), s=(seed, "string")) == token(seed)


def test_ids(spark):
    assert one(spark, hashing.derive_token(F.col("s")), s=(None, "string")) is None
    with pytest.raises(Exception, match="malformed graph id"):
        one(spark, hashing.identity_id(F.col("g"), F.lit("a")), g=("BAD!", "string"))
    assert one(spark, hashing.fact_key(F.lit("s"), F.lit("p"))) == "fact_" + hashlib.sha256(b"s\0p").hexdigest()[:32]
    assert one(spark, hashing.request_hash(F.lit("a"), F.lit("b"))) == hashlib.sha256(b"a\0b\0").hexdigest()
    same = [one(spark, hashing.trigger_id(F.lit("K"), [F.array(*map(F.lit, x))], F.lit("v"))) for x in (["b", "a"], ["a", "b"])]
    assert same[0] == same[1]
    assert one(spark, hashing.canonical_json(F.lit('{"v": {"b": 1, "a": "é"}}'))) == json.dumps({"a": "é", "b": 1}, separators=(",", ":"))


def test_text(spark):
    assert one(spark, text.collapse_blanks(F.col("s")), s=(" a \t b ", "string")) == "a b"
    assert one(spark, text.casefold(F.col("s")), s=("Straße", "string")) == "strasse"
    assert [one(spark, text.source_of(F.col("s")), s=(v, "string")) for v in ("a/b/c", "abc", None, "")] == ["a/b", "abc", None, ""]
    assert [one(spark, text.is_blank(F.col("s")), s=(v, "string")) for v in (None, "", " 　", "x")] == [True, True, True, False]


CAND = "candidate_id string, candidate_kind string, graph_id string, producer string, contract_version string, semantic_key string, scores struct<extraction_confidence:double,source_reliability:double,identity_confidence:double,policy_risk:double>"


def test_validation_collects_all_reasons(spark):
    rows = [("a", "entity", "g1", "p", "2.3.9", "k", (0.99, 0.99, None, 0.1)), ("b", "plan", "BAD!", " ", "3.0.0", "k", None), ("c", None, None, None, None, None, None), ("d", "entity", "g1", "p", "02.3.0", "k", None), ("e", "plan", "g1", "p", "2.0.0", "k", None)]
    v = {r.candidate_id: (r.valid, r.failure_kind, r.reasons) for r in validate.validate(spark.createDataFrame(rows, CAND)).collect()}
    assert v["a"] == (True, None, []) and v["b"][1] == "BAD_DATA" and len(v["b"][2]) == 4 and len(v["c"][2]) == 4
    assert v["d"][2] == ["incompatible version"] and v["e"][1] == "UNSUPPORTED_ONTOLOGY"
    assert validate.validate(spark.createDataFrame([], CAND)).count() == 0
    assert validate.validate(spark.createDataFrame(rows, CAND), graph="g2").filter("valid").count() == 0


def test_routing_boundaries(spark):
    s = lambda *x: tuple(x)
    rows = [(f"c{i}", k, "g1", "p", "2.3.0", f"k{i}", v) for i, (k, v) in enumerate([("entity", s(0.95, 0.9, None, 0.2)), ("entity", s(0.95, 0.9, 0.5, 0.2)), ("entity", s(0.85, 0.99, 0.99, 0.0)), ("entity", s(0.5, 0.99, 0.99, 0.0)), ("entity", s(0.99, 0.99, 0.99, 0.5)), ("relation", s(0.99, 0.99, 0.99, 0.0)), ("artifact", s(0.99, 0.99, None, 0.0)), ("entity", None)])]
    got = {r.candidate_id: r.route for r in route.route_candidates(spark.createDataFrame(rows, CAND)).collect()}
    assert [got[f"c{i}"] for i in range(8)] == ["AUTO", "LLM_ASSESS", "LLM_ASSESS", "HUMAN", "HUMAN", "LLM_ASSESS", "LLM_ASSESS", "HUMAN"]


def jaro_plain(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    w, used, m = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - w), min(len(b), i + w + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            m.append(c)
    if not m:
        return 0.0
    t = sum(x != b[j] for x, j in zip(m, sorted(used), strict=True)) // 2
    return (len(m) / len(a) + len(m) / len(b) + (len(m) - t) / len(m)) / 3


def test_similarity(spark):
    words = ["martha", "marhta", "", "abc", "xyz", "dwayne", "duane", "größe", "grosse", "a", "aaaa", "語彙", "彙語"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", similarity.jaro(F.col("a"), F.col("b")).alias("j")).collect():
        assert math.isclose(r.j, jaro_plain(r.a, r.b), abs_tol=1e-12), (r.a, r.b)
    assert one(spark, similarity.jaro_winkler(F.lit("martha"), F.lit("marhta"))) > 0.9
    assert one(spark, similarity.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert round(one(spark, similarity.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))) == 20015
    ts = lambda d: F.to_timestamp(F.lit(d)) if d else F.lit(None).cast("timestamp")
    assert [one(spark, similarity.temporal_compatible(*map(ts, x))) for x in ((None, None, "2024-01-01", None), ("2024-01-01", "2024-02-01", "2024-02-01", None), ("2024-01-01", "2024-02-01", "2024-02-02", None))] == [None, True, False]
    assert one(spark, similarity.both_least(F.lit(1.0), F.lit(None).cast("double"))) is None


def test_scores_of_known_cases(spark):
    f = {n: None for n in features.FEATURES} | {"name_similarity": 0.9752, "mutually_exclusive": 0.0}
    df = spark.createDataFrame([tuple(f.values()), tuple((f | {"identifier_agreement": 1.0}).values())], ", ".join(f"{k} double" for k in f))
    assert [round(r.p, 4) for r in df.select(features.rule_score().alias("p")).collect()] == [0.6048, 0.9984]


def test_blocking_cap_and_channels(spark):
    e = spark.createDataFrame([(f"k{i}", ["ada lovelace" if i < 3 else "alan"]) for i in range(4)] + [("k0", ["ada lovelace"])], "source_key string, names array<string>")
    keys = block.block_keys(e, {"name": block.name_keys(F.col("names"))})
    pairs, dropped = block.block_pairs(keys)
    assert sorted((r.left, r.right) for r in pairs.collect()) == [("k0", "k1"), ("k0", "k2"), ("k1", "k2")] and dropped.count() == 0
    assert {r.bk for r in block.block_pairs(keys, 3)[1].collect()} >= {"name:ada lovelace", "tok:ada"}
    assert block.block_pairs(keys.limit(0))[0].count() == 0


def test_signals_and_features(spark):
    e = spark.createDataFrame([("a", "journal", {"issn": ["1"], "doi": ["x"]}), ("b", "journal", {"issn": ["2"], "doi": ["x"]}), ("c", "paper", {"issn": ["1"], "doi": ["y"]}), ("d", "paper", None)], "source_key string, entity_type string, ids map<string,array<string>>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "left string, right string")
    s = features.identity_signals(features.attach(pairs, e))
    assert sorted(tuple(r) for r in s.collect()) == [("a", "b", "doi", "AGREE"), ("a", "b", "issn", "UNKNOWN"), ("a", "c", "doi", "CONTRADICT"), ("a", "c", "issn", "UNKNOWN")]
    assert {r.right: r.agreement for r in features.identifier_agreement(s).collect()} == {"b": "AGREE", "c": "CONTRADICT"}
    r = features.attribute_rarity(features.attach(pairs, e), s, features.identifier_frequency(e))
    assert [(x.right, x.attribute_rarity) for x in r.collect()] == [("b", 0.5)]
    f = {x.right: x for x in features.pair_features(pairs, e.withColumn("names", F.array(F.lit("martha"), "source_key"))).collect()}
    assert [(f[k].identifier_agreement, f[k].attribute_rarity, f[k].mutually_exclusive, f[k].name_similarity) for k in "bcd"] == [(1.0, 0.5, 0.0, 1.0), (-1.0, None, 1.0, 1.0), (None, None, 0.0, 1.0)]
    slow = {x.right: x for x in features.pair_features(pairs, e.withColumn("names", F.array("source_key", "entity_type")), batched_names=False).collect()}
    fast = {x.right: x for x in features.pair_features(pairs, e.withColumn("names", F.array("source_key", "entity_type"))).collect()}
    assert all(math.isclose(slow[k].name_similarity, fast[k].name_similarity) for k in slow)
    assert [x.rule for x in features.run_identity_rules(features.attach(pairs, e)).select("rule").distinct().collect()] == ["shared_strong_identifier"]


def test_features_within_blocks(spark):
    rows = [
        ("a", "b1", ["martha", "x"], {"doi": ["1", "2"], "issn": ["i"]}, "Journal", [1.0, 2.0]), ("b", "b1", ["marhta"], {"doi": ["2"], "issn": ["i"]}, "Journal", [2.0, 1.0]), ("c", "b1", ["martha", "x"], {"issn": ["i"], "orcid": ["o"]}, "Paper", [0.0, 0.0]),
        ("d", "b1", None, {"w": ["z"]}, "Person", None), ("e", "b1", [], None, "Person", [1.0]), ("f", "b2", ["martha"], {"w": ["z", "y"]}, "Person", [1.0, 1.0]), ("g", "b2", ["mara"], {"w": ["y", "z"], "orcid": ["o"]}, "Person", [1.0, 0.5]), ("h", None, ["mara"], {}, None, None), ("i", None, ["mara"], {}, None, None),
    ]
    e = spark.createDataFrame(rows, "source_key string, bk string, names array<string>, ids map<string,array<string>>, entity_type string, embedding array<double>")
    keys = e.select(F.col("source_key").alias("k"), F.lit("c").alias("channel"), "bk")
    want = features.pair_features(block.block_pairs(keys)[0].select("left", "right"), e.drop("bk"))
    got = features.block_features(e, "bk")
    assert sorted(map(tuple, got.collect()), key=lambda t: t[:2]) == sorted(map(tuple, want.collect()), key=lambda t: t[:2]) and got.count() == 11
    by = {(r.left, r.right): r for r in got.collect()}
    assert (by["a", "b"].attribute_rarity, by["a", "c"].attribute_rarity, by["f", "g"].attribute_rarity) == (0.5, None, 0.5) and by["c", "d"].name_similarity is None
    # of a pair, nothing is shuffled or sent to Python
    above = got._jdf.queryExecution().executedPlan().toString().partition("SortMergeJoin")[0]
    assert "left" in above and "Exchange" not in above and "Python" not in above


def test_normalize(spark):
    assert one(spark, normalize.normalize_doi(F.lit(" https://DOI.org/10.1/X "))) == "10.1/x"
    assert one(spark, normalize.normalize_orcid(F.lit("0000-0001-x"))) == "00000001X"
    assert one(spark, normalize.normalize_name_exact(F.lit("  Ada  Straße "))) == "ada strasse"
    assert one(spark, normalize.identifier_map(F.create_map(F.lit("doi"), F.array(F.lit(" B"), F.lit("a"), F.lit("b")), F.lit("z"), F.array(F.lit(" "))))) == {"doi": ["a", "b"]}
    assert one(spark, normalize.graph_of_identity(F.lit("kg://g1/identity/X"))) == "g1" and one(spark, normalize.graph_of_identity(F.lit("x"))) is None


def test_backlog(spark):
    now = dt.datetime(2026, 8, 21, 12)
    rows = [("i1", "s", None, "P1", 0.9, None, now - dt.timedelta(hours=48)), *[(f"j{k}", None, "t", "P3", 0.1, "cluster-7", now) for k in range(3)], ("k", "s", "t", "PX", None, "cluster-7", None), ("l", "s", "t", "P1", 0.7, None, now - dt.timedelta(hours=24))]
    sla = backlog.with_sla(spark.createDataFrame(rows, "item_id string, source string, entity_type string, priority string, value double, snapshot_ref string, enqueued_at timestamp"), str(now))
    assert [r.item_id for r in sla.filter("breach").collect()] == ["i1"]
    assert [r.item_id for r in backlog.priority_inversion(sla).collect()] == ["i1"] and backlog.starving(sla).count() == 1
    assert backlog.backpressure(sla).count() == 0
    many = spark.range(202).selectExpr("cast(id as string) item_id", "case when id < 101 then 'b' else 'a' end source", "'t' entity_type", "'P3' priority", "0.0D value", "cast(null as string) snapshot_ref", f"timestamp'{now}' enqueued_at")
    assert sorted((r.source, r.signal) for r in backlog.backpressure(backlog.with_sla(many, str(now))).collect()) == [("a", "QUARANTINE"), ("b", "QUARANTINE")]
    assert backlog.metrics(sla).filter("by = 'all'").first().depth == 6


def test_decisions(spark):
    p = [(x, c) for x in (0.9, 0.98, 0.9981, 0.6, 0.75, 0.1, 0.5) for c in ("LOW", "STANDARD", "HIGH", "??")]
    got = {(r.p, r.c): r.a for r in spark.createDataFrame(p, "p double, c string").select("p", "c", decide.risk_route(F.col("p"), F.col("c")).alias("a")).collect()}
    assert got[0.9981, "HIGH"] == "AUTO_LINK" and got[0.98, "HIGH"] == "LLM_ASSESS" and got[0.1, "LOW"] == "RETAIN_SEPARATE" and got[0.5, "HIGH"] == "GATHER_MORE_EVIDENCE" and got[0.5, "??"] is None
    base = spark.createDataFrame([(1, "LLM_ASSESS", True), (2, "LLM_ASSESS", False), (3, "LLM_ASSESS", True), (4, "RETAIN_SEPARATE", True), (5, "LLM_ASSESS", True)], "pair_id int, baseline string, auto_allowed boolean")
    said = spark.createDataFrame([(1, "same"), (2, "same"), (3, "same"), (3, "different"), (4, "same")], "pair_id int, recommendation string")
    assert {r.pair_id: r.final for r in decide.fold_assessments(base, said).collect()} == {1: "AUTO_LINK", 2: "PROPOSE_LINK", 3: "RETAIN_SEPARATE", 4: "RETAIN_SEPARATE", 5: "LLM_ASSESS"}
    prof = spark.createDataFrame([("g", None, None, "a"), ("g", None, None, "b"), (None, "T", "s", "c"), (None, None, None, "z")], "graph_id string, entity_type string, source string, profile_id string")
    rows = spark.createDataFrame([(1, "g", "T", "s"), (2, "g", "U", "s"), (3, None, None, None)], "n int, graph_id string, entity_type string, source string")
    assert {r.n: r.profile_id for r in decide.resolve_profiles(rows, prof).collect()} == {1: "c", 2: "b", 3: "z"}
    assert {r.profile_id for r in decide.resolve_profiles(rows, prof.limit(0)).collect()} == {"default"}


def test_clusters(spark):
    cols = "cluster_id string, cluster_graph string, cluster_type string, member string, graph_id string, entity_type string, valid_from timestamp, valid_to timestamp, reliability double, identifiers int"
    t = lambda m: dt.datetime(2020, m, 1)
    rows = [("c", "g", "T", "s/a", "g", "T", t(1), t(2), 0.5, 1), ("c", "g", "T", "s/b", "h", "T", t(3), None, 0.5, 2), ("c", "g", "T", "r/x", None, None, None, None, None, None), ("d", "g", "T", "q/1", "g", "T", None, None, None, 9), ("c", "g", "T", "s/a", "g", "T", t(1), t(2), 0.5, 1)]
    m = spark.createDataFrame(rows, cols)
    res = spark.createDataFrame([("s/b", "s/a", 1.0), ("s/a", "r/x", 0.0)], "left string, right string, mutually_exclusive double")
    v = decide.cluster_violations(m, res)
    assert sorted((r.constraint, r.offending) for r in v.collect()) == [("pairwise_mutual_exclusion", ["s/a", "s/b"]), ("temporal_consistency", ["s/a", "s/b"]), ("tenant_boundary", ["s/b"]), ("unique_source", ["s/a", "s/b"])]
    chk = {r.cluster_id: tuple(r)[1:] for r in decide.validate_clusters(m, res, v).collect()}
    assert chk == {"c": (False, 2, 3, False), "d": (True, 0, 0, True)}
    assert {r.cluster_id: r.survivor for r in decide.select_survivor(m).collect()} == {"c": "s/b", "d": "q/1"}


def test_metrics(spark):
    g = spark.createDataFrame([(0.9, True), (0.8, False), (0.2, True), (0.1, False)], "probability double, is_match boolean")
    r = evaluate.matcher_metrics(g).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision) == (1, 1, 1, 1, 0.5)
    r = evaluate.matcher_metrics(g.limit(0)).first()
    assert r.precision is None and r.samples == 0
    p = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "cluster_id int, member string")
    q = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "cluster_id int, member string")
    r = evaluate.cluster_precision_recall(p, q).first()
    assert (r.both_pairs, r.predicted_pairs, r.gold_pairs, r.recall) == (1, 3, 1, 1.0)
    w, b = evaluate.calibrate_logistic(spark.createDataFrame([(1.0, True), (0.0, False)] * 5, "f double, is_match boolean"), ["f"])
    assert w["f"] > 0 > b


def test_plans_and_store(spark, tmp_path):
    rows = [("b", i, f"c{i}", "attribute_assertion", "AUTO", None, "s", "p", v, None, dt.datetime(2020, 1, 1)) for i, v in enumerate(["x", None, "y"])] + [("b", 9, "e", "entity", "AUTO", "kg://g/identity/1", None, None, None, None, None), ("z", 1, "h", "entity", "HUMAN", None, None, None, None, None, None)]
    ops = planner.operations(spark.createDataFrame(rows, "batch_id string, input_seq int, candidate_id string, candidate_kind string, route string, identity_id string, subject_identity string, predicate string, value string, object_identity string, created_at timestamp"))
    got = ops.orderBy("op_index").collect()
    assert [(r.op_index, r.candidate_id, r.op_type) for r in got] == [(0, "c0", "ATTACH_ASSERTION"), (1, "c2", "ATTACH_ASSERTION"), (2, "e", "CREATE_IDENTITY")]
    assert [r.kind for r in planner.preconditions(ops, "snap").orderBy("pre_index").collect()] == ["snapshot_version", "assertion_absent", "assertion_absent", "entity_version"]
    assert planner.plan_ids(ops, "s", "p").count() == 1
    mine = ops.withColumn("plan_id", F.col("batch_id"))
    schema = mine.select("plan_id", "op_index", "operation_id", "op_type", "assertion_id", "status").schema
    table = store.AppendOnlyTable(spark, str(tmp_path / "t"), schema, unique="operation_id")
    assert table.published() == 0 and table.read().count() == 0
    assert executor.execute(mine, "b", 0, table).outcome == "COMMITTED" and table.published() == 1
    assert executor.execute(mine, "b", 0, table).outcome == "STALE" and executor.execute(mine, "b", 1, table).outcome == "STALE"
    assert executor.execute(mine, "none", 1, table).outcome == "EMPTY"
    assert executor.execute(mine.withColumn("op_type", F.lit("ODD")), "b", 1, table).outcome == "UNSUPPORTED_OPERATION"
    assert executor.execute(mine.unionByName(mine), "b", 1, table).outcome == "ERROR"
    with pytest.raises(store.DuplicateKeyError):
        table.append(mine)
    with pytest.raises(store.StaleEpochError):
        table.append(mine, expected=0)
    assert executor.current_assertions(table.read().filter("assertion_id is not null")).count() == 2
    done, rest = compensate.compensation(mine)
    assert [r.op_type for r in done.orderBy("op_index").collect()] == ["REVOKE_IDENTITY", "RETRACT_ASSERTION", "RETRACT_ASSERTION"] and rest.count() == 0
    (tmp_path / "t" / "_version.json").write_text('{"version": 7}')
    with pytest.raises(store.PermanentStoreError):
        store.AppendOnlyTable(spark, str(tmp_path / "t"), schema)
    snap = store.ReviewSnapshotStore(spark, str(tmp_path / "r"), schema)
    assert snap.load().count() == 0
    snap.save(mine)
    assert snap.load().count() == 3
    for bad in (1.0, True, -1, "x", None):
        with pytest.raises(ValueError):
            compensate.validated_epoch(bad)
    assert compensate.validated_epoch(" 7 ") == 7


def test_evolution(spark):
    r = spark.createDataFrame([("f", "a", "2015", 1), ("f", "b", "2014", 2), ("f", "c", "2014", 3), ("f", "d", None, 4)], "fact string, assertion_id string, value string, recorded_at int")
    assert [(x.assertion_id, x.superseded_by, x.status) for x in evolution.supersession_chain(r).orderBy("recorded_at").collect()] == [("a", "b", "SUPERSEDED"), ("b", "d", "SUPERSEDED"), ("d", None, "ACTIVE")]
    h = spark.createDataFrame([(1, ["PROPOSED", "APPROVED"]), (2, ["PROPOSED", "OBSERVED"]), (3, []), (4, None), (5, ["APPROVED"]), (6, ["PROPOSED"])], "n int, h array<string>")
    assert {x.n: (x.a, x.b) for x in h.select("n", evolution.legal_history(F.col("h")).alias("a"), evolution.may_promote(F.col("h")).alias("b")).collect()} == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False), 5: (False, False), 6: (True, False)}
    ptr = lambda x: one(spark, evolution.superseded_pointer(F.col("s")), s=(x, "string"))
    assert [ptr(x) for x in ('{"superseded_by": "x", "assertion_id": "y"}', '{"superseded_by": 7}', "{}", None, "no json")] == ["x", None, None, None, None]
    with pytest.raises(Exception, match="supersedes itself"):
        ptr('{"superseded_by": "x", "assertion_id": "x"}')
    m = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "q")], "cluster_id string, member string")
    s = spark.createDataFrame([("c", "a"), ("d", "q")], "cluster_id string, survivor string")
    assert [(x.into, x.merged) for x in evolution.merge_operations(s, m).collect()] == [("a", ["b"])]
    assert evolution.split_operations(spark.createDataFrame([("i", "j", ["x", "x", "y"])], "identity_id string, new_identity string, assertion_ids array<string>")).count() == 3


def test_targets_and_advice(spark):
    sup = spark.createDataFrame([("e1", "a1"), ("e1", "a2")], "evidence_id string, assertion_id string")
    own = spark.createDataFrame([("a1", "i1")], "assertion_id string, identity_id string")
    t = spark.createDataFrame([("t", ["i9"], ["e1", "e1"]), ("u", None, None)], "trigger_id string, identity_ids array<string>, evidence_ids array<string>")
    assert [(r.pos, r.target) for r in targeting.affected_by_trigger(t, sup, own).orderBy("pos").collect()] == [(0, "i9"), (1, "a1"), (2, "i1"), (3, "a2")]
    full = spark.createDataFrame([("t", ["al"], ["a9"], ["concept", "al2"], None)], "trigger_id string, identity_ids array<string>, assertion_ids array<string>, concept_keys array<string>, evidence_ids array<string>")
    alias = spark.createDataFrame([("al", "id1"), ("al2", "id2")], "key string, identity_id string")
    assert [r.target for r in targeting.affected_by_trigger(full, sup, own, alias).orderBy("pos").collect()] == ["id1", "a9", "concept", "id2"]
    asked = spark.createDataFrame([("r", 1, "b", None), ("r", 0, 'a"', "SUPPORTS"), ("r", 2, "zz", None), ("r", 3, "n", None)], "request_id string, pos int, evidence_id string, relationship string")
    ev = spark.createDataFrame([('a"', "PRESENT", "x\ny" + "q" * 600, None), ("b", "ERROR", "hidden", 'bad "x"'), ("n", "ABSENT", None, None)], "evidence_id string, status string, text string, detail string")
    r = advise.render_evidence(asked, ev).first()
    assert r.context == ['[a\\"] relationship=SUPPORTS, availability=PRESENT: "x\\ny' + "q" * 497 + '..."', '[b] relationship=UNKNOWN, availability=ERROR: error="bad \\"x\\""', "[zz] relationship=UNKNOWN, availability=UNKNOWN: not found in evidence lookup", "[n] relationship=UNKNOWN, availability=ABSENT: reason=UNSPECIFIED"]
    assert r.unresolved_ids == ["zz"] and r.truncated and r.rendered_ids == ['a"', "b", "n"]
    with pytest.raises(ValueError):
        advise.render_evidence(asked, ev, 0)
    none = (True, "insufficient", None, ["a"])
    ans = [('{"recommendation": "same", "confidence": 1.7, "evidence_ids": ["a", "x"]}', (False, "same", 1.0, ["a"])), ('{"recommendation": "odd", "confidence": 1}', none), ('{"recommendation": "same", "confidence": true}', (False, "same", None, [])), ('{"recommendation": 7}', none), ("[1]", none), ("no json", none), (None, none)]
    for raw, want in ans:
        assert tuple(one(spark, advise.parse_answer(F.col("s"), ["same", "different"], F.array(F.lit("a"))), s=(raw, "string")))[:4] == want


def test_streaming_queue(spark, tmp_path):
    from graphwright.streaming import queue

    rows = [("t1", dt.datetime(2025, 1, 1)), ("t1", dt.datetime(2025, 1, 1, 1)), ("t2", dt.datetime(2025, 1, 2))]
    spark.createDataFrame(rows, "trigger_id string, stored_at timestamp").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("trigger_id string, stored_at timestamp").parquet(str(tmp_path / "in"))
    q = queue.idempotent_triggers(src).writeStream.format("memory").queryName("trig").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.trigger_id for r in spark.table("trig").collect()) == ["t1", "t2"]
    table = store.AppendOnlyTable(spark, str(tmp_path / "epochs"), "n bigint")
    for i in (0, 1, 1, 0, 2):
        queue.publish_epochs(table, "s")(spark.range(1).select(F.lit(i).alias("n")), i)
    assert table.published() == 3 and sorted(r.n for r in table.read().collect()) == [0, 1, 2] and table.last_batch("s") == 2 and table.last_batch("other") == -1


def test_entry_points():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert len(q) > 45 and set(s) <= set(q) and config.INSTALLED_VERSION
