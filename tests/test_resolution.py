"""Registered resolution queries on small tables, against brute force."""

import datetime as dt

import numpy as np

from graphwright.queries import resolution


def test_knn_searches_all_labels(spark, tmp_path):
    rnd = np.random.default_rng(7)
    vecs = rnd.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v], i % 10) for i, v in enumerate(vecs)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
    want = set()
    for q in range(0, 300, 50):
        order = [int(v) for v in np.argsort(-(unit @ unit[q]), kind="stable") if v != q][:5]
        want |= {(min(q, v), max(q, v)) for v in order}
    got = resolution.knn_pairs(spark, str(tmp_path))
    assert {(r.left, r.right) for r in got.collect()} == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_normalize_entities_of_all_types(spark, tmp_path):
    names = {"Person": ["  Ine\u0301s\u00a0 Stra\u00dfe", "\uff21da", "in\u00e9s strasse", None, " "], "Organization": ["ODD\u2003Co."], "Sensor": ["Probe 1"], "Station": None, "Venue": [], "Paper": ["A  b"], "Concept": ["C"]}
    rows = [(i, f"feed/a/{i}", "g", k, n, {"doi": ["doi:X"]}, None, None, {}, None, None, None) for i, (k, n) in enumerate(names.items())]
    ddl = "row_id bigint, source_key string, graph_id string, entity_type string, normalized_names array<string>, identifiers map<string,array<string>>, affiliations array<string>, neighbors array<string>, attributes map<string,string>, source_reliability double, embedding array<double>, stored_at timestamp"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "normalized_entities.parquet"))
    got = {r.entity_type: (r.names, r.doi, r.source) for r in resolution.normalize_entities(spark, str(tmp_path)).collect()}
    want = {"person": "in\u00e9s strasse|ada", "organization": "odd co.", "sensor": "probe 1", "station": "", "venue": "", "paper": "a b", "concept": "c"}
    assert got == {k: (v, "x", "feed/a") for k, v in want.items()}


def test_decisions_not_to_link_are_evaluated(spark, tmp_path):
    rows = [(0.95, "SAME_AS", (0.9,)), (0.95, None, (0.95,)), (0.2, None, (0.1,)), (0.3, None, (None,)), (0.6, "POSSIBLY_SAME_AS", (0.5,)), (None, "SAME_AS", (0.5,))]
    spark.createDataFrame(rows, "probability double, link_kind string, feature_vector struct<name_similarity:double>").write.parquet(str(tmp_path / "match_results.parquet"))
    m = resolution.matcher_evaluation(spark, str(tmp_path)).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.samples, m.false_merge) == (1, 1, 0, 3, 5, 0.25)
    assert {(r.arm, r.tp, r.fp, r.fn, r.tn) for r in resolution.arm_comparison(spark, str(tmp_path)).collect()} == {("rules", 1, 1, 0, 3), ("name_only", 1, 1, 0, 3)}


def test_clusters_with_disjoint_periods(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    e = [(1, "a/x", "2015-01-01", "2016-01-01"), (2, "b/x", "01/03/2017", None), (3, "c/x", "2020-01-01", "2019-01-01"), (4, "d/x", None, None), (5, "e/x", "2014-05-05", "unknown")]
    e = [(n, k, "g", "Concept", {}, f, t, None, at) for n, k, f, t in e]
    spark.createDataFrame(e, "row_id bigint, source_key string, graph_id string, entity_type string, identifiers map<string,array<string>>, valid_from string, valid_to string, source_reliability double, stored_at timestamp").write.parquet(str(tmp_path / "normalized_entities.parquet"))
    c = [("apart", 1, "g", "Concept", ["a/x", "b/x"]), ("one", 1, "g", "Concept", ["c/x", "d/x"]), ("open", 1, "g", "Concept", ["a/x", "e/x"]), ("three", 1, "g", "Concept", ["c/x", "a/x", "d/x"])]
    spark.createDataFrame(c, "cluster_id string, version bigint, graph_id string, entity_type string, members array<string>").write.parquet(str(tmp_path / "clusters.parquet"))
    spark.createDataFrame([], "left_key string, right_key string, feature_vector struct<mutually_exclusive:double>").write.parquet(str(tmp_path / "match_results.parquet"))
    spark.createDataFrame([(s, "UTC", True) for s in "abcde"], "source string, home_zone string, day_first boolean").write.parquet(str(tmp_path / "source_registry.parquet"))
    got = {tuple(r) for r in resolution.cluster_violations(spark, str(tmp_path)).collect()}
    assert got == {("apart", 2, "temporal_consistency", "a/x,b/x"), ("three", 2, "temporal_consistency", "a/x,c/x")}
    assert {r.cluster_id for r in resolution.cluster_validation(spark, str(tmp_path)).collect() if not r.valid} == {"apart", "three"}


def test_names_of_different_first_letters(spark, tmp_path):
    spark.createDataFrame([("MARTHA",), ("XARTHA",), ("DIXON",)], "n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    got = {(r.a, r.b): (r.jaro, r.jaro_winkler) for r in resolution.name_similarity(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and got["MARTHA", "XARTHA"] == (0.888889, 0.888889) and got["DIXON", "DIXON"] == (1.0, 1.0)
