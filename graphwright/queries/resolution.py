"""Queries of normalisation, blocking, features, matching, clusters and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphwright.functions import similarity
from graphwright.functions.text import source_of
from graphwright.operators import block, decide, evaluate, features, normalize
from graphwright.operators.timestamps import normalise_timestamps
from graphwright.session import table


def normalize_entities(spark, d):
    e = normalize.normalize_entities(table(spark, d, "normalized_entities"), exact=True)
    return e.select("row_id", "entity_type", F.array_join("names", "|").alias("names"), F.array_join(F.try_element_at("ids", F.lit("doi")), "|").alias("doi"), "source")


def normalize_identifiers(spark, d):
    e = table(spark, d, "normalized_entities")
    ids = F.explode(normalize.identifier_map(F.col("identifiers"))).alias("namespace", "values")
    return e.select("row_id", normalize.normalize_entity_type(F.col("entity_type")).alias("entity_type"), source_of(F.col("source_key")).alias("source"), ids).withColumn("values", F.array_join("values", "|"))


def _parts(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    since = F.when(key % 5 != 0, F.timestamp_micros(F.lit(1_577_836_800_000_000) + (key % 400) * 86_400_000_000))
    until = F.when(key % 7 != 0, F.timestamp_micros(F.lit(1_577_836_800_000_000) + (key % 400 + key % 90) * 86_400_000_000))
    return p.select(
        F.concat_ws("/", F.lit("part"), "p_brand", F.col("p_partkey").cast("string")).alias("source_key"), F.array(F.lower("p_name")).alias("names"), F.create_map(F.lit("doi"), F.array(F.concat_ws("-", "p_type", F.col("p_size").cast("string"))), F.lit("issn"), F.array("p_brand"), F.lit("orcid"), F.array((key % 50).cast("string"))).alias("ids"),
        F.element_at(F.array(*map(F.lit, ("Journal", "Paper", "Person", "Co-Author"))), (key % 4 + 1).cast("int")).alias("entity_type"), since.alias("valid_from"), until.alias("valid_to"), F.array(F.lower("p_type")).alias("affiliations"), F.array("p_brand", F.col("p_size").cast("string")).alias("neighbors"),
        (F.col("p_size") * 1.5).alias("latitude"), (F.col("p_partkey") % 180).cast("double").alias("longitude"), (F.col("p_retailprice") / 3000).alias("source_reliability"), F.array((F.col("p_size") * 1.0), F.col("p_retailprice")).alias("embedding"), F.concat_ws("|", "p_name", "p_brand").alias("bk"), F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("near"),
    )


def _pairs(spark, d):
    e = _parts(spark, d)
    keys = e.select(F.col("source_key").alias("k"), F.lit("name_brand").alias("channel"), "bk")
    return block.block_pairs(keys)[0]


def block_pairs(spark, d):
    return _pairs(spark, d).select("left", "right", F.array_join("channels", ",").alias("channels"))


def block_channels(spark, d):
    e = _parts(spark, d).withColumn("names", F.array(F.col("bk")))
    keys = block.block_keys(e, {"identifier": block.identifier_keys(F.col("ids")), "name": block.name_keys(F.col("names")), "source": F.array(source_of(F.col("source_key")))})
    return keys.groupBy("channel", "bk").agg(F.count("*").alias("members"))


def block_cap_report(spark, d):
    e = _parts(spark, d)
    keys = block.block_keys(e, {"name": block.name_keys(F.col("names"))})
    return block.block_pairs(keys, 20)[1]


def knn_pairs(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return block.knn_pairs(v, v.filter("key % 50 = 0"), 5, block=None)


def _near_pairs(spark, d):
    keys = _parts(spark, d).select(F.col("source_key").alias("k"), F.lit("brand_size").alias("channel"), F.col("near").alias("bk"))
    return block.block_pairs(keys)[0].select("left", "right")


def _attached(spark, d):
    return features.attach(_near_pairs(spark, d), _parts(spark, d).select("source_key", "entity_type", "ids"))


def identity_signals(spark, d):
    return features.identity_signals(_attached(spark, d)).groupBy("namespace", "agreement").agg(F.count("*").alias("n"))


def _features(spark, d):
    return features.block_features(_parts(spark, d).drop("bk"), "near")


def pair_features(spark, d):
    whole = ("identifier_agreement", "temporal_compatible", "shared_affiliations", "mutually_exclusive")
    return _features(spark, d).select("left", "right", *[f if f in whole else F.round(f, 6).alias(f) for f in features.FEATURES])


def match_scores(spark, d):
    return _features(spark, d).select("left", "right", F.round(features.rule_score(), 6).alias("probability"))


def name_similarity(spark, d):
    n = table(spark, d, "nation").select("n_name")
    a, b = n.select(F.col("n_name").alias("a")), n.select(F.col("n_name").alias("b"))
    return a.crossJoin(b).filter("a <= b").select("a", "b", F.round(similarity.jaro(F.col("a"), F.col("b")), 6).alias("jaro"), F.round(similarity.jaro_winkler(F.col("a"), F.col("b")), 6).alias("jaro_winkler"))


def er_decisions(spark, d):
    m = table(spark, d, "match_results")
    cost, n = F.col("calibration_key.consequence_class"), F.col("match_id")
    a = decide.decide(F.col("probability"), F.when(n % 11 == 0, "INERT").otherwise("ADVISORY"), cost, n % 13 == 0, n % 7 != 0, n % 4, F.lit(1), n % 3 != 0)
    return m.select("match_id", a.alias("action")).select("match_id", "action", decide.link_kind(F.col("action")).alias("link_kind"), decide.action_route(F.col("action")).alias("route"))


PROFILES = [(None, None, None, "p_any"), ("lex", None, None, "p_lex"), ("lex", "Concept", None, "p_lex_concept"), (None, "Person", None, "p_person"), (None, "Paper", "feed/kehalwyn", "p_paper_feed"), ("g1", "Person", None, "p_g1_person"), ("g1", "Person", None, "p_g1_person_b"), (None, None, "feed/kiyunari", "p_feed")]


def profile_resolution(spark, d):
    p = spark.createDataFrame(PROFILES, "graph_id string, entity_type string, source string, profile_id string")
    e = table(spark, d, "normalized_entities").select("row_id", "graph_id", "entity_type", source_of(F.col("source_key")).alias("source"))
    return decide.resolve_profiles(e, p).select("row_id", "profile_id")


def _members(spark, d, periods=False):
    c = table(spark, d, "clusters")
    top = c.groupBy("cluster_id").agg(F.max(F.struct("version", "graph_id", "entity_type", "members")).alias("c"))
    m = top.select("cluster_id", F.col("c.graph_id").alias("cluster_graph"), F.col("c.entity_type").alias("cluster_type"), F.explode("c.members").alias("member")).filter("member is not null").distinct()
    rows = table(spark, d, "normalized_entities")
    last = rows.filter("source_key is not null").groupBy("source_key").agg(F.max(F.struct("stored_at", "row_id")).alias("_at")).select("source_key", F.col("_at.row_id").alias("row_id"))
    e = rows.join(last, ["source_key", "row_id"]).select("source_key", F.struct("stored_at", "row_id", "graph_id", "entity_type", "source_reliability", F.aggregate(F.map_values("identifiers"), F.lit(0), lambda n, v: n + F.coalesce(F.size(F.array_distinct(v)), F.lit(0))).alias("n"), normalize.identifier_map(F.col("identifiers")).alias("ids")).alias("e"))
    out = m.join(e, m.member == e.source_key, "left").select("cluster_id", "cluster_graph", "cluster_type", "member", F.col("e.row_id").alias("row_id"), F.col("e.graph_id").alias("graph_id"), F.col("e.entity_type").alias("entity_type"), F.col("e.source_reliability").alias("reliability"), F.col("e.n").alias("identifiers"), F.col("e.ids").alias("ids"))
    if periods:
        texts = rows.join(out.select("row_id").distinct(), "row_id", "left_semi")
        at = lambda f: F.max(F.when(F.col("field") == f, F.timestamp_micros("utc_micros"))).alias(f)
        out = out.join(normalise_timestamps(texts, table(spark, d, "source_registry")).groupBy("row_id").agg(at("valid_from"), at("valid_to")), "row_id", "left")
    return out.drop("row_id")


def _results(spark, d):
    return table(spark, d, "match_results").select(F.col("left_key").alias("left"), F.col("right_key").alias("right"), F.col("feature_vector.mutually_exclusive").alias("mutually_exclusive")).filter("left is not null and right is not null and left <> right")


def cluster_violations(spark, d):
    return decide.cluster_violations(_members(spark, d, periods=True), _results(spark, d)).select("cluster_id", "seq", "constraint", F.array_join("offending", ",").alias("offending"))


def cluster_validation(spark, d):
    m, r = _members(spark, d, periods=True), _results(spark, d)
    return decide.validate_clusters(m, r, decide.cluster_violations(m, r))


def select_survivor(spark, d):
    return decide.select_survivor(_members(spark, d))


def _part_clusters(spark, d):
    p = _parts(spark, d).select("source_key", "entity_type", "ids", "valid_from", "valid_to", "near")
    key = F.substring_index("source_key", "/", -1).cast("bigint")
    return p.select(
        F.col("near").alias("cluster_id"), F.lit("g").alias("cluster_graph"), F.lit("Paper").alias("cluster_type"), F.when(key % 3 == 0, F.concat(F.lit("m/"), F.col("near"), F.lit("/"), key.cast("string"))).otherwise(F.concat(F.lit("s"), key.cast("string"), F.lit("/x"))).alias("member"),
        F.when(key % 11 == 0, None).when(key % 13 == 0, "h").otherwise("g").alias("graph_id"), F.when(key % 17 == 0, "Journal").otherwise("Paper").alias("entity_type"), "valid_from", "valid_to", F.map_filter("ids", lambda k, _: k.isin("doi", "issn")).alias("ids"), (key % 19 == 0).alias("is_protected"), key.alias("key"),
    )


def _part_results(spark, d):
    m = _part_clusters(spark, d).filter("key % 2 = 0").select("cluster_id", "member", "key")
    a, b = m.select("cluster_id", F.col("member").alias("left"), F.col("key").alias("p")), m.select("cluster_id", F.col("member").alias("right"), F.col("key").alias("q"))
    return a.join(b, "cluster_id").filter("left < right").select("left", "right", ((F.col("p") + F.col("q")) % 5 == 0).cast("double").alias("mutually_exclusive"))


def cluster_rules(spark, d):
    m = _part_clusters(spark, d).drop("key")
    return decide.cluster_violations(m, _part_results(spark, d), authority=True).select("cluster_id", "seq", "constraint", F.array_join("offending", ",").alias("offending"))


def cluster_additions(spark, d):
    m = _part_clusters(spark, d)
    old, new = m.filter("key % 4 <> 0").drop("key"), m.filter("key % 4 = 0").drop("key")
    return decide.validate_addition(old, new, _part_results(spark, d), authority=True)


def _golden(spark, d):
    m = table(spark, d, "match_results").filter("probability is not null")
    return m.select("probability", F.col("link_kind").eqNullSafe("SAME_AS").alias("is_match"), F.col("feature_vector.name_similarity").alias("name_similarity"))


def matcher_evaluation(spark, d):
    m = evaluate.matcher_metrics(_golden(spark, d), 0.9)
    return m.select("tp", "fp", "fn", "tn", "samples", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "false_merge", "false_split", "calibration_error")])


def arm_comparison(spark, d):
    arms = {"rules": F.col("probability"), "name_only": F.coalesce("name_similarity", F.lit(0.0))}
    m = evaluate.run_arms(_golden(spark, d), arms, 0.9)
    return m.select("arm", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"))


def promotion_gate(spark, d):
    arms = {"rules": F.col("probability"), "name_only": F.coalesce("name_similarity", F.lit(0.0))}
    return evaluate.promotion_gate(evaluate.run_arms(_golden(spark, d), arms, 0.9), "rules", "name_only")


def cluster_pr(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("member"), F.col("label").alias("gc"), (F.col("label") * 3 + F.col("vec_id") % 3).alias("pc"))
    out = evaluate.cluster_precision_recall(v.select(F.col("pc").alias("cluster_id"), "member"), v.select(F.col("gc").alias("cluster_id"), "member"))
    return out.select("both_pairs", "predicted_pairs", "gold_pairs", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


QUERIES = {f.__name__: f for f in (
    normalize_entities, normalize_identifiers, cluster_rules, cluster_additions, block_pairs, block_channels, block_cap_report, knn_pairs, identity_signals, pair_features, match_scores, name_similarity, er_decisions, profile_resolution, cluster_violations, cluster_validation, select_survivor,
    matcher_evaluation, arm_comparison, promotion_gate, cluster_pr,
)}

_PARTS = """
e AS (SELECT 'part/' || p_brand || '/' || p_partkey AS k, p_partkey AS n, lower(p_name) AS name, p_name || '|' || p_brand AS bk, p_brand || '|' || p_size AS near, p_type || '-' || p_size AS doi, p_brand AS issn, (p_partkey % 50)::VARCHAR AS orcid, p_partkey % 4 AS t, lower(p_type) AS aff,
  p_brand, p_size::VARCHAR AS size, p_size * 1.5 AS lat, (p_partkey % 180)::DOUBLE AS lon, p_retailprice / 3000 AS rel, p_size::DOUBLE AS v1, p_retailprice AS v2, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 400 END AS since, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 400 + p_partkey % 90 END AS until FROM part),
pr AS (SELECT a.k AS l, b.k AS r FROM e a JOIN e b ON a.bk = b.bk AND a.k < b.k)
"""
_FEATURES = f"""{_PARTS},
fq AS (SELECT v, count(*) AS f FROM (SELECT k, doi AS v FROM e UNION SELECT k, issn FROM e UNION SELECT k, orcid FROM e) GROUP BY v),
w AS (SELECT e.*, a.f AS fd, b.f AS fi, c.f AS fo FROM e JOIN fq a ON a.v = doi JOIN fq b ON b.v = issn JOIN fq c ON c.v = orcid),
x AS (SELECT a.k AS "left", b.k AS "right", a.name AS na, b.name AS nb, a.doi = b.doi AS sd, a.t = 0 AND b.t = 0 AS jj, a.t >= 2 AND b.t >= 2 AS pp, a.orcid = b.orcid AS so, a.aff = b.aff AS sa, a.fd, a.fi, a.fo, a.since AS s1, a.until AS u1, b.since AS s2, b.until AS u2,
   a.lat AS la, b.lat AS lb, a.lon AS oa, b.lon AS ob, a.rel AS ra, b.rel AS rb, a.v1 AS a1, a.v2 AS a2, b.v1 AS b1, b.v2 AS b2 FROM w a JOIN w b ON a.near = b.near AND a.k < b.k),
z AS (SELECT *, NOT sd OR (pp AND NOT so) AS contra, (s1 IS NOT NULL OR u1 IS NOT NULL) AND (s2 IS NOT NULL OR u2 IS NOT NULL) AS dated, coalesce(u1 < s2, false) OR coalesce(u2 < s1, false) AS apart, CASE WHEN na = nb THEN 1.0 ELSE jaro_similarity(na, nb) END AS ja,
   len(list_filter([1, 2, 3, 4], lambda i: substr(na, 1, i) = substr(nb, 1, i) AND length(na) >= i AND length(nb) >= i)) AS pre FROM x),
y AS (SELECT "left", "right", ja + pre * 0.1 * (1 - ja) AS name_similarity, CASE WHEN contra THEN -1.0 ELSE 1.0 END AS identifier_agreement, CASE WHEN dated THEN (NOT apart)::INT::DOUBLE END AS temporal_compatible,
   2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(ob - oa) / 2), 2)))) AS geographic_distance,
   sa::INT::DOUBLE AS shared_affiliations, greatest(CASE WHEN sd THEN 1.0 / fd END, CASE WHEN jj THEN 1.0 / fi END, CASE WHEN pp AND so THEN 1.0 / fo END) AS attribute_rarity,
   least(ra, rb) AS source_reliability, (a1 * b1 + a2 * b2) / (sqrt(a1 * a1 + a2 * a2) * sqrt(b1 * b1 + b2 * b2)) AS embedding_similarity, 1.0 AS neighborhood_compatibility, (contra OR (dated AND apart))::INT::DOUBLE AS mutually_exclusive FROM z)
"""
_Z = "-2.5 + coalesce(attribute_rarity * 2, 0) + coalesce(embedding_similarity, 0) + coalesce(identifier_agreement * 6, 0) + coalesce(mutually_exclusive * -8, 0) + coalesce(name_similarity * 3, 0) + coalesce(neighborhood_compatibility * 1.5, 0) + coalesce(shared_affiliations * 0.5, 0) + coalesce(source_reliability * 0.5, 0) + coalesce(temporal_compatible, 0)"
_MEM = """
tp AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY version DESC NULLS LAST, graph_id DESC NULLS LAST, entity_type DESC NULLS LAST, members DESC) AS n FROM clusters),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY stored_at DESC NULLS LAST, row_id DESC) AS n FROM normalized_entities) WHERE n = 1),
m AS (SELECT DISTINCT tp.cluster_id, tp.graph_id AS cg, tp.entity_type AS ct, u.x AS member, cur.graph_id, cur.entity_type, cur.source_reliability AS rel, list_sum([len(list_distinct(v)) for v in map_values(cur.identifiers)]) AS ids, cur.source_key FROM tp, unnest(tp.members) AS u(x) LEFT JOIN cur ON cur.source_key = u.x WHERE tp.n = 1 AND u.x IS NOT NULL)
"""
_CONF = """count(*) FILTER (WHERE p >= 0.9 AND y) AS tp, count(*) FILTER (WHERE p >= 0.9 AND NOT y) AS fp, count(*) FILTER (WHERE p < 0.9 AND y) AS fn, count(*) FILTER (WHERE p < 0.9 AND NOT y) AS tn"""
_GOLD = "g AS (SELECT probability AS p, coalesce(link_kind = 'SAME_AS', false) AS y, feature_vector.name_similarity AS ns FROM match_results WHERE probability IS NOT NULL), arms AS (SELECT 'rules' AS arm, p, y FROM g UNION ALL SELECT 'name_only', coalesce(ns, 0), y FROM g)"
_JARO = "CASE WHEN a = b THEN 1.0 ELSE jaro_similarity(a, b) END"

_CLUSTERS = f"""{_PARTS},
c AS (SELECT near AS cluster_id, n AS key, CASE WHEN n % 3 = 0 THEN 'm/' || near || '/' || n ELSE 's' || n || '/x' END AS member, CASE WHEN n % 11 = 0 THEN NULL WHEN n % 13 = 0 THEN 'h' ELSE 'g' END AS g, CASE WHEN n % 17 = 0 THEN 'Journal' ELSE 'Paper' END AS t, since, until, doi, n % 19 = 0 AS own FROM e),
k AS (SELECT *, CASE WHEN contains(member, '/') THEN regexp_replace(member, '/[^/]*$', '') ELSE member END AS src FROM c WHERE g IS NOT NULL),
pairs AS (SELECT a.cluster_id, a.member AS l, b.member AS r, (a.key + b.key) % 5 = 0 AS excl FROM c a JOIN c b ON a.cluster_id = b.cluster_id AND a.member < b.member WHERE a.key % 2 = 0 AND b.key % 2 = 0),
kp AS (SELECT a.cluster_id, a.member AS l, b.member AS r, coalesce(a.until < b.since, false) OR coalesce(b.until < a.since, false) AS apart, a.doi <> b.doi AS contra, a.src = b.src AS same FROM k a JOIN k b ON a.cluster_id = b.cluster_id AND a.member < b.member),
v AS (SELECT cluster_id, 0 AS seq, 'pairwise_mutual_exclusion' AS rule, l || ',' || r AS offending FROM pairs WHERE excl
  UNION ALL SELECT cluster_id, 1, 'tenant_boundary', min(member) FROM k WHERE g <> 'g' OR t <> 'Paper' GROUP BY 1
  UNION ALL SELECT cluster_id, 2, 'temporal_consistency', min_by(l || ',' || r, (l, r)) FROM kp WHERE apart GROUP BY 1
  UNION ALL SELECT cluster_id, 3, 'unique_source', min_by(l || ',' || r, (r, l)) FROM kp WHERE same GROUP BY 1
  UNION ALL SELECT cluster_id, 4, 'mutually_exclusive_attribute', min_by(l || ',' || r, (l, r)) FROM kp WHERE contra GROUP BY 1
  UNION ALL SELECT cluster_id, 5, 'identity_authority', string_agg(member, ',' ORDER BY member) FROM k WHERE own AND cluster_id IN (SELECT cluster_id FROM c GROUP BY 1 HAVING count(*) > 1) GROUP BY 1)
"""
SQL = {
    "normalize_identifiers": r"""WITH n AS (SELECT row_id, regexp_replace(lower(entity_type), '[^\p{L}\p{N}]', '', 'g') AS entity_type, CASE WHEN contains(source_key, '/') THEN regexp_replace(source_key, '/[^/]*$', '') ELSE source_key END AS source, unnest(map_entries(identifiers)) AS m FROM normalized_entities),
      v AS (SELECT row_id, entity_type, source, m.key AS namespace, list_sort(list_distinct(list_filter([CASE lower(m.key) WHEN 'doi' THEN regexp_replace(lower(regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '^(https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|doi:)', '')
        WHEN 'orcid' THEN regexp_replace(upper(x), '[^0-9X]', '', 'g') ELSE lower(regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) END for x in m.value if x IS NOT NULL], lambda y: y <> ''))) AS vs FROM n)
      SELECT row_id, entity_type, source, namespace, array_to_string(vs, '|') AS values FROM v WHERE len(vs) > 0""",
    "cluster_rules": f"""WITH {_CLUSTERS} SELECT cluster_id, seq, rule AS "constraint", offending FROM v""",
    "cluster_additions": f"""WITH {_CLUSTERS}, n AS (SELECT cluster_id, count(*) AS k FROM c GROUP BY 1 HAVING bool_or(key % 4 = 0)), p AS (SELECT cluster_id, count(*) AS q FROM pairs GROUP BY 1)
      SELECT n.cluster_id, n.cluster_id NOT IN (SELECT cluster_id FROM v) AS valid, coalesce(q, 0) AS checked_pairs, k * (k - 1) // 2 AS expected_pairs, coalesce(q, 0) = k * (k - 1) // 2 AS pairwise_complete FROM n LEFT JOIN p ON p.cluster_id = n.cluster_id""",
    "block_pairs": f"""WITH {_PARTS} SELECT l AS "left", r AS "right", 'name_brand' AS channels FROM pr""",
    "block_channels": f"""WITH {_PARTS}, u AS (SELECT 'identifier' AS channel, unnest(['doi:' || doi, 'issn:' || issn, 'orcid:' || orcid]) AS bk FROM e UNION ALL SELECT 'name', unnest(list_distinct(list_concat(['name:' || bk], CASE WHEN length(bk) >= 4 THEN ['pfx:' || substr(bk, 1, 4)] ELSE [] END, ['tok:' || x for x in string_split(bk, ' ')]))) FROM e
      UNION ALL SELECT 'source', 'part/' || p_brand FROM e) SELECT channel, bk, count(*) AS members FROM u GROUP BY 1, 2""",
    "block_cap_report": f"""WITH {_PARTS}, u AS (SELECT unnest(list_distinct(list_concat(['name:' || name], CASE WHEN length(name) >= 4 THEN ['pfx:' || substr(name, 1, 4)] ELSE [] END, ['tok:' || x for x in string_split(name, ' ')]))) AS bk FROM e)
      SELECT 'name' AS channel, bk, count(*) AS members FROM u GROUP BY 2 HAVING count(*) > 20""",
    "knn_pairs": """WITH s AS (SELECT q.vec_id AS q, v.vec_id AS v, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS n FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
      SELECT DISTINCT least(q, v) AS "left", greatest(q, v) AS "right" FROM s WHERE n <= 5""",
    "identity_signals": f"""WITH {_FEATURES} SELECT 'doi' AS namespace, CASE WHEN sd THEN 'AGREE' ELSE 'CONTRADICT' END AS agreement, count(*) AS n FROM x GROUP BY 1, 2 UNION ALL SELECT 'issn', CASE WHEN jj THEN 'AGREE' ELSE 'UNKNOWN' END, count(*) FROM x GROUP BY 1, 2
      UNION ALL SELECT 'orcid', CASE WHEN NOT pp THEN 'UNKNOWN' WHEN so THEN 'AGREE' ELSE 'CONTRADICT' END, count(*) FROM x GROUP BY 1, 2""",
    "pair_features": f"""WITH {_FEATURES} SELECT "left", "right", round(name_similarity, 6) AS name_similarity, identifier_agreement, temporal_compatible, round(geographic_distance, 6) AS geographic_distance, shared_affiliations, round(attribute_rarity, 6) AS attribute_rarity, round(source_reliability, 6) AS source_reliability, round(embedding_similarity, 6) AS embedding_similarity, round(neighborhood_compatibility, 6) AS neighborhood_compatibility, mutually_exclusive FROM y""",
    "match_scores": f"""WITH {_FEATURES} SELECT "left", "right", round(1 / (1 + exp(-({_Z}))), 6) AS probability FROM y""",
    "name_similarity": f"""WITH p AS (SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_name <= y.n_name), j AS (SELECT a, b, {_JARO} AS s, CASE WHEN substr(a, 1, 4) = substr(b, 1, 4) AND length(a) > 3 AND length(b) > 3 THEN 4 WHEN substr(a, 1, 3) = substr(b, 1, 3) AND length(a) > 2 AND length(b) > 2 THEN 3 WHEN substr(a, 1, 2) = substr(b, 1, 2) AND length(a) > 1 AND length(b) > 1 THEN 2 WHEN substr(a, 1, 1) = substr(b, 1, 1) AND a <> '' AND b <> '' THEN 1 ELSE 0 END AS k FROM p)
      SELECT a, b, round(s, 6) AS jaro, round(s + k * 0.1 * (1 - s), 6) AS jaro_winkler FROM j""",
    "er_decisions": """WITH m AS (SELECT *, calibration_key.consequence_class AS cost, match_id AS n FROM match_results),
      r AS (SELECT *, CASE WHEN 1 - probability <= CASE cost WHEN 'LOW' THEN 0.10 WHEN 'STANDARD' THEN 0.02 WHEN 'HIGH' THEN 0.002 END THEN 'AUTO_LINK' WHEN 1 - probability <= CASE cost WHEN 'LOW' THEN 0.40 WHEN 'STANDARD' THEN 0.25 WHEN 'HIGH' THEN 0.10 END THEN 'LLM_ASSESS' WHEN 1 - probability >= 0.90 THEN 'RETAIN_SEPARATE' WHEN cost IN ('LOW', 'STANDARD', 'HIGH') THEN 'GATHER_MORE_EVIDENCE' END AS route FROM m),
      a AS (SELECT match_id, CASE WHEN probability IS NULL OR probability < 0 OR probability > 1 OR cost IS NULL THEN 'REJECT' WHEN n % 11 = 0 THEN 'RETAIN_SEPARATE' WHEN n % 13 = 0 THEN 'ABSTAIN' WHEN n % 7 = 0 THEN CASE WHEN cost = 'HIGH' THEN 'HUMAN_REVIEW' ELSE 'RETAIN_SEPARATE' END WHEN n % 4 < 1 THEN 'GATHER_MORE_EVIDENCE' WHEN route = 'AUTO_LINK' AND n % 3 = 0 THEN 'PROPOSE_LINK' ELSE route END AS action FROM r)
      SELECT match_id, action, CASE action WHEN 'AUTO_LINK' THEN 'SAME_AS' WHEN 'PROPOSE_LINK' THEN 'POSSIBLY_SAME_AS' END AS link_kind, CASE WHEN action IN ('AUTO_LINK', 'RETAIN_SEPARATE', 'REJECT') THEN 'AUTO' WHEN action IN ('LLM_ASSESS', 'GATHER_MORE_EVIDENCE', 'ABSTAIN') THEN 'LLM_ASSESS' ELSE 'HUMAN' END AS route FROM a""",
    "profile_resolution": """WITH p(g, t, s, id) AS (VALUES (NULL, NULL, NULL, 'p_any'), ('lex', NULL, NULL, 'p_lex'), ('lex', 'Concept', NULL, 'p_lex_concept'), (NULL, 'Person', NULL, 'p_person'), (NULL, 'Paper', 'feed/kehalwyn', 'p_paper_feed'), ('g1', 'Person', NULL, 'p_g1_person'), ('g1', 'Person', NULL, 'p_g1_person_b'), (NULL, NULL, 'feed/kiyunari', 'p_feed')),
      e AS (SELECT row_id, graph_id, entity_type, CASE WHEN contains(source_key, '/') THEN regexp_replace(source_key, '/[^/]*$', '') ELSE source_key END AS source FROM normalized_entities),
      j AS (SELECT row_id, id, row_number() OVER (PARTITION BY row_id ORDER BY (g IS NOT NULL)::INT + (t IS NOT NULL)::INT + (s IS NOT NULL)::INT DESC, id DESC) AS n FROM e JOIN p ON (g IS NULL OR g = graph_id) AND (t IS NULL OR t = entity_type) AND (s IS NULL OR s = source))
      SELECT row_id, id AS profile_id FROM j WHERE n = 1""",
    "select_survivor": f"WITH {_MEM}, r AS (SELECT cluster_id, member, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(rel, -1) DESC, coalesce(ids, 0) DESC, member) AS k FROM m) SELECT cluster_id, member AS survivor FROM r WHERE k = 1",
    "matcher_evaluation": f"""WITH {_GOLD}, c AS (SELECT {_CONF}, count(*) AS samples, avg(abs(p - y::INT)) AS ce FROM g) SELECT tp, fp, fn, tn, samples, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS false_merge, round(fn / nullif(fn + tp, 0), 6) AS false_split, round(ce, 6) AS calibration_error FROM c""",
    "arm_comparison": f"WITH {_GOLD}, c AS (SELECT arm, {_CONF} FROM arms GROUP BY arm) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision FROM c",
    "promotion_gate": f"""WITH {_GOLD}, c AS (SELECT arm, {_CONF}, count(*) AS n FROM arms GROUP BY arm), q AS (SELECT arm, n, tp / nullif(tp + fp, 0) AS pr, fp / nullif(fp + tn, 0) AS fm FROM c)
      SELECT 'rules' AS base, 'name_only' AS candidate, coalesce(a.n >= 30 AND b.n >= 30 AND b.pr - a.pr >= 0.01 AND b.fm <= a.fm, false) AS raise_threshold FROM q a, q b WHERE a.arm = 'rules' AND b.arm = 'name_only'""",
    "cluster_pr": """WITH v AS (SELECT vec_id, label AS gc, label * 3 + vec_id % 3 AS pc FROM embeddings), k AS (SELECT (SELECT count(*) FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.gc = b.gc AND a.pc = b.pc) AS both_pairs, (SELECT count(*) FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.pc = b.pc) AS predicted_pairs, (SELECT count(*) FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.gc = b.gc) AS gold_pairs)
      SELECT *, round(both_pairs / nullif(predicted_pairs, 0), 6) AS precision, round(both_pairs / nullif(gold_pairs, 0), 6) AS recall FROM k""",
}
