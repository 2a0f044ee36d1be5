"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

_MEMBERS = """
  top AS (SELECT cluster_id, max(coalesce(version, -1)) AS v FROM clusters WHERE entity_type = '{kind}' AND cluster_id IS NOT NULL GROUP BY cluster_id),
  members AS (SELECT DISTINCT c.cluster_id, m.member FROM clusters c JOIN top t ON t.cluster_id = c.cluster_id AND t.v = coalesce(c.version, -1),
    unnest(c.members) AS m(member) WHERE c.entity_type = '{kind}' AND m.member IS NOT NULL)
"""

_NOTHING = "'tbd','tba','tbc','null','nil','none','nan','na','ka','unknown','unbekannt','inconnu','inconnue','desconocido','missing','undefined','unspecified','notavailable','notknown','notgiven','notspecified','notapplicable','nodata','novalue','tobeadded','tobeannounced','tobedetermined','keineangabe','keineangaben'"

SQL: dict[str, str] = {
    "p5_found": f"""
WITH RECURSIVE {_MEMBERS.format(kind="Concept")},
  decided AS (SELECT least(left_key, right_key) AS a, greatest(left_key, right_key) AS b, link_kind,
    row_number() OVER (PARTITION BY least(left_key, right_key), greatest(left_key, right_key) ORDER BY decided_at DESC NULLS LAST, match_id DESC) AS n
    FROM match_results WHERE left_key <> right_key),
  links AS (SELECT a, b FROM decided WHERE n = 1 AND link_kind = 'SAME_AS'
    UNION SELECT x.member, y.member FROM members x JOIN members y ON x.cluster_id = y.cluster_id AND x.member <> y.member),
  e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  walk AS (SELECT a AS v, a AS w FROM e UNION SELECT walk.v, e.b FROM walk JOIN e ON e.a = walk.w)
SELECT v AS source_key, min(w) AS group_key FROM walk GROUP BY v""",
    "p6_found": rf"""
WITH {_MEMBERS.format(kind="Paper")},
  merged AS (SELECT DISTINCT plan.cluster_id AS cluster_id FROM evolution_results WHERE kind = 'MERGE' AND plan.cluster_id IS NOT NULL),
  cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY stored_at DESC NULLS LAST, row_id DESC) AS n FROM normalized_entities) WHERE n = 1),
  m AS (SELECT s.cluster_id, c.source_key, c.source_reliability AS r, c.stored_at AS t, c.normalized_names[1] AS name, c.identifiers['doi'][1] AS doi,
      c.attributes['venue'] AS venue, c.attributes['proposed_year'] AS proposed_year, c.attributes['publisher'] AS publisher
    FROM members s JOIN merged g ON g.cluster_id = s.cluster_id JOIN cur c ON c.source_key = s.member),
  f AS (SELECT cluster_id, source_key, r, t, unnest(['name', 'doi', 'venue', 'proposed_year', 'publisher']) AS field, unnest([name, doi, venue, proposed_year, publisher]) AS value FROM m),
  u AS (SELECT *, coalesce(regexp_replace(lower(value), '[^\p{{L}}\p{{N}}]', '', 'g') NOT IN ('', {_NOTHING}), false) AS good FROM f),
  n AS (SELECT cluster_id, source_key, any_value(r) AS r, any_value(t) AS t, count(*) FILTER (WHERE good) AS full_ FROM u GROUP BY cluster_id, source_key),
  picked AS (SELECT cluster_id, field, source_key, row_number() OVER (PARTITION BY cluster_id, field ORDER BY r DESC NULLS LAST, t DESC NULLS LAST, source_key) AS k FROM u WHERE good
    UNION ALL SELECT cluster_id, 'into', source_key, row_number() OVER (PARTITION BY cluster_id ORDER BY r DESC NULLS LAST, full_ DESC, t DESC NULLS LAST, source_key) FROM n)
SELECT cluster_id, field, source_key FROM picked WHERE k = 1""",
}
