"""Cluster constraints, survivor choice, decision gates and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright import config
from graphwright.functions.text import source_of
from graphwright.operators.normalize import normalize_entity_type


def cluster_violations(members: DataFrame, pair_results: DataFrame | None = None, allow_multiple: tuple[str, ...] = (), authority: bool = False) -> DataFrame:
    """(cluster_id, seq, constraint, offending) of the rules that a proposed membership breaks, each named by its first offence in key order.

    ``members`` has cluster_id, member, cluster_graph, cluster_type, graph_id,
    entity_type, valid_from, valid_to, and optionally ids (identifier map) and
    is_protected; members without an entity row have a null graph_id and no
    rule looks at them.  Order: pairs known to exclude each other (0, one row
    per pair), tenant boundary (1), periods (2), one member per source (3),
    contradicting identifiers (4), and with ``authority`` protected members of
    a real merge (5, all of them).  ``pair_results`` has left, right and
    mutually_exclusive.
    """
    m = members.dropDuplicates(["cluster_id", "member"])
    known = m.filter("graph_id is not null")
    parts = [
        known.filter("graph_id <> cluster_graph or entity_type <> cluster_type").groupBy("cluster_id").agg(F.array(F.min("member")).alias("offending")).select("cluster_id", F.lit(1).alias("seq"), F.lit("tenant_boundary").alias("constraint"), "offending"),
        _apart_in_time(known).select("cluster_id", F.lit(2).alias("seq"), F.lit("temporal_consistency").alias("constraint"), "offending"),
        _same_source(known, allow_multiple).select("cluster_id", F.lit(3).alias("seq"), F.lit("unique_source").alias("constraint"), "offending"),
    ]
    if "ids" in members.columns:
        parts.append(_contradicting(known).select("cluster_id", F.lit(4).alias("seq"), F.lit("mutually_exclusive_attribute").alias("constraint"), "offending"))
    if authority:
        many = m.groupBy("cluster_id").agg(F.count("*").alias("k")).filter("k > 1").select("cluster_id")
        owned = known.filter("is_protected").join(many, "cluster_id", "left_semi").groupBy("cluster_id").agg(F.array_sort(F.collect_set("member")).alias("offending"))
        parts.append(owned.select("cluster_id", F.lit(5).alias("seq"), F.lit("identity_authority").alias("constraint"), "offending"))
    if pair_results is not None:
        bad = pair_results.filter("mutually_exclusive = 1").select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
        a, b = m.select("cluster_id", F.col("member").alias("left")), m.select("cluster_id", F.col("member").alias("right"))
        hit = bad.join(a, "left").join(b, ["cluster_id", "right"])
        parts.append(hit.select("cluster_id", F.lit(0).alias("seq"), F.lit("pairwise_mutual_exclusion").alias("constraint"), F.array("left", "right").alias("offending")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _apart_in_time(known: DataFrame) -> DataFrame:
    """(cluster_id, offending): the first pair, in key order, whose periods are provably apart (open ends are unbounded).

    A member is apart from some other iff it ends before the latest beginning
    of the others or begins after their earliest end; two extremes of each kind
    per cluster tell that, so no pairs are built.  The smallest such member is
    the first of the pair, and the smallest member apart from it the second.
    """
    end, begin = F.when(F.col("valid_to").isNotNull(), F.struct("valid_to", "member")), F.when(F.col("valid_from").isNotNull(), F.struct("valid_from", "member"))
    first = known.groupBy("cluster_id").agg(F.min(end).alias("e1"), F.max(begin).alias("b1"))
    k = known.select("cluster_id", "member", "valid_from", "valid_to")
    next_ = k.join(first, "cluster_id").groupBy("cluster_id").agg(F.min(F.when(F.col("member") != F.col("e1.member"), end)).alias("e2"), F.max(F.when(F.col("member") != F.col("b1.member"), begin)).alias("b2"))
    j = k.join(first, "cluster_id").join(next_, "cluster_id")
    others_end = F.when(F.col("e1.member") == F.col("member"), F.col("e2.valid_to")).otherwise(F.col("e1.valid_to"))
    others_begin = F.when(F.col("b1.member") == F.col("member"), F.col("b2.valid_from")).otherwise(F.col("b1.valid_from"))
    i = j.filter((F.col("valid_to") < others_begin) | (F.col("valid_from") > others_end)).groupBy("cluster_id").agg(F.min(F.struct("member", "valid_from", "valid_to")).alias("i"))
    apart = (F.col("member") != F.col("i.member")) & (F.coalesce(F.col("i.valid_to") < F.col("valid_from"), F.lit(False)) | F.coalesce(F.col("valid_to") < F.col("i.valid_from"), F.lit(False)))
    return k.join(i, "cluster_id").filter(apart).groupBy("cluster_id").agg(F.min(F.struct("i.member", F.col("member").alias("other"))).alias("p")).select("cluster_id", F.array_sort(F.array("p.member", "p.other")).alias("offending"))


def _same_source(known: DataFrame, allow_multiple: tuple[str, ...]) -> DataFrame:
    """(cluster_id, offending): the first member, in key order, whose source has an earlier one, after that one."""
    k = known.select("cluster_id", "member", source_of(F.col("member")).alias("source"))
    k = k.filter(~F.col("source").isin(*allow_multiple)) if allow_multiple else k
    n = k.withColumn("n", F.row_number().over(Window.partitionBy("cluster_id", "source").orderBy("member"))).filter("n <= 2")
    two = n.groupBy("cluster_id", "source").agg(F.min("member").alias("a"), F.max("member").alias("b"), F.count("*").alias("k")).filter("k = 2")
    return two.groupBy("cluster_id").agg(F.min(F.struct("b", "a")).alias("p")).select("cluster_id", F.array("p.a", "p.b").alias("offending"))


def _contradicting(known: DataFrame) -> DataFrame:
    """(cluster_id, offending): the first pair, in key order, with disjoint values in a namespace whose disagreement is decisive for both.

    Members with one set of values in a namespace are represented by the
    smallest of them, so pairs are built between different sets only.
    """
    each = known.select("cluster_id", "member", normalize_entity_type(F.col("entity_type")).alias("t"), F.explode("ids").alias("namespace", "values")).filter(F.size("values") > 0)
    decisive = F.col("namespace").isin(*config.STRONG_NAMESPACES)
    for n, (types, contradicts) in config.SCOPED_NAMESPACES.items():
        if contradicts:
            decisive = decisive | ((F.col("namespace") == n) & F.col("t").isin(*types))
    sets = each.filter(decisive).groupBy("cluster_id", "namespace", F.array_sort(F.array_distinct("values")).alias("values")).agg(F.min("member").alias("member"))
    a, b = sets.select("cluster_id", "namespace", F.col("values").alias("va"), F.col("member").alias("a")), sets.select("cluster_id", "namespace", F.col("values").alias("vb"), F.col("member").alias("b"))
    hit = a.join(b, ["cluster_id", "namespace"]).filter((F.col("a") < F.col("b")) & ~F.arrays_overlap("va", "vb"))
    return hit.groupBy("cluster_id").agg(F.min(F.struct("a", "b")).alias("p")).select("cluster_id", F.array("p.a", "p.b").alias("offending"))


def with_members(members: DataFrame, additions: DataFrame) -> DataFrame:
    """Membership that would result from adding rows (the columns of ``members``) to their clusters; members that are there already change nothing."""
    return members.unionByName(additions).dropDuplicates(["cluster_id", "member"])


def validate_addition(members: DataFrame, additions: DataFrame, pair_results: DataFrame, allow_multiple: tuple[str, ...] = (), authority: bool = False) -> DataFrame:
    """``validate_clusters`` of the clusters that ``additions`` would change, as they would then be."""
    after = with_members(members.join(additions.select("cluster_id").distinct(), "cluster_id", "left_semi"), additions)
    return validate_clusters(after, pair_results, cluster_violations(after, pair_results, allow_multiple, authority))


def validate_clusters(members: DataFrame, pair_results: DataFrame, violations: DataFrame) -> DataFrame:
    """Per cluster: valid, checked pairs, expected pairs, and whether every pair was checked."""
    m = members.select("cluster_id", "member").distinct()
    size = m.groupBy("cluster_id").agg(F.count("*").alias("n"))
    known = pair_results.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
    seen = known.join(m.withColumnRenamed("member", "left"), "left").join(m.withColumnRenamed("member", "right"), ["cluster_id", "right"]).groupBy("cluster_id").agg(F.count("*").alias("checked_pairs"))
    bad = violations.select("cluster_id").distinct().withColumn("_bad", F.lit(True))
    out = size.join(seen, "cluster_id", "left").join(bad, "cluster_id", "left")
    expected = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    return out.select("cluster_id", F.col("_bad").isNull().alias("valid"), F.coalesce("checked_pairs", F.lit(0)).cast("bigint").alias("checked_pairs"), expected.alias("expected_pairs"), (F.coalesce("checked_pairs", F.lit(0)) == expected).alias("pairwise_complete"))


def select_survivor(members: DataFrame) -> DataFrame:
    """(cluster_id, survivor): highest reliability (null and members without an entity row lowest), then most identifier values, then the smallest key."""
    best = F.min(F.struct((-F.coalesce("reliability", F.lit(-1.0))).alias("r"), (-F.coalesce("identifiers", F.lit(0))).alias("n"), F.col("member").alias("m")))
    return members.groupBy("cluster_id").agg(best.alias("b")).select("cluster_id", F.col("b.m").alias("survivor"))


def is_stale(snapshot_id: Column, snapshot_version: Column, cluster_id: Column, version: Column) -> Column:
    return ~(snapshot_id.eqNullSafe(cluster_id) & snapshot_version.eqNullSafe(version))


def risk_route(p: Column, cost: Column) -> Column:
    """AUTO_LINK, LLM_ASSESS, RETAIN or GATHER by the risk 1 - p and the budgets of a cost class; null for unknown classes."""
    r = 1 - p
    auto = F.when(cost == "LOW", config.RISK["LOW"][0]).when(cost == "STANDARD", config.RISK["STANDARD"][0]).when(cost == "HIGH", config.RISK["HIGH"][0])
    assess = F.when(cost == "LOW", config.RISK["LOW"][1]).when(cost == "STANDARD", config.RISK["STANDARD"][1]).when(cost == "HIGH", config.RISK["HIGH"][1])
    return F.when(r <= auto, "AUTO_LINK").when(r <= assess, "LLM_ASSESS").when(r >= config.RETAIN_RISK, "RETAIN_SEPARATE").when(auto.isNotNull(), "GATHER_MORE_EVIDENCE")


def decide(p: Column, mode: Column, cost: Column, stale: Column, cluster_valid: Column, evidence: Column, required: Column, auto_allowed: Column) -> Column:
    """Action on a pair: the first gate that applies decides."""
    route = risk_route(p, cost)
    return (
        F.when(p.isNull() | (p < 0) | (p > 1) | cost.isNull(), "REJECT").when(mode == "INERT", "RETAIN_SEPARATE").when(stale, "ABSTAIN")
        .when(~cluster_valid, F.when(cost == "HIGH", "HUMAN_REVIEW").otherwise("RETAIN_SEPARATE")).when(evidence < required, "GATHER_MORE_EVIDENCE").when((route == "AUTO_LINK") & ~auto_allowed, "PROPOSE_LINK").otherwise(route)
    )


def link_kind(action: Column) -> Column:
    return F.when(action == "AUTO_LINK", "SAME_AS").when(action == "PROPOSE_LINK", "POSSIBLY_SAME_AS")


def action_route(action: Column) -> Column:
    return F.when(action.isin("AUTO_LINK", "RETAIN_SEPARATE", "REJECT"), "AUTO").when(action.isin("LLM_ASSESS", "GATHER_MORE_EVIDENCE", "ABSTAIN"), "LLM_ASSESS").otherwise("HUMAN")


def resolve_profiles(rows: DataFrame, profiles: DataFrame, default: str = "default") -> DataFrame:
    """Adds ``profile_id``: of the profiles whose pinned fields all match, the one with most pinned fields, then the largest id; else the default.

    ``profiles`` is a configuration table of wildcards (null matches all).  A
    profile is looked up once per distinct (graph_id, entity_type, source) and
    per pattern of pinned fields by equality, so nothing is crossed.
    """
    keys = ["graph_id", "entity_type", "source"]
    d = rows.select(*keys).distinct()
    pinned = sum((F.col(k).isNotNull().cast("int") for k in keys), F.lit(0))
    p = profiles.select(*keys, "profile_id").withColumn("_pins", pinned)
    hits = None
    for mask in range(8):
        on = [k for i, k in enumerate(keys) if mask >> i & 1]
        part = p.filter(F.expr(" and ".join(f"{k} is {'not ' if k in on else ''}null" for k in keys))).select(*on, "profile_id", "_pins")
        if on:
            j = d.join(part, on)
        else:
            j = d.withColumn("_one", F.lit(1)).join(part.groupBy().agg(F.max("profile_id").alias("profile_id"), F.max("_pins").alias("_pins")).filter("profile_id is not null").withColumn("_one", F.lit(1)), "_one").drop("_one")
        j = j.select(*keys, "profile_id", "_pins")
        hits = j if hits is None else hits.unionByName(j)
    best = hits.groupBy(*keys).agg(F.max(F.struct("_pins", "profile_id")).alias("_b")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b.profile_id").alias("_profile"))
    cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(best, cond, "left").withColumn("profile_id", F.coalesce("_profile", F.lit(default))).drop("_profile", *[f"_{k}" for k in keys])


def auto_link_permitted(authority: Column, mode: Column, actions: Column) -> Column:
    """Whether a profile may link by itself: open authority, active resolution, and the action on its list."""
    return F.coalesce((authority == "OPEN") & (mode == "ACTIVE") & F.array_contains(actions, "AUTO_LINK"), F.lit(False))


def fold_assessments(baseline: DataFrame, assessments: DataFrame) -> DataFrame:
    """(pair_id, baseline, final, consulted): advisers are heard only where the baseline is LLM_ASSESS.

    ``baseline`` has pair_id, baseline, auto_allowed and optionally er_mode;
    ``assessments`` pair_id, recommendation and optionally abstained.  Without
    an answer that is no abstention the baseline stands.  Any ``different``
    keeps the pair apart; else anything but ``same`` gathers evidence; ``same``
    from all links if allowed, proposes under ADVISORY or ACTIVE resolution,
    and keeps apart otherwise.
    """
    a = assessments if "abstained" in assessments.columns else assessments.withColumn("abstained", F.lit(False))
    a = a.filter(~F.coalesce("abstained", F.lit(False)))
    said = a.groupBy("pair_id").agg(F.coalesce(F.bool_or(F.col("recommendation") == "different"), F.lit(False)).alias("diff"), F.coalesce(F.bool_and(F.coalesce(F.col("recommendation") == "same", F.lit(False))), F.lit(False)).alias("same"))
    out = baseline.join(said, "pair_id", "left")
    mode = F.col("er_mode") if "er_mode" in baseline.columns else F.lit("ACTIVE")
    same = F.when(F.col("auto_allowed"), "AUTO_LINK").when(mode.isin("ADVISORY", "ACTIVE"), "PROPOSE_LINK").otherwise("RETAIN_SEPARATE")
    heard = F.when(F.col("diff"), "RETAIN_SEPARATE").when(F.col("same"), same).otherwise("GATHER_MORE_EVIDENCE")
    usable = (F.col("baseline") == "LLM_ASSESS") & F.col("same").isNotNull()
    return out.select("pair_id", "baseline", F.when(usable, heard).otherwise(F.col("baseline")).alias("final"), F.coalesce(usable, F.lit(False)).alias("consulted"))
