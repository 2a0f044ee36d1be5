"""Identity signals, pair features and match scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright import config
from graphwright.functions import similarity as sim
from graphwright.functions.text import source_of
from graphwright.operators.normalize import normalize_entity_type

FEATURES = ("name_similarity", "identifier_agreement", "temporal_compatible", "geographic_distance", "shared_affiliations", "attribute_rarity", "source_reliability", "embedding_similarity", "neighborhood_compatibility", "mutually_exclusive")


def attach(pairs: DataFrame, entities: DataFrame, key: str = "source_key") -> DataFrame:
    """Pairs (left, right, ...) with both normalised views as structs ``l`` and ``r``; ``entities`` has one row per key."""
    view = lambda side, s: entities.select(F.col(key).alias(side), F.struct(*[c for c in entities.columns if c != key]).alias(s))
    return pairs.join(view("left", "l"), "left").join(view("right", "r"), "right")


def attach_within(left: DataFrame, right: DataFrame, block: str, key: str = "source_key") -> DataFrame:
    """(left, right, l, r) of all pairs of a block, left < right, of two views of the same rows, each with one block.

    No pair can come up twice then, so pairs are made where the rows of their
    block meet and are neither shuffled nor written; only the rows are.
    """
    view = lambda e, side, s: e.select(block, F.col(key).alias(side), F.struct(*[c for c in e.columns if c not in (key, block)]).alias(s))
    return view(left, "left", "l").join(view(right, "right", "r").hint("merge"), block).filter("left < right").select("left", "right", "l", "r")


def identity_signals(attached: DataFrame) -> DataFrame:
    """(left, right, namespace, agreement) per identifier namespace that both sides have and that can identify.

    A namespace identifies if it is strong, or scoped and the type of either
    side is in its scope; a scoped one off its subjects says UNKNOWN.  Shared
    values AGREE; disjoint ones CONTRADICT, or say UNKNOWN where the scope does
    not contradict.
    """
    known = (*config.STRONG_NAMESPACES, *config.SCOPED_NAMESPACES)
    both = attached.select("left", "right", F.col("l.entity_type").alias("lt"), F.col("r.entity_type").alias("rt"), F.col("l.ids").alias("li"), F.col("r.ids").alias("ri"))
    ns = F.array_intersect(F.array_intersect(F.map_keys("li"), F.map_keys("ri")), F.array(*map(F.lit, known)))
    x = both.select("left", "right", "lt", "rt", "li", "ri", F.explode(ns).alias("namespace"))
    shared = F.arrays_overlap(x["li"][x["namespace"]], x["ri"][x["namespace"]])
    verdict = F.when(F.col("namespace").isin(*config.STRONG_NAMESPACES), F.when(shared, "AGREE").otherwise("CONTRADICT"))
    for n, (types, contradicts) in config.SCOPED_NAMESPACES.items():
        inside = normalize_entity_type(F.col("lt")).isin(*types) & normalize_entity_type(F.col("rt")).isin(*types)
        verdict = verdict.when(F.col("namespace") == n, F.when(~inside, "UNKNOWN").when(shared, "AGREE").otherwise("CONTRADICT" if contradicts else "UNKNOWN"))
    return x.select("left", "right", "namespace", verdict.alias("agreement"))


def identifier_agreement(signals: DataFrame) -> DataFrame:
    """Per pair: CONTRADICT beats AGREE beats UNKNOWN."""
    any_ = lambda v: F.bool_or(F.col("agreement") == v)
    return signals.groupBy("left", "right").agg(F.when(any_("CONTRADICT"), "CONTRADICT").when(any_("AGREE"), "AGREE").otherwise("UNKNOWN").alias("agreement"))


def identifier_frequency(entities: DataFrame) -> DataFrame:
    """(value, frequency): rows that carry each identifier value."""
    return entities.select(F.explode(F.array_distinct(F.flatten(F.map_values("ids")))).alias("value")).groupBy("value").agg(F.count("*").alias("frequency"))


def attribute_rarity(attached: DataFrame, signals: DataFrame, frequency: DataFrame) -> DataFrame:
    """(left, right, attribute_rarity): greatest 1 / frequency over shared identifier values outside namespaces that say UNKNOWN."""
    each = attached.select("left", "right", F.explode(F.map_keys("l.ids")).alias("namespace"), F.col("l.ids").alias("li"), F.col("r.ids").alias("ri")).filter(F.map_contains_key("ri", F.col("namespace")))
    each = each.join(signals.filter("agreement = 'UNKNOWN'").select("left", "right", "namespace"), ["left", "right", "namespace"], "left_anti")
    vals = each.select("left", "right", F.explode(F.array_intersect(F.col("li")[F.col("namespace")], F.col("ri")[F.col("namespace")])).alias("value"))
    return vals.join(frequency, "value").groupBy("left", "right").agg(F.max(1.0 / F.col("frequency")).alias("attribute_rarity"))


def with_frequency(entities: DataFrame, key: str = "source_key") -> DataFrame:
    """Adds ``id_freq``: how many rows carry each identifier value of the row; ``entities`` has one row per key."""
    each = entities.select(key, F.explode(F.array_distinct(F.flatten(F.map_values("ids")))).alias("value"))
    n = each.groupBy("value").agg(F.count("*").alias("n"))
    # as many rows as ``entities``, whatever size Spark guesses for what is exploded: never broadcast
    own = each.join(n.hint("merge"), "value").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("id_freq"))
    return entities.join(own.hint("merge"), key, "left")


#: Columns that count as null where entities lack them.
OPTIONAL = {"valid_from": "timestamp", "valid_to": "timestamp", "latitude": "double", "longitude": "double", "affiliations": "array<string>", "neighbors": "array<string>", "source_reliability": "double", "embedding": "array<double>"}
#: Namespaces that can identify, and those of them that do so for some types only.
_KNOWN = sorted((*config.STRONG_NAMESPACES, *config.SCOPED_NAMESPACES))
_SCOPED = sorted(config.SCOPED_NAMESPACES)
#: Digits of a frequency in a tag.
_DIGITS = 19


def _view(entities: DataFrame, key: str, rarity: bool, *more: str) -> DataFrame:
    """What features need of an entity, once per entity: the values of each namespace (null without any), whether it is in scope, and its identifiers as tags that begin with their frequency."""
    e = entities.select("*", *[F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items() if c not in entities.columns])
    e = with_frequency(e, key) if rarity else e.withColumn("id_freq", F.lit(None).cast("map<string,bigint>"))
    kind = normalize_entity_type(F.col("entity_type"))
    values = lambda n: F.try_element_at("ids", F.lit(n))
    tagged = lambda n, vs: F.transform(vs, lambda x: F.concat(F.lpad(F.try_element_at("id_freq", x).cast("string"), _DIGITS, "0"), n, F.lit("\t"), x))
    known = [F.when(F.size(values(n)) > 0, values(n)).alias(f"ids_{n}") for n in _KNOWN]
    scope = [kind.isin(*config.SCOPED_NAMESPACES[n][0]).alias(f"in_{n}") for n in _SCOPED]
    tags = [tagged(F.lit(n), values(n)).alias(f"tags_{n}") for n in _SCOPED]
    rest = F.map_entries(F.map_filter("ids", lambda n, _: ~n.isin(*_SCOPED)))
    return e.select(key, *more, "names", *known, *scope, *tags, F.flatten(F.transform(rest, lambda x: tagged(x["key"], x["value"]))).alias("tags"), sim.norm(F.col("embedding")).alias("norm"), *OPTIONAL)


def _verdicts(l: Column, r: Column) -> dict[str, Column]:  # noqa: E741
    """Per namespace that can identify: 1 for agreement, -1 for contradiction, 0 for seen and not weighed, null where a side has no value."""
    out = {}
    for n in _KNOWN:
        x, y = l[f"ids_{n}"], r[f"ids_{n}"]
        both, shared = x.isNotNull() & y.isNotNull(), F.arrays_overlap(x, y)
        if n in config.STRONG_NAMESPACES:
            out[n] = F.when(both, F.when(shared, 1).otherwise(-1))
        else:
            contradicts = config.SCOPED_NAMESPACES[n][1]
            out[n] = F.when(both, F.when(~(l[f"in_{n}"] & r[f"in_{n}"]), 0).when(shared, 1).otherwise(-1 if contradicts else 0))
    return out


def pair_features(pairs: DataFrame, entities: DataFrame, key: str = "source_key", rarity: bool = True, batched_names: bool = True) -> DataFrame:
    """The ten features of each pair (left, right); a feature that cannot be computed is null, never 0.

    ``entities`` is the normalised view, one row per key; columns that it lacks
    count as null.  Everything but the names is native and computed in one pass
    over the pairs; frequencies of identifiers are put beside the entities
    before.  ``batched_names`` compares names in Arrow batches, else natively.
    """
    names = (sim.best_name_similarity_batched if batched_names else sim.best_name_similarity)(F.col("l.names"), F.col("r.names"))
    return _features_of(attach(pairs, _view(entities, key, rarity), key), names, rarity)


def block_features(entities: DataFrame, block: str, key: str = "source_key", rarity: bool = True) -> DataFrame:
    """``pair_features`` of all pairs of each block; every row of ``entities`` has one block.

    Python would keep all pairs of a task on disk until they are compared.  So
    it compares each row's names with the distinct names of the block before:
    8 bytes per row and distinct names are shuffled, and a pair only looks up
    its similarity.
    """
    e = _view(entities, key, rarity, block)
    each = e.filter(F.col(block).isNotNull() & F.col("names").isNotNull()).select(block, "names").distinct()
    all_ = each.groupBy(block).agg(F.array_sort(F.collect_list("names")).alias("_all"))
    named = each.join(all_.hint("merge"), block).select(block, "names", F.array_position("_all", F.col("names")).cast("int").alias("name"), sim.name_similarities_batched(F.col("names"), F.col("_all")).alias("alike"))
    e = e.join(named.hint("merge"), [block, "names"], "left").drop("names")
    return _features_of(attach_within(e, e.drop("alike"), block, key), F.get(F.col("l.alike"), F.col("r.name") - 1), rarity)


def _features_of(a: DataFrame, names: Column, rarity: bool) -> DataFrame:
    l, r = F.col("l"), F.col("r")  # noqa: E741
    v = _verdicts(l, r)
    temporal = sim.temporal_compatible(l["valid_from"], l["valid_to"], r["valid_from"], r["valid_to"])
    # what is looked at more than once is a column of its own
    a = a.select("left", "right", "l", "r", *[c.alias(f"v_{n}") for n, c in v.items()], temporal.alias("t"))
    v = {n: F.col(f"v_{n}") for n in v}
    any_ = lambda k: F.coalesce(*[F.when(c == k, True) for c in v.values()], F.lit(False))
    agree, temporal = F.when(any_(-1), -1.0).when(any_(1), 1.0), F.col("t")
    # the least tag that both have is the rarest value; namespaces seen and not weighed say nothing
    least = [F.array_min(F.array_intersect(l["tags"], r["tags"])), *[F.when(v[n] != 0, F.array_min(F.array_intersect(l[f"tags_{n}"], r[f"tags_{n}"]))) for n in _SCOPED]]
    rare = F.lit(1.0) / F.substring(F.least(*least), 1, _DIGITS).cast("bigint")
    return a.select(
        "left", "right", names.alias("name_similarity"), agree.alias("identifier_agreement"), temporal.cast("double").alias("temporal_compatible"), sim.haversine_km(l["latitude"], l["longitude"], r["latitude"], r["longitude"]).alias("geographic_distance"),
        sim.shared_count(l["affiliations"], r["affiliations"]).cast("double").alias("shared_affiliations"), (rare if rarity else F.lit(None).cast("double")).alias("attribute_rarity"), sim.both_least(l["source_reliability"], r["source_reliability"]).alias("source_reliability"),
        sim.cosine(l["embedding"], r["embedding"], l["norm"], r["norm"]).alias("embedding_similarity"), sim.jaccard(l["neighbors"], r["neighbors"]).alias("neighborhood_compatibility"), F.coalesce((agree == -1.0) | ~temporal, agree == -1.0, ~temporal, F.lit(False)).cast("double").alias("mutually_exclusive"),
    )


def run_identity_rules(attached: DataFrame, rules: list | None = None) -> DataFrame:
    """(rule, left, right, namespace, agreement): signals of all rules (name, DataFrame -> DataFrame), in rule order by ``rule``."""
    out = None
    for i, (name, rule) in enumerate(rules or [("shared_strong_identifier", identity_signals)]):
        part = rule(attached).select(F.lit(i).alias("rule_order"), F.lit(name).alias("rule"), "left", "right", "namespace", "agreement")
        out = part if out is None else out.unionByName(part)
    return out


def linear_score(weights: dict[str, float], intercept: float, feature=F.col) -> Column:
    """Intercept plus the weighted features that are present, added in the order of their names."""
    z = F.lit(float(intercept))
    for name in sorted(weights):
        z = z + F.coalesce(feature(name) * F.lit(float(weights[name])), F.lit(0.0))
    return z


def sigmoid(z: Column) -> Column:
    """Logistic function in the form that cannot overflow."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def rule_score(feature=F.col) -> Column:
    """Probability of the rule matcher."""
    return sigmoid(linear_score(config.RULE_WEIGHTS, config.RULE_INTERCEPT, feature))


def calibrated_scores(features: DataFrame, models: DataFrame, keys: list[str], default: dict[str, float], intercept: float) -> DataFrame:
    """Adds ``probability`` by the weights of ``models`` (keys, weights map, intercept); pairs of no model take the default."""
    w = F.create_map(*[x for k, v in default.items() for x in (F.lit(k), F.lit(float(v)))])
    one = models.groupBy(*keys).agg(F.min(F.struct("intercept", F.map_entries("weights").alias("w"))).alias("_m"))
    out = features.join(one, keys, "left").withColumn("_w", F.coalesce(F.map_from_entries("_m.w"), w)).withColumn("_z", F.coalesce("_m.intercept", F.lit(float(intercept))))
    for name in sorted(FEATURES):
        out = out.withColumn("_z", F.col("_z") + F.coalesce(F.col(name) * F.try_element_at("_w", F.lit(name)), F.lit(0.0)))
    return out.withColumn("probability", sigmoid(F.col("_z"))).drop("_m", "_w", "_z")


def calibration_key(graph: Column, entity_type: Column, left: Column, right: Column, version: Column, consequence: Column) -> Column:
    """Key of a calibration model; the two sources stand in order."""
    a, b = source_of(left), source_of(right)
    return F.struct(graph.alias("graph_id"), entity_type.alias("entity_type"), F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).alias("source_pair"), version.alias("matcher_version"), consequence.alias("consequence_class"))
