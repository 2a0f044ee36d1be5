"""The surviving value of each field of a group of duplicates.

``discover`` is iterative truth discovery: the support of a value is made of
the reliabilities of the sources that vote for it, the reliability of a source
of the support its values got, in turns until nothing moves.  With reliabilities
pinned to what the records state (``choose_stated``) every record is a source of
its own, a value is supported by its strongest vote, and the alternation stands
still after its first half.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions.text import source_of
from graphwright.llm.components import current_members
from graphwright.session import cut

FIELDS = ("name", "doi", "venue", "proposed_year", "publisher")
# Texts, reduced to letters and digits, that say only that nothing is known.
NOTHING = (
    "tbd", "tba", "tbc", "null", "nil", "none", "nan", "na", "ka", "unknown", "unbekannt", "inconnu", "inconnue", "desconocido", "missing", "undefined", "unspecified",
    "notavailable", "notknown", "notgiven", "notspecified", "notapplicable", "nodata", "novalue", "tobeadded", "tobeannounced", "tobedetermined", "keineangabe", "keineangaben",
)
#: Rounds after which a discovery that still moves is called not converged, and the change of a reliability below which the rounds end.
MAX_ROUNDS, TOLERANCE = 100, 1e-4
#: How far a round moves the reliabilities towards the new estimate: damping keeps them from swinging between two states.
STEP = 0.8


def usable(value: Column) -> Column:
    """The value, or null where it is null, blank, without letters and digits, or says that nothing is known."""
    bare = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")
    return F.when((F.length(bare) > 0) & ~bare.isin(*NOTHING), value)


def field_columns() -> list[Column]:
    """The five usable field values of an entity row."""
    first = lambda a: F.get(a, F.lit(0))
    raw = {"name": first(F.col("normalized_names")), "doi": first(F.try_element_at("identifiers", F.lit("doi")))} | {f: F.try_element_at("attributes", F.lit(f)) for f in FIELDS[2:]}
    return [usable(raw[f]).alias(f) for f in FIELDS]


def merge_members(entities: DataFrame, clusters: DataFrame, evolutions: DataFrame, entity_type: str = "Paper") -> DataFrame:
    """One row per cluster to merge and member with an entity row: cluster_id, source_key, reliability, stored_at and the usable fields.

    Of several rows of a key the one with the latest ``stored_at`` (null
    first), then the largest ``row_id``, is current.
    """
    merged = evolutions.filter("kind = 'MERGE'").select(F.col("plan.cluster_id").alias("cluster_id")).filter("cluster_id is not null").distinct()
    members = current_members(clusters, entity_type).join(merged, "cluster_id", "left_semi").withColumnRenamed("member", "source_key")
    rows = entities.filter("source_key is not null").select("source_key", F.struct("stored_at", "row_id", F.col("source_reliability").alias("reliability"), F.struct(*field_columns()).alias("f")).alias("r"))
    rows = rows.join(members.select("source_key").distinct(), "source_key", "left_semi")
    current = rows.groupBy("source_key").agg(F.max("r").alias("r"))
    return members.join(current, "source_key").select("cluster_id", "source_key", F.col("r.reliability").alias("reliability"), F.col("r.stored_at").alias("stored_at"), *[F.col(f"r.f.{f}").alias(f) for f in FIELDS])


def votes_of(members: DataFrame) -> DataFrame:
    """(cluster_id, field, value, source_key, reliability, stored_at): a vote of each member for each usable value it has."""
    v = members.select("cluster_id", "source_key", "reliability", "stored_at", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x"))
    return v.select("cluster_id", "x.field", "x.value", "source_key", "reliability", "stored_at").filter("value is not null")


def _preference(*before: Column) -> Column:
    """Orders votes for ``min``: high reliability (null last), then ``before``, then late ``stored_at``, then small key."""
    return F.struct((-F.coalesce("reliability", F.lit(-1.0))).alias("r"), *before, (-F.coalesce(F.unix_micros("stored_at"), F.lit(-(1 << 62)))).alias("t"), F.col("source_key").alias("source_key"))


def choose_stated(members: DataFrame) -> DataFrame:
    """(cluster_id, field, source_key): truth discovery with the reliabilities that the records state.

    ``discover_pinned`` gives the fields.  ``field`` into is the member with
    the highest reliability (null last), then the most usable values, then the
    latest ``stored_at``, then the smallest key.  A field that no member has
    gives no row.
    """
    fields = discover_pinned(votes_of(members)).select("cluster_id", "field", "source_key")
    full = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    into = members.groupBy("cluster_id").agg(F.min(_preference((-full).alias("n"))).alias("best")).select("cluster_id", F.lit("into").alias("field"), F.col("best.source_key").alias("source_key"))
    return fields.unionByName(into)


def discover_pinned(votes: DataFrame) -> DataFrame:
    """(cluster_id, field, value, source_key): the discovery where reliabilities are stated and stay as they are.

    First half: the support of each value is its strongest vote (reliability,
    null last, then the latest ``stored_at``, then the smallest key), and the
    value with the greatest support wins.  Second half: nothing to estimate, so
    the first round is the last.  Both halves reduce before the shuffle, so a
    group of any size stays small.
    """
    support = votes.groupBy("cluster_id", "field", norm_of("value").alias("norm")).agg(F.min(F.struct(_preference().alias("p"), F.col("value").alias("value"))).alias("s"))
    best = support.groupBy("cluster_id", "field").agg(F.min("s").alias("b"))
    return best.select("cluster_id", "field", F.col("b.value").alias("value"), F.col("b.p.source_key").alias("source_key"))


def norm_of(value: str) -> Column:
    """Values that differ only in case, blanks or punctuation are one value."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def discover(members: DataFrame, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(cluster_id, field, value, support, source_key, converged): truth discovery with estimated source reliabilities.

    A source's weight starts at 1; the support of a value is the share of the
    weights of its cluster and field that vote for it; the weight of a source
    moves by STEP towards the mean support of its votes, until no weight moves
    by more than ``tolerance``.  ``converged`` is false, and a warning given,
    if that takes more than ``max_rounds``.  The surviving text of the winning
    value is that of its vote with the heaviest source, then the smallest key.
    Equal supports go to the smallest value.  Votes are summed per value and
    source before any round, so copies of a record from one source count by
    number but cost nothing.
    """
    votes = votes_of(members).withColumn("source", source_of(F.col("source_key"))).withColumn("norm", norm_of("value"))
    v = cut(votes.groupBy("cluster_id", "field", "norm", "source").agg(F.count("*").alias("n"), F.min(F.struct("source_key", "value")).alias("text")))
    weights, converged = v.select("source").distinct().withColumn("w", F.lit(1.0)), False
    for _ in range(max_rounds):
        back = v.join(_support(v, weights), ["cluster_id", "field", "norm"]).groupBy("source").agg((F.sum(F.col("support") * F.col("n")) / F.sum("n")).alias("new"))
        weights = cut(weights.join(back, "source").select("source", (F.col("w") + STEP * (F.col("new") - F.col("w"))).alias("w"), F.abs(F.col("new") - F.col("w")).alias("moved")))
        moved = weights.agg(F.max("moved")).first()[0]
        weights = weights.select("source", "w")
        if moved is None or moved <= tolerance:
            converged = True
            break
    if not converged:
        warnings.warn(f"reliabilities still move after {max_rounds} rounds", stacklevel=2)
    share = _support(v, weights)
    top = share.groupBy("cluster_id", "field").agg(F.min(F.struct((-F.col("support")).alias("s"), "norm")).alias("b")).select("cluster_id", "field", F.col("b.norm").alias("norm"), (-F.col("b.s")).alias("support"))
    text = v.join(weights, "source").groupBy("cluster_id", "field", "norm").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("text.source_key").alias("source_key"), F.col("text.value").alias("value"))).alias("x"))
    out = top.join(text, ["cluster_id", "field", "norm"])
    return out.select("cluster_id", "field", F.col("x.value").alias("value"), "support", F.col("x.source_key").alias("source_key"), F.lit(converged).alias("converged"))


def _support(v: DataFrame, weights: DataFrame) -> DataFrame:
    per = v.join(weights, "source").groupBy("cluster_id", "field", "norm").agg(F.sum(F.col("w") * F.col("n")).alias("s"))
    total = per.groupBy("cluster_id", "field").agg(F.sum("s").alias("all"))
    return per.join(total, ["cluster_id", "field"]).select("cluster_id", "field", "norm", F.coalesce(F.try_divide("s", "all"), F.lit(0.0)).alias("support"))
