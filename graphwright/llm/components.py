"""Groups of linked records by low-diameter decomposition.

At each level every vertex draws an exponential shift from a hash of its name,
which is its head start: a cluster grows from it one hop per unit of time, and
a vertex belongs to the cluster that reaches it first.  Growth ends when no
vertex can be reached sooner, at most after the largest shift.  Clusters
contract to super-vertices, the edges between clusters form the next level,
and the assignments of all levels are composed at the end.  Nothing is
collected on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.operators.skew import join_to_unique
from graphwright.session import cut

#: Rate of the exponential shifts: an edge ends between clusters with a probability of at most 1 - exp(-BETA); clusters have radii of at most the largest shift, about log(vertices) / BETA.
BETA = 0.5
#: Hops of growth per written table.
HOPS = 3
#: A level with at most so many directed edges is small enough for one task and is solved there.
FINISH_EDGES = 40_000


def _shift(v: str, level: int) -> Column:
    """Exponential shift of a vertex, the same wherever it is computed."""
    u = (F.pmod(F.xxhash64(F.col(v), F.lit(level)), F.lit(1 << 52).cast("bigint")) + 1) / float((1 << 52) + 1)
    return -F.log(u) / BETA


def _hop(edges: DataFrame, best: DataFrame, rows: int) -> DataFrame:
    """One hop of growth: only vertices whose time fell send it on.  (v, t, c, moved).

    ``edges`` holds a loop for every vertex, which carries its own time over;
    so ``best`` is read once a hop, and the plan of several hops stays linear
    (``join_to_unique`` reads it twice where it finds hot keys).
    """
    sent = join_to_unique(edges, best.withColumnRenamed("v", "src"), ["src"], rows, "inner").filter("moved or src = dst")
    own = F.col("src") == F.col("dst")
    sent = sent.select(F.col("dst").alias("v"), F.when(own, F.col("t")).otherwise(F.col("t") + 1).alias("t"), "c", own.alias("own"))
    out = sent.groupBy("v").agg(F.min(F.struct("t", "c")).alias("b"), F.min(F.when(F.col("own"), F.struct("t", "c"))).alias("was"))
    return out.select("v", "b.t", "b.c", (F.col("b") != F.col("was")).alias("moved"))


def _grow(edges: DataFrame, level: int, rows: int) -> DataFrame:
    """(v, c): the cluster of every vertex of symmetric ``edges`` (src, dst), grown until it stands."""
    own = edges.select(F.col("src").alias("v"), (-_shift("src", level)).alias("t"), F.col("src").alias("c"))
    first = edges.select(F.col("dst").alias("v"), (1 - _shift("src", level)).alias("t"), F.col("src").alias("c"))
    best = own.unionByName(first).groupBy("v").agg(F.min(F.struct("t", "c")).alias("b")).select("v", "b.t", "b.c", (F.col("b.c") != F.col("v")).alias("moved"))
    loops = cut(edges.unionByName(edges.select("src", F.col("src").alias("dst")).distinct()))
    while True:
        for _ in range(HOPS):
            best = _hop(loops, best, rows)
        best = cut(best)
        if best.filter("moved").isEmpty():
            return best.select("v", "c")


def _finish(edges: DataFrame) -> DataFrame:
    """(v, c) of a level of at most FINISH_EDGES edges, by union-find in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[str, str] = {}

        def find(x: str) -> str:
            while up.setdefault(x, x) != x:
                up[x] = x = up.setdefault(up[x], up[x])
            return x

        for t in batches:
            for a, b in zip(t["src"], t["dst"], strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        yield pd.DataFrame({"v": list(up), "c": [find(x) for x in up]}, columns=["v", "c"], dtype="object")

    return edges.select("src", "dst").coalesce(1).mapInPandas(run, "v string, c string")


def components(edges: DataFrame, least_levels: int = 1, finish: int = FINISH_EDGES) -> DataFrame:
    """(v, root) for every vertex of the undirected edges (a, b); linked vertices and no others share a root.

    Null ends and loops are ignored, repeated edges count once.  A cluster
    label reaches a vertex only along edges, so contraction never joins
    vertices that are not linked.  Two linked vertices with shifts less than
    one apart can stay apart at a level; as every level draws new shifts, about
    exp(-BETA) of the edges end inside clusters each time, and the levels end.
    After ``least_levels`` levels what is left is solved in one task as soon as
    it has at most ``finish`` directed edges.
    """
    e = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    e = cut(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct())
    levels: list[DataFrame] = []
    while rows := e.count():
        if len(levels) >= least_levels and rows <= finish:
            levels.append(cut(_finish(e)))
            break
        to = _grow(e, len(levels), rows)
        levels.append(to)
        e = join_to_unique(e, to.select(F.col("v").alias("src"), F.col("c").alias("cs")), ["src"], rows, "inner")
        e = join_to_unique(e, to.select(F.col("v").alias("dst"), F.col("c").alias("cd")), ["dst"], rows, "inner")
        e = cut(e.filter("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct())
    if not levels:
        return edges.select(F.col("a").alias("v"), F.col("a").alias("root")).limit(0)
    # A vertex of a level is either in the next level too or final.
    out = levels[-1].withColumnRenamed("c", "root")
    for to in reversed(levels[:-1]):
        up = to.join(out.select(F.col("v").alias("c"), "root"), "c", "left")
        out = up.select("v", F.coalesce("root", "c").alias("root"))
    return out


def latest_links(matches: DataFrame) -> DataFrame:
    """(a, b) of the key pairs whose latest decision is SAME_AS, a < b.

    Of several decisions on a pair, in either order, the one with the latest
    ``decided_at`` (null first), then the largest ``match_id``, counts.  Null
    and equal keys are no pairs.
    """
    pairs = matches.filter("left_key <> right_key").select(F.least("left_key", "right_key").alias("a"), F.greatest("left_key", "right_key").alias("b"), F.struct("decided_at", "match_id", "link_kind").alias("d"))
    return pairs.groupBy("a", "b").agg(F.max("d").alias("d")).filter("d.link_kind = 'SAME_AS'").select("a", "b")


def current_members(clusters: DataFrame, entity_type: str) -> DataFrame:
    """(cluster_id, member), distinct, of the highest version of each cluster of a type; null ids and members are left out."""
    c = clusters.filter((F.col("entity_type") == entity_type) & F.col("cluster_id").isNotNull()).select("cluster_id", F.coalesce("version", F.lit(-1)).alias("version"), "members")
    m = c.select("cluster_id", "version", F.explode_outer(F.array_distinct("members")).alias("member")).distinct()
    top = c.groupBy("cluster_id").agg(F.max("version").alias("version"))
    return m.join(top, ["cluster_id", "version"], "left_semi").filter("member is not null").select("cluster_id", "member")


def group_keys(matches: DataFrame, clusters: DataFrame, entity_type: str = "Concept") -> DataFrame:
    """(source_key, group_key) of every key linked with another one; ``group_key`` is the smallest key of the group.

    Clusters enter as vertices of their own, so a cluster of any size costs
    one edge per member.  Empty inputs give no rows.
    """
    links = latest_links(matches).select(F.concat(F.lit("k"), "a").alias("a"), F.concat(F.lit("k"), "b").alias("b"))
    members = current_members(clusters, entity_type).select(F.concat(F.lit("k"), "member").alias("a"), F.concat(F.lit("c"), "cluster_id").alias("b"))
    comp = cut(components(links.unionByName(members)).filter(F.col("v").startswith("k")))
    small = comp.groupBy("root").agg(F.min("v").alias("least"), F.max("v").alias("most")).filter("least <> most").select("root", "least")
    out = join_to_unique(comp, small, ["root"], comp.count(), "inner")
    return out.select(F.substring("v", 2, 1 << 30).alias("source_key"), F.substring("least", 2, 1 << 30).alias("group_key"))
