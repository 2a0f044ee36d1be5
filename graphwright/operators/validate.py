"""Candidate validation: every rule is applied, reasons are collected in rule order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright import config
from graphwright.functions.hashing import GRAPH_ID
from graphwright.functions.text import is_blank

SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$"


def version_compatible(version: Column, installed: str = config.INSTALLED_VERSION, exact: bool = False) -> Column:
    """Same major and at most the installed minor; or equality with ``exact``.  Null and malformed versions are not."""
    if exact:
        return F.coalesce(version == installed, F.lit(False))
    major, minor, _ = installed.split(".")
    part = lambda k: F.regexp_extract(version, SEMVER, k).try_cast("bigint")
    return F.coalesce(version.rlike(SEMVER) & (part(1) == int(major)) & (part(2) <= int(minor)), F.lit(False))


def validate(candidates: DataFrame, graph: str | None = None, installed: str = config.INSTALLED_VERSION, exact: bool = False) -> DataFrame:
    """Adds ``reasons`` (in rule order), ``failure_kind`` (the most severe, null if none) and ``valid``.

    Null kinds, graphs, producers and versions fail their rule.  Rows, repeated
    ones included, are judged one by one; nothing is shuffled.
    """
    rules = [
        (~F.col("candidate_kind").isin(*config.SUPPORTED_KINDS) | F.col("candidate_kind").isNull(), "UNSUPPORTED_ONTOLOGY", "unsupported kind"),
        (~F.coalesce(F.col("graph_id").rlike(GRAPH_ID), F.lit(False)), "BAD_DATA", "malformed graph id"),
        (is_blank(F.col("producer")), "BAD_DATA", "blank producer"),
        *([(~F.col("graph_id").eqNullSafe(graph), "BAD_DATA", "outside graph scope")] if graph is not None else []),
        (~version_compatible(F.col("contract_version"), installed, exact), "BAD_DATA", "incompatible version"),
    ]
    hits = F.filter(F.array(*[F.when(bad, F.struct(F.lit(config.SEVERITY[kind]).alias("severity"), F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))) for bad, kind, reason in rules]), lambda x: x.isNotNull())
    out = candidates.withColumn("_hits", hits)
    return out.withColumn("reasons", F.transform("_hits", lambda h: h["reason"])).withColumn("failure_kind", F.array_max("_hits")["kind"]).withColumn("valid", F.size("_hits") == 0).drop("_hits")


def accepted(validated: DataFrame) -> DataFrame:
    """The gate: only valid rows go on."""
    return validated.filter("valid")
