"""Normalised entity views: one output row per input row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions.text import casefold, collapse_blanks, source_of, strip_blanks

__all__ = ["source_of"]

DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "doi:")


def normalize_name(col: Column) -> Column:
    """Single spaces and folded case.  Compatibility forms are left to ``normalize_name_exact``."""
    return casefold(collapse_blanks(col))


def normalize_name_exact(col: Column) -> Column:
    """The same with Unicode compatibility composition and full case folding, in Arrow batches."""
    import unicodedata

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())

    return fold(col)


def normalize_names_exact(names: Column) -> Column:
    """``normalize_name_exact`` of every text of an array; null for null."""
    import unicodedata

    @F.pandas_udf("array<string>")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: None if xs is None else [None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold() for x in xs])

    return fold(names)


def normalize_doi(col: Column) -> Column:
    """Trimmed, folded, without the first resolver or scheme prefix."""
    prefix = "|".join(p.replace(".", r"\.") for p in DOI_PREFIXES)
    return F.regexp_replace(casefold(strip_blanks(col)), f"^({prefix})", "")


def normalize_orcid(col: Column) -> Column:
    return F.regexp_replace(F.upper(col), "[^0-9X]", "")


def normalize_identifier(namespace: Column, value: Column) -> Column:
    ns = F.lower(namespace)
    return F.when(ns == "doi", normalize_doi(value)).when(ns == "orcid", normalize_orcid(value)).otherwise(casefold(strip_blanks(value)))


def normalize_entity_type(col: Column) -> Column:
    return F.regexp_replace(casefold(col), r"[^\p{L}\p{N}]", "")


def identifier_map(ids: Column) -> Column:
    """Map namespace -> sorted distinct normalised values without empty ones; null for null, namespaces without values are dropped."""
    clean = F.transform_values(ids, lambda k, vs: F.array_sort(F.array_distinct(F.filter(F.transform(vs, lambda v: normalize_identifier(k, v)), lambda v: F.length(v) > 0))))
    return F.map_filter(clean, lambda _, vs: F.size(vs) > 0)


def string_set(values: Column, exact: bool = False) -> Column:
    """Sorted distinct normalised texts; an empty array for null."""
    values = F.coalesce(values, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(normalize_names_exact(values) if exact else F.transform(values, normalize_name), lambda v: F.length(v) > 0)))


def first_vector(representations: Column) -> Column:
    """Vector of the smallest representation name whose kind is ``vector``."""
    entries = F.array_sort(F.filter(F.map_entries(representations), lambda e: e["value"]["kind"] == "vector"))
    return F.try_element_at(entries, F.lit(1))["value"]["vector"]


def graph_of_identity(identity: Column) -> Column:
    """Graph named in a canonical identity; null for other texts."""
    return F.nullif(F.regexp_extract(identity, "^kg://([^/]+)/", 1), F.lit(""))


def normalize_entities(entities: DataFrame, hooks: dict[str, dict[str, Column]] | None = None, exact: bool = True) -> DataFrame:
    """Normalised view of entity rows: names in first-seen order, identifiers, affiliations and neighbours as sets, coordinates as numbers.

    ``hooks`` adds named columns for one entity type (null for others).  Rows
    are never merged; null arrays become empty, null maps stay null.  Names,
    affiliations and neighbours are composed by compatibility unless ``exact``
    is off, which keeps ASCII corpora out of Python.  Where the columns
    ``display_name`` and ``full_name`` exist, they are the first and last name.
    """
    more = [F.array(F.col(c)) if c in entities.columns else F.array().cast("array<string>") for c in ("display_name", "full_name")]
    raw = F.concat(more[0], F.coalesce("normalized_names", F.array().cast("array<string>")), more[1])
    names = F.array_distinct(F.filter(normalize_names_exact(raw) if exact else F.transform(raw, normalize_name), lambda v: F.length(v) > 0))
    number = lambda k: F.try_element_at("attributes", F.lit(k)).try_cast("double")
    both = number("latitude").isNotNull() & number("longitude").isNotNull()
    out = entities.select(
        "row_id", "source_key", "graph_id", normalize_entity_type(F.col("entity_type")).alias("entity_type"), names.alias("names"), identifier_map(F.col("identifiers")).alias("ids"),
        string_set(F.col("affiliations"), exact).alias("affiliations"), string_set(F.col("neighbors"), exact).alias("neighbors"), F.when(both, number("latitude")).alias("latitude"), F.when(both, number("longitude")).alias("longitude"),
        "source_reliability", "embedding", source_of(F.col("source_key")).alias("source"), "stored_at",
    )
    for kind, extra in (hooks or {}).items():
        for name, expr in extra.items():
            out = out.withColumn(name, F.when(F.col("entity_type") == kind, expr))
    return out


def typed_float(value: Column) -> Column:
    """A property of any JSON type as a number; booleans, texts and null give null."""
    v = F.try_parse_json(value)
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|TINYINT|SMALLINT)"), F.try_variant_get(v, "$", "double"))


def typed_timestamp(value: Column) -> Column:
    """A property as an instant; anything that is none gives null."""
    return value.try_cast("timestamp")


def canonical_entities(identities: DataFrame) -> DataFrame:
    """Normalised view of canonical entities (identity_id, entity_type, display_name, identifiers): the key is the identity, the graph is read from it, there are no properties."""
    names = normalize_names_exact(F.array("display_name"))
    empty = F.array().cast("array<string>")
    none = lambda t: F.lit(None).cast(t)
    return identities.select(
        none("bigint").alias("row_id"), F.col("identity_id").alias("source_key"), graph_of_identity(F.col("identity_id")).alias("graph_id"), normalize_entity_type(F.col("entity_type")).alias("entity_type"), F.filter(names, lambda v: F.length(v) > 0).alias("names"),
        identifier_map(F.col("identifiers")).alias("ids"), empty.alias("affiliations"), empty.alias("neighbors"), none("double").alias("latitude"), none("double").alias("longitude"), none("double").alias("source_reliability"), none("array<double>").alias("embedding"),
        source_of(F.col("identity_id")).alias("source"), none("timestamp").alias("stored_at"),
    )
