"""Content-addressed identifiers as native expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphwright.functions.text import json_string

# The base-32 digits of identifiers and the prefixes of their kinds.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
PREFIXES = {"operation": "op_", "assertion": "as_", "plan": "pl_", "audit": "au_", "batch": "mb_", "execution": "ex_"}
GRAPH_ID = r"^[a-z][a-z0-9_-]*$"


def derive_token(seed: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a text as 26 base-32 digits, most significant first; null for null.

    ``conv`` writes numbers of up to 64 bits in base 32: two digits for the
    first byte (two zero bits stand before it) and twice twelve for 60 bits;
    its digits beyond 9 are then replaced by those of DIGITS.
    """
    hexa = F.sha2(seed, 256)
    part = lambda start, n, width: F.lpad(F.conv(F.substring(hexa, start, n), 16, 32), width, "0")
    return F.translate(F.concat(part(1, 2, 2), part(3, 15, 12), part(18, 15, 12)), "ABCDEFGHIJKLMNOPQRSTUV", DIGITS[10:])


def derived_id(kind: str, seed: Column) -> Column:
    """Identifier of a kind in PREFIXES for a seed."""
    return F.concat(F.lit(PREFIXES[kind]), derive_token(seed))


def identity_id(graph: Column, seed: Column) -> Column:
    """``kg://<graph>/identity/<token>``; a malformed graph id raises."""
    ok = F.when(graph.rlike(GRAPH_ID), graph).otherwise(F.raise_error(F.concat(F.lit("malformed graph id: "), F.coalesce(graph, F.lit("null")))))
    return F.concat(F.lit("kg://"), ok, F.lit("/identity/"), derive_token(seed))


def random_id(kind: str) -> Column:
    """A fresh identifier: not reproducible, only for callers that want no content address."""
    return F.concat(F.lit(PREFIXES[kind]), derive_token(F.expr("uuid()")))


def fact_key(subject: Column, predicate: Column) -> Column:
    """Key of the slot (subject, predicate)."""
    return F.concat(F.lit("fact_"), F.substring(F.sha2(F.concat(subject, F.char(F.lit(0)), predicate), 256), 1, 32))


def trigger_id(kind: Column, lists: list[Column], version: Column) -> Column:
    """Content address of a trigger; the order within its lists does not matter."""
    joined = [F.array_join(F.array_sort(x), "|") for x in lists]
    return F.concat(F.lit("trg_"), F.substring(F.sha2(F.concat_ws("::", kind, *joined, version), 256), 1, 24))


def ontology_term_id(graph: Column, kind: Column, term: Column) -> Column:
    return F.concat(F.lit("ot_"), F.substring(F.sha2(F.concat_ws("::", graph, kind, term), 256), 1, 24))


def request_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, each followed by a zero byte."""
    return F.sha2(F.concat(*[F.concat(p, F.char(F.lit(0))) for p in parts]), 256)


def canonical_json(document: Column) -> Column:
    """The member ``v`` of a JSON object with sorted keys, compact and ASCII only."""
    import json

    @F.pandas_udf("string")
    def render(s: pd.Series) -> pd.Series:
        one = lambda x: None if x is None else json.dumps(json.loads(x).get("v"), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        return s.map(one)

    return render(document)


def record_seed(fact: Column, object_json: Column, object_identity: Column, valid_from: Column, valid_to: Column, source: Column, source_ref: Column, evidence: Column) -> Column:
    """Seed of an assertion record: what is claimed, for when, where it comes from and what it cites, zero bytes between.

    ``object_json`` is canonical JSON, the bounds of the period are texts.
    Evidence (evidence_id, relationship) keeps its order; null evidence is
    none.  A null ``source`` says that no origin is known.
    """
    null = lambda c: F.coalesce(json_string(c), F.lit("null"))
    period = F.concat(F.lit('{"valid_from":'), null(valid_from), F.lit(',"valid_to":'), null(valid_to), F.lit("}"))
    origin = F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), json_string(source), F.lit(","), null(source_ref), F.lit("]")))
    cited = F.transform(evidence, lambda e: F.concat(F.lit("["), null(e["evidence_id"]), F.lit(","), null(e["relationship"]), F.lit("]")))
    parts = [fact, F.lit("record"), F.coalesce(object_json, F.lit("null")), null(object_identity), period, origin, F.coalesce(F.concat(F.lit("["), F.array_join(cited, ","), F.lit("]")), F.lit("[]"))]
    return F.concat(*[x for p in parts for x in (p, F.char(F.lit(0)))][:-1])
