"""Queries p1, p2 and p5 to p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphwright.llm import bpe, chunk, components, leakage, match, names, survivor
from graphwright.llm.sql import SQL
from graphwright.session import table

__all__ = ["QUERIES", "SQL"]


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunk.split_documents(table(spark, d, "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.find_variants(table(spark, d, "normalized_entities")).select("left_key", "right_key")


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    return match.match_things(table(spark, d, "normalized_entities"), table(spark, d, "source_registry"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_matches(spark, d).select("left_key", "right_key").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.group_keys(table(spark, d, "match_results"), table(spark, d, "clusters"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return survivor.merge_members(table(spark, d, "normalized_entities"), table(spark, d, "clusters"), table(spark, d, "evolution_results"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.choose_stated(_members(spark, d))


def p6_truth(spark: SparkSession, d: str) -> DataFrame:
    return survivor.discover(_members(spark, d))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_matches": p2_matches, "p5_found": p5_found, "p6_found": p6_found, "p6_truth": p6_truth, "p7_ids": p7_ids, "p8_found": p8_found, "p8_spans": p8_spans, "p9_pieces": p9_pieces}
