"""Checks that any validator or matcher of candidates must pass; used by tests of extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validator_faults(validate: Callable[[DataFrame], DataFrame], candidates: DataFrame) -> list[str]:
    """What a validator does wrong: ids changed, a verdict without reasons or the other way round, two runs that differ."""
    out, faults = validate(candidates), []
    if out.select("candidate_id").exceptAll(candidates.select("candidate_id")).count() or out.count() != candidates.count():
        faults.append("candidate ids are not echoed")
    if not out.filter(F.col("valid") != (F.size("reasons") == 0)).isEmpty() or not out.filter(F.col("valid") != F.col("failure_kind").isNull()).isEmpty():
        faults.append("verdict, reasons and failure kind contradict")
    cols = ["candidate_id", "valid", "failure_kind", "reasons"]
    if not out.select(*cols).exceptAll(validate(candidates).select(*cols)).isEmpty():
        faults.append("two runs differ")
    return faults


def matcher_faults(score: Callable[[DataFrame], DataFrame], features: DataFrame) -> list[str]:
    """What a matcher (features -> left, right, probability) does wrong: pairs changed, probabilities outside [0, 1], two runs that differ."""
    out, faults = score(features).select("left", "right", "probability"), []
    if out.select("left", "right").exceptAll(features.select("left", "right")).count() or out.count() != features.count():
        faults.append("pairs are not echoed")
    if not out.filter("probability is null or probability < 0 or probability > 1").isEmpty():
        faults.append("a probability is missing or outside [0, 1]")
    if not out.exceptAll(score(features).select("left", "right", "probability")).isEmpty():
        faults.append("two runs differ")
    return faults
