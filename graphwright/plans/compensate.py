"""Inverse plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright import config
from graphwright.functions.hashing import derived_id


def validated_epoch(value: object) -> int:
    """A non-negative whole number, also as decimal text; floats, booleans, negatives and other texts are refused."""
    if isinstance(value, bool) or not isinstance(value, int | str | bytes):
        raise ValueError(f"not an epoch: {value!r}")
    try:
        n = int(value)
    except ValueError as e:
        raise ValueError(f"not an epoch: {value!r}") from e
    if n < 0:
        raise ValueError(f"not an epoch: {value!r}")
    return n


def inverse_type(op_type: Column) -> Column:
    """Type that undoes an operation type; null for types that nothing undoes."""
    return F.create_map(*[F.lit(x) for kv in config.INVERSE.items() for x in kv])[op_type]


def compensation(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan_id, op_index, operation_id, op_type, undoes) in reverse order, and the operations that nothing undoes.

    ``ops`` has plan_id, op_index, operation_id, op_type.  Equal indexes are
    ordered by operation id, then type.
    """
    distinct = ops.select("plan_id", "op_index", "operation_id", "op_type").distinct().withColumn("_inverse", inverse_type(F.col("op_type")))
    n = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("op_index"), F.desc("operation_id"), F.desc("op_type"))) - 1
    done = distinct.filter("_inverse is not null").select("plan_id", n.alias("op_index"), derived_id("operation", F.concat("operation_id", F.lit(":compensate"))).alias("operation_id"), F.col("_inverse").alias("op_type"), F.col("operation_id").alias("undoes"))
    return done, distinct.filter("_inverse is null").drop("_inverse")


def inverse_payload(reversal: Column, operation: Column, legacy: bool = False) -> Column:
    """The payload that undoes an operation, from its reversal data.

    It must be an object under its own key: one that is there but is no object
    raises always; one that is missing raises unless ``legacy`` says that the
    reversal data hold nothing else.
    """
    key = config.INVERSE_PAYLOAD_KEY
    there = F.coalesce(F.array_contains(F.json_object_keys(reversal), key), F.lit(False))
    found = F.get_json_object(reversal, f"$.{key}")
    bad = lambda why: F.raise_error(F.concat(F.lit("operation "), operation, F.lit(f": {why} {key}")))
    return F.when(there, F.when(F.coalesce(found.startswith("{"), F.lit(False)), found).otherwise(bad("malformed"))).otherwise(reversal if legacy else bad("no"))


def compensate(ops: DataFrame, against_snapshot: object, guards: DataFrame | None = None, legacy: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations, guards, rest) of the plans that undo the plans of ``ops`` (plan_id, op_index, operation_id, op_type, payload, reversal_data).

    Operations are undone last first.  Each plan has exactly one guard: that of
    the source plan (``guards``: plan_id, kind, subject) or one on its smallest
    operation, expecting ``against_snapshot``.  ``rest`` are the operations
    that nothing undoes; a plan of only these gives no plan.
    """
    epoch = str(validated_epoch(against_snapshot))
    mine = derived_id("plan", F.concat("plan_id", F.lit(":compensate")))
    known = ops.withColumn("_type", inverse_type(F.col("op_type")))
    n = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("op_index"), F.desc("operation_id"))) - 1
    rest = F.to_json(F.struct(F.col("operation_id").alias("compensates_operation_id"), F.col("op_type").alias("original_type")))
    own = F.concat(F.lit(f'{{"{config.INVERSE_PAYLOAD_KEY}":'), "payload", F.lit(',"original_payload":'), "payload", F.lit(","), F.substr(rest, F.lit(2)))
    done = known.filter("_type is not null").select(
        mine.alias("plan_id"), F.col("plan_id").alias("undone_plan"), n.alias("op_index"), derived_id("operation", F.concat("operation_id", F.lit(":compensate"))).alias("operation_id"), F.col("_type").alias("op_type"),
        inverse_payload(F.col("reversal_data"), F.col("operation_id"), legacy).alias("payload"), own.alias("reversal_data"), F.col("operation_id").alias("undoes"),
    )
    each = known.filter("_type is not null").groupBy("plan_id").agg(F.min("operation_id").alias("_s"))
    if guards is not None:
        each = each.join(guards.filter("kind = 'snapshot_version'").groupBy("plan_id").agg(F.min("subject").alias("_g")), "plan_id", "left").withColumn("_s", F.coalesce("_g", "_s"))
    guard = each.select(mine.alias("plan_id"), F.lit("snapshot_version").alias("kind"), F.col("_s").alias("subject"), F.lit(epoch).alias("expected"))
    return done, guard, known.filter("_type is null").drop("_type")
