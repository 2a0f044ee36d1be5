"""References to rows that do not exist, were removed, or came too late.

Method: a Bloom filter of all parent keys (sized by their number, 32 MiB at
most) is probed where the references are scanned.  A negative is a proven orphan
and takes no join.  Only the positives are joined exactly, against one summary
row per parent key; the few that a summary cannot decide are swept together
with the versions of their parents in the order of time, day by day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphwright.functions.text import strip_blanks
from graphwright.operators import bloom
from graphwright.operators.skew import join_to_unique
from graphwright.session import cut

FOREVER = "timestamp'9999-12-31 00:00:00'"


def explode_refs(audit: DataFrame) -> DataFrame:
    """One row per reference of an audit record: audit_id, recorded_at, field, ref_id.

    Blanks around an id are removed; null and blank ids are no references.
    Null or empty arrays give no row.  A null audit_id is kept as null.
    """
    one = lambda f: F.transform(F.array(F.col(f)), lambda x: F.struct(F.lit(f).alias("field"), strip_blanks(x).alias("ref_id")))
    many = lambda f: F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), lambda x: F.struct(F.lit(f).alias("field"), strip_blanks(x).alias("ref_id")))
    refs = audit.select("audit_id", "recorded_at", F.explode(F.concat(one("plan_id"), one("trace_id"), many("operation_ids"), many("source_candidate_ids"))).alias("r"))
    refs = refs.select("audit_id", "recorded_at", F.col("r.field").alias("field"), F.col("r.ref_id").alias("ref_id"))
    return refs.filter(F.length("ref_id") > 0)


def parent_rows(plans: DataFrame, triggers: DataFrame, operations: DataFrame, candidates: DataFrame) -> DataFrame:
    """field, ref_id, stored_at, removed_at of every row that a reference can name; null ids are left out."""
    parts = [
        plans.select(F.lit("plan_id").alias("field"), F.col("plan.plan_id").alias("ref_id"), "stored_at", "removed_at"),
        triggers.select(F.lit("trace_id").alias("field"), F.col("trace_id").alias("ref_id"), "stored_at", "removed_at"),
        operations.select(F.lit("operation_ids").alias("field"), F.col("operation_id").alias("ref_id"), "stored_at", "removed_at"),
        candidates.select(F.lit("source_candidate_ids").alias("field"), F.col("candidate_id").alias("ref_id"), "stored_at", "removed_at"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("ref_id").isNotNull())


def find_orphans(audit: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct (audit_id, field, ref_id, recorded_at, reason) of the references that fail.

    ``missing``: no parent row has the id.  ``late``: every parent row is stored
    after ``recorded_at``.  ``deleted``: every parent row stored by
    ``recorded_at`` was removed by then.  With a null ``recorded_at`` only
    ``missing`` is possible.  A parent row with a null ``stored_at`` counts as
    stored at no known time: it prevents ``missing`` and ``late`` and never
    counts as stored by a time.  Empty tables give no row or only ``missing``.
    Repeated rows change nothing.  Other columns of the inputs are ignored.
    """
    refs = explode_refs(audit)
    # Two counts from Parquet footers; they size the filter and the search for hot keys, never the result.
    n_parents, n_audit = parents.count(), audit.count()
    words = bloom.words_for(n_parents)
    bits = bloom.build(parents.select("field", "ref_id"), ["field", "ref_id"], words).scalar()
    refs = refs.withColumn("_may", bloom.might_contain(bits, ["field", "ref_id"], words))
    proven = refs.filter(~F.col("_may")).drop("_may").withColumn("reason", F.lit("missing"))
    maybe = refs.filter(F.col("_may")).drop("_may")

    gone = F.coalesce("removed_at", F.expr(FOREVER))
    summary = parents.groupBy("field", "ref_id").agg(
        F.min("stored_at").alias("first"), F.max("stored_at").alias("last"), F.count_if(F.col("stored_at").isNull()).alias("undated"),
        F.max(F.when(F.col("stored_at").isNotNull(), gone)).alias("gone"), F.min_by(gone, "stored_at").alias("first_gone"),
    )
    found = join_to_unique(maybe, summary.withColumn("_there", F.lit(True)), ["field", "ref_id"], n_audit * 3)
    t = F.col("recorded_at")
    # "open" marks the rest that one summary row cannot decide: some version was removed by then, a later one was not.
    verdict = (
        F.when(F.col("_there").isNull(), "missing").when(t.isNull(), None)
        .when((F.col("first") > t) & (F.col("undated") == 0), "late").when(F.col("first").isNull() | (F.col("first") > t), None)
        .when(F.col("gone") <= t, "deleted").when((F.col("last") <= t) | (F.col("first_gone") > t), None).otherwise("open")
    )
    # Only failing references are left here; they are written once, as three branches go on from them.
    judged = cut(found.withColumn("reason", verdict).filter(F.col("reason").isNotNull()).select("audit_id", "field", "ref_id", "recorded_at", "reason"))
    open_ = judged.filter(F.col("reason") == "open")
    asked = open_.select("field", "ref_id", "recorded_at").distinct()
    deleted = open_.join(_alive(asked, parents), ["field", "ref_id", "recorded_at"], "left_anti").withColumn("reason", F.lit("deleted"))
    cols = ["audit_id", "field", "ref_id", "recorded_at", "reason"]
    return proven.select(cols).unionByName(judged.filter(F.col("reason") != "open")).unionByName(deleted.select(cols)).distinct()


def _alive(asked: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``asked`` (field, ref_id, recorded_at) at whose time some version, stored by then, was not removed.

    That is the greatest removal time of the versions stored so far: within the
    day by a running maximum, before it by one of the days.  So a key with any
    number of versions and questions is split by days and nothing is paired.
    """
    key = ["field", "ref_id"]
    mine = parents.filter(F.col("stored_at").isNotNull()).join(asked.select(*key).distinct(), key, "left_semi")
    gone = F.coalesce("removed_at", F.expr(FOREVER)).alias("gone")
    line = mine.select(*key, F.col("stored_at").alias("at"), gone, F.lit(0).alias("q")).unionByName(asked.select(*key, F.col("recorded_at").alias("at"), F.lit(None).cast("timestamp").alias("gone"), F.lit(1).alias("q")))
    line = line.withColumn("day", F.date_trunc("day", "at"))
    days = line.groupBy(*key, "day").agg(F.max("gone").alias("most"))
    before = days.withColumn("before", F.max("most").over(Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select(*key, "day", "before")
    line = line.withColumn("so_far", F.max("gone").over(Window.partitionBy(*key, "day").orderBy("at", "q").rowsBetween(Window.unboundedPreceding, 0))).filter("q = 1").join(before, [*key, "day"])
    return line.filter(F.greatest("so_far", "before") > F.col("at")).select(*key, F.col("at").alias("recorded_at"))


def orphan_report(audit: DataFrame, parents: DataFrame) -> DataFrame:
    """Per field and month of ``recorded_at`` (null for none): references, missing, late, deleted.

    Counts distinct (audit_id, ref_id, recorded_at); months and fields without a reference give no row.
    """
    refs = explode_refs(audit).distinct()
    month = F.date_format("recorded_at", "yyyy-MM").alias("month")
    total = refs.groupBy("field", month).agg(F.count("*").alias("references"))
    bad = find_orphans(audit, parents).groupBy("field", month).agg(*[F.count_if(F.col("reason") == r).alias(r) for r in ("missing", "late", "deleted")])
    bad = bad.withColumnRenamed("month", "_m").withColumnRenamed("field", "_f")
    out = total.join(bad, (F.col("field") == F.col("_f")) & F.col("month").eqNullSafe(F.col("_m")), "left").drop("_f", "_m")
    return out.select("field", "month", "references", *[F.coalesce(r, F.lit(0)).cast("bigint").alias(r) for r in ("missing", "late", "deleted")])
