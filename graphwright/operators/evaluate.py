"""Quality metrics; a rate without denominator is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright import config


def matcher_metrics(scored: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, precision, recall, false-merge and false-split rates, and mean |p - y| of rows (probability, is_match)."""
    yes, y = F.col("probability") >= threshold, F.col("is_match")
    agg = [F.count_if(yes & y).alias("tp"), F.count_if(yes & ~y).alias("fp"), F.count_if(~yes & y).alias("fn"), F.count_if(~yes & ~y).alias("tn"), F.avg(F.abs(F.col("probability") - y.cast("double"))).alias("calibration_error"), F.count("*").alias("samples")]
    m = scored.groupBy(*(by or [])).agg(*agg)
    rate = lambda a, *b: F.try_divide(F.col(a), sum((F.col(x) for x in b), F.lit(0)))
    return m.withColumn("precision", rate("tp", "tp", "fp")).withColumn("recall", rate("tp", "tp", "fn")).withColumn("false_merge", rate("fp", "fp", "tn")).withColumn("false_split", rate("fn", "fn", "tp"))


def cluster_precision_recall(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision and recall of co-membership pairs, from contingency counts: no pair is built.

    ``predicted`` and ``gold`` have (cluster_id, member); pairs in both are
    pairs within the cells predicted x gold.
    """
    p, g = predicted.select(F.col("cluster_id").alias("pc"), "member").distinct(), gold.select(F.col("cluster_id").alias("gc"), "member").distinct()
    pairs = lambda df, keys: df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("bigint")), F.lit(0)).alias("k"))
    both = pairs(p.join(g, "member"), ["pc", "gc"]).withColumnRenamed("k", "both_pairs")
    out = both.crossJoin(pairs(p, ["pc"]).withColumnRenamed("k", "predicted_pairs")).crossJoin(pairs(g, ["gc"]).withColumnRenamed("k", "gold_pairs"))
    return out.withColumn("precision", F.try_divide("both_pairs", "predicted_pairs")).withColumn("recall", F.try_divide("both_pairs", "gold_pairs"))


def curation_metrics(reviews: DataFrame) -> DataFrame:
    """Yield (planned / reviewed), agreement (approved share), rollbacks, mean age of rows (status, action, rolled_back, age_hours)."""
    n = F.count("*")
    return reviews.agg(n.alias("reviewed"), F.try_divide(F.count_if(F.col("status") == "PLANNED"), n).alias("review_yield"), F.try_divide(F.count_if(F.col("action") == "APPROVE"), n).alias("agreement"), F.try_divide(F.count_if("rolled_back"), n).alias("rollback_frequency"), F.avg("age_hours").alias("mean_age_hours"))


def abstention_share(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.try_divide(F.count_if(F.col("action") == "ABSTAIN"), F.count("*")).alias("abstention"))


def run_arms(golden: DataFrame, arms: dict[str, Column], threshold: float = 0.5) -> DataFrame:
    """The same golden pairs through each arm (a probability expression): metrics per arm."""
    each = golden.select("is_match", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), p.alias("probability")) for a, p in arms.items()])).alias("x")).select("is_match", "x.arm", "x.probability")
    return matcher_metrics(each, threshold, ["arm"])


def promotion_gate(metrics: DataFrame, base: str, candidate: str) -> DataFrame:
    """Whether ``candidate`` may raise the threshold: enough samples in both arms, no null metric, precision gained, false merges not worse."""
    pick = lambda arm: metrics.filter(F.col("arm") == arm).select(F.struct("samples", "precision", "false_merge").alias(arm))
    b, c = F.col(f"`{base}`"), F.col(f"`{candidate}`")
    ok = (b["samples"] >= config.GATE_SAMPLES) & (c["samples"] >= config.GATE_SAMPLES) & (c["precision"] - b["precision"] >= config.GATE_GAIN) & (c["false_merge"] <= b["false_merge"])
    return pick(base).crossJoin(pick(candidate)).select(F.lit(base).alias("base"), F.lit(candidate).alias("candidate"), F.coalesce(ok, F.lit(False)).alias("raise_threshold"))


def calibrate_logistic(golden: DataFrame, features: list[str], epochs: int = 400, rate: float = 0.5, l2: float = 0.0, max_rows: int = 20_000) -> tuple[dict[str, float], float]:
    """Weights and intercept by batch gradient descent from zero; null features count as absent.

    The golden set is labelled by hand and held on the driver; above
    ``max_rows`` rows the first by hash are taken.
    """
    import numpy as np

    rows = golden.select(*features, F.col("is_match").cast("double").alias("_y")).orderBy(F.xxhash64(*features, "_y")).limit(max_rows).toPandas()
    x, y = np.nan_to_num(rows[features].to_numpy(dtype=float)), rows["_y"].to_numpy(dtype=float)
    w, b, n = np.zeros(len(features)), 0.0, max(len(y), 1)
    for _ in range(epochs):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - rate * (x.T @ e / n + l2 * w), b - rate * e.sum() / n
    return dict(zip(features, w.tolist(), strict=True)), float(b)


def er_metrics(scored: DataFrame | None, predicted: DataFrame | None, gold: DataFrame | None, assessments: DataFrame | None, threshold: float = 0.5) -> DataFrame:
    """One row: count, pairwise and cluster precision and recall, false-merge and false-split rates, calibration error, abstention rate; null where an input is missing or empty."""
    spark = next(df for df in (scored, predicted, assessments) if df is not None).sparkSession
    none = lambda *names: spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names])
    pair = none("precision", "recall", "false_merge", "false_split", "calibration_error").withColumn("samples", F.lit(0).cast("bigint")) if scored is None else matcher_metrics(scored, threshold)
    pair = pair.select(F.col("samples").alias("count"), F.col("precision").alias("pairwise_precision"), F.col("recall").alias("pairwise_recall"), F.col("false_merge").alias("false_merge_rate"), F.col("false_split").alias("false_split_rate"), "calibration_error")
    clusters = none("cluster_precision", "cluster_recall") if predicted is None or gold is None else cluster_precision_recall(predicted, gold).select(F.col("precision").alias("cluster_precision"), F.col("recall").alias("cluster_recall"))
    said = none("abstention_rate") if assessments is None else assessments.agg(F.try_divide(F.count_if("abstained"), F.count("*")).alias("abstention_rate"))
    return pair.crossJoin(F.broadcast(clusters)).crossJoin(F.broadcast(said))
