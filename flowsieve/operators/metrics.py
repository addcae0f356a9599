"""Evaluation tables: confusion, scores per method, ROC-AUC, fold and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import col
from flowsieve.functions.hashing import seeded_md5
from flowsieve.operators.prefix import totals_before
from flowsieve.session import durable

# The flag column of each method, in the order that settles a tie for the best one.
METHODS = {
    "z_score": "z_score_flag",
    "isolation_forest": "isolation_forest_flag",
    "local_outlier_factor": "lof_flag",
    "one_class_svm": "one_class_svm_flag",
    "ensemble": "is_anomaly",
}
RANGE_ROWS = 20_000


def ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def scores_from_counts(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
    }


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """All four (truth, predicted) cells, zero-filled."""
    cells = [F.count_if((col(truth) == t) & (col(predicted) == p)).alias(f"c{t}{p}") for t in (0, 1) for p in (0, 1)]
    rows = F.array(*[
        F.struct(F.lit(t).alias("truth"), F.lit(p).alias("predicted"), F.col(f"c{t}{p}").alias("n")) for t in (0, 1) for p in (0, 1)
    ])
    return df.agg(*cells).select(F.inline(rows))


def method_metrics(df: DataFrame, truth: str = "ground_truth", methods: dict[str, str] = METHODS, by: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """One row per method: precision, recall, f1_score, accuracy, predicted_anomalies.

    All methods come out of one pass. ``by`` adds grouping columns.
    """
    by = by or []
    aggs = []
    for i, flag in enumerate(methods.values()):
        t, p = col(truth) == 1, col(flag) == 1
        aggs += [
            F.count_if(t & p).alias(f"tp{i}"),
            F.count_if(~t & p).alias(f"fp{i}"),
            F.count_if(t & ~p).alias(f"fn{i}"),
            F.count_if(~t & ~p).alias(f"tn{i}"),
        ]
    rows = []
    for i, name in enumerate(methods):
        tp, fp, fn, tn = (F.col(f"{kind}{i}") for kind in ("tp", "fp", "fn", "tn"))
        scores = scores_from_counts(tp, fp, fn, tn)
        rows.append(F.struct(
            F.lit(name).alias("method"),
            *[(F.round(s, digits) if digits is not None else s).alias(k) for k, s in scores.items()],
            (tp + fp).alias("predicted_anomalies"),
        ))
    return df.groupBy(*[col(b) for b in by]).agg(*aggs).select(*[col(b) for b in by], F.inline(F.array(*rows)))


def best_method(metrics: DataFrame, methods: dict[str, str] = METHODS) -> DataFrame:
    """Name of the method with the highest f1_score; the earlier one wins a tie."""
    place = F.array_position(F.array(*[F.lit(m) for m in methods]), F.col("method"))
    return metrics.agg(F.max_by("method", F.struct("f1_score", -place)).alias("best_method_by_f1"))


def method_counts(df: DataFrame, methods: dict[str, str] = METHODS) -> DataFrame:
    """Rows flagged per method."""
    aggs = [F.sum(col(flag)).alias(f"n{i}") for i, flag in enumerate(methods.values())]
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"n{i}").alias("flagged")) for i, m in enumerate(methods)])
    return df.agg(*aggs).select(F.inline(rows))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(col(label).alias(label)).agg(F.count(F.lit(1)).alias("n"))


def class_profile(df: DataFrame, label: str, names: list[str], classes: list) -> DataFrame:
    """Feature rows, one mean column per class."""
    aggs, rows = [], []
    for i, n in enumerate(names):
        for c in classes:
            aggs.append(F.avg(F.when(col(label) == c, col(n))).alias(f"m{i}_{c}"))
        rows.append(F.struct(F.lit(n).alias("feature"), *[F.col(f"`m{i}_{c}`").alias(f"mean_{c}") for c in classes]))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def roc_auc(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when a class is missing.

    Rows are first counted per distinct score, so equal scores cost one row. Distinct scores are cut
    into ranges of some RANGE_ROWS, as many as that takes; whole ranges below add their totals, and only
    inside a range is anything sorted.
    """
    by = by or []
    keys = [F.lit(0).alias("_all")] if not by else []
    names = by or ["_all"]
    per_score = (
        df.where(col(score).isNotNull())
        .select(*keys, *[col(b) for b in by], col(truth).alias("_t"), col(score).cast("double").alias("_s"))
        .groupBy(*names, "_s")
        .agg(F.count_if(F.col("_t") == 1).alias("pos"), F.count_if(F.col("_t") == 0).alias("neg"))
    )
    per_score = durable(per_score, "roc")
    ranges = max(8, per_score.count() // RANGE_ROWS)
    ranged = durable(per_score.repartitionByRange(ranges, "_s").withColumn("_range", F.spark_partition_id()), "roc-ranges")
    totals = ranged.groupBy(*names, "_range").agg(F.sum("neg").alias("n"))
    totals = totals_before(totals, names, "_range", "n", ranges, "neg_under_range").select(*names, "_range", "neg_under_range")
    inner = Window.partitionBy(*names, "_range").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("neg_in_range", F.coalesce(F.sum("neg").over(inner), F.lit(0))).join(totals, [*names, "_range"])
    wins = F.col("pos").cast("double") * (F.col("neg_under_range") + F.col("neg_in_range") + F.col("neg") / 2)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    out = placed.groupBy(*names).agg(F.when(pairs > 0, F.sum(wins) / pairs).alias("roc_auc"))
    return out if by else out.select("roc_auc")


def fold_summary(df: DataFrame, by: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    aggs = []
    for m in metrics:
        aggs += [F.round(F.avg(col(m)), digits).alias(f"{m}_mean"), F.round(F.stddev_pop(col(m)), digits).alias(f"{m}_std")]
    return df.groupBy(*[col(b) for b in by]).agg(*aggs)


def flagged(df: DataFrame, id_col: str, flag: str = "is_anomaly", columns: list[str] | None = None) -> DataFrame:
    """The flagged rows, as a table of any size."""
    return df.where(col(flag) == 1).select(col(id_col), *[col(c) for c in columns or []])


def flagged_preview(df: DataFrame, id_col: str, reason: str, flag: str = "is_anomaly", limit: int = 25) -> DataFrame:
    """The first ``limit`` flagged rows by id, and how many more there are."""
    hits = flagged(df, id_col, flag, [reason])
    omitted = max(0, hits.count() - limit)
    return hits.orderBy(col(id_col)).limit(limit).withColumn("omitted", F.lit(omitted).cast("bigint"))


def run_summary(df: DataFrame, features: list[str], threshold: float, contamination: float, truth: str | None = None,
                methods: dict[str, str] = METHODS, dropped: int | None = None) -> DataFrame:
    """One row about a report; ``dropped`` tells how many input rows it leaves out. The flagged ids are the table from ``flagged``, not a list in here."""
    base = df.agg(F.count(F.lit(1)).alias("rows_processed"), F.coalesce(F.sum(col("is_anomaly")), F.lit(0)).alias("anomalies_detected"))
    base = base.withColumns({
        "numeric_features": F.array(*map(F.lit, features)),
        "z_score_threshold": F.lit(threshold),
        "model_contamination": F.lit(contamination),
        "metrics_available": F.lit(truth is not None),
    })
    if dropped is not None:
        base = base.withColumn("rows_dropped", F.lit(dropped).cast("bigint"))
    if truth is None:
        return base
    best = best_method(method_metrics(df, truth, methods), methods).first()[0]
    return base.withColumn("best_method_by_f1", F.lit(best))


def scatter_points(df: DataFrame, x: str, y: str, id_col: str, points: int, seed: int = 42, flag: str = "is_anomaly") -> DataFrame:
    """Two columns and the flag for a plot of at most ``points`` rows, picked by seeded hash."""
    return (
        df.select(col(id_col), col(x).alias("x"), col(y).alias("y"), col(flag).alias(flag), seeded_md5(seed, col(id_col)).alias("_h"))
        .orderBy("_h").limit(points).drop("_h")
    )
