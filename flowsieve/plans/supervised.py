"""Cross-validated supervised baselines, and the comparison with the unsupervised vote."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import col
from flowsieve.operators.forest import fit_forests, forests_probability
from flowsieve.operators.logistic import decision, fit_arms, probability, weights_literal
from flowsieve.operators.metrics import fold_summary, method_metrics, roc_auc
from flowsieve.plans.experiment import experiment_table
from flowsieve.plans.report import build_report
from flowsieve.session import durable

METRICS = ["precision", "recall", "f1_score", "accuracy", "roc_auc"]


def logistic_scores(table: DataFrame, folds: int) -> DataFrame:
    """Each row's probability from the model that did not see its fold. All folds train together."""

    def labels(cols, x):
        y = np.repeat(cols["truth"][:, None].astype(np.int8), folds, axis=1)
        y[cols["fold"][:, None] == np.arange(folds)[None, :]] = -1
        return y

    width = len(table.select("x").first()[0]) + 1
    beta, _ = fit_arms(table, ["x", "truth", "fold"], labels, np.zeros((folds, width)))
    own = F.element_at(weights_literal(beta), F.col("fold") + 1)
    p = probability(decision(F.col("x"), own))
    return table.select("id", "truth", "fold", p.alias("probability"), (p > 0.5).cast("int").alias("predicted"))


def forest_scores(table: DataFrame, folds: int, seed: int = 42, **options) -> DataFrame:
    """The same for a class-balanced random forest; all folds grow together."""
    sizes = {(r["fold"], r["truth"]): r["count"] for r in table.groupBy("fold", "truth").count().collect()}
    for k in range(folds):
        if not all(sum(c for (f, t), c in sizes.items() if f != k and t == cls) for cls in (0, 1)):
            raise ValueError("A training fold holds only one class.")
    width = len(table.select("x").first()[0])
    forests, growth = fit_forests(table, sum(sizes.values()), folds, width, seed=seed, **options)
    p = forests_probability(forests, growth, F.col("x"), F.col("fold"))
    return table.select("id", "truth", "fold", p.alias("probability")).withColumn("predicted", (F.col("probability") > 0.5).cast("int"))


def fold_metrics(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1, accuracy and AUC per fold (and ``by``)."""
    keys = [*(by or []), "fold"]
    counts = method_metrics(scores, "truth", {"any": "predicted"}, by=keys, digits=None).drop("method", "predicted_anomalies")
    return counts.join(roc_auc(scores, "truth", "probability", by=keys), keys)


MODELS = {"logistic_regression": lambda table, folds, seed, **_: logistic_scores(table, folds), "random_forest": lambda table, folds, seed, **options: forest_scores(table, folds, seed, **options)}


def baselines(df: DataFrame, features: list[str], truth: str, id_col: str, models: tuple[str, ...] = tuple(MODELS), folds: int = 5, seed: int = 42, **options) -> DataFrame:
    """One row per model: the fold mean and population deviation of each metric. All models learn from one experiment table, hence on the same folds;
    ``options`` are the forest's."""
    table = experiment_table(df, features, truth, id_col, folds, seed)
    scored = [MODELS[m](table, folds, seed, **options).select(F.lit(m).alias("model"), "truth", "fold", "probability", "predicted") for m in models]
    scores = durable(reduce(DataFrame.unionAll, scored), "scores")
    return fold_summary(fold_metrics(scores, ["model"]), ["model"], METRICS)


def cross_validate(df: DataFrame, features: list[str], truth: str, id_col: str, model: str = "logistic_regression", folds: int = 5,
                   seed: int = 42, **options) -> DataFrame:
    """The same for one model."""
    return baselines(df, features, truth, id_col, (model,), folds, seed, **options)


def f1_gap(supervised: DataFrame, supervised_f1: str, unsupervised_f1: float, digits: int = 4) -> DataFrame:
    """Add what labels gain over the unsupervised vote."""
    return supervised.withColumn("gap_f1", F.round(col(supervised_f1) - F.lit(unsupervised_f1), digits))


def compare_benchmark(df: DataFrame, features: list[str], truth: str, id_col: str, schema: str, threshold: float = 2.5,
                      contamination: float = 0.12, folds: int = 5, seed: int = 42) -> DataFrame:
    """One row: the vote's scores on the rows it was fitted on, logistic regression's out-of-fold scores, the gap."""
    # The input may be a costly view; it is computed once.
    df = durable(df.select(*[col(c) for c in dict.fromkeys((id_col, *features, truth))]), "benchmark-input")
    report = build_report(df, features, id_col, None, threshold, contamination, seed, keep=[truth])
    vote = method_metrics(report, truth, {"ensemble": "is_anomaly"}).first()
    totals = df.agg(F.count(F.lit(1)), F.sum(col(truth))).first()
    model = cross_validate(df, features, truth, id_col, folds=folds, seed=seed)
    out = model.select(
        F.lit(schema).alias("schema"),
        F.lit(totals[0]).alias("rows"),
        F.lit(totals[1]).alias("attacks"),
        F.array(*map(F.lit, features)).alias("numeric_features"),
        F.lit("in_sample").alias("unsupervised_scope"),
        *[F.lit(vote[m]).alias(f"unsupervised_{m}") for m in ("precision", "recall", "f1_score")],
        F.lit("out_of_fold").alias("supervised_scope"),
        *[F.col(f"{m}_{s}").alias(f"supervised_{m}_{s}") for m in ("precision", "recall", "f1_score", "roc_auc") for s in ("mean", "std")],
    )
    return f1_gap(out, "supervised_f1_score_mean", vote["f1_score"])
