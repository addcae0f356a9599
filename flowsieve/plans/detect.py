"""The whole detection run, from an input table to report, metrics and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import col
from flowsieve.functions.labels import feature_columns
from flowsieve.operators import metrics
from flowsieve.operators.windows import window_frame
from flowsieve.operators.sampling import class_sizes
from flowsieve.plans.report import build_report
from flowsieve.session import durable
from flowsieve.sources.tables import number_rows, write_json, write_report


@dataclass(frozen=True)
class Detection:
    """``report`` is a written table. ``metrics`` and ``confusion`` are there when a label was given."""

    report: DataFrame
    features: list[str]
    summary: DataFrame
    method_counts: DataFrame
    metrics: DataFrame | None
    confusion: DataFrame | None
    id_col: str

    def flagged(self) -> DataFrame:
        return metrics.flagged(self.report, self.id_col, columns=["anomaly_reason"])

    def preview(self, limit: int = 25) -> DataFrame:
        return metrics.flagged_preview(self.report, self.id_col, "anomaly_reason", limit=limit)

    def scatter(self, x: str | None = None, y: str | None = None, points: int = 10_000, seed: int = 42) -> DataFrame:
        """Plot points over two columns. A column not named is the feature that most outlies its own spread: flagged rows' mean distance in deviations."""
        if x is None or y is None:
            flagged = F.col("is_anomaly") == 1
            far = self.report.agg(*[(F.abs(F.avg(F.when(flagged, col(f))) - F.avg(col(f))) / F.stddev_pop(col(f))).alias(f"d{k}") for k, f in enumerate(self.features)]).first()
            ranked = [f for _, f in sorted(((-(far[k] or 0.0), f) for k, f in enumerate(self.features)), key=lambda t: t[0]) if f not in (x, y)]
            picked = iter([*ranked, *self.features])
            x, y = x or next(picked), y or next(picked)
        return metrics.scatter_points(self.report, x, y, self.id_col, points, seed)

    def save(self, folder: str, fmt: str = "parquet") -> None:
        """report, summary, flagged ids and metrics under ``folder``; CSV reports hold the reason codes as text."""
        flat = self.report.withColumn("reason_codes", F.array_join("reason_codes", ",")) if fmt == "csv" else self.report
        write_report(flat, f"{folder}/report", fmt)
        write_report(self.flagged(), f"{folder}/flagged", fmt)
        write_json(self.summary, f"{folder}/summary")
        if self.metrics is not None:
            write_json(self.metrics, f"{folder}/metrics")


def detect(df: DataFrame, id_col: str | None = None, label: str | None = None, threshold: float = 2.5, contamination: float = 0.12,
           seed: int = 42, window_minutes: int = 0, source: str = "source_ip", time: str = "timestamp", on_dirty: str = "drop") -> Detection:
    """Score every row, or every (source, window) when ``window_minutes`` is set. Without ``id_col`` rows are numbered.

    A window counts as an attack when one of its rows is labelled so. Rows with a null, NaN or infinite feature leave the report and are
    counted in the summary, or are an error with ``on_dirty="error"``.
    """
    if label and label not in df.columns:
        raise ValueError(f"There is no column '{label}' to read labels from.")
    if window_minutes > 0:
        df = durable(window_frame(df, source, window_minutes, time, label=label), "windows")
        label, id_col = ("ground_truth" if label else None), None
    if id_col is None:
        id_col = "row_id"
        df = number_rows(df, id_col)
    aside = (id_col, source, time) if window_minutes > 0 else (id_col,)
    features = feature_columns(df, label, aside)
    report = durable(build_report(df, features, id_col, label, threshold, contamination, seed, on_dirty=on_dirty), "report")
    dropped = df.count() - report.count()
    truth = "ground_truth" if label else None
    return Detection(
        report, features, metrics.run_summary(report, features, threshold, contamination, truth, dropped=dropped), metrics.method_counts(report),
        metrics.method_metrics(report) if truth else None, metrics.confusion(report, truth, "is_anomaly") if truth else None, id_col,
    )


def class_overview(df: DataFrame, label: str, features: list[str], id_col: str, head: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First rows, rows per class, and feature means per class."""
    classes = sorted(class_sizes(df, label))
    return df.orderBy(col(id_col)).limit(head), metrics.class_counts(df, label), metrics.class_profile(df, label, features, classes)
