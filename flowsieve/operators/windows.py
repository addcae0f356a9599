"""Per-source tumbling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampType

from flowsieve.functions.columns import col, numeric_columns
from flowsieve.functions.labels import LABEL_LIKE_NAMES, label_or_null


def event_time(df: DataFrame, name: str) -> Column:
    """The time column as timestamp; text that does not parse becomes null."""
    kind = df.schema[name].dataType
    if isinstance(kind, StringType):
        return F.try_to_timestamp(col(name))
    if isinstance(kind, TimestampType):
        return col(name)
    return col(name).cast("timestamp")


def with_valid_time(df: DataFrame, time: str = "timestamp", check: bool = True) -> DataFrame:
    """Drop rows whose time does not parse; an error if none is left."""
    out = df.withColumn("event_time", event_time(df, time)).where(F.col("event_time").isNotNull())
    if check and out.isEmpty():
        raise ValueError("No rows with a parseable time are left.")
    return out


def window_frame(df: DataFrame, source: str, minutes: int, time: str = "timestamp", names: list[str] | None = None,
                 label: str | None = None, check: bool = True) -> DataFrame:
    """One row per (source, window): mean, sum and count of each numeric column, window start as ``timestamp``.

    Label-like columns are left out before the aggregation. With ``label`` the window's
    ``ground_truth`` is 1 when any of its rows is an attack. Rows without a source are left out.
    """
    if source not in df.columns:
        raise ValueError(f"There is no column '{source}' to group windows by.")
    if label and label not in df.columns:
        raise ValueError(f"There is no column '{label}' to read labels from.")
    if names is None:
        names = [n for n in numeric_columns(df) if n not in (source, time, label) and n.lower() not in LABEL_LIKE_NAMES]
    timed = with_valid_time(df, time, check).where(col(source).isNotNull())
    return aggregate_windows(timed, source, minutes, names, label)


def aggregate_windows(timed: DataFrame, source: str, minutes: int, names: list[str], label: str | None = None) -> DataFrame:
    """The aggregation alone, on a table that has ``event_time``; it also runs on a stream."""
    aggs = []
    for n in names:
        value = F.nanvl(col(n), F.lit(None)) if timed.schema[n].dataType.typeName() in ("double", "float") else col(n)
        zero = F.lit(0).cast(timed.schema[n].dataType)
        aggs += [
            F.avg(value).alias(f"{n}_mean"),
            F.coalesce(F.sum(value), zero).alias(f"{n}_sum"),
            F.count(value).alias(f"{n}_count"),
        ]
    if label:
        aggs.append(F.max(label_or_null(col(label))).alias("ground_truth"))
    bucket = F.window(F.col("event_time"), f"{minutes} minutes")
    grouped = timed.groupBy(col(source).alias(source), bucket.alias("w")).agg(*aggs)
    return grouped.select(col(source), F.col("w.start").alias("timestamp"), *[col(c) for c in grouped.columns if c not in (source, "w")])
