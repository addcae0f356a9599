"""Column statistics, z-scores and standard scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import WIDE, col, finite

# Fixed value: the text for a row that is not unusual.
BASELINE = "baseline behavior"


@dataclass(frozen=True)
class ColumnStats:
    """Mean and population deviation per column: two numbers per feature, held on the driver."""

    names: list[str]
    mean: list[float | None]
    std: list[float | None]
    rows: int

    def table(self, spark) -> DataFrame:
        """The same numbers as a table, to save and load as model state."""
        rows = [(i, n, m, s, self.rows) for i, (n, m, s) in enumerate(zip(self.names, self.mean, self.std))]
        return spark.createDataFrame(rows, "place int, feature string, mean double, std double, rows bigint")

    @staticmethod
    def from_table(table: DataFrame) -> ColumnStats:
        found = sorted(table.collect())
        return ColumnStats([r["feature"] for r in found], [r["mean"] for r in found], [r["std"] for r in found], found[0]["rows"])


def fit_stats(df: DataFrame, names: list[str]) -> ColumnStats:
    """One pass, one aggregate for all columns. Null, NaN and infinity do not count."""
    if len(names) > WIDE:
        long = df.select(F.posexplode(F.array(*[col(n).cast("double") for n in names])).alias("i", "v"))
        value = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
        found = {r[0]: r[1:] for r in long.groupBy("i").agg(F.avg(value), F.stddev_pop(value), F.count(F.lit(1))).collect()}
        cells = [found.get(i, (None, None, 0)) for i in range(len(names))]
        return ColumnStats(list(names), [c[0] for c in cells], [c[1] for c in cells], cells[0][2])
    aggs = [F.count(F.lit(1))]
    for name in names:
        aggs += [F.avg(finite(df, name)), F.stddev_pop(finite(df, name))]
    row = df.agg(*aggs).first()
    return ColumnStats(list(names), list(row[1::2]), list(row[2::2]), row[0])


def column_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean, std) rows, lazily."""
    aggs = []
    for i, name in enumerate(names):
        aggs += [F.avg(finite(df, name)).alias(f"m{i}"), F.stddev_pop(finite(df, name)).alias(f"s{i}")]
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, n in enumerate(names)])
    return df.agg(*aggs).select(F.inline(rows))


def scaled(df: DataFrame, stats: ColumnStats) -> list[Column]:
    """Scaled columns in feature order; a constant column scales to 0."""
    out = []
    for name, mean, std in zip(stats.names, stats.mean, stats.std):
        value = finite(df, name)
        if mean is None:
            out.append(F.lit(None).cast("double"))
        elif not std:
            out.append(F.when(value.isNotNull(), F.lit(0.0)))
        else:
            out.append((value - F.lit(mean)) / F.lit(std))
    return out


def with_scaled(df: DataFrame, stats: ColumnStats, name: str = "scaled") -> DataFrame:
    """Add the scaled features as one ``array<double>`` column."""
    if len(stats.names) > WIDE:
        values = F.array(*[col(n).cast("double") for n in stats.names])
        model = F.array(*[F.struct(F.lit(m).cast("double").alias("m"), F.lit(s).cast("double").alias("s")) for m, s in zip(stats.mean, stats.std)])
        one = lambda v, c: F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).when(c.s == 0, v * 0.0).otherwise((v - c.m) / c.s)
        return df.withColumn(name, F.zip_with(values, model, one))
    return df.withColumn(name, F.array(*scaled(df, stats)))


def with_zscore(df: DataFrame, stats: ColumnStats, threshold: float = 2.5, reason: bool = True) -> DataFrame:
    """Add z_score_max (4 decimals), z_score_flag (any |z| >= threshold) and z_score_reason."""
    scores = [F.abs(z) for z in scaled(df, stats)]
    hits = [F.coalesce(z >= threshold, F.lit(False)) for z in scores]
    out = {
        "z_score_max": F.round(F.array_max(F.array(*scores)), 4),
        "z_score_flag": F.exists(F.array(*hits), lambda hit: hit).cast("int"),
    }
    if reason:
        parts = [
            F.when(hit, F.format_string("%s=%s (z=%.2f)", F.lit(name), col(name).cast("string"), z))
            for name, z, hit in zip(stats.names, scores, hits)
        ]
        found = F.array_compact(F.array(*parts))
        out["z_score_reason"] = F.when(F.size(found) == 0, F.lit(BASELINE)).otherwise(F.array_join(found, "; "))
    return df.withColumns(out)
