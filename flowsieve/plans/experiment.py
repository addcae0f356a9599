"""The table all label experiments share: scaled features, truth, folds."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import col
from flowsieve.functions.hashing import order_key
from flowsieve.operators.sampling import with_folds
from flowsieve.operators.stats import fit_stats, scaled
from flowsieve.plans.report import clean_rows
from flowsieve.session import durable


def experiment_table(df: DataFrame, features: list[str], truth: str, id_col: str, folds: int, seed: int, keys: bool = False, on_dirty: str = "drop") -> DataFrame:
    """(id, x, truth, fold[, keys]) as a written table, since every training pass reads it.

    Rows without a label, and rows with a null, NaN or infinite feature, take no part in statistics, folds, training and counts; a warning says
    how many there are. ``on_dirty="error"`` refuses them.

    ``x`` is shifted and scaled once over the whole table to keep the numbers well-conditioned. This does not
    leak: each model penalises its weights by its own training rows' deviation, which equals
    scaling inside the fold. ``keys[k]`` is the random order of the rows for fold k.
    """
    # The input may be a costly view: it is computed once, and all passes read what was written.
    names = [f"f{i}" for i in range(len(features))]
    df = durable(df.select(col(id_col).alias("id"), col(truth).alias("truth"), *[col(f).alias(n) for f, n in zip(features, names)]), "experiment-input")
    clean = clean_rows(df.where(F.col("truth").isNotNull()), names, on_dirty)
    rows, unlabelled = df.agg(F.count(F.lit(1)), F.count_if(F.col("truth").isNull())).first()
    if on_dirty == "error" and unlabelled:
        raise ValueError(f"{unlabelled} rows have no label.")
    stats = fit_stats(clean, names)
    if stats.rows < rows:
        warnings.warn(f"Left out {unlabelled} rows without a label and {rows - unlabelled - stats.rows} with a null, NaN or infinite feature.", stacklevel=3)
    base = clean.select("id", F.array(*scaled(clean, stats)).alias("x"), F.col("truth").cast("int").alias("truth"))
    out = with_folds(base, "truth", "id", folds, seed)
    if keys:
        out = out.withColumn("keys", F.array(*[order_key(f"{seed}:{k}", F.col("id")) for k in range(folds)]))
    return durable(out, "experiment", stats.rows)
