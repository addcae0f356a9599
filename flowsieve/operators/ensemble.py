"""Vote over the four detector flags, and the text that explains it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import col
from flowsieve.operators.stats import BASELINE

# The flags that vote.
VOTE_FLAGS = ["z_score_flag", "isolation_forest_flag", "lof_flag", "one_class_svm_flag"]
MODEL_REASONS = {
    "isolation_forest_flag": "Isolation Forest: rare combination of feature values",
    "lof_flag": "Local Outlier Factor: sparser than its nearest neighbours",
    "one_class_svm_flag": "One-Class SVM: outside the boundary of normal rows",
}
REASON_CODES = {
    "z_score_flag": "Z_SCORE",
    "isolation_forest_flag": "ISOLATION_FOREST",
    "lof_flag": "LOCAL_OUTLIER_FACTOR",
    "one_class_svm_flag": "ONE_CLASS_SVM",
}


def with_vote(df: DataFrame, flags: list[str] = VOTE_FLAGS, needed: int = 2) -> DataFrame:
    """Add ensemble_votes and is_anomaly (at least ``needed`` votes)."""
    votes = sum((col(f) for f in flags[1:]), col(flags[0])).cast("int")
    return df.withColumns({"ensemble_votes": votes, "is_anomaly": (votes >= needed).cast("int")})


def anomaly_reason(z_reason: Column, flags: list[str] = VOTE_FLAGS) -> Column:
    parts = []
    for f in flags:
        text = z_reason if f == "z_score_flag" else F.lit(MODEL_REASONS[f])
        parts.append(F.when(col(f) == 1, text))
    joined = F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), "; ")
    return F.when(F.col("is_anomaly") == 0, F.lit(BASELINE)).otherwise(joined)


def with_reason(df: DataFrame, flags: list[str] = VOTE_FLAGS) -> DataFrame:
    """Add anomaly_reason and the language-neutral reason_codes."""
    codes = F.array_compact(F.array(*[F.when(col(f) == 1, F.lit(REASON_CODES[f])) for f in flags]))
    none = F.array().cast("array<string>")
    return df.withColumns({
        "anomaly_reason": anomaly_reason(F.col("z_score_reason"), flags),
        "reason_codes": F.when(F.col("is_anomaly") == 1, codes).otherwise(none),
    })
