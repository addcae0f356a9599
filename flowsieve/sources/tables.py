"""Reading flow tables and writing reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowsieve.functions.columns import col, drop_dirty
from flowsieve.functions.labels import feature_columns, normalize_label
from flowsieve.operators.prefix import totals_before
from flowsieve.session import durable

# Mirror spellings of the UNSW-NB15 columns.
UNSW_ALIASES = {
    "Sload": "sload",
    "Dload": "dload",
    "Spkts": "spkts",
    "Dpkts": "dpkts",
    "Sintpkt": "sinpkt",
    "Dintpkt": "dinpkt",
}


def load_table(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    """``fmt`` (parquet or csv) or, without it, parquet by suffix and else CSV with a header. Missing and empty tables are errors."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        if (fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")) == "parquet":
            df = reader.parquet(path)
        else:
            if not schema:
                reader = reader.option("inferSchema", True)
            df = reader.option("header", True).option("positiveInf", "inf").option("negativeInf", "-inf").option("nanValue", "nan").csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            raise FileNotFoundError(f"No table lies at {path}.") from error
        raise
    if df.isEmpty():
        raise ValueError(f"The table at {path} holds no rows.")
    return df


def labeled(df: DataFrame, label: str = "label", keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Features as double plus ``ground_truth``. ``keep`` columns ride along and are no features."""
    if label not in df.columns:
        raise ValueError(f"There is no column '{label}' to read labels from.")
    names = feature_columns(df, label, keep)
    clean = drop_dirty(df, names)
    out = clean.select(
        *[col(k) for k in keep],
        *[col(n).cast("double").alias(n) for n in names],
        normalize_label(col(label)).alias("ground_truth"),
    )
    return out, names


def alias_columns(df: DataFrame, aliases: dict[str, str] = UNSW_ALIASES) -> DataFrame:
    """Rename columns to the canonical spelling where that name is still free.

    Names are compared as exact strings, and renamed by position, since they differ only in case.
    """
    names = list(df.columns)
    for old, new in aliases.items():
        if old in names and new not in names:
            names[names.index(old)] = new
    return df.toDF(*names)


def union_tables(frames: list[DataFrame]) -> DataFrame:
    """One table under the other, columns matched by name, missing ones null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def number_rows(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Row numbers 1..N in partition order.

    Rows are written once with the number that Spark gives them; counts per partition come from those written numbers, so rows and
    counts agree however the input was shuffled. Rows are not shuffled; the offsets have one row per partition.
    """
    mono, part = "_flowsieve_mono", "_flowsieve_part"
    marked = durable(df.withColumn(mono, F.monotonically_increasing_id()), "numbered").withColumn(part, F.shiftright(mono, 33))
    counts = marked.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    parts = counts.agg(F.max(part)).first()[0]
    offsets = totals_before(counts, [], part, "_n", (parts or 0) + 1, "_start").drop("_n")
    position = F.col(mono) - F.shiftleft(F.col(part), 33)
    return marked.join(offsets, part).select((F.col("_start") + position + 1).alias(name), *[col(c) for c in df.columns])


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_prepared(df: DataFrame, path: str, label: str, order: Column | None = None, rows_per_file: int = 1_000_000) -> None:
    """Prepared subset, one folder per class: a reader of one class reads only its files.

    With ``order`` (a seeded hash, for a shuffled table) each class lies in that order: rows are dealt to tasks by class and by ranges of ``order`` and sorted there, so that
    file after file of a folder, and row after row of a file, goes up. No class is sorted in one task.
    """
    if order is None:
        df.write.mode("overwrite").partitionBy(label).parquet(path)
        return
    ordered = df.withColumn("_order", order)
    files = max(1, -(-df.count() // rows_per_file))
    dealt = ordered.repartitionByRange(files, col(label), "_order").sortWithinPartitions(col(label), "_order").drop("_order")
    dealt.write.mode("overwrite").partitionBy(label).parquet(path)
