"""Preparation of balanced benchmark subsets, from tables or from paths to a written subset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsieve.functions.columns import col
from flowsieve.functions.hashing import order_key
from flowsieve.operators.sampling import balanced_sample
from flowsieve.session import durable
from flowsieve.sources.benchmarks import curated, find_label, numeric_clean
from flowsieve.sources.tables import alias_columns, load_table, union_tables, write_prepared


def prepare_unsw(frames: list[DataFrame], id_col: str, rows_per_class: int = 4000, seed: int = 42) -> DataFrame:
    """Train and test tables together, curated columns, balanced by ``label``."""
    combined = union_tables([alias_columns(f) for f in frames])
    return balanced_sample(curated(combined, "label", keep=(id_col,)), "label", id_col, rows_per_class, seed)


def prepare_cic(frames: list[DataFrame], id_col: str, rows_per_class: int = 6000, seed: int = 42) -> DataFrame:
    """Flow tables together, all numeric columns without dirty rows, balanced by the label column."""
    combined = union_tables(frames)
    label = find_label(combined.columns)
    return balanced_sample(numeric_clean(combined, label, (id_col,)), label, id_col, rows_per_class, seed)


JOBS = {"unsw": (prepare_unsw, 4000), "cic": (prepare_cic, 6000)}


def prepare_files(spark: SparkSession, kind: str, paths: list[str], target: str, id_col: str, rows_per_class: int | None = None, seed: int = 42,
                  fmt: str | None = None, rows_per_file: int = 1_000_000) -> DataFrame:
    """Read the tables at ``paths`` (each by its own suffix, or as ``fmt``), prepare the ``kind`` ("unsw" or "cic") subset, write it to ``target``, and read that back.

    Each class is a folder, its rows lie in seeded random order. Filters on the label read only the folders they need. A missing or empty input is an error, before anything is written.
    """
    prepare, usual = JOBS[kind]
    frames = [load_table(spark, path, fmt=fmt) for path in paths]
    # The sample is found in several passes: the input, of any format, is read for the first one only.
    combined = durable(union_tables([alias_columns(f) for f in frames] if kind == "unsw" else frames), "prepare")
    subset = durable(prepare([combined], id_col, usual if rows_per_class is None else rows_per_class, seed), "subset")
    label = find_label(combined.columns) if kind == "cic" else "label"
    write_prepared(subset, target, label, order_key(seed, col(id_col)), rows_per_file)
    return spark.read.schema(subset.schema).parquet(target).select(*[col(c) for c in subset.columns])
