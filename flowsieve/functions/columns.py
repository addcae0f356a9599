"""Column helpers: quoting, numeric columns, cleaning of non-finite values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType


def col(name: str) -> Column:
    """Column by its plain name; names may hold spaces, dots and slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def finite(df: DataFrame, name: str) -> Column:
    """The column as double, with NaN and infinities turned into null."""
    value = col(name).cast("double")
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    return value


WIDE = 24


def drop_dirty(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop rows where any of the columns is null, NaN or infinite."""
    if len(names) > WIDE:
        # One check over an array: a conjunction over many columns outgrows a generated method.
        values = F.array(*[col(n).cast("double") for n in names])
        return df.where(F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    keep = F.lit(True)
    for name in names:
        value = col(name)
        keep = keep & value.isNotNull()
        if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
            keep = keep & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return df.where(keep)
