"""Missing values and arithmetic: NaN is missing, bad text is null, division by zero is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float and double column, so that aggregates skip it."""
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None)) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)})


def number(column: Column | str) -> Column:
    """A double, or null where the text is none."""
    return (F.col(column) if isinstance(column, str) else column).try_cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 (dataframe libraries give an infinity or NaN there)."""
    return F.try_divide(a, b)


def zero_sum(column: Column | str) -> Column:
    """A sum that is 0, not null, over no values."""
    return F.coalesce(F.sum(column), F.lit(0.0))
