"""Casts that turn bad input into NULL instead of failing under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN is only another spelling of "missing"; keep NULL as the one form."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def to_double(c: str | Column) -> Column:
    """Numeric parse; text that is not a number, and NaN, become NULL."""
    return nan_to_null(_col(c).try_cast("double"))


def to_int(c: str | Column) -> Column:
    return _col(c).try_cast("int")


def with_parsed_number(df: DataFrame, name: str, parsed: str | None = None) -> DataFrame:
    """Best-effort parse: keep the raw column, add a typed one next to it."""
    return df.withColumn(parsed or f"{name}_number", to_double(name))


def null_out_nans(df: DataFrame) -> DataFrame:
    """NaN to NULL over every floating column, in one projection."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floats}) if floats else df
