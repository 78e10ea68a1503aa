"""Column-level table operators: derive, rename, pick, drop. None shuffles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloop.functions import log_feature, ratio_to_square, to_double
from scoreloop.functions.vocabulary import PREDICTED, REAL


def build_features(
    df: DataFrame,
    weight: str = "weight_kg",
    height: str = "height_m",
    age: str = "age",
    bmi: str = "bmi",
    log_age: str = "log_age",
    log_kind: str = "log1p",
) -> DataFrame:
    """Add the body-mass index and the log-age feature."""
    return df.withColumns({bmi: ratio_to_square(f"`{weight}`", f"`{height}`"),
                           log_age: log_feature(f"`{age}`", log_kind)})


def log_skew(df: DataFrame, age: str = "age", by: Iterable[str] = ()) -> DataFrame:
    """How far the two log features are apart: rows, mean and largest gap."""
    gap = log_feature(age, "log1p") - log_feature(age, "ln")
    return df.groupBy(*by).agg(
        F.count(gap).alias("n"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap")
    )


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map; names absent from the table are ignored."""
    return df.withColumnsRenamed(dict(names))


def select_expected(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Exactly these columns in this order; a missing one is an error."""
    columns = list(columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def select_present(df: DataFrame, preferred: Iterable[str]) -> DataFrame:
    """The preferred columns that exist, in preference order."""
    return df.select(*[F.col(f"`{c}`") for c in preferred if c in df.columns])


def feature_columns(df: DataFrame, excluded: Iterable[str]) -> list[str]:
    excluded = set(excluded)
    return [c for c in df.columns if c not in excluded]


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(features, label) projections of one table."""
    if target not in df.columns:
        raise ValueError(f"target {target!r} is not a column; available: {df.columns}")
    return df.drop(target), df.select(F.col(f"`{target}`"))


def column_roles(df: DataFrame, excluded: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) names, read from the schema alone."""
    excluded = set(excluded)
    fields = [f for f in df.schema.fields if f.name not in excluded]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    categorical = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    if not numeric and not categorical:
        raise ValueError("no numeric or categorical column found")
    return numeric, categorical


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the listed columns; values that do not convert become NULL."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in types.items()})


def coalesce_alternates(
    df: DataFrame,
    real: tuple[str, ...] = (REAL, "real_fat_percentage_feedback"),
    pred: tuple[str, ...] = (PREDICTED, "predicted_fat_percentage_feedback"),
) -> DataFrame:
    """Fill the first name of each list from the later ones that exist."""
    out = {}
    for names in (real, pred):
        present = [to_double(c) for c in names if c in df.columns]
        out[names[0]] = F.coalesce(*present) if present else F.lit(None).cast("double")
    return df.withColumns(out)
