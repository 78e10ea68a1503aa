"""Fitted feature preparation as pyspark.ml stages.

Fitting runs exact aggregates and freezes the few numbers they give into
stock stages (SQLTransformer, StringIndexerModel, OneHotEncoder, VectorAssembler),
so fitted preparation saves, loads and runs without any code of this library.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloop.functions import nan_to_null
from scoreloop.operators.order_stats import medians, modes

# Values of a text column that one-hot encoding takes; a parameter at every level.
MAX_CATEGORIES = 1000


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"double('{float(value)!r}')"


class _ColumnsEstimator(Estimator):
    """An estimator over named input columns, each with an output name."""

    inputCols = Param(Params._dummy(), "inputCols", "input columns", TypeConverters.toListString)
    suffix = Param(Params._dummy(), "suffix", "suffix of output columns", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, suffix: str = ""):
        super().__init__()
        self._setDefault(suffix="", inputCols=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def columns(self) -> list[str]:
        return self.getOrDefault(self.inputCols)

    def output(self, column: str) -> str:
        return column + self.getOrDefault(self.suffix)

    def _replace(self, expressions: dict[str, str]) -> SQLTransformer:
        """Stage computing ``expressions`` (output name -> SQL) and keeping the rest."""
        if not self.getOrDefault(self.suffix):
            names = ", ".join(_quoted(c) for c in expressions)
            keep = f"* EXCEPT ({names})"
        else:
            keep = "*"
        new = ", ".join(f"{sql} AS {_quoted(out)}" for out, sql in expressions.items())
        return SQLTransformer(statement=f"SELECT {keep}, {new} FROM __THIS__")


class PopulationScaler(_ColumnsEstimator):
    """(x - mean) / population std; a constant column scales by 1 (to 0)."""

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        stats = scale_stats(dataset, self.columns()).collect()  # one row per column
        by_name = {r["column"]: (r["mean"] or 0.0, r["scale"]) for r in stats}
        return self._replace({
            self.output(c): f"(double({_quoted(c)}) - {_literal(by_name[c][0])}) / {_literal(by_name[c][1])}"
            for c in self.columns()
        })


class MedianImputer(_ColumnsEstimator):
    """Missing numbers become the exact median of the fitted table."""

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        found = {r["column"]: r["value"] for r in medians(dataset, self.columns()).collect()}
        return self._replace({
            self.output(c): f"coalesce(nullif(double({_quoted(c)}), double('NaN')), {_literal(found[c])})"
            for c in self.columns()
            if c in found
        })


class ModeImputer(_ColumnsEstimator):
    """Missing text becomes the most frequent value, ties to the smallest."""

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        found = {r["column"]: r["value"] for r in modes(dataset, self.columns()).collect()}
        return self._replace({
            self.output(c): f"coalesce({_quoted(c)}, {_literal(found[c])})"
            for c in self.columns()
            if c in found
        })


class SortedIndexer(_ColumnsEstimator):
    """Text to label index, labels in sorted order, unknown and missing last."""

    maxCategories = Param(Params._dummy(), "maxCategories", "most values of a column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, suffix: str = "", maxCategories: int = MAX_CATEGORIES):
        super().__init__(inputCols=inputCols, suffix=suffix)
        self._set(maxCategories=maxCategories)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        vocabulary = vocabularies(dataset, self.columns(), self.getOrDefault(self.maxCategories))
        # One model per column: label lists of different lengths do not pass
        # through the many-column constructor.
        return PipelineModel([
            StringIndexerModel.from_labels(
                vocabulary[c], inputCol=c, outputCol=self.output(c), handleInvalid="keep"
            )
            for c in self.columns()
        ])


def scale_stats(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, mean, scale) from one pass; scale is 1 for a constant column."""
    columns = list(columns)
    values = {c: nan_to_null(F.col(_quoted(c)).cast("double")) for c in columns}
    stats = df.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values.values())],
        *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values.values())],
        *[(F.min(v) < F.max(v)).alias(f"v{i}") for i, v in enumerate(values.values())],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"m{i}").alias("mean"),
            F.when(F.col(f"v{i}") & (F.col(f"s{i}") > 0), F.col(f"s{i}")).otherwise(1.0).alias("scale"),
        )
        for i, c in enumerate(columns)
    ])
    return stats.select(F.inline(rows))


def standard_scale(df: DataFrame, columns: Iterable[str], suffix: str = "_scaled") -> DataFrame:
    """Lazy form of the scaler: the statistics are a scalar subquery."""
    columns = list(columns)
    wide = scale_stats(df, columns).agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("mean", "scale")))).alias("m")
    ).scalar()
    return df.withColumns({
        c + suffix: (F.col(_quoted(c)).cast("double") - wide[c]["mean"]) / wide[c]["scale"]
        for c in columns
    })


def impute(df: DataFrame, numeric: Iterable[str] = (), categorical: Iterable[str] = ()) -> DataFrame:
    """Lazy median / most-frequent imputation in place."""
    out = {}
    for columns, found, cast in ((list(numeric), medians, "double"), (list(categorical), modes, "string")):
        if columns:
            by_name = found(df, columns).agg(
                F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("m")
            ).scalar()
            for c in columns:
                value = F.col(_quoted(c)).cast(cast)
                value = nan_to_null(value) if cast == "double" else value
                out[c] = F.coalesce(value, by_name[c])
    return df.withColumns(out)


# ---- categories -----------------------------------------------------------

def vocabularies(df: DataFrame, columns: Iterable[str], limit: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct values per text column.

    One-hot output has a column per value, so a column with more than
    ``limit`` values is refused before anything larger reaches the driver.
    """
    columns = list(columns)
    if not columns:
        return {}
    texts = df.select(*[F.col(_quoted(c)).cast("string").alias(c) for c in columns])
    values = (
        texts.unpivot([], [F.col(_quoted(c)) for c in columns], "column", "value")
        .filter("value is not null")
        .distinct()
    )
    rows = values.limit(limit * len(columns) + 1).collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r["column"]].append(r["value"])
    large = [c for c, v in out.items() if len(v) > limit]
    if large or len(rows) > limit * len(columns):
        raise ValueError(f"more than {limit} categories in one of {large or columns}; not one-hot encodable")
    return {c: sorted(v) for c, v in out.items()}


def one_hot_wide(
    df: DataFrame, columns: Iterable[str], vocabulary: dict[str, list[str]] | None = None, max_categories: int = MAX_CATEGORIES
) -> DataFrame:
    """Named 0/1 columns ``<column>_<value>``; unknown and missing are all zero."""
    columns = list(columns)
    vocabulary = vocabulary or vocabularies(df, columns, max_categories)
    return df.withColumns({
        f"{c}_{v}": F.when(F.col(_quoted(c)) == v, 1.0).otherwise(0.0) for c in columns for v in vocabulary[c]
    })


def one_hot_stages(columns: Iterable[str], suffix: str = "_onehot", max_categories: int = MAX_CATEGORIES) -> list:
    """Sorted labels; an unknown or missing value encodes as all zeros."""
    columns = list(columns)
    if not columns:
        return []
    index = [f"{c}_index" for c in columns]
    return [
        SortedIndexer(inputCols=columns, suffix="_index", maxCategories=max_categories),
        OneHotEncoder(inputCols=index, outputCols=[c + suffix for c in columns], dropLast=True),
    ]


# ---- column transformer ---------------------------------------------------

def preparation(
    numeric: Iterable[str],
    categorical: Iterable[str],
    scale: bool = True,
    impute_missing: bool = False,
    output: str = "features",
    max_categories: int = MAX_CATEGORIES,
) -> Pipeline:
    """Scale (or impute) numbers, one-hot text, drop the rest: one vector column."""
    numeric, categorical = list(numeric), list(categorical)
    if not numeric and not categorical:
        raise ValueError("no numeric or categorical column found")
    stages: list = []
    if impute_missing:
        stages += [MedianImputer(inputCols=numeric)] if numeric else []
        stages += [ModeImputer(inputCols=categorical)] if categorical else []
    inputs = numeric
    if scale and numeric:
        stages.append(PopulationScaler(inputCols=numeric, suffix="_scaled"))
        inputs = [f"{c}_scaled" for c in numeric]
    stages += one_hot_stages(categorical, max_categories=max_categories)
    inputs = inputs + [f"{c}_onehot" for c in categorical]
    # A missing number stays NaN in the vector rather than failing the job;
    # impute first where the model cannot take it.
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep"))
    return Pipeline(stages=stages)


def fit_transform(
    df: DataFrame, numeric: Iterable[str], categorical: Iterable[str], **kwargs
) -> tuple[DataFrame, PipelineModel]:
    """(transformed table, fitted preparation)."""
    model = preparation(numeric, categorical, **kwargs).fit(df)
    return model.transform(df), model


def feature_table(
    df: DataFrame, numeric: Iterable[str], categorical: Iterable[str], keep: Iterable[str] = (), max_categories: int = MAX_CATEGORIES
) -> DataFrame:
    """Prepared features as named columns: scaled numbers, then one-hot columns."""
    numeric, categorical = list(numeric), list(categorical)
    vocabulary = vocabularies(df, categorical, max_categories)
    wide = one_hot_wide(standard_scale(df, numeric), categorical, vocabulary)
    hot = [f"{c}_{v}" for c in categorical for v in vocabulary[c]]
    return wide.select(
        *keep,
        *[F.col(_quoted(f"{c}_scaled")).alias(c) for c in numeric],
        *[F.col(_quoted(h)) for h in hot],
    )
