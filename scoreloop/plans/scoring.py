"""Scoring tables with fitted models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloop.functions import (
    normalise_email,
    parse_timestamp,
    prediction_id,
    round_half_even,
    truncate_to_second,
)
from scoreloop.functions.vocabulary import FEATURE_FIELDS, PREDICTED, REAL
from scoreloop.operators.metrics import regression_metrics
from scoreloop.operators.project import build_features, rename, select_expected
from scoreloop.sources.feature_groups import BATCH_GROUP, TableSpec, insert, read_group, slices
from scoreloop.sources.registry import ModelRegistry


def score_records(requests: DataFrame, model: PipelineModel, timestamp: str = "timestamp") -> DataFrame:
    """Scoring requests to ledger rows: features, prediction, id, empty label.

    The whole feature row is kept, so that a later sync or retraining finds
    every input. Works on a batch and on a stream alike.
    """
    ready = build_features(
        requests.withColumns({
            "email": normalise_email("email"),
            "timestamp": truncate_to_second(timestamp),
            "experience_level": F.col("experience_level").try_cast("int"),
        })
    )
    select_expected(ready, FEATURE_FIELDS)
    scored = model.transform(ready).withColumns({
        "prediction_id": prediction_id("email", "timestamp"),
        PREDICTED: round_half_even("prediction", 2),
        REAL: F.lit(None).cast("double"),
    })
    return scored.select("prediction_id", "email", "timestamp", PREDICTED, *FEATURE_FIELDS, REAL)


def batch_score(df: DataFrame, model: PipelineModel, names: Mapping[str, str] | None = None) -> DataFrame:
    """One (user_id, email, timestamp, prediction) row per input row."""
    kept = df.withColumns({
        "user_id": F.col("user_id").cast("string"),
        "email": F.col("email").cast("string"),
        "timestamp": parse_timestamp("timestamp"),
    })
    scored = model.transform(rename(kept, names) if names else kept)
    return scored.select("user_id", "email", "timestamp", F.col("prediction").cast("double").alias(PREDICTED))


def batch_inference(
    spark: SparkSession, root: str, registry: ModelRegistry, model_name: str, source: TableSpec,
    target: TableSpec = BATCH_GROUP, names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Latest model over a whole feature table, inserted into the output table."""
    model, _ = registry.latest(model_name)
    rows = read_group(spark, root, source.name, source.version)
    # Models count as indeterminate in plans, so large tables are cut before they are scored.
    by_key = rows.withColumns({c: F.col(c).cast("string") for c in ("user_id", "email")})
    insert(spark, root, target, [batch_score(part, model, names) for part in slices(by_key, ["user_id", "email"])])
    return read_group(spark, root, target.name, target.version)


def score_with(df: DataFrame, models: Mapping[str, PipelineModel], label: str, key: str) -> DataFrame:
    """Long (model, key, label, prediction) rows of several models on one table.

    Each model's prediction is carried as a column of the same pass, so the
    table is read once whatever the number of models.
    """
    keep = [c for c in df.columns]
    out = df
    done: list[str] = []
    for name, model in models.items():
        scored = model.transform(out)
        out = scored.select(*[F.col(f"`{c}`") for c in [*keep, *done]], F.col("prediction").alias(name))
        done.append(name)
    return out.select(key, F.col(f"`{label}`").alias("y_true"), *done).unpivot(
        [key, "y_true"], done, "model", "y_pred"
    )


def compare_models(df: DataFrame, models: Mapping[str, PipelineModel], label: str, key: str) -> DataFrame:
    """MAE, MSE, RMSE, R2 per model over the same rows."""
    return regression_metrics(score_with(df, models, label, key), by=["model"], places=None)
