"""Monitoring flow: sync the logs, match feedback, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloop.functions import nan_to_null
from scoreloop.functions.vocabulary import REAL
from scoreloop.operators.drift import drift_report, overview
from scoreloop.operators.ledger import latest_predictions
from scoreloop.operators.match import MATCH_KEYS, matched_sums, shared_keys
from scoreloop.operators.metrics import matched_metrics, worst_users
from scoreloop.sources.feature_groups import FEEDBACK_GROUP, PREDICTION_GROUP, read_group, table_path
from scoreloop.sources.files import exists

_NO_FEEDBACK = "user_id string, email string, timestamp timestamp, real_fat_percentage double, predicted_fat_percentage double"


def load_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Predictions and feedback; a feedback table that is not there yet is empty."""
    pred = read_group(spark, root, PREDICTION_GROUP.name, PREDICTION_GROUP.version)
    base = table_path(root, FEEDBACK_GROUP.name, FEEDBACK_GROUP.version)
    if exists(spark, f"{base}/spec"):
        return pred, read_group(spark, root, FEEDBACK_GROUP.name, FEEDBACK_GROUP.version)
    return pred, spark.createDataFrame([], _NO_FEEDBACK)


def match_metrics(
    pred: DataFrame, feedback: DataFrame, real: str = REAL, prefer_feedback_prediction: bool = False, **kwargs
) -> DataFrame:
    """n, MAE, RMSE, bias, signed and relative error, R2 over the whole match.

    Errors are those of the logged prediction, or of the one stored with the
    feedback where it has one.
    """
    labels = feedback.agg(F.avg(nan_to_null(F.col(real).cast("double"))))
    return matched_metrics(
        matched_sums(pred, feedback, real=real, **kwargs),
        prefer_feedback_prediction=prefer_feedback_prediction, center=F.coalesce(labels.scalar(), F.lit(0.0)),
    )


def worst_matched_users(pred: DataFrame, feedback: DataFrame, k: int = 10, **kwargs) -> DataFrame:
    """The k users with the largest MAE over the match."""
    per_user = matched_metrics(
        matched_sums(pred, feedback, **kwargs), by=["email"], prefer_feedback_prediction=True
    )
    return worst_users(per_user.selectExpr("email", "n_rows as n", "mae", "mean_real", "mean_pred"), k)


def monitor(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every report of the monitoring view as a lazy table."""
    pred, feedback = load_tables(spark, root)
    reports = {
        "overview": overview(pred, feedback),
        "latest": latest_predictions(pred, tie="user_id"),
        "drift": drift_report(pred),
    }
    if len(shared_keys(pred, feedback, MATCH_KEYS)) >= 2:
        reports["metrics"] = match_metrics(pred, feedback)
        reports["metrics_of_feedback"] = match_metrics(pred, feedback, prefer_feedback_prediction=True)
        reports["worst_users"] = worst_matched_users(pred, feedback)
    return reports
