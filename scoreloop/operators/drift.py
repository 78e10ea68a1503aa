"""Mean-shift drift and overview counters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloop.functions import nan_to_null, parse_timestamp, round_half_even

DRIFT_FEATURES = ("age", "weight_kg", "bmi", "log_age")


def drift_report(
    df: DataFrame,
    features: Iterable[str] = DRIFT_FEATURES,
    timestamp: str = "timestamp",
    days: int = 7,
    rounded: bool = True,
) -> DataFrame:
    """Mean before and within the last ``days`` days, per existing feature.

    The cutoff is a scalar subquery over the time column alone; the means of
    all features come from one more pass. Empty when a side has no rows.
    """
    present = [c for c in features if c in df.columns]
    schema = "feature string, past_mean double, recent_mean double, abs_diff double, rel_diff_pct double"
    if timestamp not in df.columns or not present:
        return df.sparkSession.createDataFrame([], schema)
    ts = parse_timestamp(timestamp)
    cutoff = df.agg((F.max(ts) - F.make_dt_interval(F.lit(days))).alias("cutoff"))
    timed = df.select(ts.alias("__ts"), *present).filter("__ts is not null")
    old = F.col("__ts") < cutoff.scalar()

    def mean(c: str, past: bool):
        value = nan_to_null(F.col(c).cast("double"))
        return F.avg(F.when(old if past else ~old, value))

    means = timed.agg(
        F.count_if(old).alias("__n_old"),
        F.count_if(~old).alias("__n_new"),
        *[mean(c, True).alias(f"{c}__past") for c in present],
        *[mean(c, False).alias(f"{c}__recent") for c in present],
    ).filter("__n_old > 0 and __n_new > 0")
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"{c}__past").alias("past_mean"),
            F.col(f"{c}__recent").alias("recent_mean"),
        )
        for c in present
    ])
    diff = F.col("recent_mean") - F.col("past_mean")
    out = means.select(F.inline(rows)).withColumns({
        "abs_diff": diff,
        "rel_diff_pct": F.try_divide(diff, F.col("past_mean")) * 100,
    })
    if rounded:
        out = out.withColumns({
            "past_mean": round_half_even("past_mean", 3),
            "recent_mean": round_half_even("recent_mean", 3),
            "abs_diff": round_half_even("abs_diff", 3),
            "rel_diff_pct": round_half_even("rel_diff_pct", 2),
        })
    return out


def overview(pred: DataFrame, feedback: DataFrame, email: str = "email") -> DataFrame:
    """Prediction rows, feedback rows, distinct users (missing emails ignored)."""
    users = F.count_distinct(email) if email in pred.columns else F.lit(0).cast("bigint")
    fb = feedback.agg(F.count(F.lit(1)).alias("n"))
    return pred.agg(F.count(F.lit(1)).alias("predictions"), users.alias("users")).select(
        "predictions", fb.scalar().alias("feedback"), "users"
    )
