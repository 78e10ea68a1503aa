"""Error metrics. Every function is one aggregate with map-side partials."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloop.functions import nan_to_null, normalise_email, round_half_even
from scoreloop.functions.vocabulary import PREDICTED, REAL
from scoreloop.operators.quality import nonempty


def _rounded(df: DataFrame, places: dict[str, int], apply: bool) -> DataFrame:
    return df.withColumns({c: round_half_even(c, p) for c, p in places.items()}) if apply else df


def _doubles(*names: str) -> list[Column]:
    return [nan_to_null(F.col(f"`{n}`").cast("double")) for n in names]


def error_summary(
    df: DataFrame,
    real: str = REAL,
    pred: str = PREDICTED,
    by: Iterable[str] = (),
    rounded: bool = True,
) -> DataFrame:
    """count, MAE, RMSE, mean signed error (real - pred), mean relative error %.

    Only rows with both a label and a prediction count. RMSE needs two rows; a
    label of 0 has no relative error. Without such rows there is no result row.
    """
    y, p = _doubles(real, pred)
    e = y - p
    n = F.count(e)
    out = df.groupBy(*by).agg(
        n.alias("count"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(n >= 2, F.sqrt(F.avg(e * e))).alias("rmse"),
        F.avg(e).alias("mean_signed_error"),
        F.avg(F.try_divide(F.abs(e), y) * 100).alias("mean_relative_error"),
    )
    places = {"mae": 3, "rmse": 3, "mean_signed_error": 3, "mean_relative_error": 2}
    return _rounded(nonempty(out, "count"), places, rounded)


def error_summary_for(df: DataFrame, email: str, **kwargs) -> DataFrame:
    """``error_summary`` of one user; the filter reaches the scan."""
    wanted = normalise_email(F.lit(email))
    return error_summary(df.filter(F.col("email") == wanted), **kwargs)


def regression_metrics(
    df: DataFrame,
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    by: Iterable[str] = (),
    places: int | None = 3,
) -> DataFrame:
    """n, MAE, MSE, RMSE, R2 (NULL for a constant label) over complete rows."""
    y, p = _doubles(y_true, y_pred)
    both = y.isNotNull() & p.isNotNull()
    y, e = F.when(both, y), y - p
    total = F.var_pop(y) * F.count(y)
    out = nonempty(
        df.groupBy(*by).agg(
            F.count(y).alias("n"),
            F.avg(F.abs(e)).alias("mae"),
            F.avg(e * e).alias("mse"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            (1 - F.try_divide(F.sum(e * e), total)).alias("r2"),
        ),
        "n",
    )
    return _rounded(out, dict.fromkeys(("mae", "mse", "rmse", "r2"), places), places is not None)


def bias_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Iterable[str] = ()) -> DataFrame:
    """n, MAE, RMSE and bias = mean(pred - real)."""
    y, p = _doubles(y_true, y_pred)
    e = p - y
    return nonempty(
        df.groupBy(*by).agg(
            F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"),
            F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        ),
        "n",
    )


def user_errors(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", logged: str | None = None, by: str = "email"
) -> DataFrame:
    """Per user: rows, MAE, mean real, mean logged prediction."""
    y, p, q = _doubles(y_true, y_pred, logged or y_pred)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(p - y)).alias("mae"),
        F.avg(y).alias("mean_real"), F.avg(q).alias("mean_pred"),
    )


def worst_users(per_user: DataFrame, k: int = 10, by: str = "email") -> DataFrame:
    """The k users with the largest MAE; ties by key."""
    return per_user.orderBy(F.desc_nulls_last("mae"), F.asc(by)).limit(k)


def matched_metrics(
    sums: DataFrame, by: Iterable[str] = (), prefer_feedback_prediction: bool = False, center: Column | None = None
) -> DataFrame:
    """All match metrics from ``matched_sums``, weighting each row by its pairs.

    With ``prefer_feedback_prediction`` the prediction repeated in a feedback
    row replaces the logged ones it matches. R2 needs the spread of the labels;
    ``center``, a value near their mean, keeps its digits where the labels lie
    far from 0.
    """
    r, w = F.col("y_true"), F.col("weight")
    own = F.col("own_pred")
    use_own = own.isNotNull() if prefer_feedback_prediction else F.lit(False)

    def pick(from_own: Column, from_log: Column) -> Column:
        return w * F.when(use_own, from_own).otherwise(from_log)

    n = pick(F.col("n_rows"), F.col("n_pred"))
    abs_e = pick(F.col("n_rows") * F.abs(own - r), F.col("sum_abs"))
    e = pick(F.col("n_rows") * (own - r), F.col("sum_err"))
    sq = pick(F.col("n_rows") * (own - r) * (own - r), F.col("sum_sq_err"))
    d = r - (F.lit(0.0) if center is None else center)
    total = F.sum(n)
    # A constant label has no spread, whatever rounding leaves.
    varies = F.min(F.when(n > 0, r)) < F.max(F.when(n > 0, r))
    spread = F.when(varies, F.sum(n * d * d) - F.sum(n * d) * F.sum(n * d) / total)
    out = sums.groupBy(*by).agg(
        total.alias("n"),
        F.sum(w * F.col("n_rows")).alias("n_rows"),
        F.try_divide(F.sum(abs_e), total).alias("mae"),
        F.sqrt(F.try_divide(F.sum(sq), total)).alias("rmse"),
        F.try_divide(F.sum(e), total).alias("bias"),
        F.try_divide(-F.sum(e), total).alias("mean_signed_error"),
        F.try_divide(
            F.sum(F.try_divide(abs_e, r) * 100), F.sum(F.when(r != 0, n))
        ).alias("mean_relative_error"),
        (1 - F.try_divide(F.sum(sq), spread)).alias("r2"),
        F.try_divide(F.sum(w * F.col("n_rows") * r), F.sum(w * F.col("n_rows"))).alias("mean_real"),
        F.try_divide(F.sum(w * F.col("sum_pred")), F.sum(w * F.col("n_pred"))).alias("mean_pred"),
    )
    return nonempty(out, "n_rows")
