"""Matching logged predictions with feedback on shared keys.

Missing keys match missing keys (``<=>``), and the match is many-to-many.
``join_feedback`` returns the matched rows themselves. ``matched_sums`` serves
every metric over the same match without forming the pairs, so a key with a
million rows on both sides costs a sort instead of 10**12 rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloop.functions import parse_timestamp, round_to_second, to_double
from scoreloop.functions.vocabulary import PREDICTED, REAL
from scoreloop.operators.cells import borders, cell_of, most_shares, thin
from scoreloop.operators.hot import DEFAULT_HOT_ROWS, HOT, hot_keys, key_hash, shares

MATCH_KEYS = ("user_id", "email", "timestamp")


def shared_keys(pred: DataFrame, feedback: DataFrame, wanted=MATCH_KEYS) -> list[str]:
    return [k for k in wanted if k in pred.columns and k in feedback.columns]


def match_ready(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in comparable form: text, and the time rounded to the second."""
    return df.withColumns({
        k: round_to_second(parse_timestamp(k)) if k == "timestamp" else F.col(k).cast("string")
        for k in keys
    })


def _equal(left: str, right: str, names: list[str]) -> Column:
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names],
    )


def join_feedback(
    pred: DataFrame,
    feedback: DataFrame,
    predicted: str = PREDICTED,
    real: str = REAL,
    hot_rows: int = DEFAULT_HOT_ROWS,
) -> DataFrame:
    """Inner many-to-many match with ``y_pred`` and ``y_true``.

    Columns on both sides come back with ``_pred`` and ``_fb`` suffixes. With
    fewer than two shared keys, or without a value to compare, the result is
    empty. Predictions of a hot key are dealt over several tasks and its
    feedback is repeated to each of them; every matching pair still meets
    exactly once.
    """
    keys = shared_keys(pred, feedback)
    has_pred = predicted in pred.columns or predicted in feedback.columns
    has_real = real in pred.columns or real in feedback.columns
    if len(keys) < 2 or not has_pred or not has_real:
        return pred.sparkSession.createDataFrame([], "y_pred double, y_true double")

    left, right = match_ready(pred, keys), match_ready(feedback, keys)
    found = hot_keys(left.select(*keys).unionByName(right.select(*keys)), keys, hot_rows)
    hot = F.broadcast(found.select(HOT, shares(hot_rows, most_shares(pred)).alias("__n")))

    def mark(df: DataFrame) -> DataFrame:
        marked = df.withColumn("__h", key_hash(keys)).join(hot, F.col("__h") == F.col(HOT), "left")
        return marked.drop("__h", HOT)

    # Dealt by row content, not at random: a task that runs again deals the same
    # way. Equal rows stay together; AQE splits them where they are too many.
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pred.columns]), F.col("__n")).cast("int")
    left = mark(left).withColumn("__salt", F.coalesce(deal, F.lit(0)))
    spread = F.sequence(F.lit(0), F.coalesce(F.col("__n"), F.lit(1)) - 1)
    right = mark(right).withColumn("__salt", F.explode(spread))

    both = set(pred.columns) & set(feedback.columns) - set(keys)
    out = [F.col(f"p.{k}").alias(k) for k in keys]
    for side, df, suffix in (("p", pred, "_pred"), ("f", feedback, "_fb")):
        out += [
            F.col(f"{side}.`{c}`").alias(c + suffix if c in both else c)
            for c in df.columns
            if c not in keys
        ]
    joined = (
        left.alias("p")
        .join(right.alias("f"), _equal("p", "f", [*keys, "__salt"]), "inner")
        .select(*out)
    )
    y_pred = predicted + "_pred" if predicted in both else predicted
    y_true = real + "_fb" if real in both else real
    return joined.withColumns({"y_pred": to_double(y_pred), "y_true": to_double(y_true)}).dropna(
        subset=["y_true", "y_pred"]
    )


def matched_sums(
    pred: DataFrame,
    feedback: DataFrame,
    predicted: str = PREDICTED,
    real: str = REAL,
    carry: tuple[str, ...] = (),
    hot_rows: int = DEFAULT_HOT_ROWS,
) -> DataFrame:
    """Per feedback value: sums over all predictions it matches.

    One row per feedback row (equal rows of a hot key share one, with their
    number in ``weight``) that has at least one matching prediction row:

    ``y_true``, ``own_pred`` (the prediction repeated in the feedback, if
    any), ``weight``, ``n_rows`` (matching prediction rows), ``n_pred`` (those
    with a prediction), ``sum_pred``, and over these predictions p and the label
    r the sums ``sum_err`` of p - r, ``sum_sq_err`` of its square and ``sum_abs``
    of its absolute value.

    Both sides are stacked and sorted by value within each key. With running
    counts and sums to the left of a value r, ``sum|r - p|`` is
    ``r*n_left - s_left + (s - s_left) - r*(n - n_left)``, and with the mean and
    the centred squares of the predictions the squared error is
    ``n*(mean - r)**2 + squares``. Values count from a reference value of their
    key, so nothing is lost where they lie far from 0 and close together. Cold
    keys take one shuffle and one sort. Hot keys are first collapsed to distinct values and
    cut into value cells, each its own group; the totals of the cells before
    are carried over through a small table (hot keys x cells).
    """
    keys = shared_keys(pred, feedback)
    extra = [c for c in carry if c not in keys]
    left = match_ready(pred, keys).select(
        *keys, to_double(predicted).alias("v"), F.lit(True).alias("is_pred")
    )
    own = to_double(predicted) if predicted in feedback.columns else F.lit(None).cast("double")
    right = (
        match_ready(feedback, keys)
        .select(
            *keys,
            to_double(real).alias("v"),
            F.lit(False).alias("is_pred"),
            own.alias("own_pred"),
            *extra,
        )
        .filter("v is not null")
    )
    rows = left.unionByName(right, allowMissingColumns=True)
    hashed = rows.withColumn("__h", key_hash(keys))
    found = hot_keys(rows, keys, hot_rows)
    hot = F.broadcast(found)
    is_hot = F.col("__h") == F.col(HOT)

    cold = hashed.join(hot, is_hot, "left_anti").withColumns(
        {"weight": F.lit(1).cast("bigint"), "cell": F.lit(0)}
    )
    cells = most_shares(pred)
    distinct = hashed.join(hot, is_hot, "left_semi").groupBy(*hashed.columns).agg(
        F.count(F.lit(1)).alias("weight")
    )
    # A cell per hot_rows rows: all borders together stay below rows/hot_rows.
    edges = (
        distinct.groupBy(F.col("__h").alias("__e")).agg(borders("v", cells).alias("edges"))
        .join(hot, F.col("__e") == F.col(HOT))
        .select("__e", thin(F.col("edges"), cells, shares(hot_rows, cells)).alias("edges"))
    )
    celled = (
        distinct.join(edges, F.col("__h") == F.col("__e"), "left")
        .withColumn("cell", cell_of(F.col("v"), F.col("edges"), cells))
        .withColumn("ref", F.coalesce(F.get("edges", F.lit(0)), F.lit(0.0)))
        .drop("__e", "edges")
    )
    # Any value of the key serves as its reference.
    anywhere = Window.partitionBy(*keys, "cell")
    cold = cold.withColumn("ref", F.coalesce(F.min("v").over(anywhere), F.lit(0.0)))

    is_value = F.col("is_pred") & F.col("v").isNotNull()
    d = F.col("v") - F.col("ref")
    n_row = F.when(F.col("is_pred"), F.col("weight")).otherwise(0)
    n = F.when(is_value, F.col("weight")).otherwise(0)
    s = F.when(is_value, F.col("weight") * d)
    mean = F.try_divide(F.col("s_cell"), F.col("n_cell"))
    squares = F.when(is_value, F.col("weight") * (d - mean) * (d - mean))

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    in_cell = anywhere.orderBy("v")
    whole = in_cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        cold.unionByName(celled)
        .withColumns({
            "n_left": F.sum(n).over(upto), "s_left": zero(F.sum(s).over(upto)),
            "rows_cell": F.sum(n_row).over(whole), "n_cell": F.sum(n).over(whole), "s_cell": zero(F.sum(s).over(whole)),
        })
        .withColumn("squares_cell", zero(F.sum(squares).over(whole)))
        .filter(~F.col("is_pred"))
    )

    # Hot keys only: what lies in the cells before, the whole key, and its centred squares.
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        celled.groupBy(*keys, "cell")
        .agg(F.sum(n).alias("c_n"), zero(F.sum(s)).alias("c_s"), F.sum(n_row).alias("c_rows"))
        .select(
            *keys, "cell",
            F.coalesce(F.sum("c_n").over(before), F.lit(0)).alias("b_n"), zero(F.sum("c_s").over(before)).alias("b_s"),
            F.sum("c_rows").over(by_key).alias("t_rows"), F.sum("c_n").over(by_key).alias("t_n"), F.sum("c_s").over(by_key).alias("t_s"),
        )
    )
    off = d - F.try_divide(F.col("t_s"), F.col("t_n"))
    spread = (
        celled.alias("l").join(carried.alias("c"), _equal("l", "c", [*keys, "cell"]))
        .groupBy(*[F.col(f"l.{k}").alias(k) for k in keys])
        .agg(zero(F.sum(F.when(is_value, F.col("weight") * off * off))).alias("t_squares"))
    )
    placed = (
        local.alias("l")
        .join(carried.alias("c"), _equal("l", "c", [*keys, "cell"]), "left")
        .join(spread.alias("t"), _equal("l", "t", keys), "left")
    )
    n_left = F.col("n_left") + F.coalesce("b_n", F.lit(0))
    s_left = F.col("s_left") + zero(F.col("b_s"))
    n_all, s_all = F.coalesce("t_n", "n_cell"), F.coalesce("t_s", "s_cell")
    # A prediction less its reference value against the label less the same.
    r = F.col("v") - F.col("ref")
    gap = F.coalesce(F.try_divide(s_all, n_all), r) - r
    return placed.select(
        *[F.col(f"l.{k}").alias(k) for k in keys],
        *extra,
        F.col("v").alias("y_true"),
        "own_pred",
        "weight",
        F.coalesce("t_rows", "rows_cell").alias("n_rows"),
        n_all.alias("n_pred"),
        (s_all + n_all * F.col("ref")).alias("sum_pred"),
        (n_all * gap).alias("sum_err"),
        (n_all * gap * gap + F.coalesce("t_squares", "squares_cell")).alias("sum_sq_err"),
        (r * n_left - s_left + (s_all - s_left) - r * (n_all - n_left)).alias("sum_abs"),
    ).filter("n_rows > 0")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: the source of fan-out in the match."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
