"""The feedback match against brute force, with and without hot keys."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scoreloop.operators.match import duplicate_keys, join_feedback, matched_sums, shared_keys
from scoreloop.operators.metrics import bias_metrics, error_summary, matched_metrics, regression_metrics, user_errors
from scoreloop.functions.vocabulary import PREDICTED, REAL
from scoreloop.plans.monitoring import match_metrics, worst_matched_users

PRED = "user_id string, email string, timestamp timestamp, predicted_fat_percentage double"
FB = "user_id string, email string, timestamp timestamp, real_fat_percentage double, predicted_fat_percentage double"
T0 = datetime(2024, 1, 1)


def data(seed=3, n=400):
    """A third of all rows share one key, and another one is missing its parts."""
    rng = random.Random(seed)

    def key():
        u = rng.random()
        if u < 0.34:
            return ("hot", "hot@x.y", T0)
        if u < 0.45:
            return (None, None, None)
        i = rng.randrange(40)
        return (str(i), f"{i}@x.y", T0 + timedelta(milliseconds=rng.choice([0, 400, 600, 1500])))

    def value(miss=0.1):
        return None if rng.random() < miss else rng.choice([10.0, 20.0, rng.uniform(1, 60)])

    pred = [(*key(), value()) for _ in range(n)]
    fb = [(*key(), value(0.05), value(0.5)) for _ in range(n)]
    return pred, fb


def second(t):
    if t is None:
        return None
    us = (t - T0) / timedelta(microseconds=1)
    return round(us / 1e6)  # Python rounds ties to even


def pairs(pred, fb):
    for u, e, t, p in pred:
        for fu, fe, ft, r, own in fb:
            if (u, e, second(t)) == (fu, fe, second(ft)):
                yield e, p, r, own


@pytest.fixture(scope="module")
def frames(spark):
    pred, fb = data()
    return pred, fb, spark.createDataFrame(pred, PRED), spark.createDataFrame(fb, FB)


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_join_is_whole(frames, hot_rows):
    pred, fb, p, f = frames
    want = sorted((x[2], x[1]) for x in pairs(pred, fb) if x[1] is not None and x[2] is not None)
    got = sorted((r["y_true"], r["y_pred"]) for r in join_feedback(p, f, hot_rows=hot_rows).collect())
    assert got == want


@pytest.mark.parametrize("hot_rows", [10, 60, 1_000_000])
def test_sums_equal_the_pairs(frames, hot_rows):
    pred, fb, p, f = frames
    all_pairs = [(e, pp, r) for e, pp, r, _ in pairs(pred, fb) if pp is not None and r is not None]
    errors = [pp - r for _, pp, r in all_pairs]
    n, mean = len(errors), sum(r for *_, r in all_pairs) / len(errors)
    got = matched_metrics(matched_sums(p, f, hot_rows=hot_rows)).first()
    assert got["n"] == n
    assert got["mae"] == pytest.approx(sum(map(abs, errors)) / n)
    assert got["rmse"] == pytest.approx(math.sqrt(sum(e * e for e in errors) / n))
    assert got["bias"] == pytest.approx(sum(errors) / n)
    assert got["mean_signed_error"] == pytest.approx(-sum(errors) / n)
    assert got["mean_relative_error"] == pytest.approx(sum(100 * abs(pp - r) / r for _, pp, r in all_pairs) / n)
    ss = sum((r - mean) ** 2 for *_, r in all_pairs)
    assert got["r2"] == pytest.approx(1 - sum(e * e for e in errors) / ss)


@pytest.mark.parametrize("hot_rows", [50, 1_000_000])
@pytest.mark.parametrize("offset,gap", [(1e6, 0.01), (1e9, 0.5), (123456.7, 0.0)])
def test_metrics_far_from_zero_keep_their_digits(spark, hot_rows, offset, gap):
    p, f = [], []
    for k in range(4):
        values = [offset + (i * 37 % 101) / 8 for i in range(120)]
        p += [(str(k), "e", T0, v) for v in values]
        f += [(str(k), "e", T0, v + gap, None) for v in values]
    all_pairs = [(x[3], y[3]) for x in p for y in f if x[0] == y[0]]
    errors = [a - b for a, b in all_pairs]
    mean = math.fsum(b for _, b in all_pairs) / len(all_pairs)
    got = match_metrics(spark.createDataFrame(p, PRED), spark.createDataFrame(f, FB), hot_rows=hot_rows).first()
    squares = math.fsum(e * e for e in errors)
    assert got["rmse"] == pytest.approx(math.sqrt(squares / len(errors)), rel=1e-9)
    assert got["mae"] == pytest.approx(math.fsum(map(abs, errors)) / len(errors), rel=1e-9)
    assert got["bias"] == pytest.approx(math.fsum(errors) / len(errors), rel=1e-7, abs=1e-9)
    assert got["r2"] == pytest.approx(1 - squares / math.fsum((b - mean) ** 2 for _, b in all_pairs), rel=1e-9)


def test_metrics_may_take_the_prediction_of_the_feedback(frames):
    pred, fb, p, f = frames
    used = [(own if own is not None else pp, r) for _, pp, r, own in pairs(pred, fb) if r is not None]
    errors = [u - r for u, r in used if u is not None]
    got = match_metrics(p, f, prefer_feedback_prediction=True, hot_rows=10).first()
    assert got["n"] == len(errors) and got["mae"] == pytest.approx(sum(map(abs, errors)) / len(errors))


def test_rows_without_a_prediction_do_not_count(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, None), ("b", None, 1.0), (None, 5.0, None)]
    got = error_summary(spark.createDataFrame(rows, f"email string, {REAL} double, {PREDICTED} double"), by=["email"]).collect()
    assert [(r["email"], r["count"], r["mae"], r["rmse"]) for r in got] == [("a", 1, 1.0, None)]


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_users_prefer_the_prediction_in_the_feedback(frames, hot_rows):
    pred, fb, p, f = frames
    want = {}
    for e, pp, r, own in pairs(pred, fb):
        if r is None:
            continue
        n, errs, preds = want.setdefault(e, (0, [], []))
        used = own if own is not None else pp
        want[e] = (n + 1, errs + ([abs(used - r)] if used is not None else []), preds + ([pp] if pp is not None else []))
    got = {r["email"]: r for r in worst_matched_users(p, f, k=1000, hot_rows=hot_rows).collect()}
    assert got.keys() == want.keys()
    for e, (n, errs, preds) in want.items():
        assert got[e]["n"] == n
        assert got[e]["mae"] == pytest.approx(sum(errs) / len(errs) if errs else None)
        assert got[e]["mean_pred"] == pytest.approx(sum(preds) / len(preds) if preds else None)


def test_one_value_may_fill_a_hot_key(spark):
    pred = [("u", "e", T0, 5.0)] * 300
    fb = [("u", "e", T0, 7.0, None)] * 200
    sums = matched_sums(spark.createDataFrame(pred, PRED), spark.createDataFrame(fb, FB), hot_rows=50)
    assert sums.count() == 1
    got = matched_metrics(sums).first()
    assert (got["n"], got["mae"], got["bias"], got["r2"]) == (60_000, 2.0, -2.0, None)


def test_missing_keys_match_and_few_keys_do_not(spark):
    p = spark.createDataFrame([("1", "a", None, 1.0), (None, None, None, 2.0)], PRED)
    f = spark.createDataFrame([("1", "a", None, 3.0, None), (None, None, None, 4.0, 9.0)], FB)
    assert sorted(join_feedback(p, f).select("y_pred", "y_true").collect()) == [(1.0, 3.0), (2.0, 4.0)]
    assert shared_keys(p.drop("email"), f) == ["user_id", "timestamp"]
    assert join_feedback(p.select("user_id", "predicted_fat_percentage"), f).count() == 0
    assert join_feedback(p, f.drop("real_fat_percentage")).count() == 0


def test_suffixes(spark):
    p = spark.createDataFrame([("1", "a", T0, 1.0)], PRED).withColumn("real_fat_percentage", F.lit(None).cast("double"))
    f = spark.createDataFrame([("1", "a", T0, 3.0, 8.0)], FB)
    out = join_feedback(p, f)
    assert out.columns == [
        "user_id", "email", "timestamp", "predicted_fat_percentage_pred", "real_fat_percentage_pred",
        "real_fat_percentage_fb", "predicted_fat_percentage_fb", "y_pred", "y_true",
    ]
    assert out.select("y_pred", "y_true").first() == (1.0, 3.0)
    assert duplicate_keys(p.unionByName(p), ["user_id", "email"]).collect() == [("1", "a", 2)]


def test_metric_edges(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 1.0), ("b", 10.0, 12.0), ("b", 10.0, 9.0), ("c", None, 1.0)], "email string, y double, p double"
    )
    got = {r["email"]: r for r in error_summary(df, "y", "p", by=["email"]).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["rmse"] is None and got["a"]["mean_relative_error"] is None
    assert (got["b"]["count"], got["b"]["mae"], got["b"]["mean_signed_error"]) == (2, 1.5, -0.5)
    assert got["b"]["rmse"] == 1.581 and got["b"]["mean_relative_error"] == 15.0
    assert error_summary(df.filter("y is null"), "y", "p").count() == 0
    r2 = {r["email"]: r["r2"] for r in regression_metrics(df, "y", "p", by=["email"]).collect()}
    assert r2 == {"a": None, "b": None}
    assert bias_metrics(df, "y", "p").first()["bias"] == pytest.approx((1 + 2 - 1) / 3)
    assert bias_metrics(df.limit(0), "y", "p").count() == 0
    assert user_errors(df, "y", "p").count() == 3


def test_tasks_stay_small_whatever_the_partitions(spark):
    """Few shuffle partitions do not make large tasks: there are as many as the advisory size wants."""
    from scoreloop.session import configure

    conf = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        configure(spark)
        rows = spark.range(40_000).select(F.col("id").alias("user_id"), F.lit("a").alias("email"), F.rand(1).alias(PREDICTED), F.rand(2).alias(REAL))
        sums = matched_sums(rows.drop(REAL), rows.drop(PREDICTED))
        sizes = sums.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 40_000 and len(sizes) > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
