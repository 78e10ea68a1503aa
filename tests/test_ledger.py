"""Ledger writes, patches and reads."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scoreloop.functions.vocabulary import PREDICTED, REAL
from scoreloop.operators.ledger import (
    fold_patches,
    history,
    history_table,
    latest_per_key,
    latest_predictions,
    lookup,
    merge_patches,
    patches_from_feedback,
    route_feedback,
    series_long,
    sync_feedback,
    sync_predictions,
    training_rows,
)

T0 = datetime(2024, 1, 1)
FB = f"prediction_id string, timestamp timestamp, {REAL} double, {PREDICTED} double"


def at(s):
    return T0 + timedelta(seconds=s)


def ledger(spark):
    return spark.createDataFrame(
        [("p1", "a@b.c", at(0), 20.0), ("p2", "a@b.c", at(5), 30.0), ("p3", "z@b.c", None, 40.0)],
        f"prediction_id string, email string, timestamp timestamp, {PREDICTED} double",
    )


def replay(patches):
    """Apply patches one by one to documents, in event order."""
    docs = {}
    for pid, ts, real, pred in sorted(patches, key=lambda r: (r[1], r[2], r[3] if r[3] is not None else -1)):
        doc = docs.setdefault(pid, {})
        doc.update(real=real, ts=ts)
        if pred is not None:
            doc.update(pred=pred, signed=round(real - pred, 3))
    return docs


def test_last_write_wins(spark, rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (None, 1, "n"), (None, 2, "m")], "k int, s int, v string")
    assert sorted(rows(latest_per_key(df, ["k"], ["s"])), key=str) == [(1, 3, "c"), (None, 2, "m")]
    twice = latest_per_key(latest_per_key(df, ["k"], ["s"]), ["k"], ["s"])
    assert twice.count() == 2
    assert latest_per_key(df, ["k"], ["s"]).columns == df.columns


def test_routing(spark):
    fb = spark.createDataFrame([("p", 1), ("", 2), (None, 3)], "prediction_id string, n int")
    linked, orphans = route_feedback(fb)
    assert [r["n"] for r in linked.collect()] == [1]
    assert sorted(r["n"] for r in orphans.collect()) == [2, 3]


def test_patches(spark):
    fb = [
        ("p1", at(10), 22.0, 21.0),
        ("p1", at(20), 25.0, None),  # later, without a prediction: errors stay
        ("p9", at(10), 18.0, None),  # unknown id: a stub row
        ("", at(10), 1.0, 1.0),
        (None, at(10), 1.0, 1.0),
    ]
    merged = merge_patches(ledger(spark), fold_patches(patches_from_feedback(spark.createDataFrame(fb, FB))))
    got = {r["prediction_id"]: r.asDict() for r in merged.collect()}
    assert set(got) == {"p1", "p2", "p3", "p9"}
    assert got["p1"][REAL] == 25.0 and got["p1"][f"{PREDICTED}_feedback"] == 21.0
    assert (got["p1"]["abs_error"], got["p1"]["signed_error"], got["p1"]["relative_error"]) == (1.0, 1.0, 4.55)
    assert got["p1"]["email"] == "a@b.c" and got["p1"][PREDICTED] == 20.0
    assert got["p2"][REAL] is None
    assert got["p9"][REAL] == 18.0 and got["p9"]["email"] is None


def test_merging_again_keeps_what_is_not_patched(spark):
    first = fold_patches(patches_from_feedback(spark.createDataFrame([("p1", at(1), 22.0, 21.0)], FB)))
    second = fold_patches(patches_from_feedback(spark.createDataFrame([("p1", at(2), 30.0, None)], FB)))
    got = merge_patches(merge_patches(ledger(spark), first), second).filter("prediction_id = 'p1'").first()
    assert (got[REAL], got["abs_error"]) == (30.0, 1.0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_folding_equals_replay_whatever_the_batches(spark, seed):
    rng = random.Random(seed)
    patches = [
        (f"p{rng.choice([0, 0, 0, 1, 2, 3])}", at(rng.randrange(8)), float(rng.randrange(10, 14)),
         rng.choice([None, None, 11.0, 12.5]))
        for _ in range(60)
    ]
    want = replay(patches)
    whole = fold_patches(patches_from_feedback(spark.createDataFrame(patches, FB)))
    rng.shuffle(patches)
    halves = [
        fold_patches(patches_from_feedback(spark.createDataFrame(part, FB))) for part in (patches[:25], patches[20:])
    ]
    pieced = fold_patches(halves[0].unionByName(halves[1]))
    for folded in (whole, pieced):
        got = {r["prediction_id"]: r for r in folded.collect()}
        assert got.keys() == want.keys()
        for pid, doc in want.items():
            assert (got[pid][REAL], got[pid]["feedback_timestamp"]) == (doc["real"], doc["ts"])
            assert got[pid][f"{PREDICTED}_feedback"] == doc.get("pred")
            assert got[pid]["signed_error"] == doc.get("signed")


def test_history_orders(spark):
    df = ledger(spark).withColumn(REAL, F.lit("x"))
    mine = history(df, " A@B.C ").collect()
    assert [r["timestamp"] for r in mine] == ["2024-01-01T00:00:00+00:00", "2024-01-01T00:00:05+00:00"]
    assert mine[0][REAL] == "x" and mine[0][f"{REAL}_number"] is None
    everyone = history(df.withColumn("email", F.lit("a"))).collect()
    assert everyone[0]["timestamp"] is None
    filled = history(df.withColumn("stored", F.lit(T0)), ingested="stored").filter("prediction_id = 'p3'").first()
    assert filled["timestamp"] == "2024-01-01T00:00:00+00:00"


def test_history_table(spark):
    df = spark.createDataFrame(
        [("p1", "2024-01-01T10:00:00+00:00", 1.0), ("p2", '{"_seconds": 1719828000}', 2.0), ("p3", "nope", 3.0)],
        f"prediction_id string, timestamp string, {PREDICTED} double",
    )
    out = history_table(df)
    assert out.columns == ["timestamp", PREDICTED]
    assert [tuple(r) for r in out.collect()] == [
        ("2024-07-01 12:00:00", 2.0), ("2024-01-01 11:00:00", 1.0), (None, 3.0)
    ]


def test_latest_counts_missing_times_as_newest(spark):
    assert [r["prediction_id"] for r in latest_predictions(ledger(spark), 2).collect()] == ["p3", "p2"]


def test_training_rows(spark, rows):
    df = spark.createDataFrame(
        [("20", None), ("bad", 1.0), (None, 2.0), ("30.5", 4.0)], f"{REAL} string, {PREDICTED} double"
    )
    assert sorted(rows(training_rows(df))) == [(20.0, 0.0), (30.5, 4.0)]


def test_lookup_lowers_but_does_not_trim(spark):
    assert {r["doc_id"] for r in lookup(ledger(spark), "A@B.C").collect()} == {"p1", "p2"}
    assert lookup(ledger(spark), " a@b.c").count() == 0
    for short in ("", "ab", None):
        with pytest.raises(ValueError, match="email_domain"):
            lookup(ledger(spark), short)


def test_series(spark):
    df = spark.createDataFrame(
        [(at(0), 1.0, None), (at(1), 2.0, None), (None, 3.0, 5.0)], f"timestamp timestamp, {PREDICTED} double, {REAL} double"
    )
    got = series_long(df).collect()
    assert {r["serie"] for r in got} == {"Predicción"} and len(got) == 2


def test_sync(spark):
    log = spark.createDataFrame(
        [("A@b.C", "2024-01-01T10:00:00+00:00", 1.0, "2", "3", 80.0, 2.0, 35)],
        f"email string, timestamp string, {PREDICTED} double, experience_level string, "
        "workout_frequency_days_week string, weight_kg double, height_m double, age int",
    )
    row = sync_predictions(log).first()
    assert row["user_id"] == "d648b243a3e817ea" and row["timestamp"] == datetime(2024, 1, 1, 10)
    assert (row["experience_level"], row["workout_frequency_days_week"], row[REAL], row["bmi"]) == (2, 3, None, 20.0)
    assert row["log_age"] == pytest.approx(3.58351893845611)
    assert sync_feedback(log.select("email", "timestamp")).columns == ["email", "timestamp", "user_id"]
