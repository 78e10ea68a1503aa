"""Streams end to end on files, compared with the batch operators."""

import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from scoreloop.functions.vocabulary import PREDICTED, REAL
from scoreloop.operators.ledger import fold_patches, latest_per_key, merge_patches, patches_from_feedback
from scoreloop.plans.scoring import score_records
from scoreloop.streaming.feedback import FEEDBACK_SCHEMA, LedgerSnapshot, apply_feedback_stream, read_feedback
from scoreloop.streaming.score import read_requests, score_stream
from test_models import request_model
from test_quality import requests

T0 = datetime(2024, 1, 1)


def finish(queries):
    for q in queries:
        assert q.awaitTermination(120)
        assert q.exception() is None


def test_score_stream(spark, tmp_path):
    model = request_model(spark)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "log")
    first = requests(spark, {}, {"age": 50}, {"age": 500})
    first.write.json(inbox)
    run = lambda: finish(score_stream(read_requests(spark, inbox), model, out, str(tmp_path / "cp"), str(tmp_path / "bad")))
    run()
    second = requests(spark, {"email": "Second@x.y"})
    second.write.mode("append").json(inbox)
    run()
    run()  # nothing new arrives twice
    valid = first.filter("age < 100").unionByName(second)
    want = sorted(score_records(valid, model).collect())
    assert sorted(spark.read.parquet(out).select(*score_records(valid, model).columns).collect()) == want
    assert [r["reasons"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [["age_domain"]]


def test_repeats_share_a_prediction_id(spark, tmp_path):
    """One row per id: of one second, in any spelling of the email; a broken request hides no valid one."""
    model = request_model(spark)
    late, other = T0.replace(microsecond=700_000), T0 + timedelta(seconds=1)
    rows = requests(spark, {"age": 500}, {"age": 501}, {}, {"timestamp": late}, {"email": " T@E.COM "}, {"timestamp": other}).coalesce(1)
    rows.unionByName(rows).coalesce(1).write.json(str(tmp_path / "in"))
    stream = read_requests(spark, str(tmp_path / "in"))
    finish(score_stream(stream, model, str(tmp_path / "log"), str(tmp_path / "cp"), str(tmp_path / "bad"), distinct_within="1 day"))
    names = requests(spark, {}, {"timestamp": other})
    want = sorted(r["prediction_id"] for r in score_records(names, model).collect())
    assert sorted(r["prediction_id"] for r in spark.read.parquet(str(tmp_path / "log")).collect()) == want
    assert sorted(r["age"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [500, 501]


def test_feedback_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    writes = spark.createDataFrame(
        [(f"p{i % 20}", f"u{i % 20}@x.y", T0 + timedelta(seconds=i), float(i)) for i in range(25)],
        f"prediction_id string, email string, timestamp timestamp, {PREDICTED} double",
    )
    snapshot = LedgerSnapshot(spark, str(tmp_path / "snap"), buckets=4)
    snapshot.create(writes, ["timestamp"])
    base = latest_per_key(writes, ["prediction_id"], ["timestamp"])
    assert snapshot.read().count() == 20

    def feedback(n):
        ids = [rng.choice(["p0", "p0", f"p{rng.randrange(20)}", "new", "", None]) for _ in range(n)]
        return spark.createDataFrame(
            [(i, "e", T0 + timedelta(seconds=rng.randrange(100)), float(rng.randrange(10, 40)),
              rng.choice([None, 20.0, 30.0])) for i in ids],
            FEEDBACK_SCHEMA,
        )

    inbox = str(tmp_path / "fb")
    for part in (feedback(40), feedback(30), feedback(1)):
        part.write.mode("append").json(inbox)
        finish([apply_feedback_stream(
            read_feedback(spark, inbox, files_per_trigger=4), snapshot, str(tmp_path / "cp"), str(tmp_path / "orphans")
        )])
    everything = spark.read.schema(FEEDBACK_SCHEMA).json(inbox)
    want = merge_patches(base, fold_patches(patches_from_feedback(everything)))
    columns = sorted(want.columns)
    got = snapshot.read()
    assert sorted(got.columns) == columns
    key = lambda r: r["prediction_id"]
    assert sorted(got.select(columns).collect(), key=key) == sorted(want.select(columns).collect(), key=key)
    assert "new" in {r["prediction_id"] for r in got.collect()}
    before = sorted(got.select(columns).collect(), key=key)
    snapshot.apply(everything)  # a replay changes nothing
    assert sorted(snapshot.read().select(columns).collect(), key=key) == before
    loose = everything.filter(F.coalesce("prediction_id", F.lit("")) == "").count()
    assert spark.read.parquet(str(tmp_path / "orphans")).count() == loose
    assert REAL in got.columns


@pytest.mark.parametrize("seed", [1, 2])
def test_writes_and_patches_in_any_order(spark, tmp_path, seed):
    """Last write and folded patches per id, in whatever order batches come."""
    rng = random.Random(seed)
    times = rng.sample(range(1000), 60)
    log = []  # (kind, id, time, value, prediction in the feedback)
    for t in times:
        pid = f"p{rng.choice([0, 0, 0, 1, 2, 3])}"
        if rng.random() < 0.3:
            log.append(("write", pid, t, float(t), None))
        else:
            log.append(("patch", pid, t, float(rng.randrange(10, 40)), rng.choice([None, 20.0])))
    want = {}
    for kind, pid, t, value, own in sorted(log, key=lambda e: e[2]):
        if kind == "write":
            want.setdefault(pid, {})[PREDICTED] = value
        else:
            doc = want.setdefault(pid, {})
            doc[REAL] = value
            if own is not None:
                doc.update({f"{PREDICTED}_feedback": own, "signed_error": value - own})

    schema = f"prediction_id string, email string, timestamp timestamp, {PREDICTED} double"
    snapshot = LedgerSnapshot(spark, str(tmp_path / "snap"), buckets=3)
    snapshot.create(spark.createDataFrame([], schema), ["timestamp"])
    rng.shuffle(log)
    for part in (log[:20], log[20:25], log[25:]):
        writes = [(p, "e", T0 + timedelta(seconds=t), v) for k, p, t, v, _ in part if k == "write"]
        patches = [(p, "e", T0 + timedelta(seconds=t), v, o) for k, p, t, v, o in part if k == "patch"]
        steps = [lambda: LedgerSnapshot(spark, str(tmp_path / "snap")).put(spark.createDataFrame(writes, schema)),
                 lambda: snapshot.apply(spark.createDataFrame(patches, FEEDBACK_SCHEMA))]
        rng.shuffle(steps)
        for step in steps:
            step()
    got = {r["prediction_id"]: r.asDict() for r in snapshot.read().collect()}
    assert got.keys() == want.keys()
    for pid, doc in want.items():
        for field in (PREDICTED, REAL, f"{PREDICTED}_feedback", "signed_error"):
            assert got[pid][field] == doc.get(field), (pid, field)
