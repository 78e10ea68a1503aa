"""The loop end to end: logs, feature tables, monitoring reports."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scoreloop import session
from scoreloop.functions import iso_utc
from scoreloop.functions.vocabulary import PREDICTED, REAL
from scoreloop.plans import fixtures as fx
from scoreloop.plans.monitoring import load_tables, match_metrics, monitor, worst_matched_users
from scoreloop.sources import feature_groups as G
from scoreloop.sources.files import append_log, read_optional

FOLDER = "/root/testdata/sf0.001"


def test_logs_to_reports(spark, tmp_path):
    root = str(tmp_path / "root")
    log = fx.prediction_log(spark, FOLDER).drop("user_id").withColumn("timestamp", iso_utc("timestamp"))
    feedback = fx.feedback_log(spark, FOLDER).drop("user_id").withColumn("timestamp", iso_utc("timestamp"))
    append_log(log, str(tmp_path / "predictions"))
    G.sync_logs(spark, root, read_optional(spark, str(tmp_path / "predictions"), log.schema), None)
    pred, fb = load_tables(spark, root)
    assert pred.count() == log.count() and fb.count() == 0
    early = monitor(spark, root)
    assert early["overview"].first()["feedback"] == 0 and early["metrics"].count() == 0

    G.sync_logs(spark, root, None, feedback)
    reports = monitor(spark, root)
    stored = G.read_group(spark, root, "user_fat_feedback").count()
    assert reports["overview"].first() == (log.count(), stored, log.select("email").distinct().count())
    assert reports["latest"].count() == 10
    assert {r["feature"] for r in reports["drift"].collect()} == {"age", "weight_kg", "bmi", "log_age"}
    got = reports["metrics"].first()
    sides = (
        fx.prediction_log(spark, FOLDER).select("email", "timestamp", PREDICTED),
        fx.feedback_log(spark, FOLDER).select("email", "timestamp", REAL, PREDICTED),
    )
    want = match_metrics(*sides).first()
    assert (got["n"], got["mae"], got["bias"]) == (want["n"], pytest.approx(want["mae"]), pytest.approx(want["bias"]))
    assert reports["worst_users"].count() == 10
    assert [r["email"] for r in reports["worst_users"].collect()] == [r["email"] for r in worst_matched_users(*sides).collect()]


def test_syncing_twice_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    log = fx.prediction_log(spark, FOLDER).withColumn("timestamp", iso_utc("timestamp"))
    G.sync_logs(spark, root, log, None)
    rows = sorted(G.read_group(spark, root, "user_fat_percentage").collect(), key=str)
    G.sync_logs(spark, root, log, None)
    again = G.read_group(spark, root, "user_fat_percentage")
    assert sorted(again.collect(), key=str) == rows
    assert again.agg(F.max(REAL)).first()[0] is None


def test_temporary_folder_only_on_a_local_master(monkeypatch):
    class Fake:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "yarn", "applicationId": "a"})

    with pytest.raises(RuntimeError):
        session.shared_dir(Fake)
    Fake.sparkContext.master = "local[2]"
    monkeypatch.setattr(session, "_LOCAL_DIRS", {"a": "here"})
    assert session.shared_dir(Fake) == "here"
