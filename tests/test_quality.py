"""Schema checks, domains, nulls, projections, drift."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scoreloop.functions.vocabulary import (
    FEATURE_FIELDS, MODEL_COLUMNS, MODEL_NAMES, PARTIAL_NAMES, SCORING_NAMES, inverse,
)
from scoreloop.operators.drift import drift_report, overview
from scoreloop.operators.project import (
    build_features, cast_columns, coalesce_alternates, column_roles, feature_columns, log_skew, rename,
    select_expected, select_present, split_target,
)
from scoreloop.operators.quality import (
    FEEDBACK_RULES, REQUEST_RULES, Rule, drop_missing, null_profile, require_schema, schema_violations, split_valid,
    violation_counts, with_reasons,
)
from scoreloop.operators.profile import head
from scoreloop.streaming.score import REQUEST_SCHEMA

GOOD = ("t@e.com", datetime(2024, 1, 1), 35, "Male", 75.0, 1.78, 180, 140, 65, 1.2, 520.5, "Mixed", 2.0, 4, "2")


def requests(spark, *changes):
    names = [f.split()[0] for f in REQUEST_SCHEMA.split(", ")]
    data = [tuple({**dict(zip(names, GOOD)), **c}.values()) for c in changes]
    return spark.createDataFrame(data, REQUEST_SCHEMA)


def test_domains(spark):
    df = requests(
        spark, {}, {"gender": "Other", "experience_level": "Intermediate"}, {"age": None}, {"height_m": 2.21, "email": ""}
    )
    valid, bad = split_valid(df, REQUEST_RULES)
    assert valid.count() == 1 and valid.columns == df.columns
    reasons = sorted(tuple(r["reasons"]) for r in bad.collect())
    assert reasons == [
        ("age_domain",), ("email_domain", "height_m_domain"), ("gender_domain", "experience_level_domain")
    ]
    counts = {r["rule"]: r["violations"] for r in violation_counts(df, REQUEST_RULES).collect()}
    assert len(counts) == len(REQUEST_RULES)
    assert {k for k, v in counts.items() if v} == {f"{c}_domain" for c in ("age", "email", "height_m", "gender", "experience_level")}
    whole = spark.createDataFrame([("35",), ("35.5",), ("x",)], "age string")
    assert [len(r["reasons"]) for r in with_reasons(whole, [Rule("age", low=10, high=100, whole=True)]).collect()] == [0, 1, 1]
    fb = spark.createDataFrame([("a", 0.5), ("a", 80.0)], "email string, real_fat_percentage double")
    assert split_valid(fb, FEEDBACK_RULES)[0].count() == 1


def test_schema_check_reports_everything(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    want = {"a": "int", "b": "double", "c": "string"}
    got = {(r["column"], r["problem"], r["actual"]) for r in schema_violations(df, want).collect()}
    assert got == {("b", "wrong_type", "string"), ("c", "missing", None)}
    with pytest.raises(ValueError, match="(?s)wrong type in b.*missing column: c"):
        require_schema(df, want)
    assert require_schema(df, {"a": "int"}) is df


def test_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, None, "b")], "x int, `y (kg)` double, z string")
    assert {tuple(r) for r in null_profile(df).collect()} == {("x", 1), ("y (kg)", 2)}
    assert drop_missing(df, ["x"]).count() == 1


def test_projections(spark):
    df = requests(spark, {})
    built = build_features(df)
    row = built.first()
    assert row["bmi"] == pytest.approx(75 / 1.78**2) and row["log_age"] == pytest.approx(3.58351893845611)
    named = select_expected(rename(built, SCORING_NAMES), MODEL_COLUMNS)
    assert tuple(named.columns) == MODEL_COLUMNS and len(MODEL_COLUMNS) == 15 and len(MODEL_NAMES) == 13
    assert len(PARTIAL_NAMES) == 9 and rename(named, inverse(SCORING_NAMES)).columns == list(FEATURE_FIELDS)
    display = build_features(named.drop("BMI", "Log_Age"), "Weight (kg)", "Height (m)", "Age", "BMI", "Log_Age", "ln")
    assert display.first()["Log_Age"] == pytest.approx(3.5553480614894135)
    with pytest.raises(ValueError, match="missing columns"):
        select_expected(df, FEATURE_FIELDS)
    assert select_present(df, ["age", "nope", "email"]).columns == ["age", "email"]
    assert feature_columns(df, {"email", "timestamp"})[0] == "age"
    x, y = split_target(df, "age")
    assert "age" not in x.columns and y.columns == ["age"]
    with pytest.raises(ValueError):
        split_target(df, "nope")
    numeric, categorical = column_roles(df, {"email"})
    assert categorical == ["gender", "workout_type", "experience_level"] and "timestamp" not in numeric
    with pytest.raises(ValueError):
        column_roles(df.select("timestamp"))
    assert log_skew(df).first()["mean_gap"] == pytest.approx(3.58351893845611 - 3.5553480614894135)


def test_casts_and_alternates(spark, rows):
    df = spark.createDataFrame([("1", "x"), ("b", "2")], "a string, b string")
    assert rows(cast_columns(df, {"a": "int"})) == [(1, "x"), (None, "2")]
    alt = spark.createDataFrame(
        [(None, 1.0, 2.0), (3.0, 4.0, None)],
        "real_fat_percentage double, real_fat_percentage_feedback double, predicted_fat_percentage_feedback double",
    )
    got = coalesce_alternates(alt).select("real_fat_percentage", "predicted_fat_percentage")
    assert rows(got) == [(1.0, 2.0), (3.0, None)]
    with pytest.raises(ValueError):
        head(df, 1)
    assert rows(head(df, 1, F.desc("a"))) == [("b", "2")]


def test_drift(spark):
    t = datetime(2024, 1, 31)
    data = [(t, 0.0, 30.0), (t - timedelta(days=7), 2.0, 31.0), (t - timedelta(days=8), 0.0, 10.0), (None, 9.0, 9.0)]
    df = spark.createDataFrame(data, "timestamp timestamp, bmi double, age double")
    got = {r["feature"]: tuple(r)[1:] for r in drift_report(df).collect()}
    assert got == {"bmi": (0.0, 1.0, 1.0, None), "age": (10.0, 30.5, 20.5, 205.0)}
    assert drift_report(df, days=30).count() == 0  # nothing before the cutoff
    assert drift_report(df.limit(0)).count() == 0
    assert drift_report(df.drop("timestamp")).count() == 0
    fb = df.limit(2)
    pred = spark.createDataFrame([("a",), ("a",), (None,)], "email string")
    assert overview(pred, fb).first() == (3, 2, 1)
