"""Preparation, forests, search, registry, scoring. Small trees, real tables."""

import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from scoreloop.functions.vocabulary import PREDICTED, REAL
from scoreloop.operators.forest import cross_validate, fit_numeric_baseline, fit_sample, random_trials, search, split_metrics
from scoreloop.operators.prep import (
    feature_table, fit_transform, impute, one_hot_wide, standard_scale, vocabularies,
)
from scoreloop.operators.split import hash_folds, split_bucket
from scoreloop.plans.scoring import batch_inference, batch_score, compare_models, score_records
from scoreloop.plans.training import train, train_and_report, train_or_register, tune
from scoreloop.sources import feature_groups as G
from scoreloop.sources.files import read_json
from scoreloop.sources.registry import ModelRegistry, numeric_metrics, save_with_copy
from test_quality import requests

NUM, CAT = ["x1", "x2"], ["c"]
SMALL = {"trees": 5, "depth": 5}


@pytest.fixture(scope="module")
def people(table):
    """Features with a known signal, keyed by part."""
    p = table("part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x1"), F.col("p_retailprice").alias("x2"),
        F.when(F.col("p_size") % 3 == 0, "a").when(F.col("p_size") % 3 == 1, "b").otherwise("d'e").alias("c"),
    ).withColumn("y", 10 + 2 * F.ln("x1") + F.when(F.col("c") == "a", 3).otherwise(0)).cache()


def test_scaling_and_one_hot(spark):
    df = spark.createDataFrame([(1.0, 5, "b"), (3.0, 5, "a"), (5.0, 5, None)], "x double, k int, c string")
    out, model = fit_transform(df, ["x", "k"], ["c"])
    got = np.array([r["features"].toArray() for r in out.orderBy("x").collect()])
    z = (np.array([1, 3, 5]) - 3) / np.std([1, 3, 5])
    want = np.column_stack([z, [0, 0, 0], [0, 1, 0], [1, 0, 0]])
    assert got == pytest.approx(want)
    unseen = model.transform(spark.createDataFrame([(3.0, 6, "zz")], "x double, k int, c string"))
    assert list(unseen.first()["features"].toArray()) == [0, 1, 0, 0]
    wide = feature_table(df, ["x", "k"], ["c"])
    assert wide.columns == ["x", "k", "c_a", "c_b"]
    assert np.array(wide.orderBy("x").collect()) == pytest.approx(want)
    assert standard_scale(df, ["k"]).agg(F.max(F.abs("k_scaled"))).first()[0] == 0


def test_vocabulary_bound(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"), F.lit("k").alias("d"))
    with pytest.raises(ValueError, match="more than 10"):
        vocabularies(df, ["c", "d"], limit=10)
    assert vocabularies(df, ["d"]) == {"d": ["k"]}
    assert one_hot_wide(df, ["d"]).agg(F.sum("d_k")).first()[0] == 50


def test_imputation(spark, rows, tmp_path):
    df = spark.createDataFrame(
        [(1.0, "a"), (2.0, "b"), (4.0, "a"), (10.0, "b"), (None, None), (float("nan"), "it's")], "x double, c string"
    )
    got = sorted(rows(impute(df, ["x"], ["c"])))
    assert got == [(1.0, "a"), (2.0, "b"), (3.0, "a"), (3.0, "it's"), (4.0, "a"), (10.0, "b")]
    out, model = fit_transform(df, ["x"], ["c"], scale=False, impute_missing=True)
    model.write().overwrite().save(str(tmp_path / "prep"))
    again = PipelineModel.load(str(tmp_path / "prep")).transform(df)
    assert sorted(map(str, rows(out.select("features")))) == sorted(map(str, rows(again.select("features"))))
    assert sorted(r["x"] for r in out.collect()) == [1, 2, 3, 3, 4, 10]


def test_training_report(people, tmp_path, spark):
    model, report = train(people, "y", "id", trees=20, depth=10)
    assert report["metrics"]["train"]["r2"] > report["metrics"]["test"]["r2"] > 0.8
    assert report["num_cols"] == NUM and report["cat_cols"] == CAT and report["n_rows"] == people.count()
    again, _ = train(people, "y", "id", trees=20, depth=10)
    a, b = (m.transform(people).agg(F.sum("prediction")).first()[0] for m in (model, again))
    assert a == pytest.approx(b)
    saved = train_and_report(people, "y", "id", str(tmp_path), str(tmp_path / "report"), exact=True, **SMALL)
    assert json.loads(json.dumps(saved)) == read_json(spark, str(tmp_path / "report"))
    assert PipelineModel.load(saved["model_paths"]["backup"]).transform(people).count() == people.count()
    with pytest.raises(ValueError, match="target"):
        train(people, "nope", "id")


def test_baseline_and_split_metrics(people):
    model = fit_numeric_baseline(people, "y", NUM, depth=5)
    got = split_metrics(model.transform(split_bucket(people, "id")), "y").collect()
    assert {r["split"] for r in got} == {"train", "test"}
    assert sum(r["n"] for r in got) == people.count()


@pytest.mark.parametrize("keyed", [True, False])
def test_fit_rows_are_drawn_one_by_one(spark, keyed):
    """Few kinds of rows, each many times: the sample holds its share of every kind, not all or none of one."""
    kind = F.col("id") % 30
    df = spark.range(30_000).select("id", kind.cast("double").alias("x"), (kind * kind).cast("double").alias("y"))
    df = df if keyed else df.drop("id")
    got = {r["x"]: r["count"] for r in fit_sample(df, ["x", "y"], rows=600, partitions=4).groupBy("x").count().collect()}
    assert len(got) == 30 and 450 <= sum(got.values()) <= 750 and max(got.values()) <= 60
    again = fit_sample(df.repartition(7), ["x", "y"], rows=600, partitions=4)
    assert {r["x"]: r["count"] for r in again.groupBy("x").count().collect()} == got
    model = fit_numeric_baseline(df, "y", ["x"], fit_rows=600, partitions=4)
    assert split_metrics(model.transform(df.withColumn("split", F.lit("all"))), "y").first()["r2"] > 0.98


def test_folds_are_worked_out_once(spark, people):
    """However many passes cross-validation takes, the plan of its rows runs once."""
    seen = spark.sparkContext.accumulator(0)
    rows = hash_folds(people, "id").cache()
    schema, n = rows.schema, rows.count()

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    scores = cross_validate(rows.mapInArrow(counted, schema), "y", [{"trees": 1, "depth": 1}], NUM, CAT)
    assert scores.agg(F.sum("n")).first()[0] == seen.value == n


def test_cross_validation_and_search(people, tmp_path):
    folded = hash_folds(people, "id")
    scores = cross_validate(folded, "y", [SMALL, {"trees": 1, "depth": 1}], NUM, CAT, parallelism=2)
    assert scores.count() == 6
    assert scores.filter("trial = 0").agg(F.sum("n")).first()[0] == people.count()
    table, best = search(folded, "y", NUM, CAT, trials=[{"trees": 1, "depth": 1}, SMALL])
    assert best == SMALL and table.count() == 2
    _, best, model = tune(people, "y", "id", trials=[SMALL], contiguous=True, model_root=str(tmp_path))
    assert model.transform(people).count() == people.count()
    trials = random_trials()
    assert trials == random_trials() and len(trials) == 30
    assert all(50 <= t["trees"] <= 500 and 3 <= t["depth"] <= 20 and 1 <= t["min_leaf"] <= 10 for t in trials)


def test_registry(people, spark, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path))
    with pytest.raises(LookupError):
        registry.latest("m")
    model, _ = train(people, "y", "id", **SMALL)
    assert registry.register(model, "m", {"mae": 1, "note": "text", "ok": True}) == 1
    assert registry.register(model, "m", {}) == 2
    assert registry.latest("m")[1] == 2
    stored = {r["version"]: r["metrics"] for r in registry.entries("m").collect()}
    assert stored == {1: {"mae": 1.0, "rmse": -1.0, "r2": -1.0}, 2: {"mae": -1.0, "rmse": -1.0, "r2": -1.0}}
    assert numeric_metrics({"n": 3})["n"] == 3.0
    unlabelled = people.withColumn(REAL, F.lit(None).cast("double")).drop("y")
    assert train_or_register(unlabelled, registry, "m", "id", fallback=model) == 3
    with pytest.raises(ValueError):
        train_or_register(people, registry, "m", "id")
    labelled = people.withColumnRenamed("y", REAL).withColumn("x1", F.when(F.col("id") % 9 > 0, F.col("x1")))
    assert train_or_register(labelled, registry, "m", "id", **SMALL) == 4
    assert registry.entries("m").filter("version = 4").first()["metrics"]["r2"] > 0
    assert len({*save_with_copy(model, str(tmp_path / "copies"), "main")}) == 2


def test_compare(people):
    good, _ = train(people, "y", "id", trees=20, depth=10)
    poor, _ = train(people, "y", "id", trees=1, depth=1)
    test = split_bucket(people, "id").filter("split = 'test'")
    got = {r["model"]: r for r in compare_models(test, {"good": good, "poor": poor}, "y", "id").collect()}
    assert got["good"]["r2"] > got["poor"]["r2"] and got["good"]["n"] == test.count()
    assert got["good"]["rmse"] == pytest.approx(got["good"]["mse"] ** 0.5)


def request_model(spark):
    rows = [{"age": 20 + i % 50, "weight_kg": 50.0 + i % 40, "experience_level": str(1 + i % 3)} for i in range(60)]
    from scoreloop.operators.forest import fit_forest
    from scoreloop.operators.project import build_features

    df = build_features(requests(spark, *rows).withColumn("experience_level", F.col("experience_level").cast("int")))
    df = df.withColumn("label", F.col("age") * 0.3 + F.col("bmi"))
    return fit_forest(df, "label", ["age", "weight_kg", "bmi", "log_age"], ["gender", "workout_type"], **SMALL)


def test_scoring(spark, tmp_path):
    model = request_model(spark)
    out = score_records(requests(spark, {"email": " T@E.com "}, {"age": 60}), model).collect()
    assert out[0]["prediction_id"] == "t_e.com__2024-01-01T00:00:00+00:00"
    assert all(r[PREDICTED] == round(r[PREDICTED], 2) and r[REAL] is None for r in out)
    root = str(tmp_path)
    scored = spark.createDataFrame(out, score_records(requests(spark, {}), model).schema)
    G.insert(spark, root, G.PREDICTION_GROUP, scored.drop("prediction_id", PREDICTED).withColumn("user_id", F.lit("u")))
    stored = G.read_group(spark, root, "user_fat_percentage")
    assert batch_score(stored, model).count() == stored.count() == 1
    registry = ModelRegistry(spark, f"{root}/models")
    registry.register(model, "m", {})
    done = batch_inference(spark, root, registry, "m", G.PREDICTION_GROUP)
    again = batch_inference(spark, root, registry, "m", G.PREDICTION_GROUP)
    assert done.columns[:4] == ["user_id", "email", "timestamp", PREDICTED]
    assert again.count() == 1
