"""Forests on all rows: against plain loops, a depth by itself, other layouts; queries whose rows a sample would miss."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from scoreloop.operators import trees as T
from scoreloop.operators.forest import cross_validate, fit_whole
from scoreloop.operators.grown import Ground, Grower, features_and
from scoreloop.plans import catalog
from scoreloop.plans import fixtures as fx
from scoreloop.session import scratch_dir


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    df = spark.range(6000).select("id", (i * 7919 % 29).cast("double").alias("a"), (i * 104729 % 997 / 10.0).alias("b"), (i % 13).cast("double").alias("c"))
    df = df.withColumn("y", F.sin("a") * 5 + F.col("b") / 20 + F.col("id") % 3).withColumn("fold", (F.hash("id") % 3 + 3) % 3)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(df).cache()


def ground(spark, rows):
    return Ground(features_and(rows, "features", F.col("y")), scratch_dir(spark, "ground"))


def plain_split(bins, y, w, least):
    """Greatest fall of the squared error, tried one by one."""
    def error(own):
        return (w[own] * (y[own] - np.average(y[own], weights=w[own])) ** 2).sum()

    best = 0.0
    for f in range(bins.shape[1]):
        for cut in range(T.BINS - 1):
            left = bins[:, f] <= cut
            if w[left].sum() >= least and w[~left].sum() >= least:
                best = max(best, error(left | ~left) - error(left) - error(~left))
    return best


@pytest.mark.parametrize("least", [1, 7])
def test_splits_are_the_best(least):
    rng = np.random.default_rng(least)
    bins, y, w = rng.integers(0, 9, (300, 3)).astype(np.uint8), rng.random(300), rng.integers(1, 4, 300)
    tree = T.grow(bins, y, w, 30, least)
    at = np.zeros(300, int)
    for _ in range(4):  # the upper nodes
        for node in np.unique(at):
            own = at == node
            if tree[node]["left"] < 0:
                continue
            left = own & (bins[:, tree[node]["feature"]] <= tree[node]["cut"])
            mean = [np.average(y[s], weights=w[s]) for s in (own, left, own & ~left)]
            gain = sum(w[s].sum() * (m - mean[0]) ** 2 for s, m in zip((left, own & ~left), mean[1:]))
            assert gain == pytest.approx(plain_split(bins[own], y[own], w[own], least))
            at[left], at[own & ~left] = tree[node]["left"], tree[node]["left"] + 1
    assert tree["count"][tree["left"] < 0].min() >= least
    order = rng.permutation(300)
    assert np.array_equal(tree, T.grow(bins[order], y[order], w[order], 30, least))
    leaf = T.route(tree, bins)
    assert all(tree[n]["value"] == pytest.approx(np.average(y[leaf == n], weights=w[leaf == n])) for n in np.unique(leaf))
    forms = [(30, 2), (3, 2), (30, 40)]
    shallow = T.grow(bins, y, w, 3, least)
    assert T.walk(tree, bins, forms)[:, 1] == pytest.approx(T.walk(shallow, bins, forms)[:, 0])


def test_draws_of_equal_rows():
    """A row that occurs n times is drawn as often as n rows are, and otherwise by each tree."""
    key = np.arange(20_000) * 7919
    for n in (1, 4, 300, 10**6):
        w = T.bootstrap(key, np.full(len(key), n), 3, 42)
        assert w.mean() == pytest.approx(n, abs=5 * math.sqrt(n / len(key))) and w.var() == pytest.approx(n, rel=0.1)
    one, other = (T.bootstrap(key, np.ones(len(key), int), t, 42) for t in (0, 1))
    assert abs(np.corrcoef(one, other)[0, 1]) < 0.05


@pytest.mark.parametrize("local_bytes", [16 << 20, 1])
def test_scores_equal_the_model(spark, rows, local_bytes):
    """In a task from the root on, or with upper levels by passes: what cross-validation scores is what the model predicts."""
    grower = Grower(own := ground(spark, rows.filter("fold > 0")), trees=4, depth=12, min_leaf=2, local_bytes=local_bytes)
    assert (len(grower.tops[0].nodes) > 1) == (local_bytes == 1)
    valid = rows.filter("fold = 0")
    trial = [(0, {}), (1, {"depth": 2}), (2, {"min_split": 400}), (3, {"trees": 1})]
    got = grower.scored(own.tile(features_and(valid, "features", F.col("y")), "valid"), trial)
    small = [Grower(own, min_leaf=2, local_bytes=local_bytes, **size).model() for size in ({"trees": 4, "depth": 2}, {"trees": 1, "depth": 12})]
    forests = [grower.model(), small[0], grower.model(400), small[1]]
    for i, model in enumerate(forests):
        out = model.transform(valid).select("id", "y", "prediction").toPandas()
        assert sorted(out["id"]) == sorted(r["id"] for r in valid.select("id").collect())
        r2 = 1 - ((out["y"] - out["prediction"]) ** 2).sum() / ((out["y"] - out["y"].mean()) ** 2).sum()
        assert got[i][0] == len(out) and got[i][1] == pytest.approx(r2, abs=1e-6)
    assert got[0][1] > 0.5 > got[1][1]


def test_layout_does_not_show(spark, rows):
    plain = rows.drop("features")
    scores = [cross_validate(df, "y", [{"trees": 3}], ["a", "c"]).collect() for df in (plain.repartition(3), plain.repartition(11, "b"))]
    assert all(list(a) == pytest.approx(list(b)) for a, b in zip(*scores))


def test_saved_and_loaded(spark, rows, tmp_path):
    plain = rows.drop("features").withColumn("kind", F.concat(F.lit("k"), (F.col("id") % 3).cast("string")))
    twice = plain.union(plain)
    model = fit_whole(twice, "y", ["a", "b", "c"], ["kind"], trees=3, depth=20)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = (m.transform(twice).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("prediction").alias("p"), F.max("prediction").alias("q")).orderBy("id").collect() for m in (model, again))
    assert len(a) == 6000 and all(r["n"] == 2 and r["p"] == pytest.approx(r["q"]) for r in a)
    assert all(list(r) == pytest.approx(list(s)) for r, s in zip(a, b, strict=True))
    assert model.transform(twice.limit(0)).count() == 0
    assert model.transform(twice.limit(5).withColumn("a", F.lit(None).cast("double"))).filter("prediction is not null").count() == 5


def test_labels_are_needed(spark, rows):
    with pytest.raises(ValueError, match="label"):
        ground(spark, rows.withColumn("y", F.when(F.col("id") > 5, F.col("y"))))
    with pytest.raises(ValueError, match="label"):
        ground(spark, rows.limit(0))
    gaps = rows.drop("features").withColumn("a", F.when(F.col("id") > 5, F.col("a")))
    with pytest.raises(ValueError, match="feature"):
        fit_whole(gaps, "y", ["a", "b"], trees=1)


def training_rows(spark, label, n, a, b, c):
    zero = F.lit(0.0)
    features = {"l_quantity": a, "l_discount": b, "l_tax": c, "p_size": zero, "p_retailprice": zero, "ratio": zero, "log_quantity": zero}
    i = F.col("id")
    columns = [v.cast("double").alias(k) for k, v in features.items()]
    return spark.range(n).select(i.cast("string").alias(fx.KEY), i.alias("l_partkey"), i.alias("l_suppkey"), *columns, F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), label.alias(fx.LABEL))


@pytest.mark.parametrize("name", ["cv_mean_r2", "cv_contiguous", "tune_and_refit"])
def test_every_kind_of_row_is_learnt(spark, monkeypatch, name):
    """13,824 kinds of rows with labels of their own, eight of each: 5,000 rows know too few of them."""
    kind = F.col("id") % 24**3
    label = (F.xxhash64(kind, F.lit(7)) % 100).cast("double")
    made = training_rows(spark, label, 8 * 24**3, kind % 24, F.floor(kind / 24) % 24, F.floor(kind / 576))
    if name == "cv_contiguous":
        made = made.withColumn(fx.KEY, F.concat(fx.KEY, F.lit("-1")))
    monkeypatch.setattr(fx, "training_set", lambda spark, sf: made)
    got = catalog.QUERIES[name](spark, "unused").collect()
    assert sum(r["n"] for r in got) == 8 * 24**3 and all(r["good"] for r in got)


def test_search_learns_from_rare_rows(spark, monkeypatch):
    """One row of 500 carries all there is to learn: 500 rows hold too few of them for a leaf."""
    rare = F.col("id") % 500 == 0
    made = training_rows(spark, F.when(rare, 1000.0).otherwise((F.col("id") % 7).cast("double")), 12_000, rare.cast("int"), F.col("id") % 7, F.lit(0))
    monkeypatch.setattr(fx, "training_set", lambda spark, sf: made)
    got = catalog.QUERIES["search_trials"](spark, "unused").collect()
    assert len(got) == 4 and all(r["n"] == 12_000 and r["good"] and r["best_is_top"] for r in got)
