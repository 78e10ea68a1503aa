"""Exact order statistics against numpy, with brackets forced to be narrow."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloop.operators import order_stats
from scoreloop.operators.cells import borders, cell_of
from scoreloop.operators.order_stats import exact_quantiles, medians, modes
from scoreloop.operators.profile import describe, histogram, pair_grid, pair_sample, table_profile, value_range
from scoreloop.operators.split import contiguous_folds, hash_folds, split_bucket, split_exact


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 10, 101, 5000])
@pytest.mark.parametrize("accuracy", [50, 100_000])
def test_quantiles(spark, n, accuracy):
    rng = random.Random(n)
    a = [rng.choice([1.0, 2.0, rng.gauss(0, 10)]) for _ in range(n)]
    b = [rng.uniform(0, 1) for _ in range(n)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r[0], r[1]): r[2] for r in exact_quantiles(df, ["a", "b"], probs, accuracy, last_rows=3).collect()}
    for name, values in (("a", a), ("b", b)):
        assert [got[name, p] for p in probs] == pytest.approx(list(np.quantile(values, probs)))


def test_few_rows_reach_the_last_step_however_many_there_are(spark, monkeypatch):
    seen = {"_narrowed": [], "_read_off": []}
    for name in seen:
        def spied(long, brackets, accuracy, found, name=name, plain=getattr(order_stats, name)):
            seen[name] += [b.inside for b in brackets]
            if name == "_read_off":
                assert all(b.few(accuracy, order_stats.LAST_ROWS) for b in brackets)
            return plain(long, brackets, accuracy, found)

        monkeypatch.setattr(order_stats, name, spied)
    for n, rounds in ((10_000, 0), (3_000_000, 1)):
        seen["_narrowed"].clear(), seen["_read_off"].clear()
        df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"))
        assert exact_quantiles(df, ["x"], [0.5]).first()["value"] == (n - 1) / 2
        # A rank and its successor share a bracket; a narrowing leaves about a thousandth.
        assert len(seen["_narrowed"]) == rounds and len(seen["_read_off"]) == 1
        assert seen["_read_off"][0] <= max(10_000, n / 500)


def test_a_sketch_that_misleads_costs_passes_only(spark, monkeypatch):
    """Pivots beside the rank: the bracket is widened until it holds it."""
    plain = order_stats.Bracket.pivots
    monkeypatch.setattr(order_stats.Bracket, "pivots", lambda self, accuracy: (self.hi, self.hi) if self.widen < 16 else plain(self, accuracy))
    df = spark.range(9_000).select(F.col("id").cast("double").alias("x"))
    for last_rows in (1, 1000):
        got = exact_quantiles(df, ["x"], [0.25, 0.5], last_rows=last_rows).collect()
        assert sorted(r["value"] for r in got) == [0.25 * 8999, 0.5 * 8999]


@pytest.mark.parametrize("values", [[5.0] * 4000 + [6.0] * 4000, [1.0] * 5000 + [2.0], [0.0] + [7.0] * 6000 + [9.0]])
def test_ties_fill_brackets(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.25, 0.5, 0.9999, 1.0]
    got = {r[1]: r[2] for r in exact_quantiles(df, ["x"], probs, last_rows=2).collect()}
    assert [got[p] for p in probs] == pytest.approx(list(np.quantile(values, probs)))


def test_median_mode_ties(spark, rows):
    df = spark.createDataFrame(
        [(1.0, "b"), (2.0, "a"), (4.0, "b"), (10.0, "a"), (None, None), (float("nan"), None)], "x double, s string"
    )
    assert rows(medians(df, ["x"])) == [("x", 3.0)]
    assert rows(modes(df, ["s"])) == [("s", "a")]


def test_describe(table):
    df = table("lineitem").select("l_quantity", "l_extendedprice")
    want = df.toPandas().describe()
    for r in describe(df, df.columns).collect():
        got = [r[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
        assert got == pytest.approx(list(want[r["column"]]))


def test_cells_keep_order(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("v"))
    edges = df.agg(borders("v", 16).alias("e"))
    got = df.withColumn("e", edges.scalar()).select("v", cell_of(F.col("v"), F.col("e"), 16).alias("c"), "e").distinct().collect()
    for r in got:
        assert r["c"] == sum(e < r["v"] for e in r["e"])
    assert len({r["c"] for r in got}) > 12


def test_histogram_and_ranges(spark, rows):
    df = spark.createDataFrame([(float(i),) for i in [0, 1, 2, 3, 4, 10, 10]], "v double")
    got = histogram(df, "v", 5).orderBy("bin").collect()
    want, edges = np.histogram([0, 1, 2, 3, 4, 10, 10], 5)
    assert [(r["bin"], r["rows"]) for r in got] == [(i + 1, c) for i, c in enumerate(want)]
    assert got[-1]["high"] == edges[-1]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r[0] for r in histogram(same, "v", 5).orderBy("bin").select("rows").collect()] == [0, 0, 0, 0, 2]
    assert histogram(same.limit(0), "v", 5).collect() == []
    assert rows(value_range(df.withColumn("w", -F.col("v")), ["v", "w"])) == [(-10.0, 10.0)]


@pytest.mark.parametrize("bins", [1, 3, 10])
def test_pair_grid(spark, bins):
    rng = random.Random(bins)
    rows_ = [(rng.gauss(0, 1), float(rng.randrange(4)), rng.choice([None, float("nan"), rng.random()]), 7.0) for _ in range(500)]
    df = spark.createDataFrame(rows_, "a double, `b c` double, d double, e double").withColumn("f", F.lit(None).cast("double"))
    got = pair_grid(df, df.columns, bins).collect()
    pairs = {(r["x_name"], r["y_name"]) for r in got}
    assert pairs == {("a", "b c"), ("a", "d"), ("a", "e"), ("b c", "d"), ("b c", "e"), ("d", "e")}  # f has no value
    columns = dict(zip(df.columns, zip(*rows_)))
    for x, y in pairs:
        own = [(u, v) for u, v in zip(columns[x], columns[y]) if u is not None and v is not None and u == u and v == v]
        spans = []
        for name in (x, y):
            every = [v for v in columns[name] if v is not None and v == v]
            spans.append((min(every), max(every)))
        cells = [r for r in got if (r["x_name"], r["y_name"]) == (x, y)]
        assert len(cells) == bins * bins and sum(r["rows"] for r in cells) == len(own)
        if "e" not in (x, y):
            want, xe, ye = np.histogram2d(*zip(*own), bins=bins, range=spans)
            assert all(r["rows"] == want[r["x_bin"] - 1][r["y_bin"] - 1] for r in cells)
            assert all(r["x_low"] == pytest.approx(xe[r["x_bin"] - 1]) and r["y_high"] == pytest.approx(ye[r["y_bin"]]) for r in cells)
        else:  # a constant column falls into its last bin
            assert all(r["rows"] == 0 for r in cells if r["y_bin"] < bins)
    assert pair_grid(df.limit(0), ["a", "d"], bins).collect() == []
    exchanges = pair_grid(df, df.columns, bins)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges <= 2  # one for all pairs' counts, one for the empty cells


def test_profile_and_sample(table):
    df = table("part")
    prof = table_profile(df).collect()
    assert [(r["ordinal"], r["column"], r["dtype"]) for r in prof] == [(i, c, t) for i, (c, t) in enumerate(df.dtypes)]
    assert {r["rows"] for r in prof} == {df.count()}
    a = pair_sample(df, ["p_size", "p_retailprice"], "p_partkey", 20).collect()
    b = pair_sample(df.repartition(7), ["p_size", "p_retailprice"], "p_partkey", 20).collect()
    assert len(a) == 20 and sorted(a) == sorted(b)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 16, 999, 5003])
def test_exact_split(spark, n):
    df = spark.range(n).repartition(3)
    parts = split_exact(df, "id").groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in parts}
    assert counts.get("test", 0) == int(np.ceil(n * 0.2))
    assert sum(counts.values()) == n
    again = split_exact(df.repartition(7), "id")
    assert split_exact(df, "id").exceptAll(again).count() == 0


def test_bucket_split_and_folds(spark):
    df = spark.range(5000)
    share = split_bucket(df, "id").filter("split = 'test'").count() / 5000
    assert 0.17 < share < 0.23
    assert {r["fold"] for r in hash_folds(df, "id", 4).select("fold").distinct().collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("n,k", [(10, 3), (11, 3), (12, 5), (14, 5), (7, 7), (1003, 10)])
def test_contiguous_folds(spark, n, k):
    df = spark.range(n).select((F.col("id") * 3 + 5).alias("key")).repartition(4)
    got = [r[0] for r in contiguous_folds(df, "key", k).orderBy("key").select("fold").collect()]
    sizes = [n // k + (i < n % k) for i in range(k)]
    assert got == [i for i, s in enumerate(sizes) for _ in range(s)]
