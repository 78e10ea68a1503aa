import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloop.llm import gbt, quality


def walk(model, row):
    total = model.base
    for at in model.roots:
        while model.left[at] != at:
            at = model.right[at] if row[model.feature[at]] > model.cut[at] else model.left[at]
        total += model.value[at]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_flat_walk_equals_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = gbt.fit(x[:2000], y[:2000])
    p = model.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.97
    assert np.allclose(p[:50], [walk(model, r) for r in x[2000:2050]])


@pytest.mark.parametrize("y,want", [([], 0.5), ([1.0] * 8, 0.9), ([0.0] * 8, 0.1)])
def test_one_class_or_no_rows(y, want):
    model = gbt.fit(np.zeros((len(y), 3)), np.array(y))
    assert model.score(np.zeros((2, 3))).tolist() == pytest.approx([want] * 2)


def test_statistics_are_finite_for_odd_texts():
    for text in (None, b"", b" \n", b"x", b"\n\n\n.", "é".encode() * 9, b"!" * 100_000, b"a b " * 100_000):
        found = quality.statistics(text)
        assert len(found) == len(quality.FEATURES) and np.isfinite(found).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 300
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    blind = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "x": F.lit(1), "key": F.lit(2), "score": F.lit(9)})
    a = sorted(map(tuple, quality.classify(docs, labels).collect()))
    assert sorted(map(tuple, quality.classify(blind.repartition(3), flipped).collect())) == a


def test_odd_rows_and_kept_columns(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(9001, None), (9002, ""), (None, "a b"), (9003, "w " * 100_000), (9001, None)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(odd)
    got = quality.classify(both, labels).collect()
    assert len(got) == both.count()
    nothing = {r.score for r in got if r.doc_id in (9001, 9002)}
    assert len(nothing) == 1
    kept = quality.keep_good(both.withColumn("score", F.lit("s")), labels)
    assert kept.columns == ["doc_id", "text", "score"]
    good = sorted(str(r.doc_id) for r in got if r.predicted)
    assert sorted(str(r.doc_id) for r in kept.collect()) == good
    assert quality.classify(both.limit(0), labels.limit(0)).collect() == []


def test_fit_bound(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    assert len(quality.fit(docs, labels, rows=0).roots) == 0
    assert len(quality.fit(docs, labels, rows=60).roots) in (0, 60)
