import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloop.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, queries, k, scale=1024):
    def ints(found):
        out = set()
        for key, v in found:
            if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
                out.add((key, tuple(math.floor(scale * x) for x in v)))
        return out

    out = []
    for q, a in ints(queries):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), key) for key, b in ints(rows) if key != q)
        out += [(q, i, key, -s) for i, (s, key) in enumerate(scored[:k], 1)]
    return sorted(out)


def make(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.geomspace(3, 0.05, dim) * rng.lognormal(size=(n, 1))
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("block_rows,query_rows", [(16, 5), (1024, 256)])
def test_equals_brute_force(spark, block_rows, query_rows):
    rows = make(1, 300)
    rows += [(1000 + i, rows[i % 9][1]) for i in range(30)] + [(5, rows[5][1])]
    rows += [(2000, None), (2001, []), (2002, [None, 1.0]), (2003, [math.nan]), (2004, [-math.inf]), (None, [9.0] * 12), (2006, [1.0]), (2007, [0.0] * 12)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("a"), "v": F.lit(1), "block": F.lit(2), "h": F.lit(0)})
    asked = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    got = topk.top_k(frame, frame.filter("vec_id % 10 = 0"), 10, block_rows=block_rows, query_rows=query_rows)
    assert sorted(map(tuple, got.collect())) == brute(rows, asked, 10)


def test_pruning_keeps_every_hit_and_skips_pairs(monkeypatch):
    rows = make(2, 3000)
    x = np.floor(1024 * np.array([v for _, v in rows]))
    x = x[np.argsort(-(x * x).sum(1))]
    axes = np.linalg.svd(x, full_matrices=False)[2].T
    seen = []
    plain = topk._exact
    monkeypatch.setattr(topk, "_exact", lambda q, v, asked: seen.append(asked.sum()) or plain(q, v, asked))
    ids = np.arange(len(x))
    q = x[::100]
    scores = q @ x.T
    bound = np.sort(scores[:, :500], 1)[:, -10]
    hits = topk.block_hits(q, ids[::100], x[500:], ids[500:], bound, axes, 3000)
    want = {(i, j) for i, j in zip(*np.nonzero(scores[:, 500:] >= bound[:, None])) if ids[::100][i] != ids[500:][j]}
    assert {(i, j) for i, j, _ in hits} == want
    assert sum(seen) < 0.7 * len(q) * 2500


def test_large_components_stay_exact(spark):
    rows = [(0, [2e5, 1.0]), (1, [3e5, 1.0]), (2, [3e5, 2.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(frame, frame.filter("vec_id = 0"), 2)
    assert sorted(map(tuple, got.collect())) == brute(rows, rows[:1], 2)


def test_nothing_to_search(spark):
    frame = spark.createDataFrame([(0, None), (1, [1.0])], SCHEMA)
    assert topk.top_k(frame, frame.filter("vec_id = 0")).collect() == []
    assert topk.top_k(frame.limit(0), frame).collect() == []
    assert topk.top_k(frame, frame.filter("vec_id = 1")).collect() == []
