import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloop.llm import ego_join


def brute(rows, cosine):
    """rows: (key, vec, label) → (key, n_links, component, kept)."""
    good = []
    for _, v, label in rows:
        ok = v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, float) / np.sqrt(sum(x * x for x in v)) if ok else None)
    n = len(rows)
    group, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            a, b = good[i], good[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b) or a @ b < cosine:
                continue
            links[i] += 1
            links[j] += 1
            x, y = group[i], group[j]
            group = [min(x, y) if g in (x, y) else g for g in group]
    out = []
    for i in range(n):
        keys = [rows[j][0] for j in range(n) if group[j] == group[i] and rows[j][0] is not None]
        least = min(keys) if keys else None
        out.append((rows[i][0], links[i], least, rows[i][0] == least))
    return sorted(out, key=str)


def clusters(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [(i, (centres[rng.integers(6)] + rng.normal(size=dim) * 0.12).tolist(), int(rng.integers(2))) for i in range(n)]
    rows += [(n + i, rows[i % 7][1], rows[i % 7][2]) for i in range(40)]
    return rows


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [1.0, None] + [0.0] * 6, 1), (904, [float("nan")] * 8, 1),
    (905, [float("inf")] + [0.0] * 7, 1), (906, [1.0] * 8, None), (907, [1.0] * 8, 1), (908, [2.0] * 8, 1), (908, [2.0] * 8, 1),
    (None, [3.0] * 8, 1), (910, [1.0] * 4, 1), (911, [-0.0] + [1.0] * 7, 1), (912, [0.0] + [1.0] * 7, 1), (913, [1e-170] * 8, 1),
]
SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_equals_brute_force(spark, block_rows):
    rows = clusters(1, 200) + [r for r in ODD if r[0] != 913]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"h1": F.lit(1), "pos": F.lit(2), "n": F.lit(3), "block": F.lit("b")})
    got = ego_join.near_duplicates(frame, 0.98, block_rows=block_rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 0.98)


def test_tiny_and_huge_lengths_keep_their_direction(spark):
    rows = [(1, [1e-170, 1e-170], 0), (2, [1e170, 1e170], 0), (3, [1e-170, -1e-170], 0)]
    got = {r.vec_id: r.component_id for r in ego_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_no_usable_vector_and_empty_table(spark):
    frame = spark.createDataFrame(ODD[:6], SCHEMA)
    assert sorted(map(tuple, ego_join.near_duplicates(frame).collect())) == sorted((r[0], 0, r[0], True) for r in ODD[:6])
    assert ego_join.near_duplicates(frame.limit(0)).collect() == []


def test_distant_blocks_are_skipped(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(8)[i % 8] + rng.normal(size=8) * 1e-3).tolist(), 0) for i in range(800)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = ego_join.near_duplicates(frame, block_rows=20).collect()
    assert {r.n_links for r in got} == {99} and {r.component_id for r in got} == set(range(8))


def test_table(spark, sf_small):
    frame = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    assert sorted(map(tuple, ego_join.near_duplicates(frame, block_rows=64).collect()), key=str) == brute(rows, 0.98)
