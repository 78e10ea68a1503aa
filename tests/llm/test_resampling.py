import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from scoreloop.llm import resampling

SCHEMA = "doc_id long, text string, row string, key int, times int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, n_max):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]


def brute(rows, targets, n_max=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, wanted = Counter(), Counter()
    for _, text in rows:
        raw.update(map(bucket, brute_features(text, n_max)[1]))
    for text in targets:
        wanted.update(map(bucket, brute_features(text, n_max)[1]))
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
    found = []
    for key, text in rows:
        words, features = brute_features(text, n_max)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([key, len(features), weight, score, None, len(words) >= min_words])
    able = sorted((r for r in found if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = place + 1
    return sorted(map(str, (tuple(r[:5]) for r in found)))


def got(spark, rows, targets, **kwargs):
    docs = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], SCHEMA)
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, row int")
    found = resampling.resample(docs, target, **kwargs)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(str(tuple(r)) for r in found.collect())


def some_rows(n=250):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "ß2", "Ünd"]
    common = [" ".join(rng.choices(words, k=8)) for _ in range(10)]
    return [
        (i, "\n".join(rng.choice([rng.choice(common), rng.choice(common).upper() + "!", " ".join(rng.choices(words, k=5)), ""]) for _ in range(rng.randint(0, 12))))
        for i in range(n)
    ]


@pytest.mark.parametrize("n_max", [1, 2, 3])
@pytest.mark.parametrize("buckets", [50, 10_000])
def test_equals_brute_force(spark, n_max, buckets):
    rows, targets = some_rows(), ["w1 w2 w3\nw4 É", None, "w1 w1 w1 und"]
    kwargs = {"n_max": n_max, "buckets": buckets, "percent": 33}
    assert got(spark, rows, targets, **kwargs) == brute(rows, targets, **kwargs)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, "a b " * 30), (None, None), (1, ""), (2, "-- ,"), (3, "one\ntwo " * 40), (3, "one\ntwo " * 40), (4, "long words " * 150_000), (5, "x" * 3_000_000 + " y" * 20), (6, "Same\nsame\n" * 15)]
    targets = ["one two", "same"]
    for n_max in (1, 2):
        assert got(spark, rows, targets, percent=60, n_max=n_max) == brute(rows, targets, percent=60, n_max=n_max)


def test_empty_tables(spark):
    assert got(spark, [], ["a"]) == []
    rows = [(1, "a b c " * 10), (2, "d")]
    assert got(spark, rows, [], percent=100) == brute(rows, [], percent=100)


def test_crossing_runs_and_segments_make_up_all_runs():
    for _, text in some_rows(40):
        lines = resampling.segments(text.encode())
        inside = [b" ".join(line[i : i + n]) for line in lines for n in (1, 2, 3) for i in range(len(line) - n + 1)]
        found = Counter(w.decode() for w in [*inside, *resampling.crossing_runs(lines, 3)])
        assert found == Counter(brute_features(text, 3)[1])


def test_documents_against_brute_force(spark, sf_small):
    docs, target = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, targets = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    found = resampling.resample(docs, target)
    assert sorted(str(tuple(r)) for r in found.collect()) == brute(rows, targets)
