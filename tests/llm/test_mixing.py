import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scoreloop.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes: dict, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(w[s] for s in open_)
        goal = {s: left * w[s] / total for s in open_}
        over = [s for s in open_ if goal[s] > most * sizes[s]]
        if not over:
            return full | goal
        for s in over:
            full[s] = float(most * sizes[s])
            left -= full[s]


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 3, 50, 1000, 20000]) + rng.randint(0, 3) * (seed > 0) for i in range(rng.choice([1, 4, 25]))} | {None: 7, "\u00e9": 12, "Z": 1}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want)
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-12, abs=1e-9)


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "z", "y"])
        rows.append((i, " ".join(["w"] * min(3000, int(rng.lognormvariate(4, 1)))), source))
    return rows


def check(found, rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    return want, taken


def test_words_taken_come_near_the_targets_and_reruns_agree(spark):
    rows = corpus(6000)
    frame = spark.createDataFrame(rows, SCHEMA)
    found = mixing.copies(frame).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    want, taken = check(found, rows)
    largest = max(r.size for r in found)  # a source ends with one document taken or not
    for source in want:
        assert abs(taken[source] - want[source]) <= largest, source
    again = mixing.copies(frame.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    other = mixing.copies(frame, seed=9).collect()
    assert sorted(map(str, other)) != sorted(map(str, found))


def test_number_of_copies_per_source_is_within_one(spark):
    rows = [(i, "w " * 10, "ab"[i % 7 == 0]) for i in range(3000)]
    found = mixing.copies(spark.createDataFrame(rows, SCHEMA)).collect()
    want, taken = check(found, rows)
    assert all(abs(taken[s] - want[s]) < 10 + 1e-6 for s in want)


def test_draws_follow_the_masses(spark):
    unit = mixing.UNIT
    rows = [("s", 10, i, int(unit * (0.2 if i % 2 else 0.7))) for i in range(8000)]
    frame = spark.createDataFrame(rows, "source string, size long, rid long, mass long")
    ups = {r.rid: r.up for r in mixing.rounded(frame, cell=16).collect()}
    assert len(ups) == len(rows)
    low, high = (sum(ups[i] for i in range(k, 8000, 2)) / 4000 for k in (1, 0))
    assert abs(low - 0.2) < 0.03 and abs(high - 0.7) < 0.03
    assert abs(sum(ups.values()) - sum(r[3] for r in rows) / unit) < 1


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (None, "x y", "b"), (5, "w " * 100_000, "b"), (5, "w", "b"), (5, "w", "b"), (6, "v w", None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(1) for k in ("size", "copies", "rid", "cell", "target")})
    found = mixing.copies(frame).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((k, len((t or "").split())) for k, t, _ in rows)
    check(found, rows)
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    many = Counter((r.doc_id, len((r.text or "").split())) for r in mixed.collect())
    want = Counter()
    for r in found:
        want[(r.doc_id, r.size)] += r.copies
    assert many == +want
    assert mixing.copies(frame.limit(0)).collect() == [] and mixing.mix(frame.limit(0)).collect() == []


def test_mixed_corpus_of_a_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = {r.doc_id: r.copies for r in mixing.copies(docs).collect()}
    got = Counter(r.doc_id for r in mixing.mix(docs).select("doc_id").collect())
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_one_repeated_row_may_hold_a_third_and_names_may_clash(spark):
    rows = [(None, "v w x", "a")] * 700 + [(None, None, None)] * 300 + [(i, "w " * (i % 40 + 1), "b") for i in range(1000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    names = ("row", "key", "h", "_key", "_h", "part", "nth", "least", "extra", "copies", "copy", "size", "_all")
    frame = frame.withColumns({k: F.concat(F.lit("mine "), F.col("source")) for k in names})
    found = mixing.copies(frame).collect()
    assert len(found) == len(rows)
    want, taken = check(found, rows)
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)
    assert len({r.occurrence for r in found if r.doc_id is None and r.size}) == 700
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    got = mixed.collect()
    assert all(r[k] == (f"mine {r.source}" if r.source else None) for r in got for k in names)
    counts = Counter()
    for r in found:
        counts[(r.doc_id, r.size)] += r.copies
    assert Counter((r.doc_id, len((r.text or "").split())) for r in got) == +counts


def test_words_of_small_sources_stay_below_their_largest_document(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    taken, want, largest = defaultdict(int), {}, defaultdict(int)
    for r in mixing.copies(docs).collect():
        taken[r.source] += r.copies * r.size
        want[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
