from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scoreloop.llm import simhash
from scoreloop.llm.common import components


def brute_print(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_groups(rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 2:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((key, f"{prints[i]:016x}", min(keys) if keys else None))
    return out


def test_golay_keys_meet_for_every_pair_within_two_errors():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    for size in range(3):
        for bits in combinations(range(23), size):
            other = words ^ sum(1 << b for b in bits)
            a, b = simhash.codewords(words), simhash.codewords(other)
            meets = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2))
            assert meets.all(), bits


def test_number_of_codeword_keys_is_one_or_six():
    found = (simhash.codewords(np.arange(1 << 16)) >= 0).sum(1)
    assert set(found.tolist()) == {1, 6}


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = set(base.tolist())
    for fp in base.tolist():
        for _ in range(6):
            other = fp
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                other ^= 1 << int(b)
            prints.add(other)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {tuple(r) for r in simhash.linked_fingerprints(frame).collect()}
    want = {(a, b) if a < b else (b, a) for a, b in combinations(signed, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want and len(want) > 100


def test_groups_equal_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, " \t"), (9004, "Two WORDS"), (9005, "two words"), (9006, "É x y"), (9001, None), (None, "solo words here now")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "root": F.lit("x"), "key": F.lit(2)})
    got = sorted(map(tuple, simhash.near_duplicates(frame).collect()), key=str)
    assert got == sorted(brute_groups(rows), key=str)


def test_keep_first_keeps_one_of_each_group_and_all_columns(spark):
    rows = [(3, "a b c d", "x"), (1, "A B C D", None), (2, "other words in here", "y"), (1, "A B C D", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.keep_first(frame)
    assert got.columns == frame.columns
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in frame.filter("doc_id < 3").collect())


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(frame).collect() == []
    assert simhash.keep_first(frame).collect() == []


def test_very_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(200_000))
    frame = spark.createDataFrame([(1, text), (2, text + " tail"), (3, "x" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 50)],
    [(1, 2), (3, 4), (4, 5), (2, 1), (7, 7), (100, 99)],
])
def test_components(spark, links):
    frame = spark.createDataFrame(links, "src long, dst long")
    got = {r.node: r.root for r in components(frame).collect()}
    group = {n: n for pair in links for n in pair if pair[0] != pair[1]}
    for _ in group:
        for a, b in links:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    assert set(got) == set(group)
    assert len({(got[n], group[n]) for n in got}) == len(set(got.values())) == len(set(group.values()))
