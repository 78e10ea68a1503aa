import random
from itertools import combinations

import corpus_pipeline
from scoreloop.llm import near_sets, simhash
from scoreloop.llm.near_sets import linked, shingles

SCHEMA = "doc_id long, text string, n int"


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(rows):
    """Places of the rows with the smallest key of their component."""
    sets, group = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    first = {}
    for i, (key, _) in enumerate(rows):
        first[group[i]] = min(first.get(group[i], key), key)
    return set(first.values())


def test_shingles_equal_brute_force():
    texts = ["", None, "One", "a b c d", "a b c d e", "A b c d e f\n g", " lead and trail ", "a b c d"]
    found, at = shingles([None if t is None else t.encode() for t in texts])
    got = [found[s:e].tolist() for s, e in zip(at, at[1:])]
    for i, j in combinations(range(len(texts)), 2):
        assert (set(got[i]) == set(got[j])) == (brute_set(texts[i]) == brute_set(texts[j])), (i, j)
    assert [len(set(g)) for g in got] == [len(brute_set(t)) for t in texts]


def test_planted_near_copies_go(spark):
    """Copies with a few words changed, far above two bits of a fingerprint."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.randint(60, 300))]
        rows.append((i, " ".join(words)))
        for copy in range(1, 3):
            other = list(words)
            for at in rng.sample(range(len(other)), max(1, len(other) * copy // 75)):
                other[at] = word()
            rows.append((1000 * copy + i, " ".join(other)))
    want = brute_kept(rows)
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    assert want <= got and len(want) < 300
    # A pair of exactly 0.8 is found with probability 0.999.
    assert len(got) - len(want) <= 1


def test_the_stage_checks_what_fingerprints_put_together(spark, monkeypatch):
    """With bands that find next to nothing, operator 8 still brings near copies together; its unlike pairs stay."""
    words = [f"word{i}" for i in range(900)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, "x " * 400 + "a b c d e f"), (4, "x " * 400 + "a c e b d f g")]
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows], SCHEMA)
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert component == {1: 1, 2: 1, 3: 3, 4: 3} and brute_kept(rows) == {1, 3, 4}
    monkeypatch.setattr(near_sets, "bands_for", lambda *_: 1)
    plain, whole = near_sets.keep_first, {"band_rows": 2000}
    assert {r.doc_id for r in plain(frame, **whole).collect()} == {1, 2, 3, 4}
    monkeypatch.setattr(near_sets, "keep_first", lambda docs, **more: plain(docs, **whole, **more))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()} == {1, 3, 4}


def test_kept_rows_of_real_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_kept(rows)
    assert {r.doc_id for r in near_sets.keep_first(docs).collect()} == want and len(want) < len(rows)


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", 1), (1, "other words stand in here now", 2), (1, "A B C D E F", 1), (1, "a b c d e f", 1), (2, "other words stand in here now", 3), (3, None, 4), (4, " ", 5), (None, "a b c d e f", 6), (None, "alone with no key", 7)]
    got = near_sets.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "n"]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n) for r in got.collect()) == [(False, 1, 1), (False, 1, 2), (False, 3, 4), (True, 0, 7)]
    assert near_sets.keep_first(spark.createDataFrame([], SCHEMA)).collect() == []


def test_members_far_from_their_centre_meet_each_other(spark):
    """Nodes 2 and 3 are similar to each other and not to the centre of their only band."""
    sets = [(1, list(range(100, 110))), (2, list(range(10))), (3, list(range(9)))]
    star = spark.createDataFrame([(7, 2, 1), (7, 3, 1)], "band long, h long, centre long")
    found = linked(star, spark.createDataFrame(sets, "h long, items array<long>"), 0.8).collect()
    assert [tuple(r) for r in found] == [(2, 3)]


def brute_roots(sets, similarity):
    group = {h: h for h, _ in sets}
    for (i, a), (j, b) in combinations(sets, 2):
        if jaccard(set(a), set(b)) >= similarity:
            low, high = sorted((group[i], group[j]))
            group = {h: low if g == high else g for h, g in group.items()}
    return group


def test_links_of_large_and_unlike_bands_equal_brute_force(spark, monkeypatch):
    """One band of near copies around 0.8, unlike sets and stragglers, in blocks far smaller than the band."""
    monkeypatch.setattr(near_sets, "BLOCK_ITEMS", 500)
    monkeypatch.setattr(near_sets, "COLUMNS", 64)
    rng = random.Random(4)
    base, sets = rng.sample(range(1 << 40), 60), []
    for h in range(1, 160):
        items = set(base if h % 4 else rng.sample(range(1 << 40), 60))
        for old in rng.sample(sorted(items), rng.randint(0, 9)):
            items.remove(old)
            items.add(rng.randrange(1 << 40))
        sets.append((h, sorted(items)))
    sets += [(900, sorted(rng.sample(base, 49))), (901, sets[3][1][:50])]
    star = spark.createDataFrame([(5, h, 1) for h, _ in sets[1:]] + [(6, h, 4) for h in (8, 12, 900)], "band long, h long, centre long")
    links = linked(star, spark.createDataFrame(sets, "h long, items array<long>"), 0.8)
    group = {h: h for h, _ in sets}
    for r in links.collect():
        low, high = sorted((group[r.src], group[r.dst]))
        group = {h: low if g == high else g for h, g in group.items()}
        assert jaccard(set(dict(sets)[r.src]), set(dict(sets)[r.dst])) >= 0.8
    assert group == brute_roots(sets, 0.8)
