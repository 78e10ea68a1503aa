import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloop.llm import paragraphs
from scoreloop.llm.paragraphs import Cut

SCHEMA = "doc_id long, text string"


def prose(rng, sentences):
    return " ".join(
        " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(rng.randint(6, 16))).capitalize() + "." for _ in range(sentences)
    )


def brute_cut(text):
    """(start, words) of each paragraph without cuts inside pieces of over 36 words."""
    words, ends = [], []
    for line in (text or "").lower().split("\n"):
        own = line.split()
        for k, w in enumerate(own):
            words.append(w)
            ends.append("soft" if k == len(own) - 1 or w[-1] in ".!?" else "")
    if ends:
        ends[-1] = "hard"
    out, start, sentence = [], 0, 0
    for i, e in enumerate(ends):
        if e:
            if e == "hard" or i + 1 - sentence >= 5:
                out.append((start, i + 1 - start))
                start = i + 1
            sentence = i + 1
    return out


def test_cuts_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n ", "one", "a b c d e. f g.", "a.\n\n b c d e f", prose(rng, 9), "X y z. " * 5, "last line has no stop\n" * 3]
    c = Cut([None if t is None else t.encode() for t in texts])
    got = [[(s, w) for d, s, w in zip(c.doc, c.start, c.words) if d == i] for i in range(len(texts))]
    assert got == [brute_cut(t) for t in texts]


def test_digest_depends_on_the_paragraph_alone():
    rng = random.Random(2)
    passage = prose(rng, 3)
    a, b = Cut([(prose(rng, 4) + " " + passage).encode()]), Cut([b"x", (passage + "\n" + prose(rng, 2)).encode()])
    assert len(set(a.digest.tolist()) & set(b.digest.tolist())) == 3
    assert Cut([b""]).digest.tolist() == []


def test_minima_estimate_jaccard():
    rng = random.Random(3)
    words = prose(rng, 30).replace(".", "").split()
    a, b = words[:200], words[10:210]
    c = Cut([" ".join(a).encode(), " ".join(b).encode()])
    # Long sentences are cut by hash; compare the sets over whole texts.
    sets = [set(c.shingles[(np.repeat(c.doc, c.words) == d) & (c.shingles != 2**64 - 1)].tolist()) for d in (0, 1)]
    assert len(sets[0] & sets[1]) > 60
    assert all(len(c.minima(k)) == len(c.words) for k in range(3))


def test_bands_reach_the_recall():
    for rows in (1, 2, 4):
        b = paragraphs.bands_for(0.8, 0.99, rows)
        assert 1 - (1 - 0.8**rows) ** b >= 0.99 > 1 - (1 - 0.8**rows) ** (b - 1)


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(3, 20))) for i in range(300)]
    planted = {}
    for k in range(12):
        passage = prose(rng, 7)
        owners = rng.sample(range(300), rng.choice([2, 3, 20]))
        for i in owners:
            text = rows[i][1].split(" ")
            at = rng.randint(0, len(text))
            rows[i] = (i, " ".join(text[:at] + [passage] + text[at:]))
            planted.setdefault(i, set()).add(min(owners))
    line = "This common line stands in every one of them."
    rows = [(i, t + "\n" + line if i % 3 else t) for i, t in rows]
    got = paragraphs.repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == set(planted)
    assert {r.doc_id for r in got if r.removed} == {i for i, first in planted.items() if min(first) < i}


def test_near_equal_paragraphs_are_clustered(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        words = [w.replace(".", "") for w in prose(rng, 4).split(" ")][:46]
        rows.append((i, " ".join(words) + "."))
        rows.append((100 + i, " ".join(["Zzz", *words[1:]]) + "."))
    found = paragraphs.repeats(spark.createDataFrame(rows, SCHEMA), recall=0.9999).collect()
    assert sum(r.removed and r.first_id == r.doc_id - 100 for r in found) >= 38


def test_odd_rows(spark):
    text = "A sentence of some words that stands here. And one more sentence that goes on for a while. Then the last one which also has its words."
    rows = [(5, text), (5, text), (None, text), (6, None), (7, ""), (8, text.upper()), (9, "w " * 50_000), (9, text), (10, "same words here now too. " * 30)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("h", "start", "words", "band", "key")})
    got = sorted(tuple(r) for r in paragraphs.repeats(frame).collect())
    n = len(text.split())
    assert sorted(set(got)) == [(5, 0, n, 5, False), (8, 0, n, 5, True), (9, 0, n, 5, True)]
    assert paragraphs.repeats(frame.limit(0)).collect() == []


def test_every_repeated_paragraph_keeps_one_copy(spark):
    rng = random.Random(6)
    p1, p2, p3 = (" ".join(w.strip(".") for w in prose(rng, 9).split(" ")[:30]) + "." for _ in range(3))
    rows = [(1, p2), (5, p1 + " " + p2 + " " + p3), (9, p1), (10, p3)]
    got = sorted(tuple(r) for r in paragraphs.repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [
        (1, 0, 30, 1, False), (5, 0, 30, 5, False), (5, 30, 30, 1, True), (5, 60, 30, 5, False), (9, 0, 30, 5, True), (10, 0, 30, 5, True)
    ]


def test_length_is_tested_on_the_joined_stretch(spark):
    rng = random.Random(7)
    p1, p2 = (" ".join(w.strip(".") for w in prose(rng, 9).split(" ")[:14]) + "." for _ in range(2))
    rows = [(1, p2), (5, p1 + " " + p2), (9, p1 + " " + p2)]
    got = sorted(tuple(r) for r in paragraphs.repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(5, 0, 14, 5, False), (5, 14, 14, 1, True), (9, 0, 28, 1, True)]


def test_similar_members_meet_although_their_centre_is_another(spark):
    """Many unlike paragraphs hold one common phrase: their bands' centres are mostly none of a pair."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    phrase, rows = " ".join(word() for _ in range(22)), []
    for i in range(300):
        tail = [word() for _ in range(14)]
        rows += [(i, f"{phrase} {' '.join(tail)}."), (1000 + i, f"{phrase} {' '.join([*tail[:-1], word()])}.")]
    found = paragraphs.repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.doc_id for r in found if r.removed and r.first_id == r.doc_id - 1000}
    assert len(got) >= 297


def test_cuts_of_a_text_do_not_depend_on_its_batch():
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["ab", "cd", "ef", "gh", "ij", "kl"], k=rng.choice([1, 3, 30, 400]))).encode() for _ in range(40)]
    together = Cut(texts)
    alone = [Cut([t]) for t in texts]
    assert together.digest.tolist() == [d for c in alone for d in c.digest.tolist()]
    # Long texts without stops or lines are cut too, and short lines one after another.
    assert max(together.words) < 200 and len(Cut([b"a b c\nd e f\n" + b"\n".join(b"w%d x%d" % (i, i) for i in range(200))]).words) > 5


def test_bands_are_dealt_out_by_themselves(spark, monkeypatch):
    """Nothing but bands and digests goes through the widest shuffle."""
    plans, write = {}, paragraphs.stored

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(paragraphs, "stored", watched)
    rng = random.Random(9)
    paragraphs.repeats(spark.createDataFrame([(i, prose(rng, 3)) for i in range(20)], SCHEMA))
    before, _, sent = plans["star"].partition("Exchange hashpartitioning(band")
    assert "Window" in before and "Exchange" not in before
    assert "MapInArrow" in sent and "xxhash64" not in sent


def test_paragraphs_left_out_of_bands_are_similar_to_no_other():
    rng = random.Random(10)
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    cut = lambda w, s: Cut([" ".join(w).encode()]).matchable(s).tolist()
    assert cut("a b c d".split(), 0.8) == [False] and cut("a b c d e f g".split(), 0.8) == [False]
    # Eight words have four shingles of the five of nine; what repeats a word may stand in another order.
    assert cut("a b c d e f g h".split(), 0.8) == [True] and cut("a b c d e f g h".split(), 0.81) == [False]
    assert cut("a a a a a".split(), 0.8) == cut("a b a b a b".split(), 1.0) == [True]
    checked = 0
    for _ in range(6000):
        s = rng.choice([0.5, 0.7, 0.8, 0.9, 1.0])
        one = rng.sample("abcdefghijkl", k=rng.randint(5, 11)) if rng.random() < 0.5 else rng.choices("abc", k=rng.randint(5, 9))
        two = list(one)
        for _ in range(rng.randint(1, 2)):
            at = rng.randint(0, len(two))
            two[at : at + rng.randint(0, 1)] = rng.choices("abcdefghijklm", k=rng.randint(0, 2))
        if rng.random() < 0.3:
            two = one + one[: rng.randint(1, 3)]
        if len(two) < 5 or one == two:
            continue
        a, b = sets(one), sets(two)
        if len(a & b) >= s * len(a | b):
            assert cut(one, s) == cut(two, s) == [True]
            checked += 1
    assert checked > 300
    # In one batch each paragraph is judged by its own words.
    c = Cut([b"a b c d e", b"a b c d e", b"p q p q p", b"a b c d e f g h i"])
    assert c.matchable(0.8).tolist() == [False, False, True, True]


def test_recall_of_repeated_windows(spark, sf_small):
    """Against every 51-word window that two documents share: stretches half covered, and words."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: [w for w in (r.text or "").lower().split()] for r in docs.collect()}
    where = {}
    for doc, own in words.items():
        for at in range(len(own) - 50):
            where.setdefault(tuple(own[at : at + 51]), set()).add(doc)
    repeated = {doc: set() for doc in words}
    for doc, own in words.items():
        for at in range(len(own) - 50):
            if len(where[tuple(own[at : at + 51])]) > 1:
                repeated[doc].update(range(at, at + 51))
    covered = {doc: set() for doc in words}
    for r in paragraphs.repeats(docs).collect():
        covered[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    stretches = []
    for doc, at in repeated.items():
        for w in sorted(at):
            if w - 1 in at:
                stretches[-1].append((doc, w))
            else:
                stretches.append([(doc, w)])
    shares = [sum(w in covered[doc] for doc, w in s) / len(s) for s in stretches]
    assert stretches and sum(s >= 0.5 for s in shares) / len(shares) >= 0.9
    assert sum(w in covered[doc] for s in stretches for doc, w in s) / sum(map(len, stretches)) >= 0.9
