import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoreloop.llm import packing, token_files
from scoreloop.llm.encode import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t ", "Hello, World's end! it's 12345", "ÀÉÎ ﬁ Σίσυφος ΟΔΟΣ", "a b c\x1fd\x85e", "<|endoftext|> x<|startoftext|>y",
    "é e ́ x", "x" * 5000, "'s 't's''ll", "日本語 テキスト 🎉🎉", "word " * 3000, "﻿bom ​zero", "ŉ İstanbul ẞ",
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(spark, sf_small, plain):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect()]
    encode = Encoder(PATH)
    for text in texts:
        assert encode.one(None if text is None else text.encode()).tolist() == plain(text), text[:80]


def test_encoder_memory_starts_afresh(monkeypatch, plain):
    monkeypatch.setattr("scoreloop.llm.encode.MEMORY", 5)
    encode = Encoder(PATH)
    for text in ("one two three four", "five six seven one", "a b c d e f g h i j k"):
        assert encode.one(text.encode()).tolist() == plain(text)


@pytest.mark.parametrize("seed", range(8))
def test_plan_fills_every_rank_once_and_overlaps_nowhere(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 512])
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, capacity + 1), min(capacity, 30))}
    room, ranks = defaultdict(set), defaultdict(list)
    for length, a, b, seq, per, base in packing.plan(counts, capacity):
        ranks[length].append((a, b))
        for r in range(a, b):
            at = base + (r - a) % per * length
            cells = set(range(at, at + length))
            where = room[seq + (r - a) // per]
            assert at + length <= capacity and not where & cells
            where |= cells
    for length, n in counts.items():
        spans = sorted(ranks[length])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    assert all(cells == set(range(len(cells))) for cells in room.values())
    total = sum(k * n for k, n in counts.items())
    assert len(room) <= -(-total // capacity) * 11 / 9 + 2


def check_packed(rows, want, capacity):
    """rows: (doc_id, piece, start, length, crc, seq, offset); want: Counter of (doc_id, piece, start, length, crc)."""
    assert Counter(r[:5] for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r[5]].append((r[6], r[3]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("cell_rows", [3, 2000])
def test_packed_documents(spark, sf_small, plain, cell_rows):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, "again"), (7, "again")], "doc_id long, text string")
    docs = docs.union(extra).withColumns({"length": F.lit(1), "piece": F.lit("x"), "_cell": F.lit(0)})
    want = Counter()
    for r in docs.collect():
        ids = np.array(plain(r.text) + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[(r.doc_id, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    packed = packing.pack(docs, PATH, 1, capacity=512, cell_rows=cell_rows)
    rows = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in packed.collect()]
    n = check_packed(rows, want, 512)
    total = sum(k[3] * v for k, v in want.items())
    assert n <= total / 512 * 1.02 + 2
    made = packing.sequences(packed).collect()
    assert len(made) == n and sum(len(r.ids) for r in made) == 4 * total


def test_empty_table_and_bad_lengths(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 1).collect() == []
    with pytest.raises(ValueError):
        packing.assign(spark.createDataFrame([(1, 9)], "k long, length long"), ["k"], 8)


@pytest.mark.parametrize("bits", [3, 8, 16])
def test_image_gives_any_token(bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 2 ** rng.integers(1, 32), n).astype(np.uint32) for n in (0, 1, 700, 64, 0, 3000, 129)]
    data = token_files.write_image(docs, bits)
    image = token_files.Image(data)
    flat = np.concatenate(docs)
    at = rng.permutation(len(flat))
    assert (image.tokens(at) == flat[at]).all()
    assert all((a == b).all() for a, b in zip(image.documents(), docs))


def test_small_ids_take_one_level():
    image = token_files.Image(token_files.write_image([np.arange(200)]))
    assert len(image.chunks) == 1 and image.tokens(np.array([199, 0])).tolist() == [199, 0]
    assert token_files.Image(token_files.write_image([])).n_ids == 0


@pytest.mark.parametrize("image_ids", [50, 2_000_000])
def test_token_files_round_trip(spark, sf_small, plain, image_ids):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, "again"), (7, "again")], "doc_id long, text string")
    docs = docs.union(extra).withColumn("part", F.lit("clash"))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for key, text in rows:
        ids = np.array(plain(text) + [2], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    files = token_files.write_files(docs, PATH, 2, image_ids=image_ids)
    assert sorted(map(tuple, token_files.read_documents(files).collect()), key=lambda r: r[1]) == want


def test_token_files_of_nothing(spark):
    files = token_files.write_files(spark.createDataFrame([], "doc_id long, text string"), PATH, 2)
    assert files.collect() == [] and token_files.read_documents(files).collect() == []
