from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from scoreloop.llm import mixing, pii, quality
from scoreloop.llm.common import stored
from tests.llm.test_near_sets import brute_kept
from tests.llm.test_pii import brute as brute_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def keyed(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "pii_redaction", "source_mixing", "best_fit_packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_rows(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.classify(stages[0], labels).filter("predicted = 1").collect()}
    assert set(keyed(stages[1])) == good and len(good) < stages[0].count()


def test_near_dedup_rows(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = brute_kept(rows)
    assert set(keyed(stages[2])) == want and len(want) < len(rows)


def test_redacted_rows(stages):
    before, after = keyed(stages[2]), keyed(stages[3])
    assert set(before) == set(after)
    for key, old in before.items():
        new, spans = after[key], brute_spans(old.text)
        assert new.n_chars == len(new.text)
        if spans:
            assert all(old.text[s:e] not in new.text for s, _, e in spans)
            assert any(f"[{k.upper()}]" in new.text for k in pii.KINDS)
        if not any(c.isdigit() or c == "@" for c in old.text):
            assert new == old


def test_mixed_rows(stages):
    want = {r.doc_id: r.copies for r in mixing.copies(stages[3]).collect()}
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter({k: v for k, v in want.items() if v})


def test_packed_rows(spark, stages):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding(), t.no_truncation()
    texts, packed = Counter((r.doc_id, r.text) for r in stages[4].collect()), stages[5].collect()
    want = Counter()
    for (key, text), n in texts.items():
        want[key] += n * (len(t.encode(text, add_special_tokens=False).ids) + 1)
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= sum(want.values()) / 4096 * 1.02 + 2


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, stages[5].collect()))
