"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloop.llm import (
    ego_join,
    lines,
    mixing,
    packing,
    paragraphs,
    pii,
    quality,
    resampling,
    simhash,
    token_files,
    topk,
    urls,
    whitening,
)
from scoreloop.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents"))


def op2_boosted_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op3_norm_sorted_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter("vec_id % 100 = 0"), k=10, scale=1024)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=1, capacity=4096, keep_ids=False)


def op5_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_quality_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]
# Hosts that name what they sell; for URLs that no rule fits.
BLOCK_GLOBS = ["%spam-farm%", "%cheap-pills%", "%casino%", "%spam-farm%/*", "%cheap-pills%/*", "%casino%/*"]


def op7_url_shift_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, BLOCK_GLOBS).drop("url")


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.read_documents(token_files.write_files(docs, public_tokenizers.path(TOKENIZER), end_id=2))


def op11_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)
    # The exact sums grow with the square of the rows; beyond a long only the decimal column has them.
    return found.withColumn("deviation_exact", F.col("deviation")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.digest(docs, lines.keep_bitmaps(docs, min_docs=10))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_paragraph_minhash,
        op2_boosted_pii_spans,
        op3_norm_sorted_top_k,
        op4_best_fit_packing,
        op5_pivotal_mixing,
        op6_quality_boosted_trees,
        op7_url_shift_and,
        op8_simhash_golay,
        op9_epsilon_grid_join,
        op10_token_files,
        op11_segment_resampling,
        op12_chebyshev_whitening,
        op13_line_bitmaps,
    )
}
