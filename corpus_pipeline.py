"""The corpus pipeline: language, quality, near-duplicates, contamination, tokens.

Each stage works on all that the one before it kept. The first four return
rows of ``documents`` as they are; the last returns digests of the tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm import byte_bpe, decontaminate, language_id, quality, simhash
from ruleloom.llm._common import remove, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; those without a letter, and those whose
    language is told with a score under 0.5, go."""
    return language_id.keep_identified(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return simhash.deduplicate(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's tokens and of the decoded bytes."""
    out = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontamination", clean_of_benchmark),
    ("byte_bpe", tokens),
]

#: Documents that are handed to a Python worker at once.
BATCH = 1000
#: SQL can express neither the classifiers nor the fingerprints' hash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each one's result is written to the
    shared folder and read again, and goes when the next one's is there.

    Null and empty texts have no letter and go at the first stage. Null and
    repeated ids are kept apart by their texts; of rows with equal id and text
    one stays. Other columns pass through whatever their names. A classifier
    that has nothing to learn from keeps all rows; an empty table gives an
    empty result.
    """
    # whole documents go through Python workers: few at once, on both sides
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
            if before is not None:
                remove(before)
            before = docs
    return docs
