"""From raw documents to token ids: five stages, each written and read again before the next.

1. toxicity: documents that score one half or more go;
2. near_duplicates: one document of each group at Jaccard 0.8 on five-word runs stays;
3. repeats: passages of 35 words or more that start elsewhere too are cut out;
4. benchmark: documents that hold a benchmark item go;
5. tokens: byte-level BPE ids, decoded again.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strideframe.llm.bytebpe import round_trip
from strideframe.llm.decontaminate import without_leaks
from strideframe.llm.minhash import one_of_each
from strideframe.llm.registry import table
from strideframe.llm.scratch import run_folder, settled
from strideframe.llm.substring import without_repeats
from strideframe.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, 80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("tokens", tokens)]
#: Learned scores and merges over iterations have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), run_folder(spark)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
