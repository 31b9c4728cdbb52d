"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of `documents` for the rows that it keeps:

1. toxicity: documents scored 0.5 or more by their nearest labelled examples, themselves left out, go;
2. exact dedup: of texts equal but for A-Z and a-z, the row with the largest doc_id stays;
3. near dedup: of each class of near-duplicates, the row with the smallest doc_id stays;
4. packing: a row per piece, with its sequence and offset.

Defined results: null text counts as empty; all empty texts are copies of each other, so one of them is packed. A row without
a doc_id is judged by its text like any other and loses to rows with one; of rows of the same id and text one stays.
Without usable labels nothing is toxic; with labels of one class only, their rate (0 or 1) is every score. Texts may be of
any length, and extra columns are passed on by every stage but the last. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalsieve.llm import exact_dedup, minhash, packing, toxicity
from evalsieve.llm.common import written
from evalsieve.llm.entry import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_distinct(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: SQL has no nearest examples, no MinHash and no tokenizer; tests/llm holds every stage against what it must keep, by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
