"""A corpus pipeline of five stages over ``documents``; each is written as Parquet and reread.

toxicity        documents that the classifier rejects go
exact_dedup     of equal texts, the document with the smallest id stays
near_dedup      of each group of linked documents, the one with the smallest id stays
mix             each document appears as often as the mix takes it, rounded to whole documents
encode          one row a document: its number of tokens and digests of the ids and the decoded text

A document that the mix takes less than half of is left out; documents without words are not in it.
Stages judge rows: rows that repeat an id, or have none, stand for themselves.  The intermediate tables of
a stage are deleted when it is written.  Labels are read from ``labels`` beside the table; those of held-out documents are not learned.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.llm import bpe, exactdedup, mixing, neardup, toxicity
from nearpath.llm.common import documents, labels, noted, shared_dir, sweep

#: No SQL expresses a trained network or the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, labels(spark, sf_dir))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    base = f"{shared_dir(spark)}/nearpath/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        before = len(noted(spark))
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        sweep(spark, before)
    return docs
