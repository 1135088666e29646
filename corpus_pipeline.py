"""From raw documents to balanced training shards: five stages, each over all that the stage before it kept.

language    drops documents whose language can't be told
near_dedup  keeps one document of every class of near duplicates
decontam    drops documents that share ten words in a row with a benchmark item
mix         takes each document 0, 1 or 2 times, so that the sources reach their target words
shard       adds shard and slot: 24 contiguous shards of about equal bytes

Defined cases. Null text: rejected by ``language``, as is a text without a letter, so later stages
see none in a run; taken alone, ``near_dedup`` keeps documents with null text (repeated ids once),
``decontam`` keeps them, ``mix`` takes them once at size 0 and ``shard`` counts 8 bytes. Null ids: rows of their own in
every stage; null sources are one source, null lang is not learnt from. Very long texts are read whole, in blocks.
Ties: the larger probability's first language in code point order; of a class of near duplicates the smallest id, then the
smallest MD5, stays; mix and shard order equal sizes and equal texts by id. Repeated rows: ``near_dedup`` keeps one of them; the other stages treat each as a document. An
empty table goes through all stages and gives an empty result with all columns. Other columns are passed on
whatever their names; input columns called ``shard`` or ``slot`` are replaced by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import decontaminate, language_id, mixing, near_dedup, sharding
from tillroll.llm.common import ship, stored
from tillroll.sources.parquet import read_table

SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.keep_first(docs, threshold=0.8)


def decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.take(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return sharding.attach_shards(docs, SHARDS)


STAGES = [("language", language), ("near_dedup", near_duplicates), ("decontam", decontam), ("mix", mix), ("shard", shard)]

#: SQL can't express the trained and the sampled stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written as Parquet and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
