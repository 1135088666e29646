"""The registered queries of the training-data operators, and their DuckDB statements."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (bisector, decontaminate, language_id, lattice_lm, line_dedup, mixing, near_dedup, nearest, periodic_runs, sharding,
                          suffix_dedup, token_counts, url_filter)
from tillroll.llm.common import crc32_mod, ship
from tillroll.llm.oracles import LLM_ORACLES  # noqa: F401
from tillroll.sources.parquet import read_table


def op1_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.shared_spans(docs, read_table(spark, sf_dir, "benchmark"), window=10)
    return marked.select("doc_id", "n_words", decontaminate.covered_words("hits").alias("n_hit"), "items").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The rules of the URL filter: host and path, and verdict.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.col("score").alias("block_score"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), threshold=0.8)
    return found.select("doc_id", "class_id", "class_size")


def op5_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                                      folds=5, held_out_fold=1)


def op6_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), min_docs=3, min_chars=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = token_counts.token_count("text", public_tokenizers.path("word_bpe_49k.json"))
    return (read_table(spark, sf_dir, "documents")
            .select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                    count.alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > 2048))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc32_mod("doc_id", 4) == 2).alias("held_out"))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return docs.select("doc_id", "held_out", language_id.language(model, "text", spark).alias("guess")).select(
        "doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


def op11_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), length=400)
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def looped_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in the texts of every tenth checksum.

    With h the CRC-32 of doc_id, g = floor(h / 10) and n words: if h is a
    multiple of 10 and n > 0, each word i >= a becomes word a + (i - a) % p,
    where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.withColumn("_h", h).withColumn(
        "_w", F.when(F.col("_h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    rows = rows.withColumn("_g", F.floor(F.col("_h") / 10)).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")),
                                    F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    looped = F.array_join(F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), F.lit(1), F.col("_n")), " ")
    return rows.withColumn("text", F.when(F.col("_a").isNotNull(), looped).otherwise(F.col("text"))).drop("_h", "_w", "_g", "_n", "_a", "_p")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = looped_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find_runs(docs, min_exponent=4, min_length=6)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    top = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
        top["period"].alias("period"), F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"), "n_words")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector.cluster_vectors(read_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


def _registered(f):
    @functools.wraps(f)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query


LLM_QUERIES = {f.__name__: _registered(f) for f in (
    op1_shard_by_bytes, op2_decontaminate, op3_url_filter, op4_near_duplicates, op5_lattice_scores, op6_dedup_lines,
    op7_token_counts, op8_nearest, op9_mix_sources, op10_language, op11_remove_repeats, op12_periodic_runs, op13_centroids)}
