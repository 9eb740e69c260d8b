"""Registered queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    bbit_minhash, compression_quality, fingerprints, jaccard_join, licenses, mixing, packing,
    periodic_runs, quality_rules, sharding, spelling_variants, substring_dedup, toxicity,
)
from faultline.llm.shipping import ready

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return build(spark, sf_dir)

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query(sql=licenses.SQL)
def op1_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


@query()
def op2_threshold_fingerprints(spark, sf_dir):
    return fingerprints.with_neighbours(documents(spark, sf_dir))


@query()
def op3_toxicity_segments(spark, sf_dir):
    rows = toxicity.scores(documents(spark, sf_dir), labels(spark, sf_dir))
    return rows.select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "n_passages",
    )


@query(sql=jaccard_join.SQL)
def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_groups(documents(spark, sf_dir))


@query()
def op5_compression_quality(spark, sf_dir):
    rows = compression_quality.scores(documents(spark, sf_dir), labels(spark, sf_dir))
    return rows.select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query(sql=substring_dedup.SQL)
def op6_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_digests(documents(spark, sf_dir))


@query()
def op7_retrieval_packing(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pieces(documents(spark, sf_dir), path)


@query()
def op8_interleaved_shards(spark, sf_dir):
    rows = sharding.interleaved(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


@query()
def op9_quality_rules(spark, sf_dir):
    rows = quality_rules.judged(documents(spark, sf_dir), labels(spark, sf_dir))
    return rows.drop("key")


@query(sql=mixing.SQL)
def op10_mix(spark, sf_dir):
    rows = mixing.copies(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("copies") * F.col("size")).alias("taken"),
    )


@query(sql=spelling_variants.SQL)
def op11_spelling_variants(spark, sf_dir):
    words = spelling_variants.with_slips(documents(spark, sf_dir), 7)
    return spelling_variants.variant_groups(words)


@query(sql=bbit_minhash.SQL)
def op12_bbit_minhash(spark, sf_dir):
    return bbit_minhash.minhash_groups(documents(spark, sf_dir))


@query(sql=periodic_runs.SQL)
def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.run_digests(documents(spark, sf_dir))
