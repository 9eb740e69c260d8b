"""A corpus from raw documents: rules, near copies, repeated passages, mixture, windows.

Every stage takes (spark, docs, sf_dir), reads all rows that the stage before it kept, and returns the
columns of documents; the last returns the pieces of the packed windows.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from faultline.llm import jaccard_join, mixing, packing, quality_rules, substring_dedup
from faultline.llm.shipping import ready
from faultline.llm.tables import stored_alone


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    ready(spark)
    return quality_rules.keepers(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more stays."""
    ready(spark)
    return jaccard_join.one_of_each(docs, 5, 80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that occur earlier go; texts left empty go too."""
    ready(spark)
    return substring_dedup.without_repeats(docs, 20)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    ready(spark)
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2,048-token windows of lexically near documents."""
    ready(spark)
    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("source_mix", mix_sources),
    ("retrieval_packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored_alone(spark, partial(stage, spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL form: the tokenizer and the retrieval order have none. Stages are tested one by one.
ORACLE_SQL = None
