"""A training corpus from raw documents: STAGES in order, each over all that the stage before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evistrata.llm import exact_dedup, mixing, ngram_join, pieces, quality
from evistrata.llm.shared import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels to learn from all stay."""
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that the five-word Jaccard links of 0.8 or more connect, the row with the smallest doc_id."""
    return ngram_join.one_of_each_group(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.draw_mix(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a sampled segmentation of each text."""
    return pieces.encode(docs, pieces.read_model(pieces.DEFAULT_MODEL))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_equal_texts),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pieces", to_pieces),
]

#: The stages learn a model and draw samples, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
