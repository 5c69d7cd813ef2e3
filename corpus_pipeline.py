"""Cleaning and packing a corpus: five stages, each a call of one corpus operator.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet and rereads it as
the next stage's input. All stages but the last keep the columns of ``documents``, and any others, whatever their names.

Null texts count as empty; empty texts are scored by the models' biases, are copies of each other for the third stage and linked with nothing in
the fourth. Of copies and of linked texts the smallest doc_id stays, of repeated rows the first; null ids stay only where a group has no other.
Texts of any length are read whole. Empty tables give empty results. Without labels of both kinds the classifiers score by their biases alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from athenor.functions.storage import materialize, table
from athenor.llm import exact_dedup, near_dedup, packing, quality, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is 0.5 or more go; the model is fit on labelled rows of this stage's input."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the row with the smallest doc_id stays."""
    return near_dedup.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of what is left."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Both classifiers are trained models, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
