"""A training-data pipeline over ``documents``: quality, exact copies, near copies, personal data, packing.

Each stage gets what the stage before has kept, written as Parquet and read again, and returns a DataFrame; all but the
last return the columns of ``documents``. The written tables lie under the checkpoint folder of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from classtilt.llm import exact_dedup, near_copies, packing, quality_rules, surrogates
from classtilt.llm.common import table
from classtilt.llm.queries import tokenizer_path
from classtilt.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def close_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(docs, surrogates.surrogate_key(spark), count_col=None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", close_copies),
    ("pii_surrogates", personal_data),
    ("packing", packed),
]

ORACLE_SQL = None  # SQL has neither the sketches of stage 3 nor the token ids of stage 5


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Every stage's result is written below the shared checkpoint folder, under a new name per run."""

    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
