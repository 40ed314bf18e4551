"""A training-data pipeline: toxicity, quality, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of `documents`; the last returns the packed pieces.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from arcloom.llm import decontaminate, jaccard_join, packing, resampling, runtime, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    runtime.trim_executors(spark)
    return toxicity.clean(docs, toxicity.fit(docs, runtime.table(spark, sf_dir, "labels")))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance draw does not select go."""
    runtime.trim_executors(spark)
    return resampling.selected(docs, resampling.fit(docs, runtime.table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of the smallest id stays."""
    runtime.trim_executors(spark)
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    runtime.trim_executors(spark)
    return decontaminate.clean(docs, runtime.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as sequences of at most 2048 tokens."""
    runtime.trim_executors(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can express neither the network nor the packing; tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again."""
    docs = runtime.table(spark, sf_dir, "documents")
    shared = os.path.join(runtime.shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(at := f"{shared}/{k}-{name}")
            docs = spark.read.parquet(at)
    return docs
