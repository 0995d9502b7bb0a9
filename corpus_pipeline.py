"""From raw documents to packed training windows: five stages, each written as Parquet and read again.

All but the last return the columns of documents, whatever further ones there are. Rows with null ids or
texts, empty and very long texts, repeated rows and empty tables go through each stage as its own
function tells; what the stages do with them is said there.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.lineage import discard
from recollect.llm import minhash, packing, pii, quality, substring
from recollect.llm.textkit import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labelled ones among all documents, accepts.

    Null, empty and blank texts go, repeated rows are judged each on its own; without labels of both
    classes nothing but these goes. An empty table stays empty.
    """
    everything = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), training=everything)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and one row of repeated ones; null, empty and wordless texts stay."""
    return minhash.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that occurred before; all rows stay, null and empty texts as they are."""
    return substring.without_repeats(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; all rows stay, null and empty texts as they are."""
    return pii.redacted(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training windows; a row with null window for a text without words."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [("quality", good), ("near_dedup", distinct), ("substring_dedup", unrepeated), ("pii", private), ("packing", windows)]

#: Hinge-loss fits, MinHash and packing can't be told in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of sf_dir. The tables between them are in the shared folder; each goes once the next is written, but for the last, which the result reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            discard(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
