"""The corpus pipeline: quality classifier, language identification, line and near deduplication, packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise import prepare
from gradewise.llm import langid, quality
from gradewise.llm.line_dedup import dedup_lines
from gradewise.llm.minhash_dedup import near_duplicates
from gradewise.llm.packing import pack
from gradewise.llm.store import materialize

#: SQL cannot express the fitted classifiers; tests hold each stage against a plain version.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below its acceptance go; the rest pass unchanged."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    return quality.accepted(docs, model)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go; the rest pass unchanged."""
    prepare(spark)
    return langid.accepted(docs, langid.fit(docs))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that occurred before go from the texts; ``n_chars`` follows. Every document stays."""
    prepare(spark)
    return dedup_lines(docs).select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    prepare(spark)
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in training sequences."""
    prepare(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_filter),
    ("language", language_filter),
    ("lines", line_filter),
    ("near_duplicates", near_duplicate_filter),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
