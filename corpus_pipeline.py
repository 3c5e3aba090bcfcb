"""Cleaning pipeline over documents: language, lines, near copies, benchmark leaks, source mix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plotweave.llm import language, lines, mixing, near, templates
from plotweave.session import scratch_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the classifier learns from these documents."""
    return language.reject_unknown(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines."""
    return lines.line_dedup(docs)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return templates.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; ``copy`` numbers the repeats from 0."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_copies", dedup_near_copies),
    ("leaks", drop_leaks),
    ("mix", mix_sources),
]

#: SQL cannot express the trained classifier of the first stage nor the hashes of the third.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each is written as Parquet in the shared folder and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
