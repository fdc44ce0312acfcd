"""A corpus pipeline of five training-data operators: each stage works on all documents that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, langid, packing, substring
from tidemark.llm.common import stage
from tidemark.llm.queries import WORD_BPE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, texts without a letter, and those that parse no better than character
    by character. Repeated rows are judged alike; null ids stay; other columns are not read, but for `lang` in training."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of smallest doc_id. Of rows alike in doc_id and text one
    stays; texts without words and rows without an id are in no group and stay."""
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document of smaller id has are cut out, and documents of which nothing is left go.
    Rows with one id don't cut each other; rows without an id neither cut nor are cut; null texts stay."""
    return substring.strip_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their id. Null texts and rows without an id match nothing
    and stay; items without a text are not looked for. An empty benchmark takes nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 4096 tokens. Every row is packed, repeated ones and those without an id
    too; a null text is one end id. The order of ties (length, id, piece) is fixed within a partition."""
    return packing.pack(docs, WORD_BPE, end_id=1, capacity=4096)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("leaks", drop_leaks),
    ("packing", pack),
]

#: Language models and tokenizers are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; what a stage returns is written and reread before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
