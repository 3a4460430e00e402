"""A training corpus from documents: five stages, each written as Parquet before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tripleframe.llm.common import WRITTEN, remove, tidy
from tripleframe.llm.decontam import drop_contaminated
from tripleframe.llm.lines import drop_repeated_lines
from tripleframe.llm.mixing import OTHERS, TARGETS, mix_sources
from tripleframe.llm.quality import drop_rejected
from tripleframe.llm.simhash import drop_near_duplicates
from tripleframe.runtime import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # lines of fewer occurrences are left: without them near copies would be torn apart before the next stage compares them
    return drop_repeated_lines(docs, min_count=10)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, TARGETS, OTHERS)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix)]

#: None: logistic regression, SimHash, banded alignment and the tokenizer are beyond SQL; tests hold run() to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Stages are written under the shared folder, each reread as the next one's documents; a
    stage's own intermediate tables and its input are removed once it is written, the result stays.

    Null texts, null ids and rows given twice pass the filters as the operators say, and mixing leaves null texts out. An
    empty table of documents gives no rows, without labels nothing is rejected, without benchmark nothing is
    contaminated. Other columns than those of documents are kept up to mixing, which drops them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        since = len(WRITTEN)
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        tidy(spark, since)
        if before:
            remove(spark, before)
        before = f"{at}/{name}"
    return docs
