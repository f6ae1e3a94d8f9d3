"""From raw documents to a mixed training corpus: stages that each call one operator.

Every stage gets the rows its predecessor kept and returns rows with the columns of
``documents``; the last adds where each document stands in the mixture. What a stage
returns is written as Parquet in the shared folder and read again, so a lost executor
costs at most the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filegrain.llm.common import written
from filegrain.llm.decontaminate import without_contaminated
from filegrain.llm.langid import with_known_language
from filegrain.llm.mixing import mixed
from filegrain.llm.neardup import LINK_PERCENT, one_of_each
from filegrain.llm.registry import table
from filegrain.llm.toxicity import without_toxic


#: Similarity on shingles of five words. tests/llm/test_methods.py holds the stage to op3's threshold.
NEAR_PERCENT = LINK_PERCENT


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go."""
    return with_known_language(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score as toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; from ``NEAR_PERCENT`` on they are near."""
    return one_of_each(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in an order that follows the sources' target weights."""
    return mixed(docs)


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
]
#: Trained models and the schedule have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
