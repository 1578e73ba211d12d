"""Cleaning and mixing a corpus: the stages one after the other, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelight.llm import contamination, languages, lines, mixing, shinglejoin
from sievelight.llm.common import remainder, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told; the models learn from two thirds of the labelled ones."""
    return languages.identified(docs, docs.filter(remainder("doc_id", 3) != 1))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that stand on more than `lines.RATIO` of their source's documents; n_chars follows.

    A text of which nothing would be left stays whole: it stands there in copies, which the next stage settles.
    """
    clean = lines.drop_boilerplate(docs.withColumn("_whole", F.col("text")))
    empty = (F.col("n_dropped") > 0) & (F.btrim("text", F.lit(" \t\r\n")) == "")
    clean = clean.withColumn("text", F.when(empty, F.col("_whole")).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return shinglejoin.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that a test item makes up a twentieth of."""
    return contamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("language id", identify_language),
    ("line dedup", drop_boilerplate),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: The stages hold trained and iterative steps that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
