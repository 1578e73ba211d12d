"""One query for each operator of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import contamination, divergence, hardnegatives, languages, lines, mixing, neighbours, outliers, quality, shinglejoin, substrings, suffixtree, warc
from .common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by a suffix tree learned from those not held out; a null text is empty."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    return suffixtree.score(documents, suffixtree.learn(documents.filter(~F.col("held_out"))))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading language of every text, learned from labelled texts not held out; `und` where a text is null or has no letter."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder("doc_id", 3) == 1).alias("held_out"))
    names, table = languages.learn(documents.filter(~F.col("held_out")))
    return languages.identify(documents.drop("lang"), names, table).select("doc_id", "held_out", "lang_pred", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back; a null page has an empty payload, repeated rows are pages each."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeated 400-byte strings cover, of every text; a null text is empty, repeated rows are documents each."""
    return substrings.report(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every text windows of the benchmark hit; null texts and items have no words."""
    return contamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of similar texts; a text without words is in none, copies are linked."""
    return shinglejoin.classes(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from a bounded sample of labels not held out; empty texts are scored too."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    learned = quality.sampled(documents.filter(~F.col("held_out")), _table(spark, sf_dir, "labels"))
    scored = quality.score(documents, quality.train(learned))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that too many of their source's documents hold; a null text stays null."""
    return lines.report(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document; a null text has size 0."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth vector, exactly."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives that score nearly as high as each anchor's positives; every seventh row carries a wrong label."""
    return hardnegatives.mine(_table(spark, sf_dir, "embeddings"), hardnegatives.moved_labels())


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard rules, and outliers among the statistics of each language and source."""
    return outliers.judge(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and each source's most telling terms."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_tree_scores,
        op2_language_id,
        op3_warc,
        op4_substring_dedup,
        op5_benchmark_decontamination,
        op6_shingle_join,
        op7_quality_classifier,
        op8_line_dedup,
        op9_mixing,
        op10_nearest_neighbours,
        op11_hard_negatives,
        op12_quality_rules,
        op13_source_divergence,
    )
}

#: SQL for those that a second engine can work out.
SQL: dict[str, str] = {
    "op3_warc": warc.ROUND_TRIP_SQL,
    "op8_line_dedup": lines.REPORT_SQL,
    "op10_nearest_neighbours": neighbours.op_sql(),
    "op11_hard_negatives": hardnegatives.MINE_SQL,
    "op13_source_divergence": divergence.AUDIT_SQL,
}
