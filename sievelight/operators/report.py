"""The tables of a scan report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..catalog import SEVERITY_RANK, Catalog
from . import findings as FN
from .enrich import explode_controls, with_check

# --- Fixed values: report limits ----------------------------------------------
TOP_CONTROLS = 6
SHOWN = 3
LISTED = 50
SUPPRESSED_SHOWN = 200
SUPPRESSED_EVIDENCE = 80
STATUSES = ("fully_scanned", "partially_scanned", "unable_to_evaluate")


def severity_counts(findings: DataFrame, catalog: Catalog) -> DataFrame:
    """Findings per severity, zero included."""
    counts = with_check(findings.select("check_id"), catalog).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return catalog.severities.join(counts, "severity", "left").select(
        "severity", "rank", F.coalesce("n", F.lit(0)).alias("findings")
    )


def coverage_counts(files: DataFrame) -> DataFrame:
    """Files per status; a missing status counts as unable_to_evaluate."""
    return files.groupBy(F.coalesce("status", F.lit(STATUSES[2])).alias("status")).agg(
        F.count(F.lit(1)).alias("files")
    )


def omission_totals(files: DataFrame, findings: DataFrame) -> DataFrame:
    """What the limits left out: per-file evidence, actors (none here) and scan-wide detail."""
    per_file = files.select(
        F.coalesce("distinct_findings_omitted", F.lit(0)).cast("bigint").alias("file_omitted"),
        F.lit(0).cast("bigint").alias("scan_omitted"),
    )
    scan = findings.filter(F.col("file") == FN.SCAN_WIDE).select(
        F.lit(0).cast("bigint").alias("file_omitted"), F.col("count").cast("bigint").alias("scan_omitted")
    )
    return per_file.unionByName(scan).agg(
        F.coalesce(F.sum("file_omitted"), F.lit(0)).alias("distinct_findings_omitted"),
        F.lit(0).cast("bigint").alias("auth_actors_evicted"),
        F.coalesce(F.sum("scan_omitted"), F.lit(0)).alias("scan_wide_omitted"),
    )


def framework_impact(findings: DataFrame, catalog: Catalog, selected: Sequence[str]) -> DataFrame:
    """Findings per selected framework; frameworks without findings or checks stay in."""
    chosen = catalog.frameworks.filter(F.col("id").isin(*selected))
    links = catalog.coverage.filter(F.col("framework").isin(*selected))
    # Count per check first: what meets the coverage table is one row per check.
    per_check = findings.groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))
    counts = links.join(per_check, "check_id").groupBy("framework").agg(F.sum("n").alias("findings"))
    covered = links.select("framework").distinct().withColumn("covered", F.lit(True))
    found = F.coalesce("findings", F.lit(0))
    return (
        chosen.withColumnRenamed("id", "framework")
        .join(covered, "framework", "left")
        .join(counts, "framework", "left")
        .select(
            "framework", "name", found.cast("bigint").alias("findings"),
            F.when(F.col("covered").isNull(), "out_of_scope").when(found == 0, "no_finding").otherwise("findings").alias("status"),
        )
    )


def control_counts(findings: DataFrame, catalog: Catalog, selected: Sequence[str]) -> DataFrame:
    """Findings per framework and control, with where the control first came up."""
    per_check = findings.groupBy("check_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(FN.position()).alias("_at")
    )
    return (
        explode_controls(per_check, catalog, selected)
        .groupBy("framework", "control")
        .agg(F.sum("n").alias("findings"), F.min(F.struct("_at", "control_pos")).alias("first_seen"))
    )


def top_controls(
    findings: DataFrame, catalog: Catalog, selected: Sequence[str], n: int = TOP_CONTROLS
) -> DataFrame:
    """The `n` controls named most often per framework; on a tie the one seen first."""
    best = Window.partitionBy("framework").orderBy(F.col("findings").desc(), "first_seen")
    return (
        control_counts(findings, catalog, selected)
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= n)
        .select("framework", "place", "control", "findings")
    )


def file_table(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Every file with its status and number of findings."""
    counts = findings.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return files.join(counts, "file", "left").select(
        "file", "type", "lines", "truncated", "status", "error", F.coalesce("n", F.lit(0)).alias("findings")
    )


def finding_groups(findings: DataFrame, catalog: Catalog) -> DataFrame:
    """Findings by check and file, most severe first."""
    groups = findings.groupBy("check_id", "file").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("count").alias("occurrences"),
        F.array_join(F.array_sort(F.collect_set("confidence")), ", ").alias("confidence"),
        F.bool_or("expired_suppression").alias("expired_suppression"),
    )
    return with_check(groups, catalog).select(
        "rank", "check_id", "file", "title", "severity", "findings", "occurrences", "confidence", "expired_suppression"
    ).orderBy("rank", "check_id", "file")


def evidence_bands(findings: DataFrame, shown: int = SHOWN, listed: int = LISTED) -> DataFrame:
    """Evidence per check and file: the first shown in full, the next listed, the rest only counted.

    A file has at most its limit of findings here, so a group stays small.
    """
    in_group = Window.partitionBy("check_id", "file").orderBy("pos")
    place = F.row_number().over(in_group)
    return (
        findings.withColumn("place", place)
        .withColumn("band", F.when(F.col("place") <= shown, "shown").when(F.col("place") <= listed, "listed").otherwise("counted"))
        .groupBy(
            "check_id", "file", "band",
            F.when(F.col("band") == "counted", F.lit(listed + 1)).otherwise(F.col("place")).alias("place"),
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(F.col("band") != "counted", F.col("location"))).alias("location"),
            F.min(F.when(F.col("band") != "counted", F.col("evidence"))).alias("evidence"),
        )
    )


def suppressed_list(suppressed: DataFrame, n: int = SUPPRESSED_SHOWN) -> DataFrame:
    """The first `n` suppressed findings."""
    return (
        suppressed.orderBy(FN.position())
        .limit(n)
        .select("check_id", "file", "fingerprint", F.left("evidence", F.lit(SUPPRESSED_EVIDENCE)).alias("evidence"))
    )


def gate(findings: DataFrame, catalog: Catalog, fail_on: str) -> DataFrame:
    """One row: does any finding reach the severity `fail_on`?"""
    threshold = SEVERITY_RANK[fail_on]
    ranks = with_check(findings.select("check_id"), catalog)
    return ranks.agg(F.coalesce(F.bool_or(F.col("rank") <= threshold), F.lit(False)).alias("failed"))
