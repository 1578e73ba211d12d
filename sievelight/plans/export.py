"""Results of a scan as files: findings as JSON lines, a header, the report tables, SARIF, a baseline."""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import DataFrame, functions as F

from ..operators import baseline, report, sarif, shards
from .scan import ScanResult

VERSION = "0.1.0"


def finding_records(result: ScanResult) -> DataFrame:
    """One record per active finding, with the fields of the JSON export."""
    return result.findings.select(
        F.col("check_id").alias("check"), "title", "severity", "file", "location", "evidence", "detail", "count",
        "fingerprint", "confidence", "confidence_score", "sample_locations", "expired_suppression",
        "mapping_provenance", "mappings",
    )


def header(result: ScanResult) -> DataFrame:
    """One row: when and how the scan ran, coverage and what the limits left out."""
    coverage = report.coverage_counts(result.files).agg(
        F.map_from_entries(F.collect_list(F.struct("status", "files"))).alias("coverage")
    )
    totals = report.omission_totals(result.files, result.findings)
    options = result.options
    fixed = F.struct(
        F.lit(options.now.astimezone(timezone.utc).isoformat()).alias("generated"),
        F.lit(VERSION).alias("scanner_version"),
        F.struct(
            F.lit(options.item_limit).cast("int").alias("max_items_per_file"), F.lit(options.max_text).cast("int").alias("max_line_length")
        ).alias("scan_limits"),
        F.array(*[F.lit(f) for f in options.selected]).alias("frameworks"),
    )
    # Two tables of one row each, joined on a constant.
    return (
        coverage.withColumn("_one", F.lit(1))
        .join(totals.withColumn("_one", F.lit(1)), "_one")
        .select(fixed.alias("f"), "coverage", "scan_wide_omitted", "distinct_findings_omitted")
        .select(
            "f.*", "coverage", F.col("scan_wide_omitted").alias("scan_wide_finding_detail_omitted"),
            "distinct_findings_omitted",
        )
    )


def report_tables(result: ScanResult) -> dict[str, DataFrame]:
    """Every section of the report as a table."""
    found, catalog, selected = result.findings, result.catalog, result.options.selected
    return {
        "severity_counts": report.severity_counts(found, catalog),
        "coverage": report.coverage_counts(result.files),
        "omissions": report.omission_totals(result.files, found),
        "framework_impact": report.framework_impact(found, catalog, selected),
        "top_controls": report.top_controls(found, catalog, selected),
        "files": report.file_table(result.files, found),
        "finding_groups": report.finding_groups(found, catalog),
        "evidence": report.evidence_bands(found),
        "suppressed": report.suppressed_list(result.suppressed),
    }


def write(result: ScanResult, folder: str, per_document: int = shards.PER_DOCUMENT) -> None:
    """Write everything below `folder`: also a baseline that accepts all active findings, for a reviewer to edit.

    SARIF and baseline come as documents of at most `per_document` rows, one file each.
    """
    finding_records(result).write.json(f"{folder}/findings")
    result.files.write.json(f"{folder}/files")
    result.suppressed.select("fingerprint").write.json(f"{folder}/suppressed")
    header(result).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{folder}/header")
    reports = sarif.documents(result.findings, result.catalog, result.options.selected, result.root, per_document=per_document)
    reports.write.partitionBy("shard").text(f"{folder}/sarif")
    entries = baseline.baseline_entries(result.findings, result.options.now, result.root)
    baseline.baseline_documents(entries, result.options.now, per_document).write.partitionBy("shard").text(f"{folder}/baseline")
    for name, table in report_tables(result).items():
        table.write.parquet(f"{folder}/report/{name}")
