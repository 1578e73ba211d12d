"""SARIF 2.1.0 rows and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import shards
from ..catalog import Catalog
from .enrich import check_profiles, relative_path, with_check
from .findings import position

# Fixed values of the format
SCHEMA_URL = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
FINGERPRINT_KEY = "complianceScanFingerprint/v2"


def rules(findings: DataFrame, catalog: Catalog, selected: Sequence[str]) -> DataFrame:
    """One row per check that occurs, in order of first appearance."""
    seen = findings.groupBy("check_id").agg(F.min(position()).alias("first_seen"))
    names = F.create_map(*[F.lit(v) for row in _names(catalog) for v in row])
    mapped = F.array_join(
        F.transform(
            F.map_entries(F.coalesce("mappings", F.create_map().cast("map<string,array<string>>"))),
            lambda e: F.concat(names[e["key"]], F.lit(": "), F.array_join(e["value"], ", ")),
        ),
        "; ",
    )
    return (
        with_check(seen, catalog)
        .join(F.broadcast(catalog.severities.select("severity", "sarif_level", "sarif_score")), "severity")
        .join(F.broadcast(check_profiles(catalog, selected)), "check_id", "left")
        .select(
            "first_seen", F.col("check_id").alias("id"), F.replace("check_id", F.lit("-"), F.lit("")).alias("name"),
            F.col("title").alias("short_description"), F.col("description").alias("full_description"),
            F.concat(
                "remediation", F.lit("\n\nCandidate assessment mappings — "), mapped,
                F.lit(". These do not establish compliance."),
            ).alias("help"),
            F.col("sarif_level").alias("level"), F.col("sarif_score").alias("security_severity"), "category",
        )
    )


def _names(catalog: Catalog) -> list[tuple[str, str]]:
    # Framework names are a fixed table of the package, not data.
    from ..catalog.frameworks import FRAMEWORKS

    return [(i, name) for i, name, _ in FRAMEWORKS]


def start_line(location: Column) -> Column:
    line = F.regexp_extract(location, r"(?U)\bline (\d+)", 1)
    return F.greatest(
        F.lit(1), F.when((line != "") & ~location.contains("page"), line.cast("bigint")).otherwise(1)
    ).cast("bigint")


def uri(file: Column, root: str | None) -> Column:
    return F.regexp_replace(F.translate(relative_path(file, root), "\\", "/"), r"^[./]+", "")


def results(findings: DataFrame, catalog: Catalog, root: str | None = None) -> DataFrame:
    """One row per finding (which carries fingerprint and confidence)."""
    message = F.concat(
        "title", F.lit(" — "), "location",
        F.when(F.col("detail") != "", F.concat(F.lit(" ("), "detail", F.lit(")"))).otherwise(""),
        F.lit(". Evidence: "), "evidence",
    )
    kept = [c for c in ("mapping_provenance",) if c in findings.columns]
    attributes = findings.drop("title", "severity", "rank", "category", "description", "remediation")
    return (
        with_check(attributes, catalog)
        .join(F.broadcast(catalog.severities.select("severity", "sarif_level")), "severity")
        .select(
            "file", "pos", F.col("check_id").alias("rule_id"), F.col("sarif_level").alias("level"),
            message.alias("message"), uri(F.col("file"), root).alias("uri"),
            start_line(F.col("location")).alias("start_line"), "fingerprint", "confidence", "confidence_score",
            F.col("count").alias("occurrence_count"), *kept,
        )
    )


def documents(
    findings: DataFrame, catalog: Catalog, selected: Sequence[str], root: str | None = None, *,
    per_document: int = shards.PER_DOCUMENT, tool: str = "sievelight", version: str = "0.1.0",
) -> DataFrame:
    """(shard, value): all findings as documents of at most `per_document` results, in order, each put together by itself.

    A document has the rules its results refer to.  Without findings there is one without results.
    """
    rule = F.struct(
        "id", "name", F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
        F.struct(F.col("full_description").alias("text")).alias("fullDescription"),
        F.struct(F.col("help").alias("text")).alias("help"),
        F.struct("level").alias("defaultConfiguration"),
        F.struct(
            F.col("security_severity").alias("security-severity"),
            F.array(F.lit("security"), F.lit("compliance"), F.col("category")).alias("tags"),
        ).alias("properties"),
    )
    rows = shards.dealt(results(findings, catalog, root), position(), per_document)
    facts = [F.col("mapping_provenance").alias("mappingProvenance")] if "mapping_provenance" in rows.columns else []
    result = F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct("uri").alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")
                ).alias("physicalLocation")
            )
        ).alias("locations"),
        F.struct(F.col("fingerprint").alias(FINGERPRINT_KEY)).alias("partialFingerprints"),
        F.struct(
            "confidence", F.col("confidence_score").alias("confidenceScore"),
            F.col("occurrence_count").alias("occurrenceCount"), *facts,
        ).alias("properties"),
    )
    # The rules of a shard and its results come together as rows of one table.
    used = rows.select("shard", F.col("rule_id").alias("id")).distinct()
    parts = rules(findings, catalog, selected).join(used, "id").select(
        "shard", F.col("first_seen").alias("o"), F.to_json(rule).alias("rule"), F.lit(None).cast("string").alias("result")
    ).unionByName(rows.select("shard", "o", F.lit(None).cast("string").alias("rule"), F.to_json(result).alias("result")))
    head = (
        f'{{"$schema":"{SCHEMA_URL}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}",'
        f'"version":"{version}","rules":['
    )
    value = F.concat(F.lit(head), shards.joined("rule"), F.lit(']}},"results":['), shards.joined("result"), F.lit("]}]}")).alias("value")
    if rows.isEmpty():
        return parts.agg(value).select(F.lit(0).cast("bigint").alias("shard"), "value")
    return parts.groupBy("shard").agg(value)
