"""Findings tied to the catalog: relevance, attributes, fingerprints, controls and their provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import Catalog
from ..catalog.frameworks import REVIEW_SOURCE
from ..functions import text as X


def relevant_checks(catalog: Catalog, selected: Sequence[str]) -> DataFrame:
    """Checks at least one selected framework covers; never more rows than there are checks."""
    return catalog.coverage.filter(F.col("framework").isin(*selected)).select("check_id").distinct()


def keep_relevant(findings: DataFrame, catalog: Catalog, selected: Sequence[str]) -> DataFrame:
    return findings.join(F.broadcast(relevant_checks(catalog, selected)), "check_id", "left_semi")


def with_check(findings: DataFrame, catalog: Catalog) -> DataFrame:
    """Add title, severity, rank, category, description and remediation."""
    attributes = catalog.checks.join(catalog.severities, "severity").select(
        "check_id", "title", "severity", "rank", "category", "description", "remediation"
    )
    return findings.join(F.broadcast(attributes), "check_id")


def relative_path(file: Column, root: str | None) -> Column:
    """`file` below `root`, with forward slashes; other paths stay as they are."""
    path = F.translate(file, "\\", "/") if root and "\\" in root else file
    if not root:
        return path
    stem = root.rstrip("/") + "/"
    return F.when(path.startswith(stem), F.substring(path, F.lit(len(stem) + 1), F.char_length(path))).otherwise(path)


def base_name(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)


def _short_hash(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def with_fingerprints(findings: DataFrame, root: str | None = None) -> DataFrame:
    """Ids that survive moved lines: `fingerprint` by path below `root`, `legacy_fingerprint` by file name."""
    check, file, evidence = F.col("check_id"), F.col("file"), F.col("evidence")
    return findings.withColumns(
        {
            "fingerprint": _short_hash(check, relative_path(file, root), evidence),
            "legacy_fingerprint": _short_hash(check, base_name(file), evidence),
        }
    )


def with_confidence(findings: DataFrame) -> DataFrame:
    return findings.withColumn("confidence", X.confidence_band(F.col("confidence_score")))


def common_root(files: DataFrame) -> DataFrame:
    """Longest common directory of the `file` column, as one row (`root`).

    The smallest and the largest path share exactly the prefix all paths share,
    so two aggregates are enough.
    """
    ends = files.agg(F.min("file").alias("low"), F.max("file").alias("high")).select(
        F.split("low", "/").alias("a"), F.split("high", "/").alias("b")
    )
    shared = F.aggregate(
        F.zip_with("a", "b", lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(True).alias("open")),
        lambda acc, p: F.when(
            acc["open"] & p["x"].eqNullSafe(p["y"]),
            F.struct(F.concat(acc["parts"], F.array(p["x"])).alias("parts"), F.lit(True).alias("open")),
        ).otherwise(F.struct(acc["parts"].alias("parts"), F.lit(False).alias("open"))),
        lambda acc: acc["parts"],
    )
    # One path only: its directory.
    directory = F.when(F.col("a") == F.col("b"), F.slice("a", F.lit(1), F.size("a") - 1)).otherwise(shared)
    return ends.select(F.array_join(directory, "/").alias("root"))


def provenance(catalog: Catalog, selected: Sequence[str] | None = None) -> DataFrame:
    """One row per check, framework and control, with what is known about the mapping."""
    links = catalog.check_controls
    if selected is not None:
        links = links.filter(F.col("framework").isin(*selected))
    version, url, day = REVIEW_SOURCE
    reviewed = catalog.reviewed.withColumn("_reviewed", F.lit(True))
    names = catalog.frameworks.select(F.col("id").alias("framework"), F.col("name").alias("_name"))
    hit = F.col("_reviewed").isNotNull()
    return (
        links.join(F.broadcast(reviewed), ["check_id", "framework", "control"], "left")
        .join(F.broadcast(names), "framework", "left")
        .select(
            "check_id", "framework", "control", "pos",
            F.when(hit, "supporting").otherwise("inferred").alias("mapping_type"),
            F.when(hit, "source_reviewed").otherwise("unreviewed").alias("review_status"),
            F.when(hit, version).otherwise(F.col("_name")).alias("source_version"),
            F.when(hit, F.lit(url)).alias("source_url"),
            F.when(hit, F.lit(day)).alias("reviewed_on"),
            F.lit(False).alias("independently_verified"),
        )
    )


def check_profiles(catalog: Catalog, selected: Sequence[str]) -> DataFrame:
    """Per check: `mappings` (framework -> controls) and `mapping_provenance` (framework -> control -> facts)."""
    facts = (
        "mapping_type", "review_status", "source_version", "source_url", "reviewed_on", "independently_verified",
    )
    by_framework = (
        provenance(catalog, selected)
        .groupBy("check_id", "framework")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "control", F.struct(*facts).alias("facts")))).alias("links"))
        .select(
            "check_id", "framework",
            F.transform("links", lambda x: x["control"]).alias("controls"),
            F.map_from_entries(F.transform("links", lambda x: F.struct(x["control"], x["facts"]))).alias("facts"),
        )
    )
    order = F.create_map(*[F.lit(v) for i, f in enumerate(selected) for v in (f, i)])
    entry = F.struct(order[F.col("framework")].alias("o"), "framework", "controls", "facts")
    return by_framework.groupBy("check_id").agg(F.array_sort(F.collect_list(F.struct(entry["o"], "framework", "controls"))).alias("m"),
        F.map_from_entries(F.collect_list(F.struct("framework", "facts"))).alias("mapping_provenance"),
    ).select(
        "check_id",
        F.map_from_entries(F.transform("m", lambda x: F.struct(x["framework"], x["controls"]))).alias("mappings"),
        "mapping_provenance",
    )


def with_mappings(findings: DataFrame, catalog: Catalog, selected: Sequence[str]) -> DataFrame:
    """Add `mappings` and `mapping_provenance`; one profile per check, so the lookup table stays small."""
    return findings.join(F.broadcast(check_profiles(catalog, selected)), "check_id", "left")


def explode_controls(findings: DataFrame, catalog: Catalog, selected: Sequence[str]) -> DataFrame:
    """One row per finding, framework and control."""
    links = catalog.check_controls.filter(F.col("framework").isin(*selected)).select(
        "check_id", "framework", "control", F.col("pos").alias("control_pos")
    )
    return findings.join(links, "check_id")  # a caller's table may be of any size: Spark goes by it
