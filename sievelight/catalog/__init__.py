"""Catalog tables: frameworks, severities, checks, cross-walk to controls, reviewed mappings."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from .checks import CHECKS, DERIVED
from .frameworks import ALIASES, FRAMEWORKS, NOTES, REVIEW_SOURCE, REVIEWED, SEVERITIES

FRAMEWORK_IDS = tuple(f[0] for f in FRAMEWORKS)
TEMPLATE = {check_id: template for check_id, template, *_ in DERIVED}
CHECK_IDS = tuple(c[0] for c in CHECKS) + tuple(TEMPLATE)
SEVERITY_RANK = {name: rank for name, rank, *_ in SEVERITIES}


def _crosswalk() -> dict[tuple[str, str], list[str]]:
    """References by check and framework, from the table beside this file."""
    with (Path(__file__).parent / "crosswalk.csv").open(encoding="utf-8", newline="") as file:
        rows = csv.DictReader(line for line in file if not line.startswith("#"))
        return {(r["check_id"], r["framework"]): r["controls"].split("; ") for r in rows}


CROSSWALK = _crosswalk()


class UnknownFramework(ValueError):
    """A framework name that is neither an id nor an alias."""


def _squeeze(name: str) -> str:
    return name.strip().lower().replace("-", "").replace("_", "")


def resolve_frameworks(names: Iterable[str]) -> list[str]:
    """Framework ids for names or aliases, in order, without repeats; `all` selects every framework."""
    known = {_squeeze(f): f for f in FRAMEWORK_IDS} | ALIASES
    chosen: dict[str, None] = {}
    for name in names:
        short = _squeeze(name)
        if short == "all":
            return list(FRAMEWORK_IDS)
        if short not in known:
            raise UnknownFramework(name)
        chosen[known[short]] = None
    if not chosen:
        raise UnknownFramework("select at least one framework, or all")
    return list(chosen)


def controls(framework: str, check_id: str) -> list[str]:
    """Built-in control references; a derived check has those of its template."""
    return CROSSWALK.get((TEMPLATE.get(check_id, check_id), framework), [])


@dataclass(frozen=True)
class Catalog:
    """Dimension tables; every one has a fixed, small size and may be broadcast.

    A cross-walk given by the caller is joined without a broadcast hint.
    """

    frameworks: DataFrame  # id, name, long, note, ord
    severities: DataFrame  # severity, rank, sarif_level, sarif_score
    checks: DataFrame  # check_id, severity, category, title, description, remediation, ord
    coverage: DataFrame  # check_id, framework
    check_controls: DataFrame  # check_id, framework, control, pos
    reviewed: DataFrame  # check_id, framework, control


def check_rows() -> list[tuple]:
    by_id = {c[0]: c for c in CHECKS}
    rows = list(CHECKS)
    for check_id, template, severity, title, description in DERIVED:
        _, _, category, _, _, remediation = by_id[template]
        rows.append((check_id, severity, category, title, description, remediation))
    return [(*row, i) for i, row in enumerate(rows)]


def coverage_rows() -> list[tuple[str, str]]:
    return [(c, f) for c in CHECK_IDS for f in FRAMEWORK_IDS if controls(f, c)]


def control_rows() -> list[tuple[str, str, str, int]]:
    return [
        (c, f, control, pos)
        for c in CHECK_IDS
        for f in FRAMEWORK_IDS
        for pos, control in enumerate(controls(f, c))
    ]


def tables(spark: SparkSession, crosswalk: DataFrame | str | None = None) -> Catalog:
    """Build the catalog.

    `crosswalk` (check_id, framework, control, pos; a table or a path to
    Parquet, JSON or CSV) replaces the built-in references of every framework it
    mentions, coverage included.
    """
    coverage = spark.createDataFrame(coverage_rows(), "check_id string, framework string")
    built_in = spark.createDataFrame(control_rows(), "check_id string, framework string, control string, pos int")
    references = built_in
    if crosswalk is not None:
        given = read_crosswalk(spark, crosswalk) if isinstance(crosswalk, str) else crosswalk
        given = given.select("check_id", "framework", "control", F.col("pos").cast("int").alias("pos"))
        named = given.select("framework").distinct()
        references = built_in.join(named, "framework", "left_anti").select(*given.columns).unionByName(given)
        coverage = (
            coverage.join(named, "framework", "left_anti")
            .select("check_id", "framework")
            .unionByName(given.select("check_id", "framework").distinct())
        )
    return Catalog(
        frameworks=spark.createDataFrame(
            [(i, n, l, NOTES.get(i), k) for k, (i, n, l) in enumerate(FRAMEWORKS)],
            "id string, name string, long string, note string, ord int",
        ),
        severities=spark.createDataFrame(
            list(SEVERITIES), "severity string, rank int, sarif_level string, sarif_score string"
        ),
        checks=spark.createDataFrame(
            check_rows(),
            "check_id string, severity string, category string, title string, description string, "
            "remediation string, ord int",
        ),
        coverage=coverage,
        check_controls=references,
        reviewed=spark.createDataFrame(list(REVIEWED), "check_id string, framework string, control string"),
    )


def with_rules(catalog: Catalog, rules: Iterable[tuple[str, str, str]], severity: str = "medium") -> Catalog:
    """The catalog with a check for each custom rule (id, pattern, detail) it lacks; every framework covers those, none by a control."""
    spark = catalog.checks.sparkSession
    known = set(CHECK_IDS)
    own = {r[0]: r[2] for r in rules if r[0] not in known}
    if not own:
        return catalog
    rows = [(i, severity, "Custom rule", detail or i, "Found by a rule of the scan's own.", "Review by the rule's purpose.", len(CHECK_IDS) + k)
            for k, (i, detail) in enumerate(own.items())]
    checks = catalog.checks.unionByName(spark.createDataFrame(rows, catalog.checks.schema))
    covered = spark.createDataFrame([(i, f) for i in own for f in FRAMEWORK_IDS], catalog.coverage.schema)
    return replace(catalog, checks=checks, coverage=catalog.coverage.unionByName(covered))


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Cross-walk table from Parquet, CSV (with header) or JSON lines, by file extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.option("header", True).schema(
            "check_id string, framework string, control string, pos int"
        ).csv(path)
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.schema("check_id string, framework string, control string, pos int").json(path)
    return spark.read.parquet(path)


def crosswalk_from_export(spark: SparkSession, path: str) -> DataFrame:
    """Cross-walk taken from an earlier JSON export of findings (its `mappings`)."""
    export = spark.read.option("multiLine", True).schema(
        "findings array<struct<check:string,mappings:map<string,array<string>>>>"
    ).json(path)
    pairs = export.select(F.inline("findings")).select("check", F.explode("mappings").alias("framework", "list"))
    return (
        pairs.select(F.col("check").alias("check_id"), "framework", F.posexplode("list").alias("pos", "control"))
        .distinct()
        .select("check_id", "framework", "control", "pos")
    )


def list_frameworks(catalog: Catalog) -> DataFrame:
    """id, name and long name of every framework, in catalog order."""
    return catalog.frameworks.orderBy("ord").select("id", "name", "long")


def list_checks(catalog: Catalog) -> DataFrame:
    """Checks by severity, then id, each with the sorted names of the frameworks that cover it."""
    frameworks = catalog.coverage.groupBy("check_id").agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))
    return (
        catalog.checks.join(F.broadcast(catalog.severities), "severity")
        .join(frameworks, "check_id", "left")
        .orderBy("rank", "check_id")
        .select("severity", "check_id", "title", F.coalesce("frameworks", F.array().cast("array<string>")).alias("frameworks"))
    )


def uncovered_frameworks(catalog: Catalog) -> DataFrame:
    """Frameworks no check is tied to."""
    covered = catalog.coverage.withColumnRenamed("framework", "id")
    return catalog.frameworks.join(covered, "id", "left_anti").select("id", "name")
