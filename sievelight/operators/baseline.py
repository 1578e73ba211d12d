"""Accepted findings: reading, applying and writing a baseline."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import shards
from .enrich import relative_path
from .findings import position

ENTRY = (
    "fingerprint string, `check` string, file string, evidence string, reason string, approved_by string, "
    "created string, expires string"
)
ENTRY_COLUMNS = ("fingerprint", "check", "file", "evidence", "reason", "approved_by", "created", "expires")
NOTE = "Findings listed here are left out of later scans that use this baseline. State a reason for each."


def latest_entries(entries: DataFrame, order: str = "pos") -> DataFrame:
    """One entry per fingerprint, the last one by `order`; entries without fingerprint are skipped."""
    usable = entries.filter(F.coalesce(F.col("fingerprint"), F.lit("")) != "")
    return (
        usable.groupBy("fingerprint")
        .agg(F.max_by(F.struct(*[c for c in usable.columns if c not in ("fingerprint", order)]), order).alias("e"))
        .select("fingerprint", "e.*")
    )


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline document or a folder of them, or of a table in Parquet with the same columns."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    document = spark.read.option("multiLine", True).schema(f"suppressions array<struct<{_as_struct(ENTRY)}>>").json(path)
    checked = document.select(
        F.when(F.col("suppressions").isNull(), F.raise_error(F.lit(f"not a baseline document: {path}")))
        .otherwise(F.col("suppressions"))
        .alias("suppressions"), F.col("_metadata.file_path").alias("path")
    )
    entries = checked.select("path", F.posexplode("suppressions").alias("at", "e"))
    return latest_entries(entries.select(F.struct("path", "at").alias("pos"), "e.*"))


def _as_struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.strip().rsplit(" ", 1) for part in ddl.split(",")))


def is_expired(expires: Column, now: datetime) -> Column:
    """An entry with a passed, unreadable or zone-less expiry counts as expired; one without any does not."""
    moment = F.lit(now.astimezone(timezone.utc).isoformat()).cast("timestamp")
    zoned = expires.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d.*(?:Z|[+-]\d\d(?::?\d\d)?)$")
    spelled = F.regexp_replace(F.regexp_replace(expires, r"([+-]\d\d)(\d\d)$", "$1:$2"), r"([T ].*[+-]\d\d)$", "$1:00")
    when = F.when(zoned, spelled.try_cast("timestamp"))
    return F.when(F.coalesce(expires, F.lit("")) == "", F.lit(False)).otherwise(
        F.coalesce(when <= moment, F.lit(True))
    )


def apply_baseline(findings: DataFrame, entries: DataFrame, now: datetime) -> DataFrame:
    """Add `suppressed` and `expired_suppression`; an entry by full path wins over one by file name.

    Baselines grow with what was accepted, so both look-ups are plain joins and
    Spark decides at run time whether a side is small enough to broadcast.
    """
    expired = is_expired(F.col("expires"), now)
    slim = entries.select("fingerprint", F.struct(expired.alias("expired")).alias("_entry"))
    old = slim.withColumnsRenamed({"fingerprint": "legacy_fingerprint", "_entry": "_old"})
    entry = F.coalesce("_entry", "_old")
    return (
        findings.join(slim, "fingerprint", "left")
        .join(old, "legacy_fingerprint", "left")
        .withColumns(
            {
                "suppressed": entry.isNotNull() & ~F.coalesce(entry["expired"], F.lit(False)),
                "expired_suppression": F.coalesce(entry["expired"], F.lit(False)),
            }
        )
        .drop("_entry", "_old")
    )


def split_by_baseline(findings: DataFrame, entries: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(active, suppressed)."""
    marked = apply_baseline(findings, entries, now)
    return marked.filter(~F.col("suppressed")).drop("suppressed"), marked.filter("suppressed").drop("suppressed")


def baseline_entries(findings: DataFrame, now: datetime, root: str | None = None) -> DataFrame:
    """New entries for `findings`: the first finding of each fingerprint, by check and file."""
    stamp = now.astimezone(timezone.utc).isoformat()
    return (
        findings.groupBy("fingerprint")
        .agg(F.min(F.struct(position().alias("at"), "check_id", "file", "evidence")).alias("f"))
        .select(
            "fingerprint", F.col("f.check_id").alias("check"), relative_path(F.col("f.file"), root).alias("file"),
            F.col("f.evidence").alias("evidence"), F.lit("").alias("reason"), F.lit("").alias("approved_by"),
            F.lit(stamp).alias("created"), F.lit(None).cast("string").alias("expires"),
        )
    )


def baseline_documents(entries: DataFrame, now: datetime, per_document: int = shards.PER_DOCUMENT) -> DataFrame:
    """(shard, value): the entries as JSON documents (version 2) of at most `per_document` entries, in order.

    `read_baseline` reads any number of them.  Without entries there is one empty document.
    """
    options = {"ignoreNullFields": "false"}
    rows = shards.dealt(entries, F.struct("check", "file", "fingerprint"), per_document)
    texts = rows.select("shard", "o", F.to_json(F.struct(*ENTRY_COLUMNS), options).alias("entry"))
    fixed = F.to_json(
        F.struct(F.lit(2).alias("version"), F.lit(now.astimezone(timezone.utc).isoformat()).alias("generated"), F.lit(NOTE).alias("note"))
    )
    head = F.concat(F.left(fixed, F.length(fixed) - 1), F.lit(',"suppressions":['))
    value = F.concat(head, shards.joined("entry"), F.lit("]}")).alias("value")
    if rows.isEmpty():
        return texts.agg(value).select(F.lit(0).cast("bigint").alias("shard"), "value")
    return texts.groupBy("shard").agg(value)
