"""Findings: insertion, merging and the two result limits.

`ord` says where a finding was made: phase 0 per item, 1 untimed logins, 2
parsed settings, 3 contact roll-ups; then item, rule and match.  It decides the
first location, the five samples and what a limit keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X

# --- Fixed values: limits and wording ---------------------------------------
SAMPLES = 5
LIMIT_CONFIDENCE = 0.4
FILE_LIMIT_TEXT = (
    "additional locations",
    "Additional distinct evidence omitted by per-file result limit",
    "Evidence detail unavailable; scan was capped for result storage",
)
SCAN_LIMIT_TEXT = (
    "additional files",
    "Additional finding detail omitted by scan-wide limit",
    "File-level attribution unavailable beyond result limit",
)
SCAN_WIDE = "(scan-wide)"

# Items per merge group.  A group of one file and one piece of evidence is cut
# into groups of this many items, so none grows with the file.
CHUNK = 1 << 10
# Steps of merging, each over CHUNK runs of the one before: enough for CHUNK ** (MERGE_STEPS + 1) items a file and task.
MERGE_STEPS = 2
# Items per run when findings are ranked within a file.
RANK_RUN = 1 << 16

# Broadcast the table of early files up to this limit; beyond it Spark decides.
MAX_BROADCAST_ROWS = 100_000



def order_key(phase: int, item_idx: Column, det: Column, k: Column) -> Column:
    return F.struct(
        F.lit(phase).alias("phase"), item_idx.cast("bigint").alias("item_idx"), det.cast("int").alias("det"),
        k.cast("int").alias("k"),
    )


def position() -> Column:
    """Order of findings in a result: by file and place; scan-wide rows come last."""
    return F.struct((F.col("file") == SCAN_WIDE).alias("late"), F.col("file"), F.col("pos"))


def insert(raw: DataFrame) -> DataFrame:
    """The masking pass every finding gets when it is stored."""
    return raw.select(
        "check_id", "file", X.sanitized("location"), X.sanitized("evidence"), X.sanitized("detail"),
        F.col("count").cast("bigint").alias("count"), "confidence_score", "ord",
    )


def merge(raw: DataFrame) -> DataFrame:
    """One row per file, check and evidence; counts add up, the first occurrence gives the rest.

    Rows that already count several events stay apart when their detail differs.
    Up to five sample locations are kept, in order.  Merging goes in steps over
    runs of items, each with map-side combining, so a piece of evidence that
    fills a third of all rows is never gathered in one task.
    """
    key = ["file", "check_id", "evidence", "_detail"]
    rows = raw.withColumn("_detail", F.when(F.col("count") > 1, F.col("detail")).otherwise("")).select(
        *key,
        F.floor(F.col("ord.item_idx") / CHUNK).alias("_chunk"),
        "count",
        F.struct("ord", "location", "detail", "confidence_score").alias("_first"),
        F.struct("ord", "location").alias("_sample"),
    )

    def first_five(samples: Column) -> Column:
        return F.slice(F.array_sort(samples), 1, SAMPLES)

    step = rows.groupBy(*key, "_chunk").agg(
        F.sum("count").alias("count"), F.min("_first").alias("_first"),
        first_five(F.collect_list("_sample")).alias("_samples"),
    )
    # A file has any number of chunks: each step joins so many of the one before.
    for _ in range(MERGE_STEPS):
        step = step.groupBy(*key, F.floor(F.col("_chunk") / CHUNK).alias("_chunk")).agg(
            F.sum("count").alias("count"), F.min("_first").alias("_first"),
            first_five(F.flatten(F.collect_list("_samples"))).alias("_samples"),
        )
    merged = step.groupBy(*key).agg(
        F.sum("count").alias("count"), F.min("_first").alias("_first"),
        first_five(F.flatten(F.collect_list("_samples"))).alias("_samples"),
    )
    return merged.select(
        "check_id", "file", F.col("_first.location").alias("location"), "evidence",
        F.col("_first.detail").alias("detail"), "count",
        F.col("_first.confidence_score").alias("confidence_score"),
        F.transform("_samples", lambda s: s["location"]).alias("sample_locations"),
        F.col("_first.ord").alias("ord"),
    )


def rank_in_file(merged: DataFrame) -> DataFrame:
    """`pos`: 1-based rank of each merged finding in its file.

    Ranks come from counts per run of items plus a rank inside the run, so the
    findings of one large file are spread over many tasks.  `merged` is read
    twice: stage it first when it is costly.
    """
    chunked = merged.withColumn("_phase", F.col("ord.phase")).withColumn(
        "_chunk", F.floor(F.col("ord.item_idx") / RANK_RUN)
    )
    before = Window.partitionBy("file").orderBy("_phase", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy("file", "_phase", "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("file", "_phase", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("file", "_phase", "_chunk").orderBy("ord", "check_id", "evidence", "detail")
    return (
        chunked.join(offsets, ["file", "_phase", "_chunk"])
        .withColumn("pos", F.col("_before") + F.row_number().over(inside))
        .drop("_phase", "_chunk", "_before")
    )


def first_items(items: DataFrame, limit: int) -> DataFrame:
    """The first `limit` items that each file holds, whatever gaps their numbers have.

    As in `rank_in_file`, counts per run of numbers are summed up and rows are ranked
    inside a run only.
    """
    run = items.withColumn("_run", F.floor(F.col("item_idx") / RANK_RUN))
    before = Window.partitionBy("file").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = run.groupBy("file", "_run").agg(F.count("*").alias("_n"))
    offsets = offsets.select("file", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file", "_run").orderBy("item_idx")
    ranked = run.join(offsets.filter(F.col("_before") < limit), ["file", "_run"])
    ranked = ranked.withColumn("_place", F.col("_before") + F.row_number().over(inside))
    return ranked.filter(F.col("_place") <= limit).select(*items.columns)


def limit_per_file(merged: DataFrame, limit: int | None = None) -> DataFrame:
    """First `limit` distinct findings of each file; the rest counted per check in one row each.  None: all, with their ranks."""
    ranked = rank_in_file(merged)
    if limit is None:
        return ranked.select(
            "check_id", "file", "location", "evidence", "detail", "count", "confidence_score", "sample_locations", "pos"
        )
    over = F.col("pos") > limit
    place, what, why = (F.lit(t) for t in FILE_LIMIT_TEXT)
    row = F.struct(
        F.when(over, place).otherwise(F.col("location")).alias("location"),
        F.when(over, what).otherwise(F.col("evidence")).alias("evidence"),
        F.when(over, why).otherwise(F.col("detail")).alias("detail"),
        F.when(over, F.lit(LIMIT_CONFIDENCE)).otherwise(F.col("confidence_score")).alias("confidence_score"),
        F.when(over, F.array().cast("array<string>")).otherwise(F.col("sample_locations")).alias("sample_locations"),
    )
    return (
        ranked.select(
            "file", "check_id", F.when(over, F.lit(0)).otherwise(F.col("pos")).alias("_slot"), "count",
            "pos", row.alias("_row"),
        )
        .groupBy("file", "check_id", "_slot")
        .agg(F.sum("count").alias("count"), F.min("pos").alias("pos"), F.min("_row").alias("_row"))
        .select(
            "check_id", "file", "_row.location", "_row.evidence", "_row.detail", "count", "_row.confidence_score",
            "_row.sample_locations", "pos",
        )
    )


def limit_per_scan(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """First `limit` findings in file order; the rest counted per check in a scan-wide row.  None: all of them.

    `findings` come from `limit_per_file`.  Each file with findings has at least
    one, so only the first `limit` files can matter: their counts make a table of
    bounded size that is summed up in order.  The findings themselves are neither
    sorted nor ranked: `pos` is their rank in the file, but for the few rows of a
    file that stand for what its own limit left out, whose places are listed.
    """
    if limit is None:
        return findings
    is_rest = F.col("location") == FILE_LIMIT_TEXT[0]
    counts = findings.groupBy("file").agg(
        F.count(F.lit(1)).alias("_n"),
        # At most one such row per check.
        F.array_sort(F.collect_list(F.when(is_rest, F.col("pos")))).alias("_late"),
    )
    running = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.orderBy("file")
        .limit(limit)
        .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .filter(F.col("_before") < limit)
    )
    early = findings.join(F.broadcast(offsets) if limit <= MAX_BROADCAST_ROWS else offsets, "file", "left")
    place = F.when(
        is_rest, F.col("_n") - F.size("_late") + F.array_position("_late", F.col("pos"))
    ).otherwise(F.col("pos"))
    over = F.coalesce(F.col("_before") + place > limit, F.lit(True))
    where, what, why = (F.lit(t) for t in SCAN_LIMIT_TEXT)
    row = F.struct(
        F.when(over, where).otherwise(F.col("location")).alias("location"),
        F.when(over, what).otherwise(F.col("evidence")).alias("evidence"),
        F.when(over, why).otherwise(F.col("detail")).alias("detail"),
        F.when(over, F.lit(LIMIT_CONFIDENCE)).otherwise(F.col("confidence_score")).alias("confidence_score"),
        F.when(over, F.array().cast("array<string>")).otherwise(F.col("sample_locations")).alias("sample_locations"),
    )
    return (
        early.select(
            "check_id", F.when(over, F.lit(SCAN_WIDE)).otherwise(F.col("file")).alias("file"),
            F.when(over, F.lit(limit + 1)).otherwise(F.col("pos")).cast("bigint").alias("pos"), "count",
            row.alias("_row"),
        )
        .groupBy("check_id", "file", "pos")
        .agg(F.sum("count").alias("count"), F.min("_row").alias("_row"))
        .select(
            "check_id", "file", "_row.location", "_row.evidence", "_row.detail", "count", "_row.confidence_score",
            "_row.sample_locations", "pos",
        )
    )


def merge_reported(findings: DataFrame) -> DataFrame:
    """Merge findings of any origin once more, after they were reported.

    Needs the raw columns; same keys as `merge`, no masking pass.
    """
    return merge(findings)
