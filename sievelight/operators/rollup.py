"""Per-file roll-ups: contact data and login failures without a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import findings as FN
from .detect import DEFAULT_CONFIDENCE

# --- Fixed values: thresholds and wording -----------------------------------
BULK_THRESHOLD = 3
UNTIMED_THRESHOLD = 5
UNTIMED_CONFIDENCE = 0.4
UNATTRIBUTED = "(unattributed)"
CONTACTS = (("email", "DATA-PII-EMAIL", "email addresses"), ("phone", "DATA-PHONE", "phone numbers"))


def contact_counts(signals: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct values per file and kind, with the first one seen: (file, kind, n, location, masked).

    Distinct values are combined first by (file, kind, value), so a file that
    holds most of them is spread over all tasks.  `cap` bounds n; None does not.
    """
    distinct = F.count(F.lit(1))
    place = F.struct("item_idx", "k", "location", F.col("detail").alias("masked"))
    return (
        signals.filter(F.col("kind").isin("email", "phone"))
        .groupBy("file", "kind", "value")
        .agg(F.min(place).alias("_place"))
        .groupBy("file", "kind")
        .agg((distinct if cap is None else F.least(distinct, F.lit(cap))).alias("n"), F.min("_place").alias("_place"))
        .select("file", "kind", "n", "_place.location", "_place.masked")
    )


def bulk_contacts(signals: DataFrame, threshold: int = BULK_THRESHOLD, cap: int | None = None) -> DataFrame:
    """One raw finding per file and kind that reaches `threshold` distinct values."""
    counts = contact_counts(signals, cap).filter(F.col("n") >= threshold)
    kind = F.col("kind")
    check, noun, slot = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (name, check_id, words) in enumerate(CONTACTS):
        check = F.when(kind == name, check_id).otherwise(check)
        noun = F.when(kind == name, words).otherwise(noun)
        slot = F.when(kind == name, i).otherwise(slot)
    return counts.select(
        check.alias("check_id"), "file", "location", F.concat(F.lit("e.g. "), "masked").alias("evidence"),
        F.concat(
            F.lit("") if cap is None else F.when(F.col("n") >= cap, "at least ").otherwise(""), F.col("n").cast("string"), F.lit(" unique "), noun,
            F.lit(" in file"),
        ).alias("detail"),
        F.col("n").cast("bigint").alias("count"), F.lit(DEFAULT_CONFIDENCE).alias("confidence_score"),
        FN.order_key(3, F.lit(0), slot, F.lit(0)).alias("ord"),
    )


def untimed_failures(logins: DataFrame, threshold: int = UNTIMED_THRESHOLD) -> DataFrame:
    """Login failures without a time stamp, counted per account, else address, per file."""
    who = F.coalesce("user", "ip", F.lit(UNATTRIBUTED))
    return (
        logins.filter(F.col("ts").isNull() & F.col("fail"))
        .groupBy("file", who.alias("who"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("item_idx").alias("_first"))
        .filter(F.col("n") >= threshold)
        .select(
            F.lit("LOG-BRUTEFORCE").alias("check_id"), "file", F.lit("unknown time").alias("location"),
            F.lit("Authentication failures (timestamps unavailable)").alias("evidence"),
            F.concat(
                F.col("n").cast("string"), F.lit(" failures for "), "who",
                F.lit("; temporal correlation unavailable"),
            ).alias("detail"),
            F.col("n").alias("count"), F.lit(UNTIMED_CONFIDENCE).alias("confidence_score"),
            FN.order_key(1, F.col("_first"), F.lit(0), F.lit(0)).alias("ord"),
        )
    )
