"""Merged findings and distinct contacts of a stream of items, as keyed state.

State holds one row for each piece of evidence and each contact of a file: how often it
occurred and where first.  Rows come out as they change (update mode); the last state of
each is the result, which is that of the batch operators on the same items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators import detect, findings as FN, rollup

KEY = ("file", "kind", "check_id", "what")


def merged_signals(items: DataFrame, *, year: int, families: tuple[str, ...] = detect.FAMILIES) -> DataFrame:
    """(file, kind, check_id, what, count, first): evidence of findings, and values of e-mail addresses and phone numbers.

    Findings get their masking pass before they are told apart.  Logins are left to
    `streaming.auth`.
    """
    found = detect.signals(items, year=year, families=families).filter(F.col("kind") != "auth")
    direct = F.col("kind") == "finding"
    masked = [F.when(direct, X.sanitize(F.col(c))).otherwise(F.col(c)).alias(c) for c in ("location", "detail")]
    rows = found.select(
        "file", "kind", F.coalesce("check_id", F.lit("")).alias("check_id"),
        F.when(direct, X.sanitize(F.col("evidence"))).otherwise(F.col("value")).alias("what"), "item_idx", "det", "k", "confidence_score", *masked,
    )
    first = F.struct("item_idx", "det", "k", "location", "detail", "confidence_score")
    return rows.groupBy(*KEY).agg(F.count("*").alias("count"), F.min(first).alias("first"))


def latest(updates: DataFrame) -> DataFrame:
    """The last state of each row: counts only grow."""
    return updates.groupBy(*KEY).agg(F.max(F.struct("count", "first")).alias("s")).select(*KEY, "s.count", "s.first")


def findings(state: DataFrame) -> DataFrame:
    """Findings of a state: merged evidence, and the roll-up of contacts by file and kind."""
    direct = state.filter(F.col("kind") == "finding").select(
        "check_id", "file", "first.location", F.col("what").alias("evidence"), "first.detail", "count", "first.confidence_score",
    )
    contacts = state.filter(F.col("kind") != "finding").select(
        "file", "kind", F.col("what").alias("value"), "first.item_idx", "first.k", "first.location", "first.detail"
    )
    return direct.unionByName(FN.insert(rollup.bulk_contacts(contacts)).drop("ord"))
