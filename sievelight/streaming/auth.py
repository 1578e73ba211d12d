"""Login correlation on an unbounded stream of login events.

`correlate` keeps, per account or address and file, the latest events and which
rules have fired, works out the rules over whole columns of events, and gives the findings of the batch operator as soon as
they arise.  `sliding_failures` is the cheaper, approximate form: failure counts
in fixed sliding windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.auth import (
    CONFIDENCE, FAILURES_BEFORE_SUCCESS, HISTORY_EVENTS, HISTORY_SECONDS, PEER_THRESHOLD, PEER_WINDOW, WINDOWS,
    keyed_events,
)

OUTPUT = (
    "file string, key_type string, key string, check_id string, item_idx bigint, location string, evidence string, "
    "detail string, count bigint, confidence_score double"
)
STATE = "us array<bigint>, fail array<boolean>, peer array<string>, fired array<string>"
US = 1_000_000


class _Events:
    """The kept and the new events of one key in the order of their lines, as columns.

    Times that fall begin a new run, and no rule looks beyond its run: the events an
    event can look back on are a stretch of rows that ends with it.
    """

    def __init__(self, us: np.ndarray, fail: np.ndarray, peer: np.ndarray) -> None:
        self.us, self.fail, self.peer = us, fail, peer
        self.failures = np.r_[0, np.cumsum(fail)]
        falls = np.r_[True, us[1:] < us[:-1]] if len(us) else np.zeros(0, bool)
        self.run = np.cumsum(falls)
        self.run_start = np.flatnonzero(falls)[self.run - 1] if len(us) else us
        # Runs lie apart on this axis, so that one sorted search serves all of them.
        self.axis = us - us[self.run_start] + np.r_[0, np.cumsum(np.diff(us).clip(min=0))][self.run_start] + self.run * (HISTORY_SECONDS + 1) * US

    def first(self, seconds: int, events: int) -> np.ndarray:
        """For each event the first row that lies within so many seconds and so many rows of it."""
        rows = np.arange(len(self.us))
        by_time = np.searchsorted(self.axis, self.axis - seconds * US)
        return np.maximum(np.maximum(by_time, self.run_start), rows - events)

    def failed(self, first: np.ndarray, upto: np.ndarray) -> np.ndarray:
        return self.failures[upto] - self.failures[first]


def _brute_force(events: _Events, new: np.ndarray, kind: str, key: str) -> tuple | None:
    rows = np.arange(len(events.us))
    fired = [
        (events.fail & new & (events.failed(events.first(seconds, HISTORY_EVENTS - 1), rows + 1) >= n)).nonzero()[0][:1].tolist()
        for n, seconds in WINDOWS
    ]
    found = [(at[0], i) for i, at in enumerate(fired) if at]
    if not found:
        return None
    at, i = min(found)
    return at, "LOG-BRUTEFORCE", f"{WINDOWS[i][0]} failures in {WINDOWS[i][1]}s for {kind} {key}", WINDOWS[i][0]


def _success(events: _Events, new: np.ndarray, success: np.ndarray, key: str) -> tuple | None:
    rows, first = np.arange(len(events.us)), events.first(HISTORY_SECONDS, HISTORY_EVENTS)
    for at in np.flatnonzero(success & new & (events.failed(first, rows) >= FAILURES_BEFORE_SUCCESS)).tolist():
        stretch = slice(first[at], at)
        same = events.fail[stretch] & ((events.peer[stretch] == events.peer[at]) | (events.peer[at] is None))
        if (n := int(same.sum())) >= FAILURES_BEFORE_SUCCESS:
            return at, "LOG-FAIL-SUCCESS", f"{n} recent failures followed by success for account {key}", n + 1
    return None


def _peers(events: _Events, new: np.ndarray, kind: str) -> tuple | None:
    rows, first = np.arange(len(events.us)), events.first(PEER_WINDOW, HISTORY_EVENTS - 1)
    check, words = ("LOG-SPRAY", "accounts") if kind == "ip" else ("LOG-DISTRIBUTED", "source IPs")
    for at in np.flatnonzero(events.fail & new & (events.failed(first, rows + 1) >= PEER_THRESHOLD)).tolist():
        stretch = slice(first[at], at + 1)
        named = {p for p in events.peer[stretch][events.fail[stretch]] if p is not None}
        if len(named) >= PEER_THRESHOLD:
            return at, check, f"{len(named)} distinct {words} in 5 minutes", int(events.fail[stretch].sum())
    return None


def _update(
    group: tuple, batches: Iterable[pd.DataFrame], state: GroupState, timed: bool = False
) -> Iterator[pd.DataFrame]:
    file, kind, key = group
    us, fail, peer, fired = state.get if state.exists else ([], [], [], [])
    if state.hasTimedOut:
        # The watermark passed all that could still count; which rules fired is kept.
        state.update(([], [], [], list(fired)))
        return
    fresh = pd.concat(list(batches)).sort_values("item_idx", kind="stable")
    kept = len(us)
    names = [p if isinstance(p, str) else None for p in [*peer, *fresh["peer"]]]
    events = _Events(
        np.r_[np.array(us, dtype=np.int64), fresh["us"].to_numpy(np.int64)],
        np.r_[np.array(fail, dtype=bool), fresh["fail"].fillna(False).to_numpy(bool)], np.array(names, dtype=object),
    )
    success = np.r_[np.zeros(kept, bool), fresh["success"].fillna(False).to_numpy(bool)]
    new = np.arange(len(events.us)) >= kept
    found = [_brute_force(events, new, kind, key), _peers(events, new, kind)]
    if kind == "user":
        found.append(_success(events, new, success, key))
    rows = []
    for at, check, detail, count in sorted(f for f in found if f and f[1] not in fired):
        line = fresh.iloc[at - kept]
        rows.append((file, kind, key, check, line["item_idx"], line["location"], line["evidence"], detail, count, CONFIDENCE[check]))
    last = len(events.us) - 1
    keep = slice(max(int(events.first(HISTORY_SECONDS, HISTORY_EVENTS - 1)[last]), 0), last + 1)
    state.update(
        (events.us[keep].tolist(), events.fail[keep].tolist(), events.peer[keep].tolist(), sorted({*fired, *(r[3] for r in rows)}))
    )
    if timed:
        latest = int(events.us[keep].max()) // 1000 + HISTORY_SECONDS * 1000
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
    if rows:
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def _update_timed(group: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    return _update(group, batches, state, timed=True)


def _update_untimed(group: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    return _update(group, batches, state)


def correlate(logins: DataFrame, watermark: str | None = None) -> DataFrame:
    """Findings of the four login rules on a streaming table of logins.

    Within a micro-batch the events of a key are taken in the order of their
    lines.  With a `watermark` (such as "30 minutes") later events are dropped and
    idle histories emptied; without one nothing is dropped and the result is that
    of the batch operator, as long as lines arrive in order.  Bound the batch
    (for files: `maxFilesPerTrigger`) to bound what one key brings at a time.
    """
    keyed = keyed_events(logins).withColumn("ts", F.col("ts").cast("timestamp"))
    timeout, update = GroupStateTimeout.NoTimeout, _update_untimed
    if watermark:
        keyed = keyed.withWatermark("ts", watermark)
        timeout, update = GroupStateTimeout.EventTimeTimeout, _update_timed
    return (
        keyed.withColumn("us", F.unix_micros("ts"))
        .groupBy("file", "key_type", "key")
        .applyInPandasWithState(update, OUTPUT, STATE, "append", timeout)
    )


def sliding_failures(
    logins: DataFrame, seconds: int = WINDOWS[0][1], threshold: int = WINDOWS[0][0], slide: int = 10,
    watermark: str = "30 minutes",
) -> DataFrame:
    """Windows with at least `threshold` failures per account or address.

    Spark's own windowed aggregate with map-side combining.  Approximate: windows
    start every `slide` seconds, late events are dropped, and a window is reported
    once per update, not once per key.
    """
    keyed = keyed_events(logins).filter("fail").withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        keyed.withWatermark("ts", watermark)
        .groupBy("file", "key_type", "key", F.window("ts", f"{seconds} seconds", f"{slide} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .filter(F.col("failures") >= threshold)
        .select("file", "key_type", "key", "w", F.col("w.start").alias("window_start"), "failures")
    )


def burst_alerts(logins: DataFrame, watermark: str = "30 minutes", **window) -> DataFrame:
    """(file, key_type, key, window_start, failures): the first windows of `sliding_failures` that are complete, one a key.

    For append mode: a window is told of once the watermark has passed it, and its key not
    again before the watermark has passed that window by its delay.
    """
    counted = sliding_failures(logins, watermark=watermark, **window).withColumn("window_time", F.window_time("w")).drop("w")
    once = counted.dropDuplicatesWithinWatermark(["file", "key_type", "key"])
    return once.select("file", "key_type", "key", "window_start", "failures")
