"""Login events related in time: brute force, spraying, distributed attacks, success after failures.

Each event counts for its account and for its address.  Per key the rules look
at the latest 200 events of at most half an hour; an event older than the one
before it starts the key's history anew, and each rule fires once per key and
file.

One account or address may hold a third of all events, so no key is handled in
one task.  Events get a position within their key from counts per run of lines;
positions are cut into blocks, and the last 200 events of a block are repeated
at the head of the next, which is all the history a rule may look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import parts_for
from . import findings as FN

# --- Fixed values: windows, thresholds, wording and confidence ---------------
WINDOWS = ((5, 60), (10, 300), (20, 1800))
HISTORY_SECONDS = 1800
HISTORY_EVENTS = 200
PEER_WINDOW = 300
PEER_THRESHOLD = 5
FAILURES_BEFORE_SUCCESS = 3
CONFIDENCE = {"LOG-FAIL-SUCCESS": 0.9, "LOG-BRUTEFORCE": 0.9, "LOG-SPRAY": 0.85, "LOG-DISTRIBUTED": 0.85}

LINE_RUN = 1 << 16  # lines per run when positions are counted
BLOCK = 1 << 12  # events per block and key
TASK_EVENTS = 1 << 16  # keyed events that one task sorts


def keyed_events(logins: DataFrame) -> DataFrame:
    """Timed events, once per account and once per address: (file, item_idx, location, evidence,
    key_type, key, peer, ip, ts, fail, success)."""
    keys = F.array(
        F.struct(
            F.lit("user").alias("key_type"), F.col("user").alias("key"), F.col("ip").alias("peer"),
            F.lit(0).alias("slot"),
        ),
        F.struct(
            F.lit("ip").alias("key_type"), F.col("ip").alias("key"), F.col("user").alias("peer"),
            F.lit(1).alias("slot"),
        ),
    )
    return (
        logins.filter(F.col("ts").isNotNull())
        .select("file", "item_idx", "location", "evidence", "ip", "ts", "fail", "success", F.inline(keys))
        .filter(F.col("key").isNotNull())
    )


def place_events(keyed: DataFrame, line_run: int = LINE_RUN, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Give each event its position in its key's history and the blocks it is needed in.

    Keys that cannot fire any rule (too few failures) are left out here.  With `parts`,
    events are sorted in so many parts, else in as many as the session sets.
    """
    key = ["file", "key_type", "key"]
    runs = keyed.withColumn("_run", F.floor(F.col("item_idx") / line_run))
    dealt = runs if parts is None else runs.repartition(parts, *key, "_run")
    ahead = Window.partitionBy(*key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    totals = (
        runs.groupBy(*key, "_run")
        .agg(
            F.count(F.lit(1)).alias("_n"), F.count_if("fail").alias("_fails"), F.count_if("success").alias("_wins")
        )
        .select(
            *key, "_run", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
            F.sum("_fails").over(whole).alias("_all_fails"), F.sum("_wins").over(whole).alias("_all_wins"),
        )
        .filter(
            (F.col("_all_fails") >= min(n for n, _ in WINDOWS))
            | ((F.col("_all_fails") >= FAILURES_BEFORE_SUCCESS) & (F.col("_all_wins") > 0))
        )
        .select(*key, "_run", "_before")
    )
    inside = Window.partitionBy(*key, "_run").orderBy("item_idx")
    placed = dealt.join(totals, [*key, "_run"]).withColumn(
        "p", F.col("_before") + F.row_number().over(inside) - 1
    )
    own = F.floor(F.col("p") / block)
    return placed.drop("_run", "_before").withColumn(
        "block",
        F.explode(
            F.when((F.col("p") % block) >= block - HISTORY_EVENTS, F.array(own, own + 1)).otherwise(F.array(own))
        ),
    ).withColumn("own", F.col("block") == F.floor(F.col("p") / block))


def correlate(logins: DataFrame, line_run: int = LINE_RUN, block: int = BLOCK) -> DataFrame:
    """Raw findings of the four rules.  `logins` is read three times: stage it first when it is costly.

    Its rows are counted first, so that a task sorts `TASK_EVENTS` at most, however many there are.
    """
    if block <= HISTORY_EVENTS:
        raise ValueError(f"block must exceed {HISTORY_EVENTS}")
    key = ["file", "key_type", "key"]
    keyed = keyed_events(logins)
    rows = logins.agg(F.count_if(F.col("ts").isNotNull() & F.col("user").isNotNull()) + F.count_if(F.col("ts").isNotNull() & F.col("ip").isNotNull()))
    parts = parts_for(rows.first()[0], TASK_EVENTS)
    placed = place_events(keyed, line_run, block, parts).repartition(parts, *key, "block")

    def ago(seconds: int) -> Column:
        return F.col("ts") - F.expr(f"INTERVAL '{seconds}' SECOND")

    by_block = Window.partitionBy(*key, "block").orderBy("p")
    step_back = F.coalesce(F.col("ts") < F.lag("ts").over(by_block), F.lit(False))
    events = placed.withColumn("run", F.sum(step_back.cast("int")).over(by_block)).withColumns(
        {"_peer_from": ago(PEER_WINDOW), "_history_from": ago(HISTORY_SECONDS)}
    )

    # The n-th failure back lies in the window exactly when n failures do: times
    # never fall within a run.
    fails = Window.partitionBy(*key, "block", "run", "fail").orderBy("p")
    brute = F.lit(None).cast("struct<n:int,seconds:int>")
    for n, seconds in reversed(WINDOWS):
        reached = (
            F.col("fail")
            & (F.lag("ts", n - 1).over(fails) >= ago(seconds))
            & (F.col("p") - F.lag("p", n - 1).over(fails) < HISTORY_EVENTS)
        )
        brute = F.when(reached, F.struct(F.lit(n).alias("n"), F.lit(seconds).alias("seconds"))).otherwise(brute)

    # Failures among the 200 events before this one and the event itself.
    history = Window.partitionBy(*key, "block", "run").orderBy("p").rowsBetween(-HISTORY_EVENTS, 0)
    failures = F.collect_list(F.when(F.col("fail"), F.struct("p", "ts", "peer"))).over(history)
    seen = events.withColumn("_brute", brute).withColumn("_failures", failures).filter("own")

    before_success = F.when(
        F.col("success") & (F.col("key_type") == "user"),
        F.size(
            F.filter(
                "_failures",
                lambda e: (e["p"] < F.col("p"))
                & (e["ts"] >= F.col("_history_from"))
                & (F.col("ip").isNull() | F.coalesce(e["peer"] == F.col("ip"), F.lit(False))),
            )
        ),
    ).otherwise(0)
    # Five failures in the window come before five peers.
    recent = F.when(
        F.col("fail") & (F.size("_failures") >= PEER_THRESHOLD),
        F.filter(
            "_failures", lambda e: (e["p"] > F.col("p") - HISTORY_EVENTS) & (e["ts"] >= F.col("_peer_from"))
        ),
    ).otherwise(F.array().cast("array<struct<p:bigint,ts:timestamp_ntz,peer:string>>"))
    scored = seen.select(
        *key, "slot", "item_idx", "location", "evidence", "_brute", before_success.alias("_before"),
        recent.alias("_recent_failures"),
    ).select(
        *key, "slot", "item_idx", "location", "evidence", "_brute", "_before",
        F.size("_recent_failures").alias("_recent"),
        F.size(
            F.array_distinct(
                F.filter(F.transform("_recent_failures", lambda e: e["peer"]), lambda p: p.isNotNull())
            )
        ).alias("_peers"),
    )
    text = lambda c: c.cast("string")
    user_key = F.col("key_type") == "user"
    fired = F.array_compact(
        F.array(
            F.when(
                F.col("_before") >= FAILURES_BEFORE_SUCCESS,
                F.struct(
                    F.lit(0).alias("rule"), F.lit("LOG-FAIL-SUCCESS").alias("check_id"),
                    F.concat(
                        text(F.col("_before")), F.lit(" recent failures followed by success for account "), "key"
                    ).alias("detail"),
                    (F.col("_before") + 1).alias("count"),
                ),
            ),
            F.when(
                F.col("_brute").isNotNull(),
                F.struct(
                    F.lit(1).alias("rule"), F.lit("LOG-BRUTEFORCE").alias("check_id"),
                    F.concat(
                        text(F.col("_brute.n")), F.lit(" failures in "), text(F.col("_brute.seconds")),
                        F.lit("s for "), "key_type", F.lit(" "), "key",
                    ).alias("detail"),
                    F.col("_brute.n").alias("count"),
                ),
            ),
            F.when(
                F.col("_peers") >= PEER_THRESHOLD,
                F.struct(
                    F.lit(2).alias("rule"),
                    F.when(user_key, "LOG-DISTRIBUTED").otherwise("LOG-SPRAY").alias("check_id"),
                    F.concat(
                        text(F.col("_peers")), F.lit(" distinct "),
                        F.when(user_key, "source IPs").otherwise("accounts"), F.lit(" in 5 minutes"),
                    ).alias("detail"),
                    F.col("_recent").alias("count"),
                ),
            ),
        )
    )
    first = (
        scored.select(*key, "slot", "item_idx", "location", "evidence", F.inline(fired))
        .groupBy(*key, "check_id")
        .agg(F.min(F.struct("item_idx", "slot", "rule", "location", "evidence", "detail", "count")).alias("f"))
    )
    score = F.lit(None).cast("double")
    for check_id, confidence in CONFIDENCE.items():
        score = F.when(F.col("check_id") == check_id, confidence).otherwise(score)
    return first.select(
        "check_id", "file", "f.location", "f.evidence", "f.detail", F.col("f.count").cast("bigint").alias("count"),
        score.alias("confidence_score"),
        FN.order_key(0, F.col("f.item_idx"), 60 + F.col("f.slot"), F.col("f.rule")).alias("ord"),
    )
