from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievelight.operators import auth, rollup
from sievelight.session import spread
from sievelight.streaming import auth as stream_auth, lines as stream_lines

SCHEMA = (
    "file string, item_idx bigint, location string, evidence string, user string, ip string, ts timestamp_ntz, "
    "fail boolean, success boolean"
)


def history(seed: int, n: int = 260) -> list[dict]:
    """Events with ties, gaps, backward steps and missing parts."""
    rng = random.Random(seed)
    at = datetime(2026, 3, 1, 10)
    users, ips = rng.randint(1, 7), rng.randint(1, 7)
    events = []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 0, 1, 2, 5, 20, 70, 400, -1, -300] if seed % 3 else [0, 1, 1, 2]))
        if rng.random() < 0.01:
            at += timedelta(seconds=rng.choice([1799, 1801, 86400]))
        fail = rng.random() < 0.75
        events.append(
            {
                "n": i + 1, "user": f"u{rng.randrange(users)}" if rng.random() > 0.1 else None,
                "ip": f"10.0.0.{rng.randrange(ips)}" if rng.random() > 0.1 else None, "ts": at, "fail": fail,
                "success": not fail or rng.random() < 0.03,
            }
        )
    return events


def rows(file: str, events: list[dict]) -> list[tuple]:
    return [
        (file, e["n"], f"line {e['n']}", "x", e["user"], e["ip"], e["ts"], e["fail"], e["success"]) for e in events
    ]


FILES = {f"h{s}.log": history(s) for s in range(40)}
FILES["hot.log"] = history(3, 3000)  # a single key meets thousands of events
FILES["hot2.log"] = history(6, 3000)


@pytest.fixture(scope="module")
def logins(spark):
    data = [r for file, events in FILES.items() for r in rows(file, events)]
    return spark.createDataFrame(data, SCHEMA).repartition(8).cache()


def shown(df):
    out: dict[str, list] = {f: [] for f in FILES}
    for r in df.collect():
        out[r.file].append((r.check_id, int(r.location.split()[1]), r.detail, r["count"]))
    return {f: sorted(v) for f, v in out.items()}


def of_one_key(kind: str, key: str, own: list[dict]) -> list[tuple]:
    """What the rules say of one account or address, each event looked at by itself."""
    peer = "ip" if kind == "user" else "user"
    found = []
    for i, e in enumerate(own):
        if i == 0 or e["ts"] < own[i - 1]["ts"]:
            begin = i  # a time that falls starts the history anew

        def back(seconds, rows, upto):
            return [x for x in own[max(begin, upto - rows) : upto] if (e["ts"] - x["ts"]).total_seconds() <= seconds and x["fail"]]

        earlier = [x for x in back(1800, 200, i) if e["ip"] in (None, x["ip"])]
        if kind == "user" and e["success"] and len(earlier) >= 3:
            text = f"{len(earlier)} recent failures followed by success for account {key}"
            found.append(("LOG-FAIL-SUCCESS", e["n"], text, len(earlier) + 1))
        if e["fail"]:
            counts = [(len(back(seconds, 200, i + 1)), need, seconds) for need, seconds in ((5, 60), (10, 300), (20, 1800))]
            hit = next(((n, seconds) for n, need, seconds in counts if n >= need), None)
            if hit:
                found.append(("LOG-BRUTEFORCE", e["n"], f"{hit[0]} failures in {hit[1]}s for {kind} {key}", hit[0]))
            recent = back(300, 200, i + 1)
            names = {x[peer] for x in recent} - {None}
            if len(names) >= 5:
                check, what = {"ip": ("LOG-SPRAY", "accounts"), "user": ("LOG-DISTRIBUTED", "source IPs")}[kind]
                found.append((check, e["n"], f"{len(names)} distinct {what} in 5 minutes", len(recent)))
    firsts: dict[str, tuple] = {}
    for f in found:
        firsts.setdefault(f[0], f)
    return list(firsts.values())


def expected_findings(events: list[dict]) -> list[tuple]:
    keys = sorted({(kind, e[kind]) for e in events for kind in ("user", "ip") if e[kind]})
    return sorted(f for kind, key in keys for f in of_one_key(kind, key, [e for e in events if e[kind] == key]))


WANT = {file: expected_findings(events) for file, events in FILES.items()}


def test_the_histories_fire_every_rule():
    assert {c for v in WANT.values() for c, *_ in v} == {"LOG-BRUTEFORCE", "LOG-FAIL-SUCCESS", "LOG-SPRAY", "LOG-DISTRIBUTED"}
    assert sum(map(len, WANT.values())) > 200


@pytest.mark.parametrize(("line_run", "block"), [(1 << 16, 1 << 12), (64, 201), (1000, 512)])
def test_correlation_like_brute_force(logins, line_run, block):
    assert shown(auth.correlate(logins, line_run=line_run, block=block)) == WANT


def test_blocks_bound_what_one_task_sees(logins):
    placed = auth.place_events(auth.keyed_events(logins), 64, 256)
    sizes = placed.groupBy("file", "key_type", "key", "block").count().agg(F.max("count")).first()[0]
    assert sizes <= 256 + auth.HISTORY_EVENTS
    own = placed.filter("own").groupBy("file", "key_type", "key", "p").count().filter("count > 1")
    assert own.isEmpty()


def test_a_block_must_hold_the_history(logins):
    with pytest.raises(ValueError):
        auth.correlate(logins, block=200)


def test_stream_like_the_batch(spark, logins, tmp_path):
    source = str(tmp_path / "in")
    # Three files of the stream, in order of lines.
    for part in range(3):
        some = logins.filter(F.floor(F.col("item_idx") / 1001) == part)
        some.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(logins.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = stream_lines.run_available(stream_auth.correlate(stream))
    assert shown(got) == WANT


def test_stream_with_watermark_runs(spark, logins, tmp_path):
    source = str(tmp_path / "in")
    logins.filter("file = 'h0.log'").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(logins.schema).parquet(source)
    got = stream_lines.run_available(stream_auth.correlate(stream, watermark="30 minutes"))
    assert shown(got)["h0.log"] == WANT["h0.log"]


def test_spaced_and_burst_failures(spark):
    def events(step):
        at = datetime(2026, 9, 28, 12)
        return [
            {"n": i + 1, "user": "alice", "ip": "10.0.0.1", "ts": at + i * step, "fail": True, "success": False}
            for i in range(5)
        ]

    data = rows("spaced.log", events(timedelta(minutes=10))) + rows("burst.log", events(timedelta(seconds=1)))
    found = auth.correlate(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.file for r in found} == {"burst.log"}
    assert {r.confidence_score for r in found} == {0.9}


def test_failures_without_a_time(spark):
    base = {"ts": None, "fail": True, "success": False}
    events = [{**base, "n": i, "user": None, "ip": ip} for i, ip in enumerate(["1.1.1.1"] * 5 + [None] * 6)]
    events += [{**base, "n": 50, "user": "u", "ip": "1.1.1.1"}]
    found = rollup.untimed_failures(spark.createDataFrame(rows("u.log", events), SCHEMA)).collect()
    assert {(r.detail.split(";")[0], r["count"], r.confidence_score) for r in found} == {
        ("5 failures for 1.1.1.1", 5, 0.4), ("6 failures for (unattributed)", 6, 0.4),
    }


def test_events_are_sorted_in_as_many_tasks_as_they_ask_for(logins, monkeypatch):
    expected = shown(auth.correlate(logins))
    monkeypatch.setattr(auth, "TASK_EVENTS", 500)
    found = auth.correlate(logins)
    keyed = auth.keyed_events(logins).count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert keyed > 8 * 500 and plan.count(f", {-(-keyed // 500)}), REPARTITION_BY_NUM") == 2
    assert shown(found) == expected


def test_a_table_of_many_short_rows_goes_to_more_tasks_than_there_are_cores(spark):
    table = spark.range(5000).coalesce(1)
    assert spread(table).rdd.getNumPartitions() == 8 and spread(table, 100).rdd.getNumPartitions() == 50
    assert spread(spark.range(5000).repartition(60), 100).rdd.getNumPartitions() == 60
