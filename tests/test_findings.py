from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievelight import catalog as CAT
from sievelight.operators import enrich, findings as FN, rollup
from sievelight.sources import tables

RAW = "check_id string, file string, location string, evidence string, detail string, count bigint, confidence_score double, item_idx bigint, k int"


def frame(spark, rows):
    df = spark.createDataFrame(
        [tuple(r[c.split()[0]] for c in RAW.split(", ")) for r in rows], RAW
    ).repartition(8)
    return df.withColumn("ord", FN.order_key(0, F.col("item_idx"), F.lit(0), F.col("k"))).drop("item_idx", "k")


def random_rows(seed, n, files=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4  # one piece of evidence takes a large share
        rows.append(
            {
                "check_id": "CFG-DEBUG" if hot else rng.choice(["CFG-DEBUG", "DATA-PAN", "DATA-SSN"]),
                "file": "f0" if hot else f"f{rng.randrange(files)}", "location": f"line {i}",
                "evidence": "hot" if hot else f"e{rng.randrange(60)}", "detail": f"d{rng.randrange(3)}",
                "count": rng.choice([1, 1, 1, 4]), "confidence_score": rng.choice([0.4, 0.65, 0.9]), "item_idx": i // 2, "k": i % 2,
            }
        )
    return rows


def merged(rows):
    """One row for all of a kind: the first one, with all counts and the first five places."""
    kinds = [(r["file"], r["check_id"], r["evidence"], r["detail"] * (r["count"] > 1)) for r in rows]
    firsts = [i for i, kind in enumerate(kinds) if kind not in kinds[:i]]
    same = {i: [r for r, kind in zip(rows, kinds) if kind == kinds[i]] for i in firsts}
    return [{**rows[i], "count": sum(r["count"] for r in same[i]), "samples": [r["location"] for r in same[i]][:5]} for i in firsts]


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(FN, "CHUNK", 16)
    monkeypatch.setattr(FN, "RANK_RUN", 64)


@pytest.mark.parametrize("steps", [2, 0])
def test_merge(spark, small_chunks, monkeypatch, steps):
    monkeypatch.setattr(FN, "MERGE_STEPS", steps)
    rows = random_rows(1, 1500)
    got = {
        (r.file, r.check_id, r.evidence, r.detail if r["count"] > 1 and r.evidence is None else r.location): (
            r["count"], r.confidence_score, r.detail, tuple(r.sample_locations),
        )
        for r in FN.merge(frame(spark, rows)).collect()
    }
    want = {
        (v["file"], v["check_id"], v["evidence"], v["location"]): (
            v["count"], v["confidence_score"], v["detail"], tuple(v["samples"]),
        )
        for v in merged(rows)
    }
    assert got == want


def test_rank_is_the_order_of_first_occurrence(spark, small_chunks):
    rows = random_rows(2, 1200)
    ranked = FN.rank_in_file(FN.merge(frame(spark, rows))).collect()
    for file in ("f0", "f1", "f2"):
        want = [v["location"] for v in merged(rows) if v["file"] == file]
        got = [r.location for r in sorted((r for r in ranked if r.file == file), key=lambda r: r.pos)]
        assert got == want
        assert sorted(r.pos for r in ranked if r.file == file) == list(range(1, len(want) + 1))


def one_check(n, file="test.conf"):
    return [
        {
            "check_id": "CFG-DEBUG", "file": file, "location": f"line {i}", "evidence": f"debug=true # {i}", "detail": "",
            "count": 1, "confidence_score": 0.65, "item_idx": i, "k": 0,
        }
        for i in range(n)
    ]


def test_file_limit_reports_what_it_leaves_out(spark):
    out = FN.limit_per_file(FN.merge(frame(spark, one_check(100))), 2).orderBy("pos").collect()
    assert [r["count"] for r in out] == [1, 1, 98]
    assert out[-1].location == "additional locations" and out[-1].confidence_score == 0.4


def test_kept_findings_keep_counting(spark):
    rows = one_check(3) + [{**one_check(1)[0], "item_idx": 50 + i, "location": f"later {i}"} for i in range(7)]
    out = FN.limit_per_file(FN.merge(frame(spark, rows)), 2).orderBy("pos").collect()
    assert [r["count"] for r in out] == [8, 1, 1]


def test_scan_limit(spark):
    rows = [r for i in range(20) for r in one_check(1, f"f{i:02}.conf")]
    out = FN.limit_per_scan(FN.limit_per_file(FN.merge(frame(spark, rows))), 2).collect()
    assert len(out) == 3
    (rest,) = [r for r in out if r.file == "(scan-wide)"]
    assert rest["count"] == 18
    assert {r.file for r in out} == {"f00.conf", "f01.conf", "(scan-wide)"}


def test_scan_limit_within_a_file(spark):
    rows = one_check(5, "a") + one_check(5, "b") + one_check(5, "c")
    out = FN.limit_per_scan(FN.limit_per_file(FN.merge(frame(spark, rows))), 7).collect()
    assert sorted((r.file, r["count"]) for r in out) == [("(scan-wide)", 8)] + [("a", 1)] * 5 + [("b", 1)] * 2


def test_limits_lose_no_occurrence(spark, small_chunks):
    rows = random_rows(5, 2000)
    total = sum(r["count"] for r in rows)
    limited = FN.limit_per_file(FN.merge(frame(spark, rows)), 9)
    assert limited.agg(F.sum("count")).first()[0] == total
    assert FN.limit_per_scan(limited, 11).agg(F.sum("count")).first()[0] == total


def test_relevance_and_fingerprints(spark):
    rows = [
        {**one_check(1)[0], "file": "prod/config.yml", "evidence": "debug=true"},
        {**one_check(1)[0], "file": "dev/config.yml", "evidence": "debug=true"},
        {**one_check(1)[0], "file": "x", "check_id": "DATA-PHONE"},
    ]
    catalog = CAT.tables(spark)
    found = enrich.with_fingerprints(frame(spark, rows))
    same = found.filter("check_id = 'CFG-DEBUG'")
    assert same.select("fingerprint").distinct().count() == 2
    assert same.select("legacy_fingerprint").distinct().count() == 1
    kept = enrich.keep_relevant(found, catalog, ["sox", "hipaa"])
    assert kept.count() == 0
    assert enrich.keep_relevant(found, catalog, ["ccpa"]).select("check_id").collect()[0][0] == "DATA-PHONE"


@pytest.mark.parametrize(
    ("paths", "root"),
    [(["/a/b/c.log", "/a/b/d/e.log"], "/a/b"), (["/a/b.log"], "/a"), (["/a/b", "/ab/c"], ""), (["/a/bc/x", "/a/b/x"], "/a")],
)
def test_common_root(spark, paths, root):
    df = spark.createDataFrame([(p,) for p in paths], "file string")
    assert enrich.common_root(df).first().root == root


def test_contact_cap(spark):
    rows = [("f", "email", f"u{i}@x", i, 0, f"line {i}", "m") for i in range(30)]
    signals = spark.createDataFrame(rows, "file string, kind string, value string, item_idx bigint, k int, location string, detail string")
    row = rollup.bulk_contacts(signals, cap=20).first()
    assert (row.detail, row["count"], row.location) == ("at least 20 unique email addresses in file", 20, "line 0")


def test_cell_limit(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for path in ("a", "b"):
        n = 0
        for r in range(200):
            for nth in range(1, rng.randint(1, 6)):
                n += 1
                rows.append((path, 0 if r < 90 else 1, r, nth, f"{path}{r}.{nth}"))
                if n <= 137:
                    want.setdefault(path, set()).add(f"{path}{r}.{nth}")
    rows += [("small", 0, 0, 1, "s")]
    want["small"] = {"s"}
    df = spark.createDataFrame(rows, "path string, block bigint, row bigint, nth int, text string").repartition(4)
    place = ["block", "row"]
    counts = df.groupBy("path", *place).agg(F.count(F.lit(1)).alias("n"))
    edges = tables.cell_edges(counts, "path", place, 137)
    assert {r.path for r in edges.collect()} == {"a", "b"}
    got: dict[str, set] = {}
    for r in tables.within_edges(df, edges, "path", place).collect():
        got.setdefault(r.path, set()).add(r.text)
    assert got == want
