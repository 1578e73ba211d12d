from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sievelight import catalog as CAT
from sievelight.operators import baseline as BL, enrich, report, sarif

NOW = datetime(2026, 6, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def catalog(spark):
    return CAT.tables(spark)


def findings(spark, rows):
    schema = (
        "check_id string, file string, location string, evidence string, detail string, count bigint, "
        "confidence_score double, sample_locations array<string>, pos bigint"
    )
    df = spark.createDataFrame(
        [(c, f, loc, ev, "", n, s, [loc], p) for c, f, loc, ev, n, s, p in rows], schema
    )
    return enrich.with_confidence(enrich.with_fingerprints(df)).withColumn("expired_suppression", F.lit(False))


def test_thirty_checks(catalog):
    rows = catalog.checks.collect()
    assert len(rows) == 30
    by_id = {r.check_id: r for r in rows}
    assert by_id["LOG-SPRAY"].category == by_id["LOG-BRUTEFORCE"].category
    assert by_id["LOG-SPRAY"].remediation == by_id["LOG-BRUTEFORCE"].remediation
    assert by_id["LOG-PRIV-CHANGE"].severity == "info"


def test_coverage_of_checks(catalog):
    counts = {r.check_id: r["count"] for r in catalog.coverage.groupBy("check_id").count().collect()}
    assert counts["DATA-PAN"] == 19 and counts["DATA-PHONE"] == 9 and counts["SECRET-PASSWORD"] == 20
    assert counts["LOG-SPRAY"] == counts["LOG-BRUTEFORCE"] == 19
    assert {r.id for r in CAT.uncovered_frameworks(catalog).collect()} == {"iso50001", "osha", "tcfd"}


def test_references_are_complete(catalog):
    assert sum(len(v) for v in CAT.CROSSWALK.values()) == 612
    assert catalog.check_controls.count() == 773
    rows = {(r.framework, r.pos): r.control for r in catalog.check_controls.filter("check_id = 'LOG-SPRAY'").collect()}
    assert rows["iso27017", 2] == "CLD.12.4.5" and rows["iso27001", 0] == "A.8.15" and rows["cis", 1] == "6.2"


def test_framework_names():
    assert CAT.resolve_frameworks(["PCI_DSS", "cpra", "ISO", "gdpr", "GDPR"]) == ["pci-dss", "ccpa", "iso27001", "gdpr"]
    assert len(CAT.resolve_frameworks(["gdpr", "all"])) == 23
    for bad in (["nonsense"], []):
        with pytest.raises(CAT.UnknownFramework):
            CAT.resolve_frameworks(bad)


def test_provenance(catalog):
    rows = {(r.check_id, r.framework, r.control): r for r in enrich.provenance(catalog).collect()}
    known = rows["DATA-PAN", "nist-csf", "PR.DS-01"]
    assert (known.mapping_type, known.review_status, known.independently_verified) == ("supporting", "source_reviewed", False)
    other = rows["DATA-PAN", "pci-dss", "Req 3.4.1"]
    assert (other.mapping_type, other.review_status, other.reviewed_on) == ("inferred", "unreviewed", None)
    assert sum(r.review_status == "source_reviewed" for r in rows.values()) == 9


def test_own_crosswalk(spark, tmp_path):
    rows = [("DATA-PAN", "iso27001", "A.1", 0), ("DATA-PAN", "iso27001", "A.2", 1), ("CFG-DEBUG", "tcfd", "T.1", 0)]
    given = spark.createDataFrame(rows, "check_id string, framework string, control string, pos int")
    given.write.parquet(str(tmp_path / "c.parquet"))
    given.coalesce(1).write.option("header", True).csv(str(tmp_path / "c.csv"))
    for path in ("c.parquet", "c.csv"):
        own = CAT.tables(spark, str(tmp_path / path))
        found = findings(spark, [("DATA-PAN", "f", "line 1", "e", 1, 0.65, 1)])
        row = enrich.with_mappings(found, own, ["iso27001", "gdpr"]).first()
        assert row.mappings == {"iso27001": ["A.1", "A.2"], "gdpr": ["Art. 32(1)(a)"]}
        assert {r.id for r in CAT.uncovered_frameworks(own).collect()} == {"iso50001", "osha"}


def test_crosswalk_from_an_export(spark, tmp_path):
    doc = {"findings": [{"check": "DATA-PAN", "mappings": {"cis": ["3.11"], "gdpr": ["a", "b"]}}, {"check": "DATA-PAN", "mappings": {"cis": ["3.11"]}}]}
    (tmp_path / "e.json").write_text(json.dumps(doc))
    rows = {tuple(r) for r in CAT.crosswalk_from_export(spark, str(tmp_path / "e.json")).collect()}
    assert rows == {("DATA-PAN", "cis", "3.11", 0), ("DATA-PAN", "gdpr", "a", 0), ("DATA-PAN", "gdpr", "b", 1)}


def test_baseline_by_path_name_and_expiry(spark):
    found = findings(
        spark,
        [("CFG-DEBUG", "prod/config.yml", "line 1", "debug=true", 1, 0.65, 1), ("CFG-DEBUG", "dev/config.yml", "line 1", "debug=true", 1, 0.65, 1)],
    )
    a, b = sorted(found.collect(), key=lambda r: r.file, reverse=True)
    assert a.fingerprint != b.fingerprint

    def split(entries):
        df = spark.createDataFrame(entries, "fingerprint string, expires string")
        active, suppressed = BL.split_by_baseline(found, df, NOW)
        return {r.file: r.expired_suppression for r in active.collect()}, {r.file for r in suppressed.collect()}

    assert split([(a.legacy_fingerprint, None)]) == ({}, {a.file, b.file})
    assert split([(a.fingerprint, "2020-01-01T00:00:00Z")]) == ({a.file: True, b.file: False}, set())
    assert split([(a.fingerprint, "2030-01-01T00:00:00+02:00")]) == ({b.file: False}, {a.file})
    assert split([(a.fingerprint, "2030-01-01T00:00:00")])[0][a.file] is True  # no zone
    assert split([(a.fingerprint, "soon")])[0][a.file] is True
    # The entry by path decides, even when an entry by name exists.
    assert split([(a.fingerprint, "2020-01-01T00:00:00Z"), (a.legacy_fingerprint, None)]) == ({a.file: True}, {b.file})


def test_baseline_round_trip(spark, tmp_path):
    found = findings(
        spark, [("DATA-PAN", "/r/b.txt", "line 2", "e", 1, 0.65, 2), ("DATA-PAN", "/r/a.txt", "line 1", "e", 1, 0.65, 1), ("CFG-DEBUG", "/r/z", "line 1", "x", 1, 0.65, 1)]
    )
    entries = BL.baseline_entries(found, NOW)
    document = json.loads(BL.baseline_documents(entries, NOW).first().value)
    assert document["version"] == 2
    assert [(e["check"], e["file"]) for e in document["suppressions"]] == [("CFG-DEBUG", "/r/z"), ("DATA-PAN", "/r/a.txt"), ("DATA-PAN", "/r/b.txt")]
    assert document["suppressions"][0]["expires"] is None
    document["suppressions"].append({**document["suppressions"][0], "reason": "later entry"})
    document["suppressions"].append({"check": "no id"})
    (tmp_path / "b.json").write_text(json.dumps(document))
    read = {r.fingerprint: r.reason for r in BL.read_baseline(spark, str(tmp_path / "b.json")).collect()}
    assert len(read) == 3 and "later entry" in read.values()
    assert BL.split_by_baseline(found, BL.read_baseline(spark, str(tmp_path / "b.json")), NOW)[0].isEmpty()
    (tmp_path / "x.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="not a baseline"):
        BL.read_baseline(spark, str(tmp_path / "x.json")).collect()


def test_sarif_document(spark, catalog):
    found = findings(
        spark,
        [("DATA-PAN", "/r/.env", "line 7", 'say "x"', 2, 0.9, 1), ("CFG-DEBUG", "/r/a.conf", "page 2, line 5", "debug", 1, 0.65, 1)],
    )
    full = enrich.with_mappings(found, catalog, ["gdpr"])
    document = json.loads(sarif.documents(full, catalog, ["gdpr"], "/r").first().value)
    run = document["runs"][0]
    assert document["version"] == "2.1.0"
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["DATA-PAN", "CFG-DEBUG"]
    first, second = run["results"]
    assert first["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "env"}, "region": {"startLine": 7}}
    assert second["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert first["level"] == "error" and first["properties"]["occurrenceCount"] == 2
    assert first["properties"]["mappingProvenance"]["gdpr"]["Art. 32(1)(a)"]["review_status"] == "unreviewed"
    assert run["tool"]["driver"]["rules"][0]["properties"]["security-severity"] == "9.5"


def test_documents_of_bounded_size(spark, catalog, tmp_path):
    rows = [("DATA-PAN" if i % 3 else "CFG-DEBUG", f"/r/f{i % 7}.txt", f"line {i}", f"e{i}", 1, 0.65, i) for i in range(95)]
    found = findings(spark, rows)
    texts = sarif.documents(enrich.with_mappings(found, catalog, ["gdpr"]), catalog, ["gdpr"], "/r", per_document=20).orderBy("shard").collect()
    runs = [json.loads(t.value)["runs"][0] for t in texts]
    assert [len(run["results"]) for run in runs] == [20, 20, 20, 20, 15]
    places = [(x["artifactLocation"]["uri"], x["region"]["startLine"]) for run in runs for r in run["results"]
              for x in [r["locations"][0]["physicalLocation"]]]
    assert [u for u, _ in places] == sorted(u for u, _ in places) and len(set(places)) >= 94
    assert all({r["id"] for r in run["tool"]["driver"]["rules"]} == {r["ruleId"] for r in run["results"]} for run in runs)
    BL.baseline_documents(BL.baseline_entries(found, NOW), NOW, 30).write.partitionBy("shard").text(str(tmp_path / "b"))
    assert BL.read_baseline(spark, str(tmp_path / "b")).count() == 95
    none = found.limit(0)
    empty = json.loads(sarif.documents(enrich.with_mappings(none, catalog, ["gdpr"]), catalog, ["gdpr"]).first().value)
    assert empty["runs"][0]["results"] == [] == empty["runs"][0]["tool"]["driver"]["rules"]
    assert json.loads(BL.baseline_documents(BL.baseline_entries(none, NOW), NOW).first().value)["suppressions"] == []


def test_gate_and_counts(spark, catalog):
    found = findings(spark, [("CFG-DEBUG", "f", "line 1", "e", 1, 0.65, 1)])
    assert report.gate(found, catalog, "high").first().failed is False
    assert report.gate(found, catalog, "medium").first().failed is True
    assert report.gate(found.limit(0), catalog, "info").first().failed is False
    assert {r.severity: r.findings for r in report.severity_counts(found, catalog).collect()} == {
        "critical": 0, "high": 0, "medium": 1, "low": 0, "info": 0,
    }


def test_export(spark, make_items, tmp_path):
    from sievelight.plans import export, scan as SC

    items = make_items(["4111 1111 1111 1111", "debug = true"])
    result = SC.scan_items(items, SC.Options(now=NOW, frameworks=["gdpr", "soc2"]))
    export.write(result, str(tmp_path / "out"))
    header = json.loads(spark.read.text(str(tmp_path / "out/header")).first().value)
    assert header["frameworks"] == ["gdpr", "soc2"] and header["coverage"] == {"fully_scanned": 1}
    rows = spark.read.json(str(tmp_path / "out/findings")).collect()
    assert {r.check for r in rows} == {"DATA-PAN", "CFG-DEBUG"}
    accepted = BL.read_baseline(spark, str(tmp_path / "out/baseline"))
    again = SC.scan_items(items, SC.Options(now=NOW, frameworks=["gdpr", "soc2"], baseline=accepted))
    assert again.findings.isEmpty() and again.suppressed.count() == 2
    assert spark.read.parquet(str(tmp_path / "out/report/severity_counts")).count() == 5
