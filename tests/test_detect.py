from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

import expected
from sievelight.functions import text as X
from sievelight.operators import config_tree, detect
from sievelight.plans import feeds
from sievelight.sources import settings as S

SMALL = "/root/testdata/sf0.001"


def found(items, families):
    rows = detect.signals(items, year=2026, families=families).filter(F.col("kind") == "finding").collect()
    return rows


def test_content_rules(make_items):
    lines = [*expected.CONTENT, *expected.CLEAN]
    got: dict[int, list] = {}
    for r in found(make_items(lines), ("content",)):
        got.setdefault(r.item_idx, []).append((r.check_id, r.evidence, r.detail))
    assert {lines[i - 1]: sorted(hits) for i, hits in got.items()} == expected.CONTENT
    assert {c for rows in expected.CONTENT.values() for c, _, _ in rows} == {
        "DATA-PAN", "DATA-SSN", "DATA-MRN", "SECRET-PRIVKEY", "SECRET-CLOUD-KEY", "SECRET-PASSWORD", "SECRET-HIGH-ENTROPY",
    }


def test_findings_in_documents_are_masked(spark):
    """Evidence stays short, is a part of its line but for what is masked, and shows no card, number or key."""
    items = feeds.document_items(spark, SMALL)
    lines = {(r.file, r.item_idx): r.text for r in items.collect()}
    rows = found(items, ("content",))
    assert len(rows) > 5
    for r in rows:
        line = lines[r.file, r.item_idx]
        if r.check_id == "SECRET-PRIVKEY":
            continue
        pieces = [x for x in re.split(r"[*…]+", r.evidence) if len(x) > 8]
        assert all(p.strip() in line for p in pieces), (r.evidence, line)
        if r.check_id == "DATA-SSN":
            assert not re.search(r"\d{3}-\d{2}-\d{4}", r.evidence)


def test_masked_documents_keep_their_other_words(spark):
    items = feeds.document_items(spark, SMALL)
    rows = items.select("text", X.sanitize(F.col("text")).alias("z")).collect()
    changed = [r for r in rows if r.z != r.text[:500]]
    assert 5 < len(changed) < len(rows) / 4
    for r in changed:
        assert "*" in r.z or "[REDACTED]" in r.z
        words = [w for w in r.z.split() if w.isalpha()]
        assert all(w in r.text for w in words)


def checks(items, *families):
    return {(r.item_idx, r.check_id) for r in found(items, families)}


def test_settings_on_lines(make_items):
    lines = [
        "verify_ssl=true", "insecure_skip_verify=false", "insecure_skip_verify=true", "ssl_protocols TLSv1.2",
        "ssl_protocols SSLv3", "# debug=true", "log_level=info", "log_level = off", "retention_days=365",
        "retention_days=3655", "retention_days=400", "retention_days=4000", "min_password_length = 12",
        "min_password_length = 11", "auth_required=true anonymous_enable=true", "allow_guest: public-read",
    ]
    assert checks(make_items(lines, ftype="config"), "config") == {
        (3, "CFG-TLS-VERIFY-OFF"), (5, "CFG-WEAK-TLS"), (8, "CFG-AUDIT-OFF"), (10, "CFG-RETENTION"), (12, "CFG-RETENTION"),
        (14, "CFG-WEAK-PASS-POLICY"), (16, "CFG-ANON-ACCESS"),
    }


def test_families_by_file_type(make_items):
    lines = ["debug=true", "useradd bob"]
    assert checks(make_items(lines, ftype="log"), "config", "log") == {(2, "LOG-PRIV-CHANGE")}
    assert checks(make_items(lines, ftype="config"), "config", "log") == {(1, "CFG-DEBUG")}
    assert checks(make_items(lines, ftype="text"), "config", "log") == {(1, "CFG-DEBUG"), (2, "LOG-PRIV-CHANGE")}
    assert checks(make_items(lines, ftype="csv"), "config", "log") == set()


def test_a_failure_hides_a_change(make_items):
    lines = ["sudo: bob NOT in sudoers useradd x"]
    assert checks(make_items(lines, ftype="log"), "log") == {(1, "LOG-PRIV-FAIL")}


def test_whole_texts_and_a_limit_on_request(make_items):
    tail = "x" * 19_950 + " 4111 1111 1111 1111"
    beyond = "x" * 20_000 + " 4111 1111 1111 1111"
    items = make_items([tail, beyond])
    assert checks(items, "content") == {(1, "DATA-PAN"), (2, "DATA-PAN")}
    limited = detect.signals(items, year=2026, families=("content",), max_text=20_000).filter(F.col("kind") == "finding")
    assert {(r.item_idx, r.check_id) for r in limited.collect()} == {(1, "DATA-PAN")}


def test_parsed_settings(spark):
    doc = (
        '{"a": {"verify_ssl": false, "protocols": ["TLSv1", "SSLv3"], "min_password_length": 8}, "minlen": "8", '
        '"retention": 0.0, "tls-min-version": "TLSv1.1", "insecure-skip-verify": "yes", "x": null, "e": {}, "l": []}'
    )
    docs = spark.createDataFrame([("d.json", doc), ("bad.json", "{oops")], "file string, text string")
    rows = config_tree.settings_findings(S.flatten_json(docs)).collect()
    assert {(r.check_id, r.evidence) for r in rows} == {
        ("CFG-TLS-VERIFY-OFF", "a.verify_ssl = False"), ("CFG-WEAK-PASS-POLICY", "a.min_password_length = 8"),
        ("CFG-WEAK-TLS", "tls-min-version = TLSv1.1"), ("CFG-TLS-VERIFY-OFF", "insecure-skip-verify = yes"),
    }


def leaves(spark, rows):
    df = spark.createDataFrame(rows, "file string, format string, text string")
    out: dict[str, dict] = {}
    for r in S.flatten_json(S.as_json(df)).collect():
        out.setdefault(r.file, {})[r.path] = (r.value, r.value_type)
    return out


def test_trees_of_any_depth_and_length(spark):
    deep = '{"k":' * 50 + "1" + "}" * 50
    got = leaves(spark, [
        ("a", "json", '{"b": [1, [2, {"c": "x"}], null, true], "a": {"d": -3, "e": "é"}}'), ("none", "json", "[]"), ("n", "json", "3"),
        ("s", "json", '"s"'), ("null", "json", "null"), ("deep", "json", deep), ("long", "json", json.dumps({"l": list(range(5000))})),
        ("bad", "json", "{"),
    ])
    assert got["a"] == {"b[0]": ("1", "int"), "b[1][0]": ("2", "int"), "b[1][1].c": ("x", "string"), "b[3]": ("True", "bool"),
                        "a.d": ("-3", "int"), "a.e": ("é", "string")}
    assert got["n"] == {"": ("3", "int")} and got["s"] == {"": ("s", "string")} and not {"none", "null", "bad"} & got.keys()
    assert got["deep"] == {".".join("k" * 50): ("1", "int")}
    assert got["long"] == {f"l[{i}]": (str(i), "int") for i in range(5000)}


def test_formats_agree(spark):
    want = {"web.debug": ("True", "bool"), "web.port": ("8080", "int"), "web.rate": ("0.5", "float"), "web.hosts[1]": ("b", "string")}
    got = leaves(spark, [
        ("t", "toml", '[web]\ndebug = true\nport = 8080\nrate = 0.5\nhosts = ["a", "b"]\nsince = 2026-01-02\n'),
        ("y", "yaml", "web:\n  debug: true\n  port: 8080\n  rate: 0.5\n  hosts: [a, b]\n  since: 2026-01-02\n  none: null\n"),
        ("j", "json", '{"web": {"debug": true, "port": 8080, "rate": 0.5, "hosts": ["a", "b"]}}'),
        ("i", "ini", "[web]\ndebug = true\nport: 8080\n"), ("bad", "toml", "= ="), ("cyclic", "yaml", "&a [*a]"), ("bad2", "yaml", "a: [1"),
    ])
    for name in ("t", "y", "j"):
        assert got[name] == {**want, "web.hosts[0]": ("a", "string")}
    assert got["i"] == {"web.debug": ("true", "string"), "web.port": ("8080", "string")}
    assert not {"bad", "cyclic", "bad2"} & got.keys()


def test_custom_rules(make_items):
    rows = detect.signals(make_items(["Hello There", "bye"]), year=2026, families=(), rules=[("MINE", r"\bthere\b", "greets")])
    assert [(r.item_idx, r.check_id, r.detail) for r in rows.collect()] == [(1, "MINE", "greets")]
