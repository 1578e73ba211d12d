from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sievelight.operators import ruletable

LITERALS = {
    r"\bword\b": "word", "abc": "abc", "ab": None, "abc|def": None, "(abc|def)ghij": "ghij", "abc(def)?ghi": "abc", "abcd?efg": "abc",
    "abcd+efg": "abcd", "abcd*": "abc", "abcd{0,3}xyz": "abc", "a.bcd$": "bcd", r"x\.yz\d+end": "x.yz", "[abc]def[]x]ghij": "ghij",
    "[^]]abc": "abc", r"[\]x]abcd": "abcd", "(?i)Hello": "hello", "(?x)a b c": None, r"\Qa|b\E": None, "naïve": None, "": None, "a{2}bcd": "bcd",
    "((abc)d)efg": "efg", "Api[_-]?Key": "api", "[a&&[bc]]xyz": "xyz", "tok\\tabc": "tok",
}


@pytest.mark.parametrize("pattern", sorted(LITERALS))
def test_required_literal(pattern):
    assert ruletable.required_literal(pattern) == LITERALS[pattern]


def test_rules_of_a_table(spark, make_items, monkeypatch):
    texts = ["Hello there World", "nothing", "x1 y22", "the WORLD of hello", "api-key = 3", "ſtraße world", "", "worldly hello_"]
    rules = [("A", "hello", ""), ("B", r"\bworld\b", "w"), ("C", r"\d\d", ""), ("D", "api[_-]?key", "k"), ("E", "absent", ""), ("A", "hello", ""),
             ("F", "^the|key", ""), ("G", "there world$", None)]
    table = spark.createDataFrame(rules, "check_id string, pattern string, detail string")
    want = sorted(
        (i, check, detail or "") for check, pattern, detail in set(rules) for i, t in enumerate(texts, 1) if re.search(pattern, t.strip(), re.I)
    )
    for chars in (1 << 20, 30):
        monkeypatch.setattr(ruletable, "SENT_CHARS", chars)
        got = ruletable.rule_signals(make_items(texts), table, year=2026).collect()
        assert sorted((r.item_idx, r.check_id, r.detail) for r in got) == want
    assert {r.kind for r in got} == {"finding"} and {r.evidence for r in got if r.check_id == "D"} == {"api-key = *"}
    assert ruletable.rule_signals(make_items(texts), table.limit(0), year=2026).isEmpty()


def test_rules_of_a_table_in_a_scan(spark, make_items):
    from sievelight.plans.scan import Options, scan_items

    table = spark.createDataFrame([("OWN-1", "secret plan", "a plan"), ("OWN-2", r"\?$", None)], "check_id string, pattern string, detail string")
    found = scan_items(make_items(["the Secret Plan", "why?", "no"]), Options(frameworks=["gdpr"], rule_table=table)).findings.collect()
    assert sorted((r.check_id, r.severity, r.location) for r in found) == [("OWN-1", "medium", "line 1"), ("OWN-2", "medium", "line 2")]


def test_words_are_told_without_their_patterns(spark, make_items):
    texts = ["the world of hello_", "Straße, hello", "über ber", "ber\u0301 x", "e\u0301ber", "\u212aelvin world\u00d7two", "日本world", "world日本 world",
             "\u3000ſtar\u3000", "b\u00fcrgerworld", "hello-world", "x world\u200d", "world٣ٳ", "WORLD", "1world two2 two", "", "mıx wórld"]
    words = ["world", "hello", "ber", "hello_", "kelvin", "two", "star", "mix", "rld", "rgerworld"]
    rules = spark.createDataFrame([(w.upper(), rf"\b{w}\b", "") for w in words], "check_id string, pattern string, detail string")
    items = make_items(texts)
    found = ruletable.rule_signals(items, rules, year=2026)
    plain = F.octet_length("t") == F.char_length("t")
    hit = F.regexp_like("t", F.concat(F.when(plain, "(?id)").otherwise("(?iUd)"), "pattern"))
    want = items.withColumn("t", F.btrim("text", F.lit(" \u3000"))).crossJoin(rules).filter(hit)
    assert sorted(found.select("item_idx", "check_id").collect()) == sorted(want.select("item_idx", "check_id").collect())
    index = {w: [i] for i, w in enumerate(words)}
    tell = lambda t: ruletable._candidates(t, index, ruletable._automaton(index), ruletable._automaton({}))
    assert tell("the world of otherworldly hello, über") == ([0, 1], [])
    assert tell("日本world") == ([], [0, 8]) and tell("日本world world") == ([0], [8])


def test_two_tables_in_one_session(spark, make_items):
    texts = ["hello there", "the world", "api-key = 3", "x1 y22"]
    schema = "check_id string, pattern string, detail string"
    first = [("A", "hello", ""), ("B", r"\bworld\b", ""), ("C", r"\d\d", "")]
    second = [("D", "there", ""), ("E", r"\bthe\b", ""), ("F", "api-key", ""), ("G", r"\d\d", "")]
    # Workers are used again by the next search; each has to meet its own rules.
    for rules, want in ((first, [(1, "A"), (2, "B"), (4, "C")]), (second, [(1, "D"), (2, "E"), (3, "F"), (4, "G")])) * 2:
        got = ruletable.rule_signals(make_items(texts), spark.createDataFrame(rules, schema), year=2026).collect()
        assert sorted((r.item_idx, r.check_id) for r in got) == want
