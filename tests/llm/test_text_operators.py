"""Scores, languages, quality, contamination and lines: brute force on small tables, held-out results on given ones."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import contamination, languages, lines, quality, suffixtree
from sievelight.llm.common import remainder

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return (text or "").encode().lower().split()


# --- suffix tree -------------------------------------------------------------------
@pytest.mark.parametrize("share", [suffixtree.FREQUENT_SHARE, 0.01])
def test_base_scores_and_tree(odd, monkeypatch, share):
    monkeypatch.setattr(suffixtree, "FREQUENT_SHARE", share)
    marked = odd.withColumn("held_out", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))
    model = suffixtree.learn(marked.filter(~F.col("held_out")))
    given = marked.collect()
    counts = Counter(t for r in given if not r.held_out for t in [*tokens(r.text), "END"])
    n, v = sum(counts.values()), len(counts)
    got = suffixtree.score(marked, model).collect()
    assert len(got) == len(given)
    want = []
    for r in given:
        own = [*tokens(r.text), "END"]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        want.append((str(r.doc_id), len(own), sum(counts[t] > 0 for t in own), n, round(base, 5)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    for context in [*model.tree.contexts[3][:4].tolist(), 0x7A7A7A]:
        keys = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert model.tree.chance(keys).sum() == pytest.approx(1)


def test_tree_scores_new_text_of_the_kind_better(documents):
    model = suffixtree.learn(documents(["abab abab abab " * 20] * 10 + ["cdcd cdcd " * 20] * 10))
    got = {r.doc_id: r.score for r in suffixtree.score(documents(["abab abab cdcd", "acbd dbca badc"]), model).collect()}
    assert got[0] > got[1] + 5


def test_tree_without_training(odd, nothing):
    model = suffixtree.learn(nothing)
    got = suffixtree.score(odd, model)
    assert got.count() == odd.count() and got.filter("n_known > 0").isEmpty()
    assert suffixtree.score(nothing, model).isEmpty()


# --- languages ---------------------------------------------------------------------
def test_languages_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, table = languages.learn(docs.filter(remainder("doc_id", 3) != 1))
    got = languages.identify(docs, names, table).filter(remainder("doc_id", 3) == 1)
    right, total = got.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * total


def test_languages_odd_texts(documents, odd, nothing):
    train = documents([(i, t, lang, None, None, None, None, None) for i, (t, lang) in enumerate(
        [("the thing that there is the other", "en"), ("und die der das ist nicht auf", "de"), (None, "fr"), ("x", None)] * 4)])
    names, table = languages.learn(train)
    assert names == ["de", "en"]
    mixed = " ".join(["the thing that there is"] * 12 + ["und die der das ist"] * 8)
    got = {r.doc_id: r for r in languages.identify(documents(["the thing there", "die und der", mixed, "12 ?!", "", None]), names, table).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "de", "en", "und", "und", "und"]
    assert 0.4 < got[2].score < 0.8 and got[0].score > 0.9 and got[5].score == 0
    assert languages.identify(odd, names, table).count() == odd.count()
    assert languages.identify(nothing, names, table).isEmpty()
    assert languages.identify(odd, *languages.learn(nothing)).filter("lang_pred <> 'und'").isEmpty()
    kept = languages.identified(documents(["the thing there", None, "42"]), train)
    assert [r.doc_id for r in kept.collect()] == [0] and kept.columns == train.columns


# --- quality -----------------------------------------------------------------------
def test_quality_held_out(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    weights = quality.train(quality.sampled(docs.filter(remainder("doc_id", 4) != 2), labels))
    rows = quality.score(docs, weights).join(labels, "doc_id").filter(remainder("doc_id", 4) == 2).collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.8


def test_quality_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0, "z") for i in range(8)] + [(0, 1, 1, "z"), (None, 1, 0, "z"), (5, None, 0, "z")], "doc_id bigint, quality int, toxic int, text string")
    rows = quality.sampled(odd, labels)
    assert {r.doc_id: r.label for r in rows.collect()}[0] == 0.5
    weights = quality.train(rows)
    got = quality.score(odd, weights).collect()
    assert len(got) == odd.count() and all(0 < r.score < 1 for r in got)
    assert quality.score(nothing, weights).isEmpty()
    assert not quality.train(quality.sampled(nothing, labels)).any()
    assert quality.sampled(odd, labels, sample=3).select("doc_id").distinct().count() == 3


# --- contamination -----------------------------------------------------------------
def hits(docs, tests, window=13):
    words = lambda t: WORD.findall((t or "").encode().lower())
    phrases: dict = {}
    for item, text in tests:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, on, items = words(text), set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(w) - size + 1):
                found = phrases.get(tuple(w[i : i + size]))
                if found:
                    on.update(range(i, i + size))
                    items |= found
        items = sorted(str(i) for i in items if i is not None)
        out.append((str(doc), len(w), len(on), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(on) and 20 * len(on) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize(("limit", "group"), [(10**6, 10**6), (10**6, 60), (3, 10**6)])
def test_contamination(spark, odd, nothing, monkeypatch, limit, group):
    monkeypatch.setattr(contamination, "TERM_LIMIT", limit)
    monkeypatch.setattr(contamination, "GROUP_BYTES", group)
    base = odd.filter("doc_id = 0").first().text.split()
    tests = [(1, " ".join(base[10:40])), (2, "ONE, two"), (3, None), (4, "..."), (2, "a b"), (None, "c d"), (10, " ".join(base[30:60])), (1, " ".join(base[10:40]))]
    table = spark.createDataFrame([(*t, "x") for t in tests], "item_id bigint, text string, id string")
    got = sorted(tuple(str(x) if i == 0 else x for i, x in enumerate(r)) for r in contamination.report(odd, table).collect())
    assert got == hits([(r.doc_id, r.text) for r in odd.collect()], tests)
    assert contamination.report(nothing, table).isEmpty()
    assert contamination.report(odd, table.limit(0)).filter("n_hit > 0").isEmpty()
    bad = {g[0] for g in got if g[5]}
    kept = contamination.decontaminated(odd, table)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(g[0] for g in got if g[0] not in bad or g[0] == "None" and not g[5])


def test_proximity(spark, documents):
    docs = documents(["alpha x x beta", "beta alpha", "alpha x x x x x beta", "alpha"])
    tests = spark.createDataFrame([(1, "alpha beta")], "item_id bigint, text string")
    got = {r.doc_id: r.n_hit for r in contamination.contamination(docs, tests, reach=3).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0}


# --- lines -------------------------------------------------------------------------
@pytest.mark.parametrize("sent", [lines.SENT_LINES, 0])
def test_lines(odd, nothing, sent):
    given = odd.collect()
    hosts = Counter(r.source for r in given)
    seen = Counter((r.source, s) for r in given for s in {x.strip(" \t\r") for x in (r.text or "").split("\n")} if s)
    drop = {k for k, n in seen.items() if n >= lines.LEAST_PAGES and n > lines.RATIO * hosts[k[0]]}
    want = []
    for r in given:
        parts = r.text.split("\n") if r.text is not None else []
        kept = [p for p in parts if (r.source, p.strip(" \t\r")) not in drop]
        want.append(str((r.doc_id, None if r.text is None else "\n".join(kept), len(parts), len(parts) - len(kept))))
    got = lines.drop_boilerplate(odd, sent=sent)
    assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got.collect()) == sorted(want)
    assert drop and got.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert lines.drop_boilerplate(nothing, sent=sent).isEmpty()


def test_lines_on_a_few_per_cent_of_pages(documents):
    """A line on 3 % of a host's pages goes, one on 4 pages and those of one page stay."""
    pages = [[f"own {i}", *["planted"] * (i % 33 == 0), *["by chance"] * (i < 4)] for i in range(500)]
    got = {r.doc_id: r for r in lines.report(documents(["\n".join(p) for p in pages])).collect()}
    for i, page in enumerate(pages):
        assert got[i].text == "\n".join(x for x in page if x != "planted") and got[i].n_dropped == page.count("planted")
