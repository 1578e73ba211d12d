"""Quality rules: counts against brute force, estimates against the same steps over whole arrays."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines))


def made(seed, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(int(math.exp(rng.gauss(4.5, 0.8))))]
        if i % 23 == 5:
            text = [w + " | # " for w in text]
        if i % 31 == 7:
            text = ["\n".join(text[:6])] * 3 + text
        if i % 41 == 3:
            text = [w * 6 for w in text]
        rows.append((i, rng.choice([" ", "\n", " ", "\t"]).join(text), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), *"xxxx"))
    return rows


def test_counts(documents, odd):
    texts = ["a b c d e f a b c d e", "x x x x x x", "a b c d e\na b c d e \na b c d e", "#*$%&|<>", "é é\n\n é é", "l\r\nl\r\nl", "\n\n", "a b c d", "a\x0bb\x0cc"]
    given = documents(made(1, 60) + [(1000 + i, t, "en", "a", *"xxxx") for i, t in enumerate(texts)]).unionByName(odd)
    got = outliers.measured(given).collect()
    want = Counter((r.doc_id, *brute_counts(r.text)) for r in given.collect())
    assert Counter((r.doc_id, *(r[c] for c in outliers.COUNTS)) for r in got) == want


def squared(x, mean, cov):
    return np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)


def brute_estimate(x, spread):
    """The same concentration over an array: a core is all vectors up to the bin that fills it."""
    floor, p = np.diag(np.square(spread)), x.shape[1]
    middle = lambda a: np.sort(a, axis=0)[(len(a) + 1) // 2 - 1]
    median = middle(x)
    ends = []
    for mean, cov in [(median, np.diag((1.4826 * middle(abs(x - median))) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True))]:
        cov = cov + floor
        for _ in range(outliers.STEPS):
            bins = np.floor(outliers.BINS * np.log2(1 + squared(x, mean, cov)))
            core = x[bins <= np.sort(bins)[math.ceil(outliers.CORE * len(x)) - 1]]
            mean, cov = core.mean(axis=0), np.cov(core.T, bias=True) + floor
        ends.append((np.linalg.slogdet(cov)[1], mean, cov))
    _, mean, cov = min(ends, key=lambda e: e[0])
    near = x[squared(x, mean, cov) <= outliers.widening(outliers.CORE, p) * outliers.chi_square_limit(outliers.WEIGHTED, p)]
    return near.mean(axis=0), outliers.widening(outliers.WEIGHTED, p) * np.cov(near.T, bias=True) + floor


def test_estimates(spark):
    rng = np.random.default_rng(2)
    spread = {"a": 0.1, "b": 0.2, "c": 0.1}
    parts = {}
    for name, n in (("one", 300), ("two", 900), ("flat", 200)):
        mix = rng.normal(0, 1, (3, 3))
        x = rng.normal(0, 1, (n, 3)) @ mix + rng.normal(0, 5, 3)
        x[: n // 6] = rng.normal(9, 0.5, (n // 6, 3))
        if name == "flat":
            x[:, 1] = 2.0
        parts[name] = np.round(x * outliers.GRAIN).astype(int)
    table = spark.createDataFrame([(name, *map(int, r)) for name, x in parts.items() for r in x], "gid string, a bigint, b bigint, c bigint")
    got = {r.gid: r for r in outliers.estimate(table.repartition(5), spread).collect()}
    for name, x in parts.items():
        mean, cov = brute_estimate(x / outliers.GRAIN, list(spread.values()))
        factor = np.zeros((3, 3))
        factor[np.tril_indices(3)] = got[name].factor
        assert np.allclose(got[name].mean, mean, atol=2e-3) and np.allclose(np.linalg.inv(factor.T @ factor), cov, rtol=0.02, atol=2e-3)


def test_outliers_go_and_ordinary_texts_stay(documents):
    rows = made(5, 1500)
    got = {r.doc_id: r for r in outliers.judge(documents(rows)).collect()}
    strange = {r[0] for r in rows if r[0] % 23 == 5 or r[0] % 41 == 3}
    told = {i for i in got if not got[i].base_failed}
    assert len(got) == len(rows) and all(got[i].kept is False and got[i].distance is None for i in got.keys() - told)
    assert sum(not got[i].kept for i in strange & told) >= 0.95 * len(strange & told)
    ordinary = {i for i in told - strange if i % 31 != 7}
    assert sum(got[i].kept for i in ordinary) >= 0.995 * len(ordinary)


def test_odd(odd, nothing, documents):
    got = outliers.judge(odd, least_rows=5)
    assert got.count() == odd.count() and got.filter("kept IS NULL OR kept AND base_failed").isEmpty()
    few = outliers.judge(documents(made(3, 12))).collect()
    assert all(r.kept != r.base_failed and r.distance is None for r in few)
    assert outliers.judge(nothing).isEmpty()
    same = outliers.judge(documents([made(8, 1)[0]] * 150))
    assert same.filter(F.col("kept")).count() in (0, 150)


@pytest.mark.parametrize(("share", "k", "limit"), [(0.95, 1, 3.841), (0.975, 5, 12.833), (0.5, 7, 6.346)])
def test_chi_square(share, k, limit):
    assert outliers.chi_square_limit(share, k) == pytest.approx(limit, abs=2e-3)
