"""Hard negatives against brute force in Python's whole numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sievelight.llm import hardnegatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int, row string, slot string, score string"


def brute(rows):
    taking = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = [math.floor(256 * x) for x in vector if math.isfinite(256 * x)]
        if len(own) == len(vector) and sum(x * x for x in own) < 2**61:
            taking.append((vec_id, label, own))
    out = []
    for i, (anchor, label, a) in enumerate(taking):
        if anchor % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b)), v, k) for j, (v, k, b) in enumerate(taking) if i != j]
        for s, positive, _ in sorted(t for t in scores if t[2] == label)[:5]:
            window = sorted((t[0], t[1]) for t in scores if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s)
            out += [(anchor, positive, r, v, -s, -t) for r, (t, v) in enumerate(window[:5], 1)]
    return sorted(out)


def made(seed, n=700, size=9, spread=1.0):
    rng = random.Random(seed)
    centre = [rng.gauss(0, 1) for _ in range(size)]
    return [(i, [spread * (c + rng.gauss(0, 0.4)) for c in centre], 3 if rng.random() < 0.4 else rng.randint(0, 4)) for i in range(n)]


def run(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.mine(table, **more).collect())


@pytest.mark.parametrize(("spread", "block_bytes"), [(1.0, H.BLOCK_BYTES), (0.01, 72), (1e6, 100)])
def test_against_brute_force(spark, spread, block_bytes):
    rows = made(int(spread) + 1, spread=spread)
    inf = float("inf")
    rows += [(None, rows[0][1], 3), (100, rows[0][1], None), (200, None, 3), (300, [1.0, None], 3), (400, [inf, 1.0], 3), (401, [float("nan")], 3),
             (500, [1e300] * 9, 3), (501, [1e8] * 9, 2), (600, [], 3), (700, rows[7][1][:4], 3), (800, [*rows[7][1], 5.0, -5.0], 2), (-100, rows[9][1], 1)]
    rows += [rows[0], rows[0], rows[8], (0, rows[1][1], 4)]
    got = run(spark, rows, block_bytes=block_bytes)
    assert got and got == brute(rows)


def test_nothing_to_mine(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert run(spark, [(100, [-1.0], 1), (2, [1.0], 1), (3, [0.9], 2)]) == []  # a positive with a negative score


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for top, size in [(3, 5), (256, 700), (2**20, 64), (2**27, 60)]:
        a, b = rng.integers(-top, top + 1, (7, size)), rng.integers(-top, top + 1, (6, size))
        a[0], b[0] = top, -top
        primes = H.primes_for(int(max((a**2).sum(axis=1).max(), (b**2).sum(axis=1).max())))
        got = H.products([H.residues(a, p) for p in primes], [H.residues(b, p) for p in primes], primes)
        want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
        assert got.tolist() == want
    assert all(all(p % q for q in range(2, p)) for p in H.PRIMES)
    assert all(((1 << 24) // (p // 2) ** 2) * (p // 2) ** 2 <= 1 << 24 for p in H.PRIMES)
    with pytest.raises(ValueError):
        H.primes_for(1 << 90)
