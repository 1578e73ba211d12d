"""Source divergence audit against brute force in plain whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievelight.llm import divergence

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, listed):
    """Rows of the audit for (lang, source, text) triples."""
    holders, uses, per_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
        holders[lang or ""].update(set(terms))
        uses[lang or "", source or ""].update(terms)
        per_lang[lang or ""].update(terms)
    out = []
    for lang, source in uses:
        kept = [t for t in per_lang[lang] if holders[lang][t] >= least]

        def part(counter):
            total = sum(counter[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // total for t in kept}

        def far(p, q):
            return (p - q) ** 2 // (p + q)

        mine, whole = part(uses[lang, source]), part(per_lang[lang])
        pairs = [(-sum(far(mine[t], other[t]) for t in kept), name.encode())
                 for (code, name), counter in uses.items() if code == lang and name != source for other in [part(counter)]]
        terms = [(-far(mine[t], whole[t]), t) for t in kept if uses[lang, source][t] and mine[t] > whole[t]]
        out += [(lang, source, "pair", n.decode(), -v, r) for r, (v, n) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", n.decode(), -v, r) for r, (v, n) in enumerate(sorted(terms)[:listed], 1)]
    return sorted(out)


def made(seed, sources=9, docs=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéüß") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    rows = []
    for i in range(docs):
        source = rng.choice(["hot"] * 4 + [f"s{j}" for j in range(sources)])
        words = rng.choices(vocabulary, weights=[1 + (len(w) * 7 + len(source) * k) % 11 for k, w in enumerate(vocabulary)], k=rng.randint(0, 60))
        rows.append((i, rng.choice([" ", "-", "3", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in words),
                     rng.choice(["en", "en", "fr", None]), rng.choice([source, source, source, None]), "x", "x", "x", "x"))
    return rows


@pytest.mark.parametrize(("least", "more"), [(10, {}), (2, {"block_counts": 40, "tile": 2, "part_terms": 4}), (5, {"listed": 3, "part_terms": 16, "tile": 3})])
def test_audit(documents, least, more):
    rows = made(least)
    rows += [(900, None, "xx", "empty", *"xxxx"), (901, "12 3", "xx", "digits", *"xxxx"), (902, "word", "one", "alone", *"xxxx"),
             (903, "rare terms here", "en", "only rare", *"xxxx"), rows[0], rows[0]]
    got = sorted(tuple(r) for r in divergence.audit(documents(rows), least, **more).collect())
    assert got == brute([(r[2], r[3], r[1]) for r in rows], least, more.get("listed", 10))


def test_audit_odd(odd, nothing):
    given = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in divergence.audit(odd, 1).collect()) == brute(given, 1, 10)
    assert divergence.audit(nothing).isEmpty()


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 7)
    text = "Ab cdéfghijklmnopq r-s  tuvwxyz é".encode()
    assert [t for piece in divergence._terms(text) for t in piece] == [m.lower() for m in TERM.findall(text)]


def test_skyband():
    rng = np.random.default_rng(4)
    n, lang_n, name = rng.integers(0, 9, 700), rng.integers(0, 9, 700), rng.permutation(700)
    over = [sum((n >= n[i]) & (lang_n <= lang_n[i]) & (name < name[i])) for i in range(700)]
    for k in (1, 3, 10):
        assert sorted(divergence.skyband(n, lang_n, name, k, 64)) == [i for i in range(700) if over[i] < k]


def test_shares_are_exact():
    count, total = np.array([2, 3, 10**9, 7 * 10**14]), np.array([7, 3, 3 * 10**9, 9 * 10**14])
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total)]
