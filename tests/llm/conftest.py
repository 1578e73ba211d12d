from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, score string, row string, bucket string, size string"


def rows(texts, source="s", lang="en"):
    return [(i, t, lang, source, "x", "x", "x", "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents from texts or whole rows; further columns have names that operators use themselves."""

    def build(given, **more):
        given = list(given)
        full = given if given and isinstance(given[0], tuple) else rows(given, **more)
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in every column, empty and blank texts, repeated rows, a text without blanks and a very long one."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(1, 9)))
    base = " ".join(word() for _ in range(120))
    near = base.replace(base.split()[60], "changed", 1)
    long_ = " ".join(word() for _ in range(60_000))
    texts = [base, base, near, None, "", " \t\n ", "x" * 5000, "one two", "ONE Two", "a b c d e", long_, "éé \U0001f600 ok \x00 end", base.upper()]
    given = [(i, t, "en" if i % 2 else "de", "s1" if i % 3 else "s2", "x", "x", "x", "x") for i, t in enumerate(texts)]
    given += [given[0], given[0], given[3], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    given += [(100 + i, f"header line\n{word()} {word()}\nfooter", "en", "s3", "x", "x", "x", "x") for i in range(12)]
    return documents(given)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents(rows(["x"])).limit(0)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
