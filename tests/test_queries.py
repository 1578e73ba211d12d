"""Every registered query, compared with its SQL on a second engine."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from compare import canonical  # noqa: E402
from sievelight.plans import oracle, queries as registered  # noqa: E402

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = registered.QUERIES, oracle.SQL


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["check_id", "severity", "files", "occurrences"]
    assert result.count() > 0


def test_every_sql_has_a_query():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(SQL) <= set(QUERIES)
    # Evidence in free text is compared with tables of texts instead.
    assert set(QUERIES) - set(SQL) == {"content_findings", "sanitized_documents"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got[1]
        return
    result = duck.execute(SQL[name])
    want = canonical([d[0] for d in result.description], result.fetchall())
    assert got == want
