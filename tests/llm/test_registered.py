"""The registered queries of this part: names, columns, and SQL on a second engine where there is some."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from compare import canonical  # noqa: E402
from sievelight.llm import queries  # noqa: E402


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, small, name):
    duck = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, small)
    result = duck.execute(queries.SQL[name])
    want = canonical([d[0] for d in result.description], result.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op1_suffix_tree_scores", {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}),
        ("op2_language_id", {"doc_id", "held_out", "lang_pred", "score"}),
        ("op4_substring_dedup", {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}),
        ("op5_benchmark_decontamination", {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}),
        ("op6_shingle_join", {"doc_id", "n_shingles", "component_id"}),
        ("op7_quality_classifier", {"doc_id", "held_out", "score", "predicted"}),
        ("op9_mixing", {"doc_id", "size", "source_size", "target", "taken"}),
    ],
)
def test_rows_and_columns(spark, small, name, columns):
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    df = queries.QUERIES[name](spark, small)
    assert columns <= set(df.columns) and df.count() == docs
