"""Quality scores: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, or of other signs, A-Z folded; features are
single words, pairs and a word's return after one or two, hashed, with the logarithm of their count, scaled to norm 1.
Training rows are a bounded sample of the labelled ones, dealt to a fixed number of
shards; each shard updates the state (z, n) of every coordinate row by row, and the
shards' states are averaged after each pass.  A score is a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, text_of, written
from .textbytes import LETTERS, LOWER, SPACE, chunks, hashes, mix, runs

BITS = 18
#: Labelled rows learned from at most, by least hash of their id.
SAMPLE = 20_000
SHARDS = 8
PASSES = 4
#: Learning rate and its offset; weights of the absolute and the squared norm.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Scores from here on predict label 1.
THRESHOLD = 0.7
_AGAIN = mix(np.arange(3, dtype=np.uint64) + np.uint64(11))


def features(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, coordinate and value of each feature, sorted; coordinate 0 is the constant 1 of every text."""
    n = len(begins) - 1
    start, end, text = runs(~SPACE[data], begins, LETTERS[data])
    word = hashes(LOWER[data], start, end)
    grams, owners = [word], [text]
    for apart in (1, 2):  # pairs, and a word that comes again, which is one feature whatever the word
        same = text[:-apart] == text[apart:]
        a, b = word[:-apart][same], word[apart:][same]
        if apart == 1:
            grams, owners = [*grams, mix(a * np.uint64(31) + b)], [*owners, text[:-apart][same]]
        grams, owners = [*grams, np.full((a == b).sum(), _AGAIN[apart])], [*owners, text[:-apart][same][a == b]]
    key = (np.concatenate(owners).astype(np.uint64) << np.uint64(BITS)) | (np.concatenate(grams) >> np.uint64(64 - BITS))
    key, count = np.unique(key, return_counts=True)
    doc, at = (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, weights=value**2, minlength=n))
    real = at > 0
    doc, at, value = doc[real], at[real], (value / norm[doc])[real]
    doc, at, value = np.r_[np.arange(n), doc], np.r_[np.zeros(n, np.int64), at], np.r_[np.ones(n), value]
    order = np.argsort(doc, kind="stable")
    return doc[order], at[order], value[order]


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _update(z: np.ndarray, n: np.ndarray, at: np.ndarray, value: np.ndarray, label: float) -> None:
    """One row's step; changes z and n in place."""
    w = _weights(z[at], n[at])
    g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
    squares = n[at] + g * g
    z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / ALPHA * w
    n[at] = squares


def sampled(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(text, label) of at most `sample` labelled ids; a null label teaches nothing, several labels of an id are averaged."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return documents.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def train(rows: DataFrame) -> np.ndarray:
    """Weights from rows (doc_id, text, label); zeros where there are none."""
    spark = rows.sparkSession
    small_batches(spark)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, begins in chunks(batch.column(0)):
                doc, at, value = features(data, begins)
                cut = np.searchsorted(doc, np.arange(1, last - first))
                parts = [
                    pa.array([x.tobytes() for x in np.split(a, cut)], pa.binary())
                    for a in (at.astype(np.uint32), value.astype(np.float32))
                ]
                rest = [batch.column(i).slice(first, last - first) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([*parts, *rest], names=["at", "value", "label", "shard", "turn"])

    turn = F.xxhash64(F.lit(7), "doc_id", "text")
    source = rows.select("text", F.col("label").cast("double"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARDS)).cast("int"), turn.alias("turn"))
    made = written(source.mapInArrow(featurise, "at binary, value binary, label double, shard int, turn bigint"), "features")
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for _ in range(PASSES):
        sent = spark.sparkContext.broadcast((z, n))

        def learn(table: pa.Table) -> pa.Table:
            z, n = (a.copy() for a in sent.value)  # noqa: B023
            for i in np.argsort(np.asarray(table["turn"]), kind="stable").tolist():
                at = np.frombuffer(table["at"][i].as_buffer(), dtype=np.uint32)
                value = np.frombuffer(table["value"][i].as_buffer(), dtype=np.float32).astype(np.float64)
                _update(z, n, at, value, table["label"][i].as_py())
            return pa.table({"z": [z.tobytes()], "n": [n.tobytes()], "rows": pa.array([table.num_rows], pa.int64())})

        states = made.groupBy("shard").applyInArrow(learn, "z binary, n binary, rows bigint").collect()
        total = sum(s["rows"] for s in states)
        if total:
            z = sum(np.frombuffer(s["z"]) * (s["rows"] / total) for s in states)
            n = sum(np.frombuffer(s["n"]) * (s["rows"] / total) for s in states)
        sent.unpersist()
    return _weights(z, n)


def score(documents: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """`documents` with column score, 0 to 1; one of that name is replaced.  A null or empty text has the score of the constant alone."""
    spark = documents.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(weights.astype(np.float64))
    kept = documents.drop("score").select("*", text_of(text).alias("_text"))
    schema = kept.drop("_text").schema.add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            found = []
            for first, last, data, begins in chunks(batch.column(batch.num_columns - 1)):
                doc, at, value = features(data, begins)
                found.append(np.bincount(doc, weights=w[at] * value, minlength=last - first))
            total = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=schema.names
            )

    return kept.mapInArrow(predict, schema)
