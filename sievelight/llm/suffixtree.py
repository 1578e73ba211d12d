"""Language-model scores from a probabilistic suffix tree over bytes, and unigram scores of words.

A text becomes its words, A-Z folded, each followed by a blank, and an end sign.
Every byte and the end sign are symbols; the text's beginning is a context of its own.
Counts of all symbols after all contexts of up to `DEPTH` symbols are gathered from
the whole training text.  A context becomes a state where it is frequent enough and
its next-symbol distribution diverges from that of the context one symbol shorter;
the suffixes of a state are states.  A state's distribution is smoothed with the
shorter one's, so each sums to one.  A symbol is scored in the longest state that is
a suffix of what precedes it.

Shares of the whole bound the tree: a symbol after a context is kept if it makes up at
least `LEAST_SHARE` of all symbols, so the tree has at most (DEPTH + 1) / LEAST_SHARE
of them and can be sent to every task.  Frequent words are bounded likewise; counts
of the others are looked up by a shuffle of packed requests.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import nullable, partitions, small_batches, text_of, written
from .textbytes import CHUNK, LOWER, WORDS, chunks, hashes, mix, packed, runs

DEPTH = 6
#: Least share of all symbols that a symbol after a context has, to be kept.
LEAST_SHARE = 1 / (1 << 22)
#: A state's divergence in nats a symbol, at least; in all it must also pay half a logarithm for each next symbol.
LEAST_DIVERGENCE = 0.001
#: Words of at least this share of all tokens are sent to every task (16 bytes each).
FREQUENT_SHARE = 1 / (1 << 21)
#: Requests a task packs before it hands them on.
REQUESTS = 1_000_000
#: Counts a task combines before it hands them on.
COUNTS = 1_000_000

_END, _BLANK = 10, 32  # neither the line feed nor another blank can be part of a word
_END_TOKEN = np.uint64(0x656E64)
_MASK = [np.uint64((1 << (8 * d)) - 1) if d < 8 else np.uint64(2**64 - 1) for d in range(9)]


def symbols(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol: itself behind its context, packed, and its text number; for each word: hash and text number."""
    n = len(begins) - 1
    inside = WORDS[data]
    start, end, text = runs(inside, begins)
    low = LOWER[data]
    size = end - start
    upto = np.cumsum(size + 1)
    place = upto - size - 1 + DEPTH * (text + 1) + text
    out = np.full(int(upto[-1] if len(upto) else 0) + n * (DEPTH + 1), _END, dtype=np.uint8)
    at = np.flatnonzero(inside)
    out[at + np.repeat(place - start, size)] = low[at]
    out[place + size] = _BLANK
    length = np.bincount(text, weights=size + 1, minlength=n).astype(np.int64) + 1
    key = np.zeros(len(out) - DEPTH if len(out) else 0, dtype=np.uint64)
    for j in range(DEPTH + 1):
        key = (key << np.uint64(8)) | out[j : len(out) - DEPTH + j]
    owner = np.repeat(np.arange(n), length)
    real = np.arange(length.sum()) + np.repeat(np.arange(n) * DEPTH, length)
    return key[real], owner, hashes(low, start, end), text


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys) % np.uint64(buckets)).astype(np.int32)


class _Tally:
    """Counts of 64-bit keys, combined now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > 2 * COUNTS:
            self.combine()

    def combine(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            keys, inverse = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([p[1] for p in self.parts])).astype(np.int64)
            self.parts = [(keys, counts)]
        self.size = len(self.parts[0][0]) if self.parts else 0
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def gather(documents: DataFrame, text: str = "text") -> DataFrame:
    """All counts of the training texts, written: (kind, key, n), kind 0 for words, 1 for symbols behind contexts."""
    small_batches(documents.sparkSession)
    buckets = partitions(documents.sparkSession)
    names = ["kind", "bucket", "keys", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = (_Tally(), _Tally())

        def rows() -> Iterator[pa.RecordBatch]:
            for kind, tally in enumerate(tallies):
                keys, counts = tally.combine()
                tally.parts, tally.size = [], 0
                which, parts = packed(_bucket(keys, buckets), keys, counts.astype(np.uint32))  # keys stay sorted within a bucket
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), kind, np.int32)), which, *parts], names=names)

        for batch in batches:
            for first, last, data, begins in chunks(batch.column(0)):
                key, _, word, _ = symbols(data, begins)
                tallies[0].add(np.concatenate([word, np.full(last - first, _END_TOKEN)]))
                tallies[1].add(key)
            if any(t.size > COUNTS for t in tallies) and any(len(t.combine()[0]) > COUNTS for t in tallies):
                yield from rows()
        yield from rows()

    def add(table: pa.Table) -> pa.Table:
        tally = _Tally()
        for i in range(table.num_rows):
            keys, counts = np.frombuffer(table["keys"][i].as_buffer(), np.uint64), np.frombuffer(table["counts"][i].as_buffer(), np.uint32)
            tally.parts.append((keys, counts.astype(np.int64)))
        keys, counts = tally.combine()
        return pa.table({"kind": np.full(len(keys), table["kind"][0].as_py(), np.int32), "key": keys.view(np.int64), "n": counts})

    made = documents.select(text_of(text)).mapInArrow(count, "kind int, bucket int, keys binary, counts binary")
    return written(made.groupBy("kind", "bucket").applyInArrow(add, "kind int, key bigint, n bigint"), "counts")


def states(grams: DataFrame) -> DataFrame:
    """The tree from (key, n): a row for each kept symbol of each state (d, context, symbol, n, total, kinds)."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    least = max(1, int(total * LEAST_SHARE))
    depths = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND(int(_MASK[d + 1].view(np.int64))).alias("gram")) for d in range(DEPTH + 1)]))
    each = grams.select(depths.alias("g"), "n").groupBy("g.d", "g.gram").agg(F.sum("n").alias("n"))
    each = written(each.withColumn("context", F.shiftrightunsigned("gram", 8)), "contexts")
    totals = each.groupBy("d", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter(F.col("total") >= least)
    kept = written(each.filter(F.col("n") >= least).join(totals, ["d", "context"]), "frequent")  # bounded by the shares
    shorter = kept.select(
        (F.col("d") + 1).alias("d"), F.col("gram").alias("short_gram"), F.col("n").alias("short_n"), F.col("total").alias("short_total")
    )
    masks = F.element_at(F.array(*[F.lit(int(_MASK[d].view(np.int64))) for d in range(DEPTH + 1)]), F.col("d") + 1)
    cut = kept.filter("d > 0").withColumn("short_gram", F.col("gram").bitwiseAND(F.element_at(F.array(*[F.lit(int(_MASK[d].view(np.int64))) for d in range(1, DEPTH + 2)]), F.col("d"))))
    pairs = cut.join(shorter, ["d", "short_gram"])
    n, t, m, u = (F.col(c).cast("double") for c in ("n", "total", "short_n", "short_total"))
    tests = pairs.groupBy("d", "context").agg(
        F.sum(n * F.log((n / t) / (m / u))).alias("gain"), F.sum(n).alias("seen"), F.sum(m).alias("short_seen"),
        F.first(t).alias("t"), F.first(u).alias("u"), F.first("kinds").alias("kinds"),
    )
    rest, short_rest = F.col("t") - F.col("seen"), F.greatest(F.col("u") - F.col("short_seen"), F.lit(0.5))
    gain = F.col("gain") + F.when(rest > 0, rest * F.log((rest / F.col("t")) / (short_rest / F.col("u")))).otherwise(0.0)
    diverging = tests.filter((gain >= LEAST_DIVERGENCE * F.col("t")) & (gain >= 0.5 * F.col("kinds") * F.log("t")))
    suffixes = diverging.select(F.explode(F.sequence(F.lit(1), F.col("d"))).alias("d"), "context")
    tree = suffixes.select("d", F.col("context").bitwiseAND(masks).alias("context")).distinct()
    inner = kept.join(tree, ["d", "context"], "left_semi")
    return kept.filter("d = 0").unionByName(inner).select("d", "context", F.col("gram").bitwiseAND(255).alias("symbol"), "n", "total", "kinds")


@dataclass
class Tree:
    """States of each depth, sorted, with the weight of the shorter state; kept symbols, sorted, with their probability."""

    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    grams: list[np.ndarray]
    chances: list[np.ndarray]

    @classmethod
    def build(cls, rows: pa.Table) -> Tree:
        d, context, symbol, n, total, kinds = (np.asarray(rows[c]) for c in ("d", "context", "symbol", "n", "total", "kinds"))
        context = context.astype(np.uint64)
        root = d == 0
        base = np.zeros(256)
        base[symbol[root]] = n[root]
        spare = max(0.5, (total[root][0] - base.sum()) / 256) if root.any() else 0.5
        base = (base + spare) / (base.sum() + 256 * spare)
        tree = cls([np.zeros(1, np.uint64)], [np.zeros(1)], [np.arange(256, dtype=np.uint64)], [base])
        for depth in range(1, DEPTH + 1):
            own = np.flatnonzero(d == depth)
            gram = (context[own] << np.uint64(8)) | symbol[own].astype(np.uint64)
            own, gram = own[np.argsort(gram)], np.sort(gram)
            states, first = np.unique(context[own], return_index=True)
            seen = np.add.reduceat(n[own], first) if len(own) else np.zeros(0)
            size, variety = total[own][first], kinds[own][first]
            weight = (variety + size - seen) / (size + variety)
            shorter = tree.chance(gram & _MASK[depth])
            which = np.searchsorted(states, context[own])
            chance = n[own] / (size + variety)[which] + weight[which] * shorter if len(own) else np.zeros(0)
            for all_, part in zip((tree.contexts, tree.weights, tree.grams, tree.chances), (states, weight, gram, chance), strict=True):
                all_.append(part)
        return tree

    def chance(self, key: np.ndarray) -> np.ndarray:
        """Probability of each symbol behind its packed context, in the longest state that ends the context."""
        p = self.chances[0][(key & _MASK[1]).astype(np.int64)]
        open_ = np.arange(len(key))
        for depth in range(1, len(self.contexts)):
            states, grams = self.contexts[depth], self.grams[depth]
            gram = key[open_] & _MASK[depth + 1]
            if not len(states) or not len(open_):
                break
            at = np.minimum(np.searchsorted(states, gram >> np.uint64(8)), len(states) - 1)
            there = states[at] == gram >> np.uint64(8)
            open_, at, gram = open_[there], at[there], gram[there]
            g = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            p[open_] = np.where(grams[g] == gram, self.chances[depth][g], self.weights[depth][at] * p[open_])
        return p


@dataclass
class Model:
    """What was gathered: the counts, how many tokens and distinct ones, the tree, and the frequent words."""

    counts: DataFrame
    tokens: int
    distinct: int
    tree: Tree
    least: int
    frequent: tuple[np.ndarray, np.ndarray]


def learn(documents: DataFrame, text: str = "text") -> Model:
    """Learn from all rows of `documents`; a null text counts as an empty one."""
    counts = gather(documents, text)
    word = counts.filter("kind = 0")
    tokens, distinct = word.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(1, int(tokens * FREQUENT_SHARE))
    often = word.filter(F.col("n") >= least).select("key", "n").toArrow()
    keys = np.asarray(often["key"]).view(np.uint64)
    order = np.argsort(keys)
    tree = Tree.build(states(counts.filter("kind = 1").select("key", "n")).toArrow())
    return Model(counts, tokens, distinct, tree, least, (keys[order], np.asarray(often["n"])[order]))


_DOC = "unit bigint, doc_no int, n_tokens bigint, n_known bigint, logs double, score double"
_REQUEST = "bucket int, words binary, docs binary, times binary"


def _first_pass(documents: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Rows for documents (scores, and sums over frequent words) and rows of packed requests for the other words' counts."""
    sent = documents.sparkSession.sparkContext.broadcast((model.tree, *model.frequent))
    width = len(documents.columns) - 1
    names = documents.columns[:width]
    schema = T.StructType([*nullable(documents.schema.fields[:width]), *T.StructType.fromDDL(_DOC).fields, *T.StructType.fromDDL(_REQUEST).fields])
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, words, counts = sent.value
        unit, docs, size = TaskContext.get().partitionId() << 33, 0, 0
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        types: list[pa.DataType] = []

        def requests() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            word, doc, times = (np.concatenate(x) for x in zip(*waiting, strict=True))
            which, parts = packed((word % np.uint64(buckets)).astype(np.int32), word, doc, times)
            n = len(which)
            blank = [pa.nulls(n, t) for t in [*types, *kinds[1:6]]]
            yield pa.RecordBatch.from_arrays(
                [*blank[: len(types)], pa.array([unit] * n, pa.int64()), *blank[len(types) :], which, *parts], names=schema.names
            )

        for batch in batches:
            types = [c.type for c in batch.columns[:width]]
            for first, last, data, begins in chunks(batch.column(width), 2 * CHUNK):
                n = last - first
                key, owner, word, text = symbols(data, begins)
                grams, inverse = np.unique(key, return_inverse=True)
                value = np.bincount(owner, weights=np.log10(tree.chance(grams))[inverse], minlength=n).astype(np.float64)
                word, text = np.concatenate([word, np.full(n, _END_TOKEN)]), np.concatenate([text, np.arange(n)])
                order = np.lexsort((text, word))
                word, text = word[order], text[order]
                new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])])
                times = np.diff(np.r_[new, len(word)])
                word, text = word[new], text[new]
                at = np.minimum(np.searchsorted(words, word), max(len(words) - 1, 0))
                known = words[at] == word if len(words) else np.zeros(len(word), bool)
                logs = np.bincount(text[known], weights=times[known] * np.log10(counts[at[known]] + 1.0), minlength=n).astype(np.float64)
                tokens = np.bincount(text, weights=times, minlength=n)
                seen = np.bincount(text[known], weights=times[known], minlength=n)
                if not known.all():
                    waiting.append((word[~known], (text[~known] + docs).astype(np.uint32), times[~known].astype(np.uint32)))
                    size += int((~known).sum())
                columns = [
                    pa.array(np.full(n, unit)), pa.array(np.arange(docs, docs + n, dtype=np.int32)), pa.array(tokens.astype(np.int64)),
                    pa.array(seen.astype(np.int64)), pa.array(logs), pa.array(value), *[pa.nulls(n, t) for t in kinds[6:]],
                ]
                yield pa.RecordBatch.from_arrays([*[c.slice(first, n) for c in batch.columns[:width]], *columns], names=schema.names)
                docs += n
                if size >= REQUESTS:
                    yield from requests()
                    waiting.clear()
                    unit, docs, size = unit + 1, 0, 0
        yield from requests()

    assert names == schema.names[:width]
    return written(documents.mapInArrow(score, schema), "scored")


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`documents` without `text`, with n_tokens, n_known, train_tokens, base_score and score; columns of those names are replaced.

    Every row gives one row; a null text is an empty one, which has the end token alone.
    """
    spark = documents.sparkSession
    small_batches(spark)
    new = ("unit", "doc_no", "n_tokens", "n_known", "logs", "score", "bucket", "words", "docs", "times", "train_tokens", "base_score")
    own = [c for c in documents.columns if c != text and c not in new]
    buckets = partitions(spark)
    rows = _first_pass(documents.select(*[F.col(f"`{c}`") for c in own], text_of(text).alias("_text")), model, buckets)
    asked = rows.filter(F.col("bucket").isNotNull()).select("bucket", "unit", "words", "docs", "times")
    rare = model.counts.filter((F.col("kind") == 0) & (F.col("n") < model.least)).select("key", "n")
    # Keys are unsigned when their bucket is worked out, as in the tasks.
    signed = F.pmod(F.col("key"), F.lit(buckets)) + F.when(F.col("key") < 0, (1 << 64) % buckets).otherwise(0)
    rare = rare.withColumn("bucket", F.pmod(signed, F.lit(buckets)).cast("int"))

    def answer(known: pa.Table, requests: pa.Table) -> pa.Table:
        key = np.asarray(known["key"]).view(np.uint64)
        order = np.argsort(key)
        key, n = key[order], np.asarray(known["n"])[order]
        out: dict[str, list] = {"unit": [], "docs": [], "logs": [], "known": []}
        for i in range(requests.num_rows if len(key) else 0):
            word = np.frombuffer(requests["words"][i].as_buffer(), dtype=np.uint64)
            doc = np.frombuffer(requests["docs"][i].as_buffer(), dtype=np.uint32)
            times = np.frombuffer(requests["times"][i].as_buffer(), dtype=np.uint32)
            at = np.minimum(np.searchsorted(key, word), len(key) - 1)
            there = key[at] == word
            which, inverse = np.unique(doc[there], return_inverse=True)
            out["unit"].append(requests["unit"][i].as_py())
            out["docs"].append(which.tobytes())
            out["logs"].append(np.bincount(inverse, weights=times[there] * np.log10(n[at[there]] + 1.0)).astype(np.float64).tobytes())
            out["known"].append(np.bincount(inverse, weights=times[there]).astype(np.float64).tobytes())
        return pa.table(out, schema=pa.schema([("unit", pa.int64()), ("docs", pa.binary()), ("logs", pa.binary()), ("known", pa.binary())]))

    answers = rare.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, "unit bigint, docs binary, logs binary, known binary")

    def add(table: pa.Table) -> pa.Table:
        doc = np.concatenate([np.frombuffer(b.as_buffer(), dtype=np.uint32) for b in table["docs"]])
        which, inverse = np.unique(doc, return_inverse=True)
        sums = [np.bincount(inverse, weights=np.concatenate([np.frombuffer(b.as_buffer()) for b in table[c]])) for c in ("logs", "known")]
        unit = np.full(len(which), table["unit"][0].as_py(), np.int64)
        return pa.table({"unit": unit, "doc_no": which.astype(np.int32), "more_logs": sums[0], "more_known": sums[1].astype(np.int64)})

    more = answers.groupBy("unit").applyInArrow(add, "unit bigint, doc_no int, more_logs double, more_known bigint")
    docs = rows.filter(F.col("doc_no").isNotNull()).drop("bucket", "words", "docs", "times")
    joined = docs.join(more, ["unit", "doc_no"], "left")
    scale = float(np.log10(model.tokens + model.distinct + 1))
    return joined.select(
        *[F.col(f"`{c}`") for c in own], "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"), "score",
    )
