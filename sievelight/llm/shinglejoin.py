"""Similarity join of shingle sets by Jaccard, with PartEnum signatures.

A set of s features that is similar to another (intersection over union of 3/4 or
more) differs from it in at most k = s / 3 features.  Sets are banded by size.  In a
band the domain of features is cut into n partitions; a set's part in each is one
candidate signature, and similar sets have equal parts in all but k of those they
fill.  Of the subsets of k + 1 partitions that could be enumerated, one is enough:
the first k + 1 filled ones in an order that all sets share, so two similar sets have
a signature in common whatever they differ in.  Sets near a band's lower end also
get the signatures of the band below.  In bands of small sets each feature is a
partition of its own.

In the shared order, parts made of very common features come last.  Which features
are common is estimated on a sample of documents; it changes only how many
candidates there are, never the result.

Sets are told by a hash of all their features, so copies are one set.  Candidates are
runs of sets with one signature.  A run's first set is compared with the others;
members that are then still in different components are compared further, first
the likeliest and then all that a parity sketch does not rule out (the bits in which
two sketches differ are never more than the features in which the sets do).  Sets are
sent to where they meet only where sums of their features over cells do not settle the
pair: features in which two sets differ are all in cells whose sums do, and each such
cell holds some.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import nullable, partitions, small_batches, text_of, written
from .components import components, further_linked
from .textbytes import chunks, mix, packed, shingles, words

WIDTH = 5
#: Bands end at powers of this; up to the first number of features, partitions are single features.
BAND = 4
SINGLE = 64
#: One document in so many tells which features are common; common is what so many of those hold; of those at most so many are sent to tasks.
SAMPLE, COMMON, MOST_COMMON = 16, 4, 1 << 18
SKETCH_BITS = 1024
#: Features a cell holds about, cells of a set at least and at most.
PER_CELL, LEAST_CELLS, MOST_CELLS = 8, 16, 512
#: First sets that each set is compared with at first.
HUBS = 2
#: Signatures a task packs before it hands them on.
PACKED = 1_000_000
#: Ids up to this many are sent to all tasks to pick documents; more are joined.
SENT_IDS = 2_000_000
#: Sets compared with one first set in one task.
COMPARED = 256


def _sets(data: np.ndarray, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features, sorted within each text; their text numbers; number of features of every text."""
    feature, text = shingles(*words(data, begins), width)
    order = np.lexsort((feature, text))
    feature, text = feature[order], text[order]
    new = np.r_[True, (feature[1:] != feature[:-1]) | (text[1:] != text[:-1])] if len(feature) else np.zeros(0, bool)
    feature, text = feature[new], text[new]
    return feature, text, np.bincount(text, minlength=len(begins) - 1)


def set_hash(feature: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """A hash of each text's whole set; 0 for an empty one."""
    total = np.zeros(n, dtype=np.uint64)
    np.add.at(total, text, mix(feature ^ np.uint64(0x5DEECE66D)))
    size = np.bincount(text, minlength=n).astype(np.uint64)
    return np.where(size > 0, mix(total + size) | np.uint64(1), np.uint64(0))


def _parts(feature: np.ndarray, text: np.ndarray, scheme: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets under a scheme for each (the end of its band): text number and hash, by text in the shared order."""
    end = scheme[text]
    place = mix(feature + np.uint64(0xA5A5A5A5))
    part = np.where(end <= SINGLE, place, place % np.maximum(end, 1).astype(np.uint64))
    order = np.lexsort((part, text))
    part, text, feature = part[order], text[order], feature[order]
    first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (text[1:] != text[:-1])])
    content = np.add.reduceat(mix(feature ^ np.uint64(0xC0FFEE)), first)
    owner = text[first]
    at = np.minimum(np.searchsorted(common, feature), max(len(common) - 1, 0))
    rare = common[at] != feature if len(common) else np.ones(len(feature), bool)
    some_rare = np.add.reduceat(rare.astype(np.int64), first) > 0
    name = mix(content + part[first] * np.uint64(0x9E3779B97F4A7C15) + scheme[owner].astype(np.uint64))
    order = np.lexsort((name, ~some_rare, owner))
    return owner[order], name[order]


def signatures(feature: np.ndarray, text: np.ndarray, size: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and signature, all that each set is found by."""
    if not len(feature):
        return text, feature
    level = np.zeros(len(size), dtype=np.int64)
    for _ in range(40):
        level += BAND ** (level + 1) <= size  # the band of size s is [BAND^level, BAND^(level+1))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for below in (0, 1):
        scheme = BAND ** (level + 1 - below)
        on = size > 0 if not below else (size > 0) & (level > 0) & (3 * size <= 4 * (BAND**level - 1))
        mine = on[text]
        if not mine.any():
            continue
        owner, name = _parts(feature[mine], text[mine], scheme, common)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
        few = rank <= size[owner] // 3
        out.append((owner[few], name[few]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _common(documents: DataFrame, width: int) -> np.ndarray:
    """Features that many documents of the sample hold, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, begins in chunks(batch.column(0)):
                feature, n = np.unique(_sets(data, begins, width)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(n)], names=["feature", "n"])

    some = documents.filter(F.pmod("row", F.lit(SAMPLE)) == 0).select("text").mapInArrow(count, "feature bigint, n bigint")
    often = some.groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    found = often.orderBy(F.desc("n"), "feature").limit(MOST_COMMON).select("feature").toArrow()
    return np.sort(np.asarray(found["feature"]).view(np.uint64))


def _documents(documents: DataFrame, width: int) -> DataFrame:
    """Documents (id, row, n_shingles, set, sketch, cells); written."""
    more = T.StructType.fromDDL("n_shingles bigint, set bigint, sketch binary, cells binary")
    schema = T.StructType([*nullable([documents.schema["id"], documents.schema["row"]]), *more.fields])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, begins in chunks(batch.column(2)):
                n = last - first
                feature, text, count = _sets(data, begins, width)
                told = [
                    batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(count),
                    pa.array(set_hash(feature, text, n).view(np.int64)),
                    pa.array([x.tobytes() for x in _sketches(feature, text, n)], pa.binary()), pa.array(_cells(feature, text, count), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(told, names=schema.names)

    return written(documents.select("id", "row", "text").mapInArrow(tell, schema), "told")


def _signed(documents: DataFrame, width: int) -> DataFrame:
    """Signatures of all sets, packed by bucket (bucket, low, high, sets).

    Not written: they are the largest table here and are read once, so making the sets
    again costs less than keeping them on disk next to their shuffle.
    """
    spark = documents.sparkSession
    common = spark.sparkContext.broadcast(_common(documents, width))
    buckets = partitions(spark)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            name, own = (np.concatenate(x) for x in zip(*waiting, strict=True))
            # Forty bits tell signatures of a bucket apart; what falls together by chance is compared in vain.
            bits = (name >> np.uint64(20)).astype(np.uint32), (name >> np.uint64(52)).astype(np.uint8)
            which, parts = packed((name % np.uint64(buckets)).astype(np.int32), *bits, own)
            yield pa.RecordBatch.from_arrays([which, *parts], names=["bucket", "low", "high", "sets"])

        for batch in batches:
            for first, last, data, begins in chunks(batch.column(0)):
                feature, text, count = _sets(data, begins, width)
                at, name = signatures(feature, text, count, common.value)
                waiting.append((name, set_hash(feature, text, last - first)[at]))
                size += len(name)
                if size >= PACKED:
                    yield from hand_on()
                    waiting.clear()
                    size = 0
        yield from hand_on()

    return documents.select("text").mapInArrow(sign, "bucket int, low binary, high binary, sets binary")


def _distinct_runs(own: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each run of sets, beginning at `begin`, whether it is the first with just these sets."""
    size = np.diff(np.r_[begin, len(own)])
    one, two = np.bitwise_xor.reduceat(mix(own), begin), np.add.reduceat(mix(own ^ np.uint64(0x2545F491)), begin)
    same = np.lexsort((two, one, size, own[begin]))
    told = [c[same] for c in (own[begin], size, one, two)]
    once = np.zeros(len(begin), bool)
    once[same] = np.r_[True, np.any([c[1:] != c[:-1] for c in told], axis=0)]
    return once


def _runs(signed: DataFrame) -> DataFrame:
    """Sets that share a signature: (run, a, b), a the first of the run, b each other one; written.

    Similar sets share many signatures, so the same sets make up many runs: a bucket gives each such run once.
    """

    def meet(table: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), dtype=t) for x in table[c]])
        name = (read("high", np.uint8).astype(np.uint64) << np.uint64(32)) | read("low", np.uint32)
        own = read("sets", np.uint64)
        order = np.argsort(name, kind="stable")
        name, own = name[order], own[order]
        same = np.zeros(len(name), bool)
        same[1:] = name[1:] == name[:-1]
        many = same.copy()
        many[:-1] |= same[1:]
        name, own = name[many], own[many]
        order = np.lexsort((own, name))
        name, own = name[order], own[order]
        new = np.r_[True, (name[1:] != name[:-1]) | (own[1:] != own[:-1])] if len(name) else np.zeros(0, bool)
        name, own = name[new], own[new]
        head = np.r_[True, name[1:] != name[:-1]] if len(name) else np.zeros(0, bool)
        if len(name):
            once = _distinct_runs(own, np.flatnonzero(head))[np.cumsum(head) - 1]
            name, own, head = name[once], own[once], head[once]
        first = own[np.flatnonzero(head)][np.cumsum(head) - 1] if len(name) else own
        run = mix(name * np.uint64(1 << 20) + np.uint64(table["bucket"][0].as_py()))
        rest = ~head
        return pa.table({"run": run[rest].view(np.int64), "a": first[rest].view(np.int64), "b": own[rest].view(np.int64)})

    return written(signed.groupBy("bucket").applyInArrow(meet, "run bigint, a bigint, b bigint"), "runs")


def _sketches(feature: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each text the parity of its features in each of some cells, as packed bits."""
    cell = text * SKETCH_BITS + (mix(feature) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=n * SKETCH_BITS) & 1).astype(bool).reshape(n, SKETCH_BITS), axis=1)


def _cells(feature: np.ndarray, text: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For each text sums of its features over cells, about `PER_CELL` features each: a count in the low bits, a hash above it.

    The cells are a power of two, and two neighbouring ones add up to one of half as many.
    """
    number = 1 << np.maximum(np.log2(np.maximum(size, 1) / PER_CELL), np.log2(LEAST_CELLS)).astype(np.int64)
    number = np.minimum(number, MOST_CELLS)
    first = np.r_[0, np.cumsum(number)]
    spread = mix(feature + np.uint64(0x5151))
    at = first[text] + ((spread >> np.uint64(32)) * number[text].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    total = np.zeros(first[-1], np.uint64)
    np.add.at(total, at, (spread << np.uint64(16)) | np.uint64(1))
    return [c.tobytes() for c in np.split(total, first[1:-1])]


def _apart(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """So many features at least and at most are in one of two sets only: those of the cells that differ."""
    while len(a) > len(b):
        a = a[::2] + a[1::2]
    while len(b) > len(a):
        b = b[::2] + b[1::2]
    differ = a != b
    one, two = ((x[differ] & np.uint64(0xFFFF)).astype(np.int64) for x in (a, b))
    # Cells of equal counts that differ hold two features at least that the other lacks.
    more = np.abs(one - two)
    return int(np.where(more == 0, 2, more).sum()), int((one + two).sum())


def _settled(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (a, b, sure), without those whose cells differ by so much that they cannot be similar; written.

    Sure are those where the cells that differ hold so little that they must be.
    """
    of = lambda side: facts.select(F.col("set").alias(side), F.col("size").alias(f"size_{side}"), F.col("cells").alias(f"cells_{side}"))
    told = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.col("size_a") + F.col("size_b"), "cells_a", "cells_b")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            bounds = np.array([(size, *_apart(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))) for size, x, y in both], np.int64).reshape(-1, 3)
            open_, sure = 7 * bounds[:, 1] <= bounds[:, 0], 7 * bounds[:, 2] <= bounds[:, 0]
            told = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sure)], names=["a", "b", "sure"])
            yield told.filter(pa.array(open_))

    return written(told.mapInArrow(settle, "a bigint, b bigint, sure boolean"), "settled")


def _bits(sketches: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), dtype=np.uint64).reshape(len(sketches), -1)


def _plausible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches do not rule out; written.  Sketches are small, so this comes before sets are moved."""
    of = lambda side: facts.select(F.col("set").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    told = pairs.join(of("a"), "a").join(of("b"), "b")
    told = told.filter(4 * F.least("size_a", "size_b") >= 3 * F.greatest("size_a", "size_b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.bitwise_count(_bits(batch.column(3)) ^ _bits(batch.column(4))).sum(axis=1, dtype=np.int64)
            close = 7 * apart <= np.asarray(batch.column(2))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(close)) for c in batch.columns[:2]], names=["a", "b"])

    told = told.select("a", "b", F.col("size_a") + F.col("size_b"), "sketch_a", "sketch_b")
    return written(told.mapInArrow(keep, "a bigint, b bigint"), "plausible")


def _compare(documents: DataFrame, pairs: DataFrame, facts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar; written.

    The texts of one document each go to where a pair meets, where the sets are made: texts
    are smaller than the hashes of their features, and a shuffle can compress them.  A first
    set's text goes there once for up to `COMPARED` others.
    """
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / COMPARED).alias("parts"))
    dealt = written(pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "dealt")
    sends = dealt.select(F.col("b").alias("set"), "a", "part", F.lit(1).alias("role")).union(
        dealt.select(F.col("a").alias("set"), "a", "part", F.lit(0).alias("role")).distinct()
    )
    sends = written(sends.join(facts.select("set", "row"), "set").select("row", "set", "a", "part", "role"), "sends")
    few = sends.count() <= SENT_IDS
    chosen = documents.select("row", "text").join(F.broadcast(sends) if few else sends, "row")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key = np.zeros(0, np.uint64), None
        for batch in batches:
            a, b = [], []
            columns = [c.to_pylist() for c in batch.columns[:4]]
            for begin, end, data, begins in chunks(batch.column(4)):
                feature, _, count = _sets(data, begins, width)
                each = np.split(feature, np.cumsum(count)[:-1])
                for features, first, part, role, other in zip(each, *(c[begin:end] for c in columns), strict=True):
                    if role == 0:
                        own, key = features.copy(), (first, part)
                    elif key == (first, part):
                        both = len(np.intersect1d(own, features, assume_unique=True))
                        if 100 * both >= 75 * (len(own) + len(features) - both):
                            a.append(first)
                            b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    met = chosen.select("a", "part", "role", "set", "text").repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return written(met.mapInArrow(compare, "a bigint, b bigint"), "similar")


def _wide(runs: DataFrame, tested: DataFrame) -> DataFrame:
    """The runs that their first pairs do not settle, one of those with the same sets; written.

    These are runs of three sets or more, and those of two whose pair is not tested yet.
    """
    told = runs.join(tested.select("a", "b", F.lit(True).alias("done")), ["a", "b"], "left").groupBy("run").agg(
        F.first("a").alias("a"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("b")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "b")).alias("y"),
        F.max(F.col("done").isNull()).alias("left"),
    )
    one = told.filter("n > 1 OR left").groupBy("a", "n", "x", "y").agg(F.min("run").alias("run")).select("run")
    return written(runs.join(one, "run", "left_semi"), "wide-runs")


def _further(runs: DataFrame, labels: DataFrame, facts: DataFrame, best: int | None) -> DataFrame:
    """Pairs of one run, of different components, that their sketches do not rule out: each set's `best`, or all; written.

    (a, b, run), run being given where a set had more than `best`: other runs need no further look.
    """
    label = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    told = runs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    mine = {s: F.coalesce(f"label_{s}", s) for s in ("a", "b")}
    open_ = told.filter(mine["a"] != mine["b"]).select("run").distinct()
    members = told.join(open_, "run", "left_semi").select(
        "run", F.explode(F.array(*[F.struct(F.col(s).alias("set"), mine[s].alias("label")) for s in ("a", "b")])).alias("m")
    ).select("run", "m.set", "m.label").distinct()
    members = members.join(facts.select("set", "sketch", "size"), "set")

    buckets = partitions(runs.sparkSession)
    members = members.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets)).cast("int"))

    def pair(table: pa.Table) -> pa.Table:
        run, own, label, size = (np.asarray(table[c]) for c in ("run", "set", "label", "size"))
        sketch = _bits(table["sketch"])
        order = np.lexsort((size, run))
        run, own, label, size, sketch = run[order], own[order], label[order], size[order], sketch[order]
        edge = np.r_[np.flatnonzero(np.r_[True, run[1:] != run[:-1]]), len(run)]
        a, b, open_run = [own[:0]], [own[:0]], [own[:0]]
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            upto = lo + np.searchsorted(size[lo:hi], 4 * size[lo:hi] // 3, "right")
            for i in range(lo, hi - 1):
                rest = np.arange(i + 1, upto[i - lo])
                rest = rest[label[rest] != label[i]]
                if not len(rest):
                    continue
                apart = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                close = 7 * apart <= size[rest] + size[i]
                rest = rest[close]
                more = best is not None and len(rest) > best
                if more:
                    rest = rest[np.argsort(apart[close], kind="stable")[:best]]
                open_run.append(np.full(len(rest), run[lo] if more else 0))
                a.append(np.minimum(own[i], own[rest]))
                b.append(np.maximum(own[i], own[rest]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "run": np.concatenate(open_run)})

    found = members.groupBy("bucket").applyInArrow(pair, "a bigint, b bigint, run bigint")
    return written(found.withColumn("run", F.when(F.col("run") != 0, F.col("run"))), "further")


def similar_sets(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Documents (id, row, n_shingles, set) and components of sets (node, label), both written.

    Sets of a component are joined by links of similarity 3/4 or more; sets without
    a link are in no component.  Documents without words have set 0.
    """
    spark = documents.sparkSession
    small_batches(spark)
    source = documents.select(F.col(id_column).alias("id"), F.xxhash64(id_column, text_column).alias("row"), text_of(text_column).alias("text"))
    told = _documents(source, width)
    docs = told.select("id", "row", "n_shingles", "set")
    runs = _runs(_signed(source, width))
    every = runs.select("a", "b").distinct()
    # Runs of one class begin with the same few sets: the least of them join the class, the other pairs are looked at where it is still apart.
    hub = F.row_number().over(Window.partitionBy("b").orderBy("a"))
    pairs = written(every.withColumn("hub", hub).filter(F.col("hub") <= HUBS).select("a", "b"), "pairs")
    found = runs.select(F.col("a").alias("set")).union(runs.select("b")).distinct()
    facts = told.join(found, "set", "left_semi").groupBy("set")
    facts = written(facts.agg(F.min("row").alias("row"), F.first("sketch").alias("sketch"), F.first("cells").alias("cells"), F.first("n_shingles").alias("size")), "facts")

    def compared(pairs: DataFrame) -> DataFrame:
        settled = _settled(_plausible(pairs, facts), facts)
        open_ = written(settled.filter(~F.col("sure")).select("a", "b"), "open")
        sure = settled.filter("sure").select("a", "b")
        return sure if open_.isEmpty() else sure.union(_compare(source, open_, facts, width))

    labels, tested = components(compared(pairs)), pairs
    wide = _wide(runs, pairs)
    for best in (3, None):
        found = _further(wide, labels, facts, best)
        more = written(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            labels, tested = further_linked(labels, compared(more)), tested.union(more)
        wide = wide.join(found.filter(F.col("run").isNotNull()).select("run").distinct(), "run", "left_semi")
        if wide.isEmpty():
            break
    return docs, labels


def classes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the smallest id reachable by links, the row's own included.

    Words are parted by white space, A-Z folded; a text of fewer than `width` words is
    one feature, one without words (or null) has none and no links.  Copies are
    linked.  A null id is never the smallest, unless all of its class are null.
    """
    docs, labels = similar_sets(documents, id_column, text_column, width)
    known = docs.filter(F.col("n_shingles") > 0).join(labels.withColumnRenamed("node", "set"), "set", "left")
    known = known.withColumn("class", F.coalesce("label", "set"))
    least = known.groupBy("class").agg(F.min("id").alias("component_id"))
    least = written(least, "classes")
    per_set = written(known.select("set", "class").distinct().join(least, "class").select("set", "component_id"), "set-classes")
    out = docs.join(per_set, "set", "left").select(
        F.col("id").alias(id_column), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )
    return out


def one_of_each(documents: DataFrame) -> DataFrame:
    """`documents` with one row of each class: that of least id, then least digest of its text; rows without words all stay.

    Repeated rows of one id and text (or of no id) are one document here and give one row, that with the least other columns.
    """
    docs, labels = similar_sets(documents)
    known = docs.filter(F.col("n_shingles") > 0).join(labels.withColumnRenamed("node", "set"), "set", "left")
    known = known.groupBy(F.coalesce("label", "set")).agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("kept"))
    # The survivors are a large share of all rows, what goes is not: the join takes out what goes, and what is there repeatedly.
    kept = written(known.select(F.col("kept.row").alias("_row"), F.lit(True).alias("twice")), "kept")
    rows = docs.filter(F.col("n_shingles") > 0).groupBy(F.col("row").alias("_row")).agg(F.count("*").alias("n"))
    gone = rows.join(kept, "_row", "left").filter(F.col("twice").isNull() | (F.col("n") > 1))
    gone = written(gone.select("_row", F.coalesce("twice", F.lit(False)).alias("twice")), "gone")
    sent = F.broadcast if gone.count() <= SENT_IDS else lambda table: table
    given = documents.withColumn("_row", F.xxhash64("doc_id", "text"))
    rest = given.join(sent(gone.select("_row")), "_row", "left_anti").drop("_row")
    twice = gone.filter("twice").select("_row")
    if twice.isEmpty():
        return rest
    # Combined before it is shuffled, so one row may be there any number of times.
    once = given.join(sent(twice), "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in documents.columns])).alias("one"))
    return rest.unionByName(once.select("one.*"))
