"""Exact substring deduplication: bytes under a string of 400 bytes that also starts elsewhere.

Suffixes fall into buckets by an anchor: the least hash of a 64-byte piece within a
suffix's first 400 bytes, the leftmost if it is there twice.  Two suffixes that share
400 bytes share the anchor and their distance from it, so they meet in one bucket,
and a bucket of one suffix holds no repeat.  Only the buckets of repeated anchors are
built, with the stretches of text their suffixes need, and sorted one after the other.

A bucket is sorted by a difference cover.  Its stretches are laid out with their
anchors at multiples of the cover's period, the suffixes at the cover's positions
are ranked first, by blocks of one period and then by doubling, and any other suffix
is placed by the bytes before its next cover position, that position's rank and the
bytes after it: long ties cost no more than short ones, and memory is a few numbers
for each byte of the bucket.

Copies of a whole text are found first; one of them stands for all.  Buckets of very
many suffixes are not gathered: their 400-byte strings are counted by a 128-bit hash,
spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions, small_batches, text_of, written
from .textbytes import _ODD, _VALUES, chunks, mix, packed

LENGTH = 400
PIECE = 64
#: The cover's period, and positions such that every difference modulo the period occurs between two of them.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Suffixes with one anchor beyond which a bucket is counted by hash instead of sorted.
LARGE = 256
#: Bytes of stretches sorted at a time.
SORTED_BYTES = 1 << 20
#: Rows up to this many are sent to all tasks, more are joined.
SENT_ROWS = 1_000_000
#: Anchors a task packs before it hands them on.
PACKED = 1_000_000


def _window_hashes(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of the `length` bytes at each position, built by doubling."""
    base = int(_ODD) + 2 * seed
    now, now_length = mix(_VALUES[data] + np.uint64(seed)), 1
    out, out_length, left = None, 0, length
    while left:
        if left & 1:
            if out is None:
                out, out_length = now, now_length
            else:
                m = len(data) - out_length - now_length + 1
                out = out[: max(m, 0)] * np.uint64(pow(base, now_length, 1 << 64)) + now[out_length : out_length + max(m, 0)]
                out_length += now_length
        left >>= 1
        if left:
            m = max(len(now) - now_length, 0)
            now = now[:m] * np.uint64(pow(base, now_length, 1 << 64)) + now[now_length : now_length + m]
            now_length *= 2
    return mix(out)


def _anchors(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the suffixes of `LENGTH` bytes or more: runs with one anchor (first and last suffix), the anchor's place and hash."""
    n, width = len(data), LENGTH - PIECE + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.view(np.uint64)
    piece = _window_hashes(data, PIECE)
    key = (piece & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(piece), dtype=np.uint64)
    rows = -(-len(key) // width)
    padded = np.full(rows * width, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    block = padded.reshape(rows, width)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - LENGTH + 1
    place = (np.minimum(after[:last], before[width - 1 : width - 1 + last]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(begins)
    whole = np.zeros(n + 1, dtype=np.int64)
    long_ = size >= LENGTH
    whole[begins[:-1][long_]] += 1
    whole[begins[:-1][long_] + size[long_] - LENGTH + 1] -= 1
    valid = np.cumsum(whole)[:last] > 0
    start = np.zeros(n + 1, dtype=bool)
    start[begins] = True
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1] | start[1:last]
    first = np.flatnonzero(new)
    ends = valid.copy()
    ends[:-1] &= new[1:] | ~valid[1:]
    return first, np.flatnonzero(ends), place[first], piece[place[first]]


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks, from 0 on, of tuples of keys in their order."""
    rank = np.unique(keys[0], return_inverse=True)[1].astype(np.uint64)
    for key in keys[1:]:
        if key.dtype != np.uint32:
            key = np.unique(key, return_inverse=True)[1]
        rank = np.unique((rank << np.uint64(32)) | key.astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    return rank.astype(np.uint32)


def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes at each place as a number that sorts like them."""
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | text[at + j]
    return out


def _period_rank(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _rank(*[_word(text, at + j) for j in (0, 8, 16, PERIOD - 8)])


def repeated(stretches: list[np.ndarray], anchors: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each stretch, which of its first `counts` suffixes share their first `LENGTH` bytes with another suffix of any stretch.

    A stretch holds LENGTH bytes for its last suffix; `anchors` are places within it.
    """
    size = np.array([len(s) for s in stretches])
    shift = np.empty(len(stretches), dtype=np.int64)
    at = 0
    for i in range(len(stretches)):
        at += (-(at + anchors[i])) % PERIOD
        shift[i] = at
        at += size[i]
    text = np.zeros(at + 2 * LENGTH, dtype=np.uint8)
    end = np.zeros(len(text), dtype=np.int64)  # where the stretch of each place ends
    for i, s in enumerate(stretches):
        text[shift[i] : shift[i] + size[i]] = s
        end[shift[i] : shift[i] + size[i]] = shift[i] + size[i]
    # Ranks of the cover's positions: blocks of one period, then of 2, 4 and 8, then of 12.
    place = np.arange(len(text))
    sample = place[(np.isin(place % PERIOD, COVER)) & (place + PERIOD <= end)]
    number = np.zeros(len(text), dtype=np.int64)
    number[sample] = np.arange(len(sample))
    ranks = {1: _period_rank(text, sample)}
    for blocks, (a, b) in {2: (1, 1), 4: (2, 2), 8: (4, 4), 12: (8, 4)}.items():
        real = sample + blocks * PERIOD <= end[sample]
        rank = np.zeros(len(sample), dtype=np.uint32)
        rank[real] = _rank(ranks[a][real], ranks[b][number[sample[real] + a * PERIOD]])
        ranks[blocks] = rank
    suffix = np.concatenate([shift[i] + np.arange(counts[i]) for i in range(len(stretches))])
    residue = np.arange(PERIOD)
    ahead = np.array([min((c - r) % PERIOD for c in COVER) for r in residue])
    cover = suffix + ahead[suffix % PERIOD]
    both = _period_rank(text, np.concatenate([suffix, suffix + LENGTH - PERIOD]))
    # Equal strings lie alike from their anchors, so at one residue; without it, two that share a cover position would pass for equal.
    start = (suffix % PERIOD).astype(np.uint64) << np.uint64(32) | both[: len(suffix)]
    order = _rank(start, ranks[12][number[cover]], both[len(suffix) :])
    many = np.bincount(order)[order] > 1
    return np.split(many, np.cumsum(counts)[:-1])


def _stay(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that occur more than once (copy, keep: least row), and the documents without the other rows of those."""
    copies = docs.filter(F.octet_length("text") >= LENGTH).groupBy("copy").agg(F.count("*").alias("n"), F.min("row").alias("keep"))
    copies = written(copies.filter("n > 1").select("copy", "keep"), "copies")
    few = copies.count() <= SENT_ROWS
    told = docs.join(F.broadcast(copies) if few else copies, "copy", "left")
    return copies, told.filter(F.col("keep").isNull() | (F.col("keep") == F.col("row"))).select("row", "text")


def _repeated_anchors(docs: DataFrame, large: int) -> DataFrame:
    """(row, anchors, large): the anchors of each document that stand elsewhere too, and those that stand very often; written."""
    buckets = partitions(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            if waiting:
                name, row = (np.concatenate(x) for x in zip(*waiting, strict=True))
                which, parts = packed((name % np.uint64(buckets)).astype(np.int32), name, row)
                yield pa.RecordBatch.from_arrays([which, *parts], names=["bucket", "names", "rows"])
                waiting.clear()

        for batch in batches:
            rows = np.asarray(batch.column(0)).view(np.uint64)
            for at, _, data, begins in chunks(batch.column(1)):
                first, _, _, name = _anchors(data, begins)
                waiting.append((name, rows[at:][np.searchsorted(begins, first, "right") - 1]))
            if sum(len(w[0]) for w in waiting) >= PACKED:
                yield from hand_on()
        yield from hand_on()

    def meet(table: pa.Table) -> pa.Table:
        name, row = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table[c]]) for c in ("names", "rows"))
        name, inverse, n = np.unique(name, return_inverse=True, return_counts=True)
        many = n[inverse] > 1
        pair = np.unique(np.stack([row[many], name[inverse[many]], n[inverse[many]].astype(np.uint64)]), axis=1)
        return pa.table({"row": pair[0].view(np.int64), "anchor": pair[1].view(np.int64), "large": pair[2] > large})

    found = docs.mapInArrow(find, "bucket int, names binary, rows binary")
    met = found.groupBy("bucket").applyInArrow(meet, "row bigint, anchor bigint, large boolean")
    pick = lambda many: F.collect_list(F.when(F.col("large") == many, F.col("anchor")))
    return written(met.groupBy("row").agg(pick(False).alias("anchors"), pick(True).alias("large")), "anchors")


_KINDS = "bucket int, anchor bigint, row bigint, first bigint, last bigint, place int, n int, bytes binary, one bigint, two bigint"


def _batch(**columns: np.ndarray | list) -> pa.RecordBatch:
    """Rows of `_KINDS` with the given columns, the others null."""
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    size = len(next(iter(columns.values())))
    names = [c.split() for c in _KINDS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[n], types[t]) if n in columns else pa.nulls(size, types[t]) for n, t in names], names=[n for n, _ in names]
    )


def _runs(row: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last of the runs of consecutive positions."""
    order = np.lexsort((position, row))
    row, position = row[order], position[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (position[1:] != position[:-1] + 1)] if len(row) else np.zeros(0, bool)
    return row[new], position[new], position[np.r_[new[1:], True]] if len(row) else position


class _Strings:
    """Hashes of strings from large buckets; what a task can tell by itself is not handed on one by one."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        one, two, row, first = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((two, one))
        one, two, row, first = one[order], two[order], row[order], first[order]
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        start = np.flatnonzero(new)
        times = np.diff(np.r_[start, len(one)])
        alone = np.repeat(times == 1, times)
        r, f, e = _runs(row[~alone], first[~alone])
        yield _batch(row=r, first=f, last=e)
        yield _batch(row=row[alone], first=first[alone], one=one[alone].view(np.int64), two=two[alone].view(np.int64), n=np.ones(alone.sum(), int))
        more = start[times > 1]  # repeated here: others need to know of it, but no place
        yield _batch(one=one[more].view(np.int64), two=two[more].view(np.int64), n=np.full(len(more), 2))


def _suffixes(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """What the buckets are built from; written.

    Rows with a bucket are stretches that are sorted; those with `one` and `two` the
    hashes of single strings of large buckets, with how often a task has found them;
    the others runs that a task has found to be repeated.
    """
    small = anchors.agg(F.coalesce(F.sum(F.size("anchors") + F.size("large") + 1), F.lit(0))).first()[0] <= SENT_ROWS
    chosen = docs.join(F.broadcast(anchors) if small else anchors, "row").select("row", "text", "anchors", "large")
    buckets = partitions(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _Strings()
        for batch in batches:
            for i in range(batch.num_rows):
                row, (_, _, data, begins) = batch.column(0)[i].as_py(), next(chunks(batch.column(1).slice(i, 1)))
                first, last, place, name = _anchors(data, begins)
                sort, count = (np.isin(name, np.asarray(batch.column(c)[i].values).view(np.uint64)) for c in (2, 3))
                if sort.any():
                    f, e, p, h = first[sort], last[sort], place[sort], name[sort]
                    yield _batch(
                        bucket=(h % np.uint64(buckets)).astype(np.int32), anchor=h.view(np.int64), row=np.full(len(f), row), first=f,
                        place=p - f, n=e - f + 1, bytes=[data[a : b + LENGTH].tobytes() for a, b in zip(f, e, strict=True)],
                    )
                if count.any():
                    at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[count], last[count], strict=True)])
                    strings.add(_window_hashes(data, LENGTH)[at], _window_hashes(data, LENGTH, 1)[at], np.full(len(at), row), at)
            if strings.size >= PACKED:
                yield from strings.hand_on()
        yield from strings.hand_on()

    return written(chosen.mapInArrow(make, _KINDS), "suffixes")


def _sorted_repeats(stretches: DataFrame) -> DataFrame:
    """(row, first, last): runs of suffixes whose string starts elsewhere too, from buckets sorted one after the other."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("anchor")
        anchor, row, first, place, n = (np.asarray(table[c]) for c in ("anchor", "row", "first", "place", "n"))
        size = np.asarray(pa.compute.binary_length(table["bytes"])) if len(anchor) else np.zeros(0, int)
        edge = np.r_[np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]), len(anchor)]
        upto = np.r_[0, np.cumsum(size)]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(edge) - 1:
            to = max(int(np.searchsorted(upto[edge], upto[edge[at]] + SORTED_BYTES, "right")) - 1, at + 1)
            lo, hi = edge[at], edge[to]
            texts = [np.frombuffer(table["bytes"][i].as_buffer(), np.uint8) for i in range(lo, hi)]
            many = np.concatenate(repeated(texts, place[lo:hi], n[lo:hi]))
            owner = np.repeat(np.arange(lo, hi), n[lo:hi])
            position = np.concatenate([np.arange(k) for k in n[lo:hi]]) + first[owner]
            start = many & np.r_[True, (owner[1:] != owner[:-1]) | ~many[:-1]]
            stop = many & np.r_[(owner[1:] != owner[:-1]) | ~many[1:], True]
            out.append((row[owner[start]], position[start], position[stop]))
            at = to
        parts = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table(dict(zip(("row", "first", "last"), parts, strict=True)))

    return stretches.groupBy("bucket").applyInArrow(build, "row bigint, first bigint, last bigint")


def _spans(runs: DataFrame) -> DataFrame:
    """(row, spans): the bytes to remove of each document, as merged [begin, end); written."""

    def merge(table: pa.Table) -> pa.Table:
        first, last = np.asarray(table["first"]), np.asarray(table["last"]) + LENGTH
        order = np.argsort(first, kind="stable")
        first, last = first[order], np.maximum.accumulate(last[order])
        new = np.r_[True, first[1:] > last[:-1]]
        begin, end = first[new], last[np.r_[new[1:], True]]
        spans = [{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.table({"row": table["row"][:1], "spans": pa.array([spans], kind)})

    return written(runs.groupBy("row").applyInArrow(merge, "row bigint, spans array<struct<begin: bigint, end: bigint>>"), "spans")


def repeated_spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", large: int = LARGE) -> DataFrame:
    """(id, text, whole, spans), a row for each row of `documents`: what of its UTF-8 bytes stands elsewhere.

    `whole` tells that another row has the same text of `LENGTH` bytes or more, and
    then all of it does; else `spans` are the maximal runs, null if there are none.
    A null text is an empty one.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(
        F.col(id_column).alias("id"), text_of(text_column).alias("text"), F.md5(text_of(text_column)).alias("copy"),
        F.xxhash64(id_column, text_column).alias("row"),
    )
    copies, single = _stay(docs)
    anchors = _repeated_anchors(single, large)
    suffixes = _suffixes(single, anchors)
    runs = _sorted_repeats(suffixes.filter(F.col("bucket").isNotNull()))
    strings = suffixes.filter(F.col("one").isNotNull())
    twice = strings.groupBy("one", "two").agg(F.sum("n").alias("times")).filter("times > 1").select("one", "two")
    twice = written(twice, "strings")
    alone = strings.filter(F.col("row").isNotNull()).join(twice, ["one", "two"], "left_semi")
    sure = suffixes.filter(F.col("last").isNotNull()).select("row", "first", "last")
    spans = _spans(runs.union(sure).union(alone.select("row", "first", F.col("first").alias("last"))))
    few = spans.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0] <= SENT_ROWS
    copy = copies.select("copy", F.lit(True).alias("whole"))
    told = docs.join(F.broadcast(copy) if copies.count() <= SENT_ROWS else copy, "copy", "left")
    told = told.join(F.broadcast(spans) if few else spans, "row", "left")
    return told.select("id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")


def dedup(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", large: int = LARGE) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept), a row for each row of `documents`; `kept` are the remaining bytes."""
    found = repeated_spans(documents, id_column, text_column, large)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, whole, spans in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                data = text.encode()
                own = [(0, len(data))] if whole else [(s["begin"], s["end"]) for s in spans or []]
                at, kept = 0, []
                for begin, end in own:
                    kept.append(data[at:begin])
                    at = end
                kept.append(data[at:])
                rows.append((len(data), sum(e - b for b, e in own), len(own), b"".join(kept)))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array([r[3] for r in rows], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    schema = found.select("id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return found.mapInArrow(cut, schema).withColumnRenamed("id", id_column)


def report(documents: DataFrame, large: int = LARGE) -> DataFrame:
    return dedup(documents, large=large).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
