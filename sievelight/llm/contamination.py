"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents.  A block holds the documents of about a megabyte
of text and, for each term, the sorted positions at which it stands; positions
run on from document to document with one number left out between two, so no
phrase crosses a border.  The index is written to the shared folder.  A search
takes test phrases in bounded groups and, in each block, starts from a phrase's
rarest term there and keeps a position only where every further term's list,
shifted by its offset, holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import small_batches, text_of, written
from .textbytes import CHUNK, LETTERS, chunks, words

#: Words of a window.
WINDOW = 13
#: Terms up to which an index is narrowed to the terms of the tests (8 bytes each are sent to tasks).
TERM_LIMIT = 1_000_000
#: Bytes of test text searched at a time; more is searched in further groups.
GROUP_BYTES = 4_000_000

_BLOCK = "block bigint, doc_no int, n_words bigint, terms binary, counts binary, positions binary, firsts binary"


def build_index(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", terms: np.ndarray | None = None) -> DataFrame:
    """Write the index and return it: a row for each document (block, doc_no, id, n_words) and one for each block's lists.

    Words are runs of ASCII letters, digits and bytes beyond ASCII, A-Z folded; a
    null text has none.  `terms` (sorted hashes) narrows the lists to those terms.
    Documents may repeat and ids may be null: rows are told by block and number.
    """
    spark = documents.sparkSession
    small_batches(spark)
    source = documents.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), *T.StructType.fromDDL(_BLOCK).fields])
    keep = None if terms is None else spark.sparkContext.broadcast(terms)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, last, data, begins in chunks(batch.column(1), 2 * CHUNK):
                h, text = words(data, begins, LETTERS)
                n = last - first
                size = np.bincount(text, minlength=n)
                position = np.arange(len(h)) + text
                if keep is not None:
                    own = keep.value
                    at = np.minimum(np.searchsorted(own, h), max(len(own) - 1, 0))
                    found = own[at] == h if len(own) else np.zeros(len(h), bool)
                    h, position = h[found], position[found]
                order = np.argsort(h, kind="stable")
                term, count = np.unique(h, return_counts=True)
                lists = [
                    [None] * n + [b.tobytes()]
                    for b in (
                        term, count.astype(np.uint32), position[order].astype(np.uint32),
                        (np.cumsum(size) - size + np.arange(n)).astype(np.uint32),
                    )
                ]
                columns = [
                    pa.concat_arrays([batch.column(0).slice(first, n), pa.nulls(1, batch.schema.field(0).type)]),
                    pa.array([block] * (n + 1), pa.int64()), pa.array([*range(n), None], pa.int32()),
                    pa.array([*size.tolist(), None], pa.int64()), *[pa.array(x, pa.binary()) for x in lists],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
                block += 1

    return written(source.mapInArrow(index, schema), "positions")


def _phrases(tests: list[tuple], window: int) -> tuple[np.ndarray, list[np.ndarray], list[list]]:
    """Distinct phrases (one array of term hashes each) and the items that hold each."""
    column = pa.array([t[1] or "" for t in tests], pa.string())
    found: dict[bytes, set] = {}
    for first, _, data, begins in chunks(column):
        h, text = words(data, begins, LETTERS)
        for item in np.unique(text):
            own = h[text == item]
            for at in range(max(1, len(own) - window + 1)):
                found.setdefault(own[at : at + window].tobytes(), set()).add(tests[first + int(item)][0])
    keys = list(found)
    return [np.frombuffer(k, dtype=np.uint64) for k in keys], [list(found[k]) for k in keys]


def _bounded(tests: DataFrame, id_column: str, text_column: str, window: int) -> Iterator[tuple[list[np.ndarray], list[list]]]:
    """Phrases and items of the tests, a bounded group at a time."""
    group, size = [], 0
    for row in tests.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).toLocalIterator():
        group.append((row.id, row.text))
        size += len(row.text) + 1
        if size >= GROUP_BYTES:
            yield _phrases(group, window)
            group, size = [], 0
    if group:
        yield _phrases(group, window)


class _Lists:
    """The lists of one block, with look-ups for many phrases at a time."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes) -> None:
        self.terms = np.frombuffer(terms, dtype=np.uint64)
        self.counts = np.frombuffer(counts, dtype=np.uint32).astype(np.int64)
        self.positions = np.frombuffer(positions, dtype=np.uint32).astype(np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts) << 32) + self.positions

    def number(self, term: np.ndarray) -> np.ndarray:
        """Each term's number here, or -1."""
        if not len(self.terms):
            return np.full(term.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        return np.where(self.terms[at] == term, at, -1)

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of each term: which of the terms, and where."""
        count = self.counts[term]
        owner = np.repeat(np.arange(len(term)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return owner, self.positions[np.repeat(self.begin[term], count) + inner]

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 32) + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (position >= 0)

    def nearest(self, term: np.ndarray, position: np.ndarray, reach: int) -> np.ndarray:
        """Whether the term stands within `reach` of the position, either side."""
        key = (term << 32) + np.maximum(position - reach, 0)
        at = np.searchsorted(self.keys, key)
        at = np.minimum(at, len(self.keys) - 1)
        return (self.keys[at] >> 32 == term) & (np.abs((self.keys[at] & 0xFFFFFFFF) - position) <= reach)


def _exact(lists: _Lists, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of one length: number of the phrase and begin of each occurrence."""
    number = lists.number(phrases)
    there = np.flatnonzero((number >= 0).all(axis=1))
    if not len(there):
        return there, there
    number = number[there]
    order = np.argsort(lists.counts[number], axis=1, kind="stable")  # the rarest term first
    owner, position = lists.spread(number[np.arange(len(there)), order[:, 0]])
    begin = position - order[owner, 0]
    for k in range(1, phrases.shape[1]):
        slot = order[owner, k]
        on = lists.holds(number[owner, slot], begin + slot)
        owner, begin = owner[on], begin[on]
        if not len(owner):
            break
    return there[owner], begin


def _near(lists: _Lists, phrases: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """As `_exact`, but the terms may stand in any order within `reach` words of the rarest one."""
    number = lists.number(phrases)
    there = np.flatnonzero((number >= 0).all(axis=1))
    if not len(there):
        return there, there
    number = number[there]
    order = np.argsort(lists.counts[number], axis=1, kind="stable")
    owner, position = lists.spread(number[np.arange(len(there)), order[:, 0]])
    for k in range(1, phrases.shape[1]):
        on = lists.nearest(number[owner, order[owner, k]], position, reach)
        owner, position = owner[on], position[on]
    return there[owner], position


def search(
    index: DataFrame, phrases: list[np.ndarray], items: list[list], item_type: T.DataType, reach: int | None = None
) -> DataFrame:
    """Where phrases occur: (block, doc_no, spans, items), a row for each document that has any.

    Spans are runs [begin, end) of the document's word numbers, merged; items are
    those whose phrases occur.  `reach` None asks for the exact phrase; a number
    asks for all its terms within so many words of the rarest one, whose place is
    then the span.
    """
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(phrases):
        by_length.setdefault(len(p), []).append(i)
    parts = [(np.array(rows), np.array([phrases[i] for i in rows])) for n, rows in sorted(by_length.items()) if n]
    sent = index.sparkSession.sparkContext.broadcast((parts, items))
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("doc_no", T.IntegerType()),
         T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(item_type))]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, items = sent.value
        for batch in batches:
            for block, terms, counts, positions, firsts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lists, first = _Lists(terms, counts, positions), np.frombuffer(firsts, dtype=np.uint32).astype(np.int64)
                found: dict[int, tuple[list, set]] = {}
                for rows, group in parts if len(lists.terms) else []:
                    which, begin = _exact(lists, group) if reach is None else _near(lists, group, reach)
                    doc = np.searchsorted(first, begin, "right") - 1
                    own = begin - first[doc]
                    for d, b, w in zip(doc.tolist(), own.tolist(), rows[which].tolist(), strict=True):
                        spans, names = found.setdefault(d, ([], set()))
                        spans.append((b, b + (group.shape[1] if reach is None else 1)))
                        names.update(items[w])
                if found:
                    rows = [
                        {"block": block, "doc_no": d, "spans": [{"begin": b, "end": e} for b, e in _merged(spans)], "items": list(names)}
                        for d, (spans, names) in found.items()
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    postings = index.filter(F.col("terms").isNotNull()).select("block", "terms", "counts", "positions", "firsts")
    return postings.mapInArrow(find, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def contamination(
    documents: DataFrame, tests: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, reach: int | None = None,
) -> DataFrame:
    """What of each document stands in test items: id, n_words, spans of hit words, n_hit and the items.

    An item's phrases are its runs of `window` words, or all its words if fewer; an
    item without words, or a null text, has none.  Items of one id count once, a
    null item id not at all in `items` (its phrases still hit).  Every row of
    `documents` gives one row; a null id stays null.
    """
    item_type = tests.select(F.col(item_column).alias("id")).schema["id"].dataType
    terms: np.ndarray | None = np.zeros(0, np.uint64)
    for phrases, _ in _bounded(tests, item_column, item_text, window):
        terms = np.unique(np.concatenate([terms, *phrases]))
        if len(terms) > TERM_LIMIT:
            terms = None  # the index then holds every term
            break
    index = build_index(documents, id_column, text_column, terms)
    found = [search(index, phrases, items, item_type, reach) for phrases, items in _bounded(tests, item_column, item_text, window)]
    hits = reduce(DataFrame.union, found or [search(index, [], [], item_type)])
    if len(found) > 1:
        hits = hits.groupBy("block", "doc_no").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
        )
    hits = written(hits, "hits")
    docs = index.filter(F.col("doc_no").isNotNull()).select("block", "doc_no", F.col("id").alias(id_column), "n_words")
    numbers = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["end"] - 1))))
    hits = hits.select("block", "doc_no", "spans", F.size(numbers).cast("long").alias("n_hit"),
                       F.array_distinct(F.array_compact("items")).alias("items"))
    out = docs.join(hits, ["block", "doc_no"], "left").drop("block", "doc_no")
    return out.withColumns(
        {"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
         "items": F.coalesce("items", F.array().cast(T.ArrayType(item_type)))}
    )


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> F.Column:
    """At least a twentieth of the words, and at least one, stand in test items."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminated(documents: DataFrame, tests: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all their columns as they were.

    The decision rests on a row's id and text and is tied back by a digest of both:
    repeated rows share it, and a null id is an id like any other.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), text_of()))
    bad = contamination(documents.select(key.alias("key"), text_of().alias("text")), tests, "key")
    bad = written(bad.filter(contaminated()).select(F.col("key").alias("_key")).distinct(), "contaminated")
    return documents.withColumn("_key", key).join(bad, "_key", "left_anti").drop("_key")


def report(documents: DataFrame, tests: DataFrame) -> DataFrame:
    """`contamination` with the items as a digest and the decision."""
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return contamination(documents, tests).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
