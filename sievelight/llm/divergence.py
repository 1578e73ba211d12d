"""Audit of how the sources of a language differ in their words.

Words are counted by language and source inside the tasks that read the texts, and the
counts are combined before they are shuffled.  Two results follow, in whole numbers
throughout:

* how far each source is from each other one of its language.  Terms are dealt to blocks
  and sources to tiles; a task holds the shares of one block's terms for two tiles of
  sources, and gives one number a pair, so what is sent does not grow with the terms;
* each source's terms that stand out most against the language.  A term's value rises
  with its count in the source and falls with its count in the language, and equal values
  go by UTF-8.  So a term that k others dominate (counts no lower there, no higher here,
  earlier in UTF-8) is not among the first k: parts of a source's terms keep those that
  fewer than k others dominate, their skyband; skybands are merged by sixteens, and only
  the last one is ranked by exact values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import text_of, written

#: Documents of its language that must hold a term.
LEAST_DOCS = 10
#: Terms listed for each source.
LISTED = 10
#: Shares are whole numbers of this part.
SCALE = 1_000_000_000
#: Distinct words a task holds before it sends their counts on, and bytes of a text split at a time.
HELD_WORDS, PIECE_BYTES = 400_000, 1 << 22
#: Counts in one block of terms, sources in a tile, terms of a block worked on at a time.
BLOCK_COUNTS, TILE, TERMS_AT_ONCE = 1 << 18, 128, 2048
#: Terms of a source in one part, and skybands merged by one task.
PART_TERMS, MERGED = 1 << 16, 16

PAIR = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

_LETTER = [65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
#: Bytes that belong to no term become blanks, A-Z become a-z.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if _LETTER[b] else 32 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and _LETTER[text[end]]:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, source and term of a task's rows: occurrences, and documents that hold it.  The empty term counts documents."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, holders) in seen.items():
            n = len(holders)
            columns = [pa.array([lang] * n), pa.array([source] * n), pa.array(list(holders), pa.binary()),
                       pa.array([uses[t] for t in holders], pa.int64()), pa.array(list(holders.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        seen.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
            uses, holders = seen.setdefault((lang, source), (Counter(), Counter()))
            before = len(holders)
            own = {b""}
            for terms in _terms(text.as_py()):
                uses.update(terms)
                own.update(terms)
            holders.update(own)
            held += len(holders) - before
            if held >= HELD_WORDS:
                yield from emit()
                held = 0
    yield from emit()


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over all documents, terms as bytes; a row with the empty term for every group.

    Nulls in text, lang and source count as empty.  Rows that are repeated count as
    documents each.
    """
    rows = documents.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").cast("binary").alias("text"))
    each = rows.mapInArrow(_count, "lang string, source string, term binary, n bigint, docs bigint")
    return written(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) by long division, three digits at a time."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def _share(count: Column, total: Column) -> Column:
    scaled = F.lit(SCALE).cast("decimal(20,0)") * (count + 2).cast("decimal(18,0)")
    return F.call_function("div", scaled, total.cast("decimal(20,0)")) + 1


def _pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block of terms for two tiles of sources: what it adds to each pair's distance.

    A block without terms stands for pairs of which neither source has any of the terms;
    other blocks add what their terms change in that.
    """
    first, second = right["a"][0].as_py(), right["b"][0].as_py()
    names = right["source"].to_pylist()
    tile = np.asarray(right["tile"])
    total = np.asarray(right["total"]) + 2 * np.asarray(right["kept"])
    none = np.where(total > 0, shares(np.full(len(names), 2), np.maximum(total, 1)), 1)
    rows, cols = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
    apart = (none[rows, None] - none[None, cols]) ** 2 // (none[rows, None] + none[None, cols])
    if left.num_rows == 0:
        value = apart * int(right["kept"][0].as_py())
    else:
        place = {name: i for i, name in enumerate(names)}
        source = np.array([place[s] for s in left["source"].to_pylist()])
        coded = left["term"].combine_chunks().dictionary_encode()
        term, terms = np.asarray(coded.indices), len(coded.dictionary)
        n = np.asarray(left["n"])
        order = np.argsort(term, kind="stable")
        source, term, n = source[order], term[order], n[order]
        value = apart * -terms
        for start in range(0, terms, TERMS_AT_ONCE):
            lo, hi = np.searchsorted(term, [start, start + TERMS_AT_ONCE])
            width = min(TERMS_AT_ONCE, terms - start)
            p = np.repeat(none[:, None], width, axis=1)
            p[source[lo:hi], term[lo:hi] - start] = shares(n[lo:hi] + 2, total[source[lo:hi]])
            for i, row in enumerate(rows):
                q = p[cols]
                value[i] += ((q - p[row]) ** 2 // (q + p[row])).sum(axis=1)
    i, j = np.nonzero(rows[:, None] < cols[None, :] if first == second else np.ones_like(value, dtype=bool))
    one, two = rows[i], cols[j]
    lang = [right["lang"][0].as_py()] * len(i)
    return pa.Table.from_arrays([pa.array(lang, pa.string()), *(pa.array([names[k] for k in side], pa.string()) for side in (one, two)), pa.array(value[i, j])], schema=PAIR)


def distances(counts: DataFrame, groups: DataFrame, block_counts: int = BLOCK_COUNTS, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of different sources of a language.

    `counts` is (lang, source, term, n) of kept terms, `groups` (lang, source, total,
    kept) of all sources.  Both are dealt by block and pair of tiles.
    """
    most = counts.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    wide = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks, tiles = -(-most // block_counts), max(1, -(-wide // tile))
    numbers = F.sequence(F.lit(0), F.lit(tiles - 1))
    mine = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")

    def dealt(rows: DataFrame) -> DataFrame:
        met = rows.withColumn("tile", mine).withColumn("other", F.explode(numbers))
        return met.withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")}).drop("other")

    block = F.pmod(F.xxhash64("term"), F.lit(max(1, blocks))).cast("int")
    left = dealt(counts.select("lang", "source", "term", "n", block.alias("block"))).drop("tile")
    right = dealt(groups.select("lang", "source", "total", "kept").withColumn("block", F.explode(F.sequence(F.lit(-1), F.lit(blocks - 1)))))
    key = ["lang", "block", "a", "b"]

    def add(own: pa.Table, asked: pa.Table) -> pa.Table:
        if own.num_rows == 0 and asked["block"][0].as_py() >= 0:
            return PAIR.empty_table()
        return _pairs(own, asked)

    each = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(add, "lang string, source string, item string, value bigint")
    once = each.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return once.select("lang", F.explode(both).alias("way"), "value").select("lang", "way.source", "way.item", "value")


def skyband(n: np.ndarray, lang_n: np.ndarray, name: np.ndarray, k: int, step: int = 512) -> np.ndarray:
    """Places of the terms that fewer than k others dominate; `name` gives the order of the terms in UTF-8.

    In order of falling n a term follows all that dominate it, and of those it is enough
    to count the ones kept: one that was left out has k of them before itself.
    """
    order = np.lexsort((name, lang_n, -n))
    kept = np.zeros(0, np.int64)
    for start in range(0, len(order), step):
        own = order[start : start + step]
        over = ((lang_n[kept, None] <= lang_n[None, own]) & (name[kept, None] < name[None, own])).sum(axis=0)
        own = own[over < k]
        over = over[over < k]
        over = over + np.triu((lang_n[own, None] <= lang_n[None, own]) & (name[own, None] < name[None, own]), 1).sum(axis=0)
        kept = np.r_[kept, own[over < k]]
    return kept


def leading_terms(counts: DataFrame, k: int = LISTED, part_terms: int = PART_TERMS) -> DataFrame:
    """The rows of `counts` (lang, source, term, n, lang_n) among which each source's first k terms are, by merged skybands."""
    most = counts.groupBy("lang", "source").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // part_terms))
    columns = ["lang", "source", "part", "term", "n", "lang_n"]
    schema = "lang string, source string, part int, term binary, n bigint, lang_n bigint"

    def band(table: pa.Table) -> pa.Table:
        terms = table["term"].to_pylist()
        name = np.empty(len(terms), np.int64)
        name[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
        return table.take(pa.array(skyband(np.asarray(table["n"]), np.asarray(table["lang_n"]), name, k)))

    rows = counts.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).select(*columns)
    while True:
        rows = rows.groupBy("lang", "source", "part").applyInArrow(band, schema)
        if parts == 1:
            return rows.drop("part")
        parts = -(-parts // MERGED)
        rows = rows.withColumn("part", F.floor(F.col("part") / MERGED).cast("int")).select(*columns)


def audit(
    documents: DataFrame, least_docs: int = LEAST_DOCS, listed: int = LISTED, block_counts: int = BLOCK_COUNTS, tile: int = TILE,
    part_terms: int = PART_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of the sources of `documents` (text, lang, source).

    Part `pair` ranks the other sources of the language by distance, part `term` the
    source's terms, at most `listed`, that stand out against the language.  Nulls count
    as empty texts and names; repeated rows are documents each; ties go by UTF-8; other
    columns play no part.  A source without kept terms has pairs but no terms, a language
    of one source no pairs; an empty table gives no rows.
    """
    every = term_counts(documents)
    words = every.filter(F.octet_length("term") > 0)
    kept = words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs)
    counts = written(words.select("lang", "source", "term", "n").join(kept.drop("docs"), ["lang", "term"]), "kept-counts")
    in_lang = counts.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    in_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.filter(F.octet_length("term") == 0).select("lang", "source").join(in_group, ["lang", "source"], "left")
    groups = written(groups.join(in_lang, "lang", "left").na.fill(0, ["total", "kept", "lang_total"]), "groups")

    here, there = F.col("p"), F.col("q")
    leading = leading_terms(counts.select("lang", "source", "term", "n", "lang_n"), listed, part_terms).join(groups, ["lang", "source"])
    leading = leading.withColumns(
        {"p": _share(F.col("n"), F.col("total") + 2 * F.col("kept")), "q": _share(F.col("lang_n"), F.col("lang_total") + 2 * F.col("kept"))}
    ).filter(here > there)
    value = F.call_function("div", (here - there) * (here - there), here + there)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = leading.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), value.alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= listed)
    pairs = distances(counts, groups, block_counts, tile)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(terms)


AUDIT_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
grp AS (SELECT DISTINCT lang, source FROM doc),
use AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n FROM use GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
own AS (SELECT lang, source, term, count(*) AS n FROM use SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (
  SELECT grp.lang, grp.source, coalesce(t.n, 0) AS n, coalesce(k.v, 0) AS v, coalesce(k.n, 0) AS lang_n
  FROM grp LEFT JOIN (SELECT lang, source, sum(n) AS n FROM own GROUP BY lang, source) t USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang) k USING (lang)
),
share AS (
  SELECT size.lang, size.source, kept.term, coalesce(own.n, 0) AS n,
         1 + (CAST({SCALE} AS HUGEINT) * (coalesce(own.n, 0) + 2)) // (size.n + 2 * size.v) AS p,
         1 + (CAST({SCALE} AS HUGEINT) * (kept.n + 2)) // (size.lang_n + 2 * size.v) AS q
  FROM size JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM share WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= {LISTED}
"""
