"""Hard negatives by exact integer scores from residue arithmetic.

Scores are inner products of whole-numbered vectors.  A block of anchors meets batches of
rows: both are reduced modulo a few primes, centred about 0, and multiplied as float32
matrices, in stretches so short that every sum stays below 2^24 and hence exact.  The
residues of a score give the signed score by Chinese remaindering, digit by digit in
mixed radix.  How many primes are needed follows from the largest squared length, which
bounds every score (Cauchy-Schwarz).

Anchors are taken a block of bounded size at a time, which is sent to all tasks; the rows
stay where they are and stream past it, and a task keeps for each anchor the best few so
far.  A first pass finds each anchor's positives, a second the negatives in the window of
each positive's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import new_folder, written

#: Components are multiplied by this and rounded down.
UNIT = 256
#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this many hundredths of the positive's.
LEAST = 80
#: Anchors of one block take about so many bytes as whole numbers.
BLOCK_BYTES = 8 << 20
#: Anchors and rows multiplied at a time.
SIDE = 1024
#: Squared lengths from here on are left out: their scores might not fit 64 bits.
MOST = 1 << 62
#: Primes of the residues; sums of 260 products of centred residues stay below 2^24.
PRIMES = (509, 503, 499, 491, 487, 479, 467, 463)


def whole_numbers(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that take part, and their components as whole numbers, shorter vectors filled up with zeros."""
    column = table["vector"]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    owner = np.repeat(np.arange(len(column)), size)
    with np.errstate(over="ignore", invalid="ignore"):
        value = np.floor(UNIT * np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan)))
    fits = np.abs(value) < 2.0**31  # false for what is not finite
    bad = np.bincount(owner[~fits], minlength=len(column)) > 0
    value = np.where(fits, value, 0).astype(np.int64)
    length = np.zeros(len(column))
    np.add.at(length, owner, value.astype(np.float64) ** 2)
    good = np.flatnonzero(~bad & (length < MOST * 0.999))
    full = np.zeros((len(column), int(size.max(initial=0))), np.int32)
    first = np.cumsum(size) - size
    full[owner, np.arange(len(owner)) - first[owner]] = value
    return good, full[good]


def taking_part(vectors: DataFrame, label: Column, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(row, vec_id, label, v, length, bits) of the rows that take part, written: v packs the components, length is squared.

    Rows with a null id, label or vector, with a null or non-finite component, or too
    long for scores of 64 bits are left out.  `row` tells rows of one id apart.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(column).alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, full = whole_numbers(batch)
            length = (full.astype(np.int64) ** 2).sum(axis=1)
            keep = batch.select(["vec_id", "label"]).take(pa.array(good))
            packed = pa.array([v.tobytes() for v in full], pa.binary())
            yield pa.RecordBatch.from_arrays([*keep.columns, packed, pa.array(length, pa.int64())], names=["vec_id", "label", "v", "length"])

    packed = rows.mapInArrow(pack, "vec_id bigint, label bigint, v binary, length bigint")
    return written(packed.select(F.monotonically_increasing_id().alias("row"), "*"), "whole-vectors")


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int32)
    for i, v in enumerate(column):
        own = np.frombuffer(v.as_buffer(), np.int32)
        out[i, : len(own)] = own
    return out


def primes_for(bound: int) -> tuple[int, ...]:
    """The first primes whose product exceeds twice the bound."""
    product = 1
    for i, p in enumerate(PRIMES, 1):
        product *= p
        if product > 2 * bound + 1:
            return PRIMES[:i]
    raise ValueError("scores beyond 64 bits")


def residues(x: np.ndarray, prime: int) -> np.ndarray:
    """x modulo a prime, between -(prime - 1) / 2 and (prime - 1) / 2, as float32."""
    r = x % prime
    return np.where(r > prime // 2, r - prime, r).astype(np.float32)


def products(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products of the rows of two matrices given by their residues.

    In mixed radix with centred digits the signed value is the sum of digits times
    products of primes; sums in 64 bits that wrap around still end at the right value.
    """
    digits: list[np.ndarray] = []
    total = np.zeros((len(a[0]), len(b[0])), np.int64)
    radix = 1
    for i, p in enumerate(primes):
        stretch = (1 << 24) // (p // 2) ** 2
        r = np.zeros_like(total)
        for at in range(0, a[i].shape[1], stretch):
            r += (a[i][:, at : at + stretch] @ b[i][:, at : at + stretch].T).astype(np.int64)
        weight = 1
        for digit, q in zip(digits, primes, strict=False):
            r -= digit * weight
            weight = weight * q % p
        r = (r % p) * pow(weight, -1, p) % p
        r[r > p // 2] -= p
        digits.append(r)
        total += r * np.int64((radix + (1 << 63)) % (1 << 64) - (1 << 63))
        radix *= p
    return total


class _Best:
    """The best k rows of each slot so far: largest score first, ties by smaller id."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.score = np.full((slots, k), np.iinfo(np.int64).min)
        self.vec_id = np.full((slots, k), np.iinfo(np.int64).max)
        self.held = np.zeros((slots, k), bool)

    def take(self, slot: np.ndarray, score: np.ndarray, allowed: np.ndarray, vec_id: np.ndarray) -> None:
        """Scores of some slots (rows) with all ids of a batch (columns), where allowed."""
        open_ = allowed & ((score >= self.score[slot, -1:]) | ~self.held[slot, -1:])
        at, col = np.nonzero(open_)
        if not len(at):
            return
        touched, at = np.unique(at, return_inverse=True)
        old, place = np.nonzero(self.held[slot[touched]])
        s = np.r_[self.score[slot[touched]][old, place], score[touched[at], col]]
        v = np.r_[self.vec_id[slot[touched]][old, place], vec_id[col]]
        own = np.r_[old, at]
        order = np.lexsort((v, -s, own))
        own, s, v = own[order], s[order], v[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        top = rank < self.k
        to, rank = slot[touched[own[top]]], rank[top]
        self.score[to, rank], self.vec_id[to, rank], self.held[to, rank] = s[top], v[top], True


def _streamed(rows: DataFrame, anchors: dict, primes: tuple[int, ...], slots: dict, k: int) -> DataFrame:
    """(slot, vec_id, score): of each slot its best k rows, over each task's rows.

    A slot belongs to an anchor.  Without a window it takes rows of the anchor's label
    but the anchor itself, with one rows of other labels whose score is in the window.
    """
    context = rows.sparkSession.sparkContext
    sent = context.broadcast((anchors, slots))
    width = anchors["x"].shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, slots = sent.value
        best = _Best(len(slots["anchor"]), k)
        sides = [(slice(lo, lo + SIDE), [residues(anchors["x"][lo : lo + SIDE], p) for p in primes]) for lo in range(0, len(anchors["row"]), SIDE)]
        first = [np.searchsorted(slots["anchor"], (side.start, side.stop)) for side, _ in sides]
        for batch in batches:
            for lo in range(0, batch.num_rows, SIDE):
                part = batch.slice(lo, SIDE)
                row, label, vec_id = (np.asarray(part[c]) for c in ("row", "label", "vec_id"))
                x = unpacked(part["v"], width)
                theirs = [residues(x, p) for p in primes]
                for (side, mine), (begin, end) in zip(sides, first, strict=True):
                    score = products(mine, theirs, primes)
                    same = anchors["label"][side, None] == label[None, :]
                    if "low" not in slots:
                        best.take(np.arange(side.start, side.start + len(score)), score, same & (anchors["row"][side, None] != row[None, :]), vec_id)
                        continue
                    of = slots["anchor"][begin:end] - side.start
                    for nth in range(POSITIVES):  # an anchor's slots stand together
                        slot = begin + np.flatnonzero(slots["nth"][begin:end] == nth)
                        at = of[slot - begin]
                        inside = (score[at] >= slots["low"][slot, None]) & (score[at] <= slots["high"][slot, None])
                        best.take(slot, score[at], inside & ~same[at], vec_id)
        slot, rank = np.nonzero(best.held)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(best.vec_id[slot, rank]), pa.array(best.score[slot, rank])], names=["slot", "vec_id", "score"])

    # As many streams as run at once: what each brings home is bound by them, not by the rows.
    streams = max(2 * context.defaultParallelism, 8)
    return rows.select("row", "vec_id", "label", "v").coalesce(streams).mapInArrow(search, "slot bigint, vec_id bigint, score bigint")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, label: Column | None = None, every: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` has vec_id, embedding and label (or `label` gives it).  Anchors are rows
    whose id is divisible by `every`; an anchor's positives are its best rows of the same
    label, and of each positive the best rows of other labels are given whose score lies
    between `LEAST` per cent of the positive's and the positive's; a positive with a
    negative score has none.  What takes part is told at `taking_part`; a vector shorter
    than the longest counts as followed by zeros, one without components as all zeros.
    Rows of one id are rows of their own, anchors too, so repeated rows give repeated
    results; ties go to smaller ids.  Other columns play no part; an empty table gives no
    rows.
    """
    spark = vectors.sparkSession
    rows = taking_part(vectors, F.col("label") if label is None else label)
    length, size, n = rows.agg(F.max("length"), F.max(F.octet_length("v")), F.count_if(F.col("vec_id") % every == 0)).first()
    width = (size or 0) // 4
    primes = primes_for(length or 0)
    blocks = max(1, -(-n * max(size or 0, 24) // block_bytes))
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    if blocks > 1:
        asked = written(asked, "anchors")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    folder = new_folder(spark, "negatives")
    for block in range(blocks):  # one bounded block after the other
        table = asked.filter(F.col("block") == block).drop("block").toArrow().sort_by("row")
        anchors = {"row": np.asarray(table["row"]), "label": np.asarray(table["label"]), "x": unpacked(table["v"].combine_chunks(), width)}
        alike = _first(_streamed(rows, anchors, primes, {"anchor": np.arange(len(anchors["row"]))}, POSITIVES), POSITIVES)
        alike = alike.select("slot", "vec_id", "score", (F.col("rank") - 1).alias("nth")).toArrow().sort_by([("slot", "ascending"), ("nth", "ascending")])
        anchor, high = np.asarray(alike["slot"]), np.asarray(alike["score"])
        low = -(-LEAST * high // 100) if LEAST * int(np.abs(high).max(initial=0)) < MOST else np.array([-(-LEAST * int(h) // 100) for h in high])
        slots = {"anchor": anchor, "nth": np.asarray(alike["nth"]), "low": low, "high": high}
        names = pa.table({"slot": np.arange(len(anchor)), "anchor_id": np.asarray(table["vec_id"])[anchor], "positive_id": alike["vec_id"], "positive_score": alike["score"]})
        found = _first(_streamed(rows, anchors, primes, slots, NEGATIVES), NEGATIVES)
        named = found.join(F.broadcast(spark.createDataFrame(names)), "slot")
        named = named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        named.write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def moved_labels() -> Column:
    """The label, but the next one of ten where the id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


MINE_SQL = f"""
WITH u AS (
  SELECT row_number() OVER () AS rid, CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({UNIT} * x)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.rid AS anchor, a.id AS anchor_id, c.rid AS rid, c.id AS id, a.label = c.label AS alike,
         CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM u a JOIN u c ON a.rid <> c.rid WHERE a.id % 100 = 0
),
p AS (
  SELECT anchor, anchor_id, rid AS positive, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT alike AND {LEAST} * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= {NEGATIVES}
"""
