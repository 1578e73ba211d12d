"""Nearest neighbours by largest inner product, over a vantage-point tree for each shard.

Inner products are no metric.  With one more coordinate, sqrt(M^2 - |x|^2) for a
vector x (M the largest norm) and 0 for a query scaled to norm M, the squared
distance is 2 M^2 - 2 M <q, x> / |q|: nearest there is largest product here, and
the triangle inequality may prune.  A branch is left out when its least possible
distance exceeds `factor` times the distance of the query's k-th best so far:
1 gives exact results, less is faster and may miss some.

Vectors are dealt by a hash of their id to shards of bounded size, whose trees are
written as a table; queries are packed in blocks, and a task takes one block through
a few shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_batches, written

SHARD_ROWS = 2048
QUERY_ROWS = 1024
LEAF_ROWS = 64
#: Trees that one task searches in turn, so that each block of queries brings home one list from so many.
SHARDS_TOGETHER = 8
#: Distances are compared with so much to spare, relative to the largest norm.
SLACK = 1e-7


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part, as doubles.

    Those with a null id or vector, without components, with a null or non-finite
    component, with norm 0, or of another length than most are left out.
    """
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    big = F.lit(float("inf"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).filter(
        F.col("vec_id").isNotNull() & (F.size("vector") > 0)
    )
    rows = rows.filter(~odd).withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).filter("norm > 0")
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.filter(F.size("vector") == (lengths.n if lengths else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order wherever its vectors stand: equal vectors get equal scores."""
    return np.einsum("ij,kj->ik", a, b, optimize=False)


def _build(x: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, and for each inner node the largest distance inside and the least outside.

    A node is a stretch [lo, hi): its vantage point, then the nearer half, then the rest.
    """
    n = len(x)
    order, inner, outer = np.arange(n), np.zeros(n), np.zeros(n)
    left = [(0, n)]
    while left:
        lo, hi = left.pop()
        if hi - lo <= LEAF_ROWS:
            continue
        own = order[lo:hi]
        centre = x[own].mean(axis=0)
        far = int(np.argmax(((x[own] - centre) ** 2).sum(axis=1)))  # a point at the rim parts best
        own[0], own[far] = own[far], own[0]
        rest = own[1:]
        d = np.sqrt(((x[rest] - x[own[0]]) ** 2).sum(axis=1) + (spare[rest] - spare[own[0]]) ** 2)
        half = len(rest) // 2
        by = np.argsort(d, kind="stable")
        order[lo + 1 : hi] = rest[by]
        inner[lo], outer[lo] = d[by[half - 1]], d[by[half]]
        left += [(lo + 1, lo + 1 + half), (lo + 1 + half, hi)]
    return order, inner, outer


class _Search:
    """Searches of a block of queries, in one tree after the other; what one found narrows the next."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, most: float, k: int, factor: float) -> None:
        self.query_ids, self.queries, self.most, self.k, self.factor = query_ids, queries, most, k, factor
        self.norm = np.sqrt((queries**2).sum(axis=1))
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)

    def through(self, ids: np.ndarray, x: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> None:
        self.ids, self.x, self.inner, self.outer = ids, x, inner, outer
        self.visit(0, len(ids), np.arange(len(self.queries)))

    def distance(self, score: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.most**2 - 2 * self.most * score / self.norm[q], 0))

    def reach(self, q: np.ndarray) -> np.ndarray:
        worst = self.score[q, -1]
        return np.where(np.isinf(worst), np.inf, self.factor * self.distance(np.where(np.isinf(worst), 0, worst), q) + SLACK * self.most)

    def take(self, q: np.ndarray, lo: int, hi: int) -> np.ndarray:
        score = _dots(self.queries[q], self.x[lo:hi])
        own = self.query_ids[q][:, None] == self.ids[None, lo:hi]
        open_ = np.where(own, -np.inf, score)
        better = (open_ >= self.score[q, -1:]).any(axis=1) & ~own.all(axis=1)
        if better.any():
            at = q[better]
            scores = np.concatenate([self.score[at], open_[better]], axis=1)
            ids = np.concatenate([self.found[at], np.broadcast_to(self.ids[lo:hi], (len(at), hi - lo))], axis=1)
            ids = np.where(np.isneginf(scores), np.iinfo(np.int64).max, ids)
            best = np.lexsort((ids, -scores))[:, : self.k]
            self.score[at], self.found[at] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)
        return score

    def visit(self, lo: int, hi: int, q: np.ndarray) -> None:
        if not len(q):
            return
        if hi - lo <= LEAF_ROWS:
            self.take(q, lo, hi)
            return
        d = self.distance(self.take(q, lo, lo + 1)[:, 0], q)
        middle = lo + 1 + (hi - lo - 1) // 2
        near = d <= (self.inner[lo] + self.outer[lo]) / 2
        self.visit(lo + 1, middle, q[near])
        self.visit(middle, hi, q[~near])
        reach = self.reach(q)
        self.visit(middle, hi, q[near & (self.outer[lo] - d <= reach)])
        self.visit(lo + 1, middle, q[~near & (d - self.inner[lo] <= reach)])


def build_index(rows: DataFrame, shards: int, most: float) -> DataFrame:
    """A row for each shard, written to the shared folder: ids, vectors and radii in tree order."""
    small_batches(rows.sparkSession)

    def build(table: pa.Table) -> pa.Table:
        ids, x = np.asarray(table["vec_id"]), _matrix(table["vector"])
        spare = np.sqrt(np.maximum(most**2 - (x**2).sum(axis=1), 0))
        order, inner, outer = _build(x, spare)
        parts = (ids[order].tobytes(), x[order].tobytes(), inner.tobytes(), outer.tobytes())
        return pa.table({"shard": table["shard"][:1], **{n: [p] for n, p in zip(("ids", "x", "inner", "outer"), parts, strict=True)}})

    dealt = rows.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"))
    return written(dealt.groupBy("shard").applyInArrow(build, "shard int, ids binary, x binary, inner binary, outer binary"), "trees")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k best others, largest product first, ties to smaller ids.

    Queries are the usable rows whose id is divisible by `every`; rows of the
    query's own id are no candidates.  A query repeated with the same vector is
    searched once.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    n, most = rows.agg(F.count("*"), F.max("norm")).first()
    queries = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"])
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // (every * QUERY_ROWS)))
    trees = build_index(rows, shards, most or 0.0)

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"block": table["block"][:1], "qids": [np.asarray(table["vec_id"]).tobytes()], "q": [_matrix(table["vector"]).tobytes()]})

    packed = queries.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    packed = written(packed.groupBy("block").applyInArrow(pack, "block int, qids binary, q binary"), "queries")
    groups = -(-shards // SHARDS_TOGETHER)
    left = trees.withColumn("part", F.floor(F.col("shard") / SHARDS_TOGETHER).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        query_ids, found, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for j in range(asked.num_rows):
            ids, q = np.frombuffer(asked["qids"][j].as_buffer(), np.int64), np.frombuffer(asked["q"][j].as_buffer())
            one = _Search(ids, q.reshape(len(ids), -1), most, k, factor)
            for i in range(own.num_rows):
                ids = np.frombuffer(own["ids"][i].as_buffer(), np.int64)
                x, inner, outer = (np.frombuffer(own[c][i].as_buffer()) for c in ("x", "inner", "outer"))
                one.through(ids, x.reshape(len(ids), -1), inner, outer)
            real = ~np.isneginf(one.score)
            query_ids.append(np.repeat(one.query_ids, real.sum(axis=1)))
            found.append(one.found[real])
            score.append(one.score[real])
        return pa.table({n: np.concatenate(v) for n, v in (("query_id", query_ids), ("vec_id", found), ("score", score))})

    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
    found = written(met.applyInArrow(search, "query_id bigint, vec_id bigint, score double"), "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op_sql(k: int = 20, every: int = 20) -> str:
    return f"""
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {k}
"""
