"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of (a, b); a component's label is its smallest node.

    In each round every node moves to that of least hash among itself and its
    neighbours, and links are carried over to where their ends have moved; those
    within one place go.  A link's end that moved is linked to where it went, so no
    connection is lost.  Hashes differ by round, so the number of places falls by a
    share each time whatever the shape, and all rounds together join a few times the
    links.  Each round is written, so a lost executor costs that round at most.
    """
    edges, moves = written(links.select("a", "b").distinct(), "links"), []
    while not edges.isEmpty():
        if len(moves) == ROUNDS:
            raise RuntimeError("components did not settle")
        near = edges.union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b"))
        rank = F.struct(F.xxhash64(F.lit(str(len(moves))), "b"), "b")
        moved = near.groupBy("a").agg(F.min(rank).alias("to")).select(F.col("a").alias("node"), F.col("to.b").alias("place"))
        moves.append(written(moved, "moves"))
        to = lambda side: moves[-1].select(F.col("node").alias(side), F.col("place").alias(f"to_{side}"))
        edges = edges.join(to("a"), "a").join(to("b"), "b").filter("to_a != to_b")
        # A link and its reverse are one.
        edges = written(edges.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    place = moves.pop()
    while moves:
        further = place.select(F.col("node").alias("place"), F.col("place").alias("last"))
        place = moves.pop().join(further, "place", "left").select("node", F.coalesce("last", "place").alias("place"))
    place = written(place, "places")
    return written(place.join(place.groupBy("place").agg(F.min("node").alias("label")), "place").select("node", "label"), "labels")


def further_linked(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (see `components`) as they are with more links (a, b): only the new links are gone through."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = components(ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")))
    known = labels.join(over.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left")
    new = over.join(labels, "node", "left_anti")
    return written(known.select("node", F.coalesce("least", "label").alias("label")).union(new), "labels")
