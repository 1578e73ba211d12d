"""Mixing sources to target weights by entropy balancing, with built-in functions only.

Each document gets a rate between 0 and 2.  Among all rates that give each source
its target of words, those chosen differ least from one copy each, in relative
entropy with both bounds: rate = 2 / (1 + exp(-m u)), where u is the document's
size over its source's mean and m the source's multiplier, the odds being tilted
exponentially.  The dual problem is convex and its Hessian diagonal, for a document
is in one source; each Newton step is one aggregation over counts of documents by
source and size.  Rates become copies by rounding running sums, and one document
of each source takes what is left over as part of a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import text_of, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of all documents.
SHARE = 1.5
#: Copies a document may have, and a source's words in the mix over its words.
MOST = 2
#: Newton steps at most, and the relative error that ends them.
STEPS = 60
CLOSE = 1e-10
#: Documents of one size and source ranked together.
SLOT = 512


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(sid, source, source_size, n, target): a table of sources with sizes gets its targets.

    In order of 2 * size / weight the sources held at their limit come first; the
    level that the rest shares follows from running sums.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(names) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    limit = MOST * F.col("source_size").cast("double")
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = sizes.select("*", number.cast("int").alias("sid"), weight.alias("weight"), limit.alias("limit")).withColumn("level", level)
    free = F.col("limit") > F.col("weight") * F.col("level")
    first = F.min(F.when(free, F.struct((F.col("limit") / F.col("weight")).alias("ratio"), "sid", "level"))).over(everything)
    return ranked.withColumn("shared", first["level"]).select(
        "sid", "source", "source_size", "n", F.least("limit", F.coalesce(F.col("weight") * F.col("shared"), "limit")).alias("target")
    )


def _rate(multiplier: Column, size: Column, mean: Column) -> Column:
    return MOST / (1 + F.exp(-multiplier * size / mean))


def balance(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """The multiplier of each source whose target is within its limits: (sid, m, mean).

    `counts` is (sid, size, docs).  Newton's step is taken where it stays in the
    interval known to hold the solution, else the interval is halved.
    """
    size = F.col("size").cast("double")
    state = sources.filter((F.col("target") > 0) & (F.col("target") < MOST * F.col("source_size"))).select(
        "sid", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(0.0).alias("m"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("error"),
    )
    state = stage(state)
    for _ in range(STEPS):
        each = counts.join(state, "sid")
        share = 1 / (1 + F.exp(-F.col("m") * size / F.col("mean")))
        sums = each.groupBy("sid").agg(
            F.sum(F.col("docs") * size * MOST * share).alias("words"),
            F.sum(F.col("docs") * size * size / F.col("mean") * MOST * share * (1 - share)).alias("slope"),
        )
        over = F.col("words") - F.col("target")
        step = state.join(sums, "sid").withColumns(
            {"lo": F.when(over <= 0, F.col("m")).otherwise(F.col("lo")), "hi": F.when(over >= 0, F.col("m")).otherwise(F.col("hi")),
             "error": F.abs(over) / F.col("target"), "next": F.col("m") - over / F.when(F.col("slope") > 0, F.col("slope"))}
        )
        inside = (F.col("next") > F.coalesce("lo", F.lit(-1e300))) & (F.col("next") < F.coalesce("hi", F.lit(1e300)))
        near = F.abs(F.col("next") - F.col("m")) <= 2 * F.greatest(F.lit(1.0), F.abs("m"))
        half = F.when(F.col("lo").isNull(), F.least(2 * F.col("m"), F.lit(-1.0))).when(
            F.col("hi").isNull(), F.greatest(2 * F.col("m"), F.lit(1.0))
        ).otherwise((F.col("lo") + F.col("hi")) / 2)
        move = F.when(F.col("error") <= CLOSE, F.col("m")).when(inside & near, F.col("next")).otherwise(half)
        state = stage(step.select("sid", "target", "mean", move.alias("m"), "lo", "hi", "error"))
        if (state.agg(F.max("error")).first()[0] or 0.0) <= CLOSE:
            break
    return state.select("sid", "m", "mean")


def mix(documents: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies), a row for each row of `documents`.

    `taken` counts the words the mix takes of a document, repeats included: whole
    copies, save for one document of each source whose last copy may be cut.  A null
    text has size 0 and nothing is taken; a null source is a source of its own;
    repeated rows are documents of their own, in an order by digest that reruns keep.
    """
    digest = F.xxhash64(F.col("doc_id"), F.col("text"))
    sized = documents.select("doc_id", "source", words_in(text_of()).alias("size"), digest.alias("digest"))
    sized = written(sized, "sizes")
    counts = sized.groupBy("source", "size").agg(F.count("*").alias("docs"))
    counts = written(counts, "size-counts")
    per_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("n"))
    sources = written(targets(per_source, weights, share), "sources")
    named = sources.select(F.col("source").alias("_source"), "sid")
    counts = written(
        counts.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("sid", "source", "size", "docs"), "counts-by-source"
    )
    found = balance(counts, sources)
    rates = counts.join(sources.select("sid", "target", "source_size"), "sid").join(found, "sid", "left").select(
        "sid", "source", "size", F.ceil(F.col("docs") / SLOT).alias("slots"),
        F.when(F.col("m").isNotNull(), _rate(F.col("m"), F.col("size").cast("double"), F.col("mean")))
        .when(F.col("target") > 0, float(MOST)).otherwise(0.0).alias("rate"),
    )
    rates = written(rates, "rates")
    return _round(sized, rates, sources)


def _round(sized: DataFrame, rates: DataFrame, sources: DataFrame) -> DataFrame:
    """Copies from rates.  Documents of one source and size are ranked by digest in slots of bounded size."""
    r = rates.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "sid", "slots")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    slotted = sized.join(r, same).select("doc_id", "sid", "size", "digest", F.pmod("digest", "slots").alias("slot"))
    slotted = written(slotted, "slots")
    filled = slotted.groupBy("sid", "size", "slot").agg(F.count("*").alias("docs"))
    filled = filled.join(rates.select("sid", "size", "rate"), ["sid", "size"])
    order = Window.partitionBy("sid").orderBy("size", "slot")
    running = F.sum(F.col("docs") * F.col("rate")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = filled.withColumn("upto", F.floor(running + 0.5))
    filled = filled.withColumn("give", F.col("upto") - F.coalesce(F.lag("upto").over(order), F.lit(0)))
    within = Window.partitionBy("sid", "size", "slot").orderBy("digest", "doc_id")
    ranked = slotted.withColumn("rank", F.row_number().over(within)).join(filled.select("sid", "size", "slot", "docs", "give"), ["sid", "size", "slot"])
    whole = F.floor(F.col("give") / F.col("docs")) + F.when(F.col("rank") <= F.pmod("give", "docs"), 1).otherwise(0)
    placed = written(ranked.select("doc_id", "sid", "size", "slot", "rank", (whole * F.col("size")).alias("taken")), "copies")
    where = F.struct("size", "slot", "rank", "taken")
    room = MOST * F.col("size") - F.col("taken")
    sums = placed.groupBy("sid").agg(
        F.sum("taken").alias("sum"), F.max_by(where, F.struct(room.alias("room"), "slot", "rank")).alias("grow"),
        F.max_by(where, F.struct("taken", "slot", "rank")).alias("cut"),
    )
    rest = F.round(F.col("target")).cast("long") - F.col("sum")
    one = F.when(rest > 0, F.col("grow")).otherwise(F.col("cut"))
    last = sums.join(sources, "sid").select(
        "sid", one["size"].alias("size"), one["slot"].alias("slot"), one["rank"].alias("rank"),
        F.greatest(F.least(rest, MOST * one["size"] - one["taken"]), -one["taken"]).alias("more"),
    )
    out = placed.join(last, ["sid", "size", "slot", "rank"], "left").select(
        "doc_id", "sid", "size", (F.col("taken") + F.coalesce("more", F.lit(0))).cast("long").alias("taken")
    )
    few = sources.count() <= 10_000
    facts = sources.select("sid", "source", "source_size", "target")
    out = out.join(F.broadcast(facts) if few else facts, "sid")
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", copies.cast("long").alias("copies"))
