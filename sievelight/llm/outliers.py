"""Quality rules by robust multivariate outliers.

Counts of each text become a vector of five statistics (length, mean length of a word,
shares of symbols, repeated lines and repeated words), pulled towards usual values where
a text is short, and set on a logarithmic scale.  For every language and source the
minimum-covariance-determinant estimate tells where the bulk of its vectors lies: from
two starts (medians with median deviations; all vectors) steps of concentration keep the
three quarters of the vectors that are nearest by the estimate so far, and estimate anew;
the start that ends with the smaller determinant wins, and one reweighting follows.
Vectors too far off by Mahalanobis distance are rejected.

All vectors take part in all steps.  Distances are sorted into narrow bins, so a step is
one aggregation by group and bin with sums of whole numbers, combined before they are
shuffled; what is left of a group is a few hundred rows, however large it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import text_of, written
from .textbytes import _ODD, WORDS, chunks, hashes, mix, runs

#: The hard rules: words at least, and words in repeated windows at most, in hundredths.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
#: Vectors that an estimate needs; smaller groups of a language are estimated together, then those of all languages.
LEAST_ROWS = 100
#: Share of the vectors that the determinant is taken of, steps at most, change of its logarithm that ends them.
CORE, STEPS, CLOSE = 0.75, 12, 1e-3
#: Share of a normal distribution that a reweighted estimate rests on, and share that may lie beyond the limit of distance.
WEIGHTED, BEYOND = 0.975, 1e-9
#: Statistics are whole multiples of 1 / GRAIN; bins of distance for each doubling.
GRAIN, BINS = 1024, 32
#: Words of usual kind, of so many characters, that every text is taken to hold besides its own; and lines.
USUAL_WORDS, USUAL_CHARS, USUAL_LINES = 20, 5, 4
#: Least spread of each statistic: differences below it mean nothing.
SPREAD = {"length": 0.3, "word": 0.04, "symbols": 0.1, "lines": 0.2, "repeats": 0.2}

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counted(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The `COUNTS` of each text, as rows of a matrix; `n_lines` are the lines with a word."""
    n = len(begins) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(mask)]
        return sums[begins[1:]] - sums[begins[:-1]]

    in_word = WORDS[data]
    start, end, text = runs(in_word, begins)
    word = hashes(data, start, end)
    line, to, of = runs(data != 10, begins)
    sums = np.r_[0, np.cumsum(in_word)]
    filled = sums[to] > sums[line]
    line, to, of = line[filled], to[filled], of[filled]
    first = np.unique(mix(hashes(data, line, to) + of.astype(np.uint64) * _ODD), return_index=True)[1]
    lines = np.bincount(of, minlength=n)
    covered = np.zeros(len(word) + 1, np.int64)
    k = len(word) - WINDOW + 1
    if k > 0:
        h = np.zeros(k, np.uint64)
        for j in range(WINDOW):
            h = h * _ODD + word[j : j + k]
        at = np.flatnonzero(text[:k] == text[WINDOW - 1 :])
        _, which, often = np.unique(mix(mix(h[at]) + text[at].astype(np.uint64) * _ODD), return_inverse=True, return_counts=True)
        again = at[often[which] > 1]
        covered[again] += 1
        np.subtract.at(covered, again + WINDOW, 1)
    repeated = np.bincount(text, weights=np.cumsum(covered)[:-1] > 0, minlength=n).astype(np.int64)
    chars = per_text(in_word & ((data & 0xC0) != 0x80))
    return np.stack([np.bincount(text, minlength=n), chars, per_text(_SYMBOL[data]), lines - np.bincount(of[first], minlength=n), repeated, lines])


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, lang and source of each row with its `COUNTS`; a null text has none of anything."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, begins in chunks(batch["text"]):
                own = batch.slice(first, last - first).select(["doc_id", "lang", "source"])
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c.astype(np.int64)) for c in counted(data, begins))],
                                                 names=["doc_id", "lang", "source", *COUNTS])

    rows = documents.select("doc_id", text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed() -> Column:
    """The hard rules: too few words, or too many of them in windows that come again."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The statistics of a row of counts, in whole multiples of 1 / GRAIN."""
    words = F.col("n_words") + USUAL_WORDS
    plain = {
        "length": F.log1p("n_words"),
        "word": F.log((F.col("word_chars") + USUAL_WORDS * USUAL_CHARS) / words),
        "symbols": F.log1p(10 * F.col("n_symbols") / words),
        "lines": F.log1p(10 * F.col("n_dup_lines") / (F.col("n_lines") + USUAL_LINES)),
        "repeats": F.log1p(10 * F.col("n_repeat_words") / words),
    }
    return {name: F.round(GRAIN * value).cast("long") for name, value in plain.items()}


def chi_square(x: float, k: int) -> float:
    """Share of a chi-square distribution of k degrees of freedom below x."""
    a, half, term, total, i = k / 2, x / 2, 1.0, 1.0, 0
    while term > total * 1e-17:
        i += 1
        term *= half / (a + i)
        total += term
    return math.exp(a * math.log(half) - half - math.lgamma(a + 1)) * total if x > 0 else 0.0


def chi_square_limit(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < share else (low, middle)
    return high


def widening(share: float, k: int) -> float:
    """By how much the covariance of the nearest `share` of a normal distribution falls short of that of the whole."""
    return share / chi_square(chi_square_limit(share, k), k + 2)


def _half(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def solved(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, spread: Sequence[float], widen: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, lower factors of the inverse covariances, and logarithms of the determinants, from sums in grains."""
    p = sums.shape[1]
    mean = sums / n[:, None]
    cov = np.zeros((len(n), p, p))
    for c, (i, j) in enumerate(_half(p)):
        cov[:, i, j] = cov[:, j, i] = squares[:, c] / n - mean[:, i] * mean[:, j]
    cov = widen * cov / GRAIN**2 + np.diag(np.square(spread))
    root = np.linalg.cholesky(cov)
    return mean / GRAIN, np.linalg.inv(root), 2 * np.log(np.einsum("gii->gi", root)).sum(axis=1)


PARAMETERS = "gid string, start int, mean array<double>, factor array<double>, logdet double"


def _estimates(sums: DataFrame, names: Sequence[str], spread: Sequence[float], widen: float = 1.0) -> DataFrame:
    """Parameters from rows of gid, start, n and sums of the statistics and of their products."""
    p = len(names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [np.asarray(c, dtype=np.float64) for c in batch.columns[2:]]
            mean, factor, logdet = solved(given[0], np.stack(given[1 : 1 + p], axis=1), np.stack(given[1 + p :], axis=1), spread, widen)
            lower = np.stack([factor[:, i, j] for i, j in _half(p)], axis=1)
            yield pa.RecordBatch.from_arrays([batch["gid"], batch["start"], pa.array(mean.tolist(), pa.list_(pa.float64())),
                                              pa.array(lower.tolist(), pa.list_(pa.float64())), pa.array(logdet)],
                                             names=["gid", "start", "mean", "factor", "logdet"])

    return sums.mapInArrow(solve, PARAMETERS)


def _sums(names: Sequence[str]) -> list[Column]:
    pairs = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in _half(len(names))]
    return [F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names), *pairs]


def _summed(names: Sequence[str]) -> list[str]:
    return ["n", *names, *(f"p{i}_{j}" for i, j in _half(len(names)))]


def distance(names: Sequence[str]) -> Column:
    """Squared Mahalanobis distance of a row that its parameters were joined to."""
    off = [F.col(c) / GRAIN - F.col("mean")[i] for i, c in enumerate(names)]
    rows = [F.lit(0.0)] * len(names)
    for c, (i, j) in enumerate(_half(len(names))):
        rows[i] = rows[i] + F.col("factor")[c] * off[j]
    total = F.lit(0.0)
    for row in rows:
        total = total + row * row
    return total


def _medians(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """gid and, of each statistic, its median and median absolute deviation, from counts of its values."""
    each = rows.select("gid", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(c).alias("v")) for i, c in enumerate(names)])).alias("s"))
    counts = each.groupBy("gid", "s.dim", "s.v").agg(F.count("*").alias("n"))

    def middle(of: DataFrame, name: str) -> DataFrame:
        by = Window.partitionBy("gid", "dim")
        upto = F.sum("n").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return of.select("gid", "dim", "v", upto.alias("upto"), F.sum("n").over(by).alias("all")).filter(2 * F.col("upto") >= F.col("all")).groupBy(
            "gid", "dim").agg(F.min("v").alias(name))

    counts = written(counts, "values")
    median = written(middle(counts, "median"), "medians")
    off = counts.join(median, ["gid", "dim"]).groupBy("gid", "dim", F.abs(F.col("v") - F.col("median")).alias("v")).agg(F.sum("n").alias("n"))
    return median.join(middle(off, "off"), ["gid", "dim"])


def _starts(rows: DataFrame, names: Sequence[str], spread: Sequence[float]) -> DataFrame:
    """Parameters of both starts for each group."""
    plain = _estimates(rows.groupBy("gid", F.lit(1).alias("start")).agg(*_sums(names)), names, spread)
    wide = [1.4826 * F.col(f"off{i}") / GRAIN for i in range(len(names))]
    spreads = [F.sqrt(w * w + s * s) for w, s in zip(wide, spread, strict=True)]
    per_dim = [F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{c}{i}") for i in range(len(names)) for c in ("median", "off")]
    robust = _medians(rows, names).groupBy("gid").agg(*per_dim).select(
        "gid", F.lit(0).alias("start"), F.array(*[F.col(f"median{i}") / GRAIN for i in range(len(names))]).alias("mean"),
        F.array(*[1 / spreads[i] if i == j else F.lit(0.0) for i, j in _half(len(names))]).alias("factor"),
        F.lit(float("inf")).alias("logdet"),
    )
    return plain.unionByName(robust)


def estimate(rows: DataFrame, spread: dict[str, float]) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimates: gid, mean, factor.

    `rows` has gid and the statistics that `spread` names, as whole numbers of grains.
    Equal rows give equal estimates in whatever order they come.
    """
    names, least = list(spread), list(spread.values())
    p = len(names)
    found = written(_starts(rows, names, least), "estimates")
    by = Window.partitionBy("gid", "start")
    before = F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for _ in range(STEPS):
        joined = rows.join(found, "gid").withColumn("bin", F.floor(BINS * F.log2(1 + distance(names))))
        binned = joined.groupBy("gid", "start", "bin").agg(*_sums(names))
        core = binned.withColumns({"before": before, "all": F.sum("n").over(by)}).filter(F.col("before") < F.ceil(CORE * F.col("all")))
        sums = core.groupBy("gid", "start").agg(*[F.sum(c).alias(c) for c in _summed(names)])
        new = _estimates(sums, names, least).join(found.select("gid", "start", F.col("logdet").alias("last")), ["gid", "start"])
        new = written(new, "estimates")
        still = new.filter(F.abs(F.col("last") - F.col("logdet")) > CLOSE).isEmpty()
        found = new.drop("last")
        if still:
            break
    best = found.groupBy("gid").agg(F.min_by(F.struct("start", "mean", "factor"), F.struct("logdet", "start")).alias("b")).select("gid", "b.*")
    near = rows.join(best, "gid").filter(distance(names) <= widening(CORE, p) * chi_square_limit(WEIGHTED, p))
    sums = near.groupBy("gid", "start").agg(*_sums(names))
    return written(_estimates(sums, names, least, widening(WEIGHTED, p)).select("gid", "mean", "factor"), "estimates")


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """(lang, source, gid): which estimate a language and source go by; none where even all small groups are few."""
    sizes = written(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "group-sizes")
    rest = sizes.filter(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("in_lang"))
    in_all = rest.filter(F.col("in_lang") < least).agg(F.sum("in_lang")).first()[0] or 0
    gid = F.when(F.col("n") >= least, F.to_json(F.struct("lang", "source"))).when(
        F.col("in_lang") >= least, F.to_json(F.struct("lang"))).when(F.lit(in_all >= least), F.lit("{}"))
    return written(sizes.join(rest, "lang", "left").select("lang", "source", gid.alias("gid")), "groups")


def judge(documents: DataFrame, least_rows: int = LEAST_ROWS, beyond: float = BEYOND) -> DataFrame:
    """doc_id, `COUNTS`, base_failed, distance and kept, a row for each row of `documents` (doc_id, text, lang, source).

    Words are parted by white space, lines by line feeds.  A row that fails the hard
    rules is not kept and takes no part in the estimates; of the others those are kept
    whose squared distance is within the limit that a share of `beyond` of a normal
    distribution exceeds.  Nulls count as empty texts and names; repeated rows take part
    each.  Where too few rows pass the hard rules for any estimate, all of them are kept,
    without a distance.  Other columns play no part; an empty table gives no rows.
    """
    rows = written(measured(documents), "text-counts")
    rows = rows.withColumn("base_failed", base_failed())
    passing = rows.filter(~F.col("base_failed"))
    groups = _groups(passing.select("lang", "source"), least_rows)
    vectors = passing.withColumns(vector()).join(groups.filter(F.col("gid").isNotNull()), ["lang", "source"])
    found = estimate(written(vectors.select("gid", *SPREAD), "vectors"), SPREAD)
    limits = groups.join(found, "gid").drop("gid")
    limit = chi_square_limit(1 - beyond, len(SPREAD))
    far = F.when(~F.col("base_failed"), distance(list(SPREAD)))
    told = rows.withColumns(vector()).join(limits, ["lang", "source"], "left").withColumn("distance", far)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))
    return told.select("doc_id", *COUNTS, "base_failed", "distance", kept.alias("kept"))
