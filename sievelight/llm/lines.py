"""Boilerplate lines by how often they stand on the pages of one host, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: A line is boilerplate beyond this share of its host's pages ...  On hosts of 500 pages, lines of one or two pages, most
#: of them in copies of one text, have up to 0.4 %, and lines of five pages or more 1 % and up: this lies between.
RATIO = 0.005
#: ... if at least so many pages hold it.
LEAST_PAGES = 5
#: Lists of boilerplate lines up to this many lines in all are sent to every task (16 bytes a line).
SENT_LINES = 200_000
#: Else a host's pages are dealt out over so many parts.
PARTS = 64


def _line_key(line: Column) -> Column:
    """What tells lines apart: a digest of the line without blanks, tabs and returns at its ends; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """Each host's boilerplate: (host, lines), lines an array of keys.  Written to the shared folder.

    A page holds a line once however often it repeats it.  Counts are combined
    before they are shuffled, so one host or one line may be on any number of rows.
    A host has at most (mean lines of a page) / ratio such lines.
    """
    keys = F.array_compact(F.array_distinct(F.transform(_lines(text), _line_key)))
    # The empty key stands for the page itself, which gives the host's total.
    each = pages.select(F.col(host).alias("host"), F.explode(F.array_append(F.coalesce(keys, F.array().cast("array<binary>")), F.lit(b""))).alias("key"))
    counts = each.groupBy("host", "key").agg(F.count("*").alias("pages"))
    counts = written(counts.filter((F.col("key") == F.lit(b"")) | (F.col("pages") >= least)), "line-counts")
    totals = counts.filter(F.col("key") == F.lit(b"")).select(F.col("host").alias("of"), F.col("pages").alias("total"))
    often = counts.filter(F.col("key") != F.lit(b"")).join(totals, F.col("host").eqNullSafe(F.col("of")))
    often = often.filter(F.col("pages") > F.lit(ratio) * F.col("total"))
    return written(often.groupBy("host").agg(F.collect_list("key").alias("lines")), "boilerplate")


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, sent: int = SENT_LINES
) -> DataFrame:
    """`pages` with boilerplate lines taken out of `text`, and columns n_lines and n_dropped.

    Lines are parted by line feeds; blank ones are kept and never count.  A null
    text stays null and has no lines; a null host is a host of its own.  Every row
    gives one row; repeated rows count as pages each.  Columns of the names n_lines
    and n_dropped are replaced.
    """
    found = boilerplate(pages, host, text, ratio, least)
    lines = found.select(F.col("host").alias("_host"), F.col("lines").alias("_lines"))
    many = found.agg(F.coalesce(F.sum(F.size("lines") + 1), F.lit(0))).first()[0] > sent
    on = F.col(host).eqNullSafe(F.col("_host"))
    if many:  # deal out each host's pages, and give each part the host's list
        lines = lines.withColumn("_part_of", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        pages = pages.withColumn("_part", F.pmod(F.xxhash64(text), F.lit(PARTS)).cast("int"))
        joined = pages.join(lines, on & (F.col("_part") == F.col("_part_of")), "left").drop("_part", "_part_of")
    else:
        joined = pages.join(F.broadcast(lines), on, "left")
    whole = _lines(text)
    kept = F.filter(whole, lambda line: ~F.coalesce(F.array_contains(F.col("_lines"), _line_key(line)), F.lit(False)))
    n = F.coalesce(F.size(whole), F.lit(0))
    clean = joined.withColumn("_kept", F.when(F.col("_lines").isNotNull(), kept).otherwise(whole))
    return clean.withColumns(
        {
            "n_lines": F.when(F.col(text).isNull(), 0).otherwise(n).cast("long"),
            "n_dropped": F.when(F.col(text).isNull(), 0).otherwise(n - F.size("_kept")).cast("long"),
        }
    ).withColumn(text, F.array_join("_kept", "\n")).drop("_host", "_lines", "_kept")


def report(documents: DataFrame) -> DataFrame:
    return drop_boilerplate(documents).select("doc_id", "source", "text", "n_lines", "n_dropped")


REPORT_SQL = f"""
WITH page AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
part AS (
  SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM page
),
line AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM part),
seen AS (SELECT source, bare, count(DISTINCT rid) AS pages FROM line WHERE bare <> '' GROUP BY source, bare),
host AS (SELECT source, count(*) AS total FROM page GROUP BY source),
drops AS (
  SELECT seen.source, bare FROM seen JOIN host ON seen.source IS NOT DISTINCT FROM host.source
  WHERE pages >= {LEAST_PAGES} AND pages > CAST({RATIO} AS DOUBLE) * total
),
kept AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY no) FILTER (WHERE drops.bare IS NULL) AS text,
         count(*) AS n_lines, count(drops.bare) AS n_dropped
  FROM line LEFT JOIN drops ON line.bare = drops.bare AND line.source IS NOT DISTINCT FROM drops.source GROUP BY rid
)
SELECT doc_id, source, CASE WHEN page.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM page LEFT JOIN kept USING (rid)
"""
