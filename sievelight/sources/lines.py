"""Text, log and config files as lines."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import stage
from .classify import classify, is_supported

LINE_TYPES = ("text", "log", "config")


def plain_path(path: Column) -> Column:
    """`file:/a/b` and `file:///a/b` as `/a/b`; percent escapes decoded; other schemes untouched."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def as_uri(path: str) -> str:
    """`/a`, `file:/a`, `file://a` and `file:///a` spelt `file:///a`, relative paths made absolute; other schemes untouched."""
    if path.startswith("file:"):
        return "file:///" + path.removeprefix("file:").lstrip("/")
    return path if "://" in path else "file://" + os.path.abspath(path)


def locate(uri: str):
    """(file system, place) of a URI as Spark and this package spell them, without percent escapes."""
    from urllib.parse import quote

    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(uri, safe=":/@"))


def wanted(path: Column, named: Sequence[str]) -> Column:
    """Files named by the caller, and the supported files of directories."""
    listed = is_supported(path)
    return (path.isin(*named) | listed) if named else listed


def escape_globs(uri: str) -> str:
    """A file name for a Spark reader, which would take these characters for a pattern."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in uri)


def read_lines(spark: SparkSession, uris: Sequence[str], ftype: str) -> DataFrame:
    """Lines of text files of one type: (path, ftype, block, row, text).

    Files are split into blocks and read in parallel.  `block` and `row` order the lines
    of a file; see `block_counts` for line numbers.  Only file names, which Spark's file
    index holds anyway, come from the driver.
    """
    return spark.read.text([escape_globs(u) for u in uris]).select(
        F.col("_metadata.file_path").alias("path"), F.lit(ftype).alias("ftype"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        F.make_valid_utf8("value").alias("text"),
    )


def block_counts(searched: DataFrame) -> DataFrame:
    """One row per block of a file, with its lines counted and what was found in them: read once, staged.

    `searched` has path, block, row (null where nothing could be read), `found` (a struct,
    null for a line without a hit) and optionally `error`.  Rows count up by one within a
    block.  Each task sends one row per block, which holds the hits and not the text.
    """
    error = F.max("error") if "error" in searched.columns else F.max(F.lit(None).cast("string"))
    cells = F.count("cell") if "cell" in searched.columns else F.sum(F.lit(0))
    counted = searched.groupBy("path", "block").agg(
        F.min("row").alias("first_row"), F.coalesce(F.max("row") - F.min("row") + 1, F.lit(0)).alias("n_lines"),
        cells.alias("n_cells"), F.collect_list("found").alias("hits"), error.alias("error"),
    )
    return stage(counted)


def number(blocks: DataFrame) -> DataFrame:
    """What was found in the lines of `block_counts`, with path, block and `line`, the 1-based number in its file.

    Numbers of lines are summed up over the blocks of a file, which are few; the hits
    carry the row they were found in.
    """
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("path", "block", F.coalesce(F.sum("n_lines").over(ahead), F.lit(0)).alias("_before"))
    hits = blocks.filter(F.size("hits") > 0).select("path", "block", "first_row", F.explode("hits").alias("_hit"))
    return hits.join(offsets, ["path", "block"]).select(
        "path", "block", (F.col("_before") + F.col("_hit.row") - F.col("first_row") + 1).alias("line"), "_hit.*"
    )


def numbered_lines(blocks: DataFrame) -> DataFrame:
    """Hits in lines, with `file`, `item_idx` and `location`."""
    return (
        number(blocks)
        .withColumn("file", plain_path(F.col("path")))
        .withColumn("item_idx", F.col("line"))
        .withColumn("location", F.concat(F.lit("line "), F.col("line").cast("string")))
        .drop("path", "block", "row", "line")
    )


def file_counts(blocks: DataFrame, items: str = "n_lines") -> DataFrame:
    """(file, items, error) from `block_counts`; the items are lines or cells."""
    return blocks.groupBy("path").agg(F.sum(items).alias("items"), F.max("error").alias("error")).select(
        plain_path(F.col("path")).alias("file"), "items", "error"
    )


def split_lines(texts: DataFrame, file: Column, text: Column, ftype: Column | str = "text") -> DataFrame:
    """Texts held in a column as items: (file, ftype, item_idx, location, text).

    One pass, no shuffle.  A final line break does not start another line.
    """
    kind = ftype if isinstance(ftype, Column) else F.lit(ftype)
    pieces = F.split(text, "\r\n|\r|\n")
    last_empty = F.element_at(pieces, -1) == ""
    body = F.when(last_empty, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    return texts.select(
        file.alias("file"), kind.alias("ftype"), F.posexplode(body).alias("_i", "text")
    ).select(
        "file", "ftype", (F.col("_i") + 1).cast("bigint").alias("item_idx"),
        F.concat(F.lit("line "), (F.col("_i") + 1).cast("string")).alias("location"), "text",
    )
