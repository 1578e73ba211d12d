"""What a scan is asked to look at."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .classify import classify, is_structured
from .hidden import list_hidden, probe
from .lines import as_uri, locate, plain_path, wanted


def usable_inputs(spark: SparkSession, inputs: Sequence[str]) -> tuple[list[str], list[str]]:
    """(existing inputs, those that are single files).  A missing path is warned about and skipped."""
    from pyarrow import fs

    kept, named = [], []
    for item in dict.fromkeys(inputs):
        uri = as_uri(item)
        system, place = locate(uri)
        kind = system.get_file_info(place).type
        if kind == fs.FileType.NotFound:
            warnings.warn(f"path not found, skipped: {item}", stacklevel=2)
            continue
        kept.append(item)
        if kind == fs.FileType.File:
            named.append(uri.removeprefix("file://"))
    return kept, named


def list_files(spark: SparkSession, inputs: Sequence[str], named: Sequence[str] = ()) -> DataFrame:
    """(file, uri, type, length, hidden, structured, shape, n_rows, error): every file that takes part, once.

    A link to a file that is listed anyway is left out.  `error` tells files that cannot
    be opened, and Parquet files without a readable footer.
    """
    hidden = list_hidden(spark, inputs, named).select(
        "file", "uri", F.col("ftype").alias("type"), "length", F.lit(True).alias("hidden")
    )
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
        listed = (
            found.select(F.col("path").alias("uri"), plain_path(F.col("path")).alias("file"), "length")
            .filter(wanted(F.col("file"), named))
            .select("file", "uri", classify(F.col("file")).alias("type"), "length", F.lit(False).alias("hidden"))
        )
        both = listed.unionByName(hidden)
    except AnalysisException:  # only hidden files were named
        both = hidden
    probed = probe(both.dropDuplicates(["file"]))
    # Of several names of one file that which is no link stays, else the first.
    order = F.struct((F.col("uri") != F.col("real")).alias("link"), "file")
    columns = [c for c in probed.columns if c != "real"]
    once = probed.groupBy("real").agg(F.min_by(F.struct(*columns), order).alias("f")).select("f.*")
    return once.withColumn("structured", (F.col("type") == "config") & is_structured(F.col("file"), F.col("length")))


def names(files: DataFrame, kind: str) -> list[str]:
    """URIs of the files of one type that Spark reads itself: neither hidden, compressed nor failing."""
    rows = files.filter((F.col("type") == kind) & ~one_by_one() & F.col("error").isNull()).select("uri")
    return [row.uri for row in rows.toLocalIterator()]


def one_by_one() -> Column:
    """Files to be read by `hidden.read_guarded_lines`."""
    return F.col("hidden") | F.lower("file").endswith(".gz")
