"""Files read one by one: those Spark leaves out of every listing, and compressed ones.

Spark lists no names that start with a dot or an underscore (`.env` matters most) and no
empty files.  Both the listing and the reading happen in tasks, file by file, and a file
that cannot be read gives a row that says so.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .classify import classify
from .lines import LINE_TYPES, as_uri, locate, plain_path, wanted

BATCH = 2_000
RUN = 1 << 16  # lines of a file read in one go that count as a block
#: Bytes of files that one task reads one by one, on average, where there are many.
READ_BYTES = 1 << 25


def as_uri_column(column: str) -> Column:
    """`as_uri` of a column of URIs that have a scheme."""
    return F.regexp_replace(column, "^file:/+", "file:///")


def _first_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries right below each input, so that its folders can be walked in different tasks."""
    from pyarrow import fs

    for batch in batches:
        for uri in batch["input"]:
            system, place = locate(uri)
            info = system.get_file_info(place)
            if info.type == fs.FileType.File:
                rows = [(uri, place.rsplit("/", 1)[0], info.path)]
            else:
                below = system.get_file_info(fs.FileSelector(place, allow_not_found=True))
                rows = [(uri, place.rstrip("/"), e.path) for e in below]
            yield pd.DataFrame(rows, columns=["input", "root", "place"])


def _walk_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hidden and empty files at or below each entry, folder by folder."""
    from pyarrow import fs

    for batch in batches:
        for uri, root, start in zip(batch["input"], batch["root"], batch["place"]):
            system, _ = locate(uri)
            ahead = [system.get_file_info([start])]
            while ahead:
                entries = ahead.pop()
                rows = []
                for entry in entries:
                    if entry.type == fs.FileType.Directory:
                        ahead.append(system.get_file_info(fs.FileSelector(entry.path)))
                        continue
                    parts = entry.path[len(root) :].strip("/").split("/")
                    hidden = any(p.startswith((".", "_")) and "=" not in p for p in parts)
                    if entry.type == fs.FileType.File and (hidden or entry.size == 0):
                        rows.append((uri, entry.path, entry.size))
                yield pd.DataFrame(rows, columns=["input", "place", "length"])


def list_hidden(spark: SparkSession, inputs: Sequence[str], named: Sequence[str] = ()) -> DataFrame:
    """(uri, file, ftype, length) of hidden and of empty files that take part in a scan."""
    uris = [(as_uri(i),) for i in inputs]
    cores = spark.sparkContext.defaultParallelism
    listed = (
        spark.createDataFrame(uris, "input string")
        .repartition(len(uris))
        .mapInPandas(_first_level, "input string, root string, place string")
        .repartition(cores, "place")
        .mapInPandas(_walk_batches, "input string, place string, length bigint")
    )
    scheme = F.regexp_extract("input", r"^([a-z0-9+.-]+://)", 1)
    uri = F.concat(scheme, F.col("place"))
    file = plain_path(uri)
    return (
        listed.select(uri.alias("uri"), file.alias("file"), classify(file).alias("ftype"), "length")
        .filter((F.col("ftype").isin(*LINE_TYPES) | (F.col("length") == 0)) & wanted(F.col("file"), named))
        .dropDuplicates(["file"])
    )


def _line_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io

    names = ["path", "ftype", "row", "text", "error"]
    for batch in batches:
        for uri, ftype in zip(batch["uri"], batch["ftype"]):
            rows: list[tuple] = []
            try:
                system, place = locate(uri)
                kind = "gzip" if place.lower().endswith(".gz") else None
                with system.open_input_stream(place, compression=kind) as raw:
                    for i, line in enumerate(io.TextIOWrapper(raw, encoding="utf-8", errors="replace")):
                        rows.append((uri, ftype, i, line.rstrip("\n"), None))
                        if len(rows) == BATCH:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            except Exception as failure:  # a file that cannot be read on is told of in a row; the others are read
                rows.append((uri, ftype, None, None, type(failure).__name__))
            yield pd.DataFrame(rows, columns=names).astype({"row": "Int64"})


def _dealt(files: DataFrame) -> DataFrame:
    """Files to all cores, and to as many tasks as their bytes ask for: a list of names is so small that one task would get it all."""
    length = F.sum("length") if "length" in files.columns else F.lit(0)
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(length, F.lit(0))).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    return files.repartition(max(1, min(n, tasks)), "uri")


def read_guarded_lines(files: DataFrame) -> DataFrame:
    """Lines of the files (uri, type) one by one: (path, ftype, block, row, text, error).

    For files that cannot be split or that Spark does not list.  A file that fails ends
    with a row that has only its path and the kind of error; what came before is kept.
    """
    lines = _dealt(files).select(as_uri_column("uri").alias("uri"), F.col("type").alias("ftype")).mapInPandas(
        _line_batches, "path string, ftype string, row bigint, text string, error string"
    )
    return lines.select("path", "ftype", F.coalesce(F.floor(F.col("row") / RUN), F.lit(-1)).alias("block"), "row", "text", "error")


def _probe_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import os

    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for uri, kind, length in zip(batch["uri"], batch["type"], batch["length"]):
            real, shape, n, error = uri, None, None, None
            try:
                system, place = locate(uri)
                if uri.startswith("file:"):
                    real = "file://" + os.path.realpath(place)
                if kind == "parquet":
                    with system.open_input_file(place) as source:
                        footer = pq.ParquetFile(source)
                        shape, n = footer.schema_arrow.remove_metadata().to_string(), footer.metadata.num_rows
                elif length:
                    with system.open_input_stream(place, compression=None) as source:
                        source.read(1)
            except Exception as failure:
                error = type(failure).__name__
            rows.append((uri, real, shape, n, error))
        yield pd.DataFrame(rows, columns=["_uri", "real", "shape", "n_rows", "error"]).astype({"n_rows": "Int64"})


def probe(files: DataFrame) -> DataFrame:
    """Adds real (the place a link leads to), shape and n_rows (of Parquet files, from the footer) and error to files.

    Every file is opened once, in as many tasks as there are cores; one that cannot be opened gets the kind of error.
    """
    uri = as_uri_column("uri")
    cores = files.sparkSession.sparkContext.defaultParallelism
    found = files.select(uri.alias("uri"), "type", "length").repartition(cores, "uri").mapInPandas(
        _probe_batches, "_uri string, real string, shape string, n_rows bigint, error string"
    )
    return files.withColumn("uri", uri).join(found, F.col("uri") == F.col("_uri"), "left").drop("_uri")
