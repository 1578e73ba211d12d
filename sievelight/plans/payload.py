"""Scan of uploaded contents: rows of (name, base64 data)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .. import catalog as CAT
from ..operators import detect
from ..session import stage, stage_table
from ..sources import delimited, lines as L, settings as S
from ..sources.classify import STRUCTURED_EXTS, STRUCTURED_MAX_BYTES, classify, extension
from .scan import (
    SIGNAL_COLUMNS, Options, ScanResult, _within, collect_findings, drop_parsed_lines, file_status, finish,
    parse_settings, raw_findings,
)


RUN = 1 << 16
#: Names of uploads sent to every task at most; more are joined.
SENT_NAMES = 500_000


def name_uploads(uploads: DataFrame) -> DataFrame:
    """(file, bytes): safe base names; a name that repeats gets `_1`, `_2`, … before its extension.

    `uploads` has name, data and `ord`, the order of the uploads.  A name may be
    that of most uploads, so equal names are counted per run of `ord` first and
    ranked within a run.  The data take no part in that: they are staged, and meet
    their names again by number.
    """
    held = stage_table(
        uploads.select(
            F.monotonically_increasing_id().alias("_id"), "name", "ord", F.unbase64(F.coalesce("data", F.lit(""))).alias("bytes")
        )
    )
    base = F.regexp_replace("name", r"^.*/", "")
    safe = F.regexp_replace(base, r"(?U)[^\w.\- ()\[\]]", "_")
    named = held.select(
        "_id", F.when(F.coalesce(safe, F.lit("")) == "", "upload").otherwise(safe).alias("name"), "ord",
        F.floor(F.col("ord") / RUN).alias("_run"),
    )
    ahead = Window.partitionBy("name").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        named.groupBy("name", "_run")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select("name", "_run", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("name", "_run").orderBy("ord", "_id")
    ext = extension(F.col("name"))
    stem = F.left("name", F.char_length("name") - F.char_length(ext))
    numbered = named.join(offsets, ["name", "_run"]).withColumn("_n", F.col("_before") + F.row_number().over(inside) - 1)
    files = stage_table(
        numbered.select(
            "_id",
            F.when(F.col("_n") == 0, F.col("name"))
            .otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext))
            .alias("file"),
        )
    )
    sent = F.broadcast(files) if files.count() <= SENT_NAMES else files
    return held.select("_id", "bytes").join(sent, "_id").select("file", "bytes")


def _unpacked(packed: pd.Series) -> pd.DataFrame:
    """Contents of gzip uploads; of a broken one what comes before the fault."""
    import zlib

    rows = []
    for data in packed:
        out, error = [], None
        while data:
            stream = zlib.decompressobj(31)
            try:
                out.append(stream.decompress(data))
                if not stream.eof:
                    error = "EOFError"
                data = stream.unused_data
            except zlib.error:
                error, data = "BadGzipFile", None
        rows.append((b"".join(out), error))
    return pd.DataFrame(rows, columns=["content", "error"])


def _parquet_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io

    import pyarrow.parquet as pq

    names = ["file", "ftype", "item_idx", "location", "text", "error"]
    for batch in batches:
        for file, content in zip(batch["file"], batch["content"]):
            row = 0
            try:
                source = pq.ParquetFile(io.BytesIO(content))
                width = len(source.schema_arrow)
                for part in source.iter_batches(batch_size=1024):
                    cells = [
                        (file, "parquet", (row + r) * width + c + 1, f"row {row + r + 1}, {name}", str(v), None)
                        for c, name in enumerate(part.schema.names)
                        for r, v in enumerate(part.column(c).to_pylist()) if v is not None and v != ""
                    ]
                    row += part.num_rows
                    yield pd.DataFrame(cells, columns=names)
            except Exception as failure:  # a broken upload leaves the others alone
                yield pd.DataFrame([(file, "parquet", 0, None, None, type(failure).__name__)], columns=names)


def _dialect(name: pd.Series, sample: pd.Series) -> pd.DataFrame:
    guessed = [delimited.guess_dialect(n, s) for n, s in zip(name, sample)]
    return pd.DataFrame([(d.delimiter, d.quote, d.skip_space) for d in guessed], columns=["delimiter", "quote", "skip_space"])


def _csv_uploads(texts: DataFrame) -> list[tuple[delimited.Dialect, DataFrame]]:
    """Lines of CSV uploads by dialect."""
    name = F.regexp_replace("file", r"(?i)\.gz$", "")
    dialect = F.pandas_udf(_dialect, "delimiter string, quote string, skip_space boolean")
    told = stage(texts.select("file", "text", dialect(name, F.left("text", F.lit(delimited.SAMPLE_CHARS))).alias("d")))
    lines = L.split_lines(told, F.struct("file", "d"), F.col("text")).select(
        F.col("file.file").alias("path"), F.col("file.d").alias("d"), F.floor(F.col("item_idx") / RUN).alias("block"), F.col("item_idx").alias("row"),
        "text", F.lit(None).cast("string").alias("error"),
    )
    kinds = [delimited.Dialect(*r.d) for r in told.select("d").distinct().collect()]  # a few delimiters and quotes
    same = lambda d: (F.col("d.delimiter") == d.delimiter) & (F.col("d.quote") == d.quote) & (F.col("d.skip_space") == d.skip_space)
    return [(d, lines.filter(same(d)).drop("d")) for d in kinds]


def scan_uploads(uploads: DataFrame, options: Options | None = None) -> ScanResult:
    """Scan uploads; findings carry the bare file name and fingerprints use no root.

    Compressed texts are unpacked and Parquet uploads read; a broken one is told of in the
    file table, with what could be read of it searched.
    """
    options = options or Options()
    spark = uploads.sparkSession
    catalog = CAT.with_rules(CAT.tables(spark, options.crosswalk), options.rules)
    named = name_uploads(uploads).withColumn("type", classify(F.col("file")))
    packed = F.lower("file").endswith(".gz")
    whole = named.filter(~packed).select(
        "file", "type", F.octet_length("bytes").alias("length"), F.col("bytes").alias("content"), F.lit(None).cast("string").alias("error")
    )
    unpacked = F.pandas_udf(_unpacked, "content binary, error string")
    opened = named.filter(packed).select("file", "type", F.octet_length("bytes").alias("length"), unpacked("bytes").alias("u")).select(
        "file", "type", "length", "u.content", "u.error"
    )
    # Read several times below, each time by kind and for some columns only.
    contents = stage_table(whole if named.filter(packed).select("file").isEmpty() else whole.unionByName(opened))
    texts = contents.filter(F.col("type").isin(*L.LINE_TYPES, "csv")).select(
        "file", "type", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    )
    readable = texts.filter(F.col("type").isin(*L.LINE_TYPES))
    lines = L.split_lines(readable, F.col("file"), F.col("text"), F.col("type")).withColumn("error", F.lit(None).cast("string"))
    tables = contents.filter((F.col("type") == "parquet") & (F.col("length") > 0)).select("file", "content").mapInPandas(
        _parquet_batches, "file string, ftype string, item_idx bigint, location string, text string, error string"
    )
    items = lines.unionByName(tables)

    def search(rows: DataFrame, **more) -> DataFrame:
        return detect.signals(rows, year=options.stamp_year, rules=options.rules, max_text=options.max_text, **more)

    parts = [search(_within(items.filter(F.col("error").isNull()).drop("error"), options.item_limit)).select(*SIGNAL_COLUMNS)]
    counts = [items.groupBy("file").agg(F.count("text").alias("items"), F.max("error").alias("_broken"))]
    for dialect, rows in _csv_uploads(texts.filter(F.col("type") == "csv").select("file", "text")):
        for source in delimited.line_items(rows, dialect):
            blocks = L.block_counts(search(source.items, inside=("row", "ftype", "cell", "nth")))
            parts.append(_within(delimited.place_cells(blocks, source), options.item_limit).select(*SIGNAL_COLUMNS))
            counts.append(L.file_counts(blocks, "n_cells").withColumnRenamed("error", "_broken"))
    docs = readable.filter(
        (F.col("type") == "config") & (F.col("length") <= STRUCTURED_MAX_BYTES)
        & F.concat(F.lit("."), S.settings_format(F.col("file"))).isin(*STRUCTURED_EXTS)
    ).select("file", S.settings_format(F.col("file")).alias("format"), "text")
    settings, parsed = parse_settings(docs)
    parsed = stage(parsed)
    signals = stage(drop_parsed_lines(reduce(DataFrame.unionByName, parts), parsed))
    table = (
        contents.join(reduce(DataFrame.unionByName, counts), "file", "left")
        .join(parsed.withColumn("_parsed", F.lit(True)), "file", "left")
        .select(
            "file", "type", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("error", "_broken").alias("error"),
            F.when(F.col("type") == "config", F.when(F.col("_parsed"), "structured").otherwise("line_fallback")).alias(
                "config_parser"
            ),
        )
    )
    found = collect_findings(raw_findings(signals, settings), options, catalog)
    return finish(found, file_status(table, options.item_limit), options, catalog, None)
