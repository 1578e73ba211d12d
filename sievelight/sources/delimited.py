"""CSV and TSV files as cells.

Files are read as text blocks in parallel.  A line is a record unless a quoted cell runs
over a line break.  Whether it does is told by a finite-state scan: of each line it is
worked out whether it ends inside a quoted cell if it begins outside one, and if it
begins inside one; these effects are composed over the lines of a block and then over the
blocks of a file.  A quote within a cell that did not begin with one is a character like
any other.  In files without a line that opens such a cell, lines are records and nothing
is moved; only the lines of other files are put together into records.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import stage, stage_table
from .hidden import as_uri_column, read_guarded_lines
from .lines import escape_globs, locate, number, plain_path

# --- Fixed values -----------------------------------------------------------------
DELIMITERS = ",;\t|"
SAMPLE_CHARS = 4096
#: Lines of a longer record are records of their own, as are those after a quote that is never closed.
LONG_RECORD = 1 << 24
#: Records whose numbers are summed up together, and records put together that a task works on, on average.
RECORD_RUN = 1 << 14
TASK_RECORDS = 1 << 16
#: Names of files sent to every task at most.
SENT_NAMES = 10_000

# States within a record: at the start of a cell, in a cell, in a quoted cell, after a quote in a quoted cell.
START, CELL, QUOTED, QUOTE = range(4)


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    quote: str
    skip_space: bool


def guess_dialect(name: str, sample: str) -> Dialect:
    """Dialect by the standard sniffer; by extension when it cannot tell."""
    try:
        found = csv.Sniffer().sniff(sample, delimiters=DELIMITERS)
    except csv.Error:
        return Dialect("\t" if name.lower().endswith(".tsv") else ",", '"', True)
    return Dialect(found.delimiter, found.quotechar or '"', bool(found.skipinitialspace))


def _sniff_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for uri, path in zip(batch["uri"], batch["file"]):
            kind = "gzip" if path.lower().endswith(".gz") else None
            try:
                system, place = locate(uri)
                with system.open_input_stream(place, compression=kind) as stream:
                    head = stream.read(4 * SAMPLE_CHARS).decode("utf-8", "replace")[:SAMPLE_CHARS]
            except Exception:  # the reader will tell of it
                head = ""
            d = guess_dialect(path[:-3] if kind else path, head)
            rows.append((uri, path, d.delimiter, d.quote, d.skip_space))
        yield pd.DataFrame(rows, columns=["uri", "file", "delimiter", "quote", "skip_space"])


def sniff(files: DataFrame) -> DataFrame:
    """Dialect of CSV files (uri, file); each task reads the head of its files only."""
    return files.select(as_uri_column("uri").alias("uri"), "file").mapInPandas(
        _sniff_batches, "uri string, file string, delimiter string, quote string, skip_space boolean"
    )


# --- the finite-state scan ----------------------------------------------------------


def ends_inside(text: Column, dialect: Dialect, inside: bool) -> Column:
    """Whether a line ends inside a quoted cell, begun outside (`inside` False) or inside one."""

    def after_piece(state: Column, piece: Column) -> Column:
        """State after characters that are no quotes."""
        tail = F.substring_index(piece, dialect.delimiter, -1)
        blank = (F.ltrim(tail) if dialect.skip_space else tail) == ""
        parted = F.instr(piece, dialect.delimiter) > 0
        open_ = F.when(parted, F.when(blank, START).otherwise(CELL)).otherwise(F.when((state == START) & blank, START).otherwise(CELL))
        return F.when((piece == "") | (state == QUOTED), state).otherwise(open_)

    def step(state: Column, piece: Column) -> Column:
        # Between two pieces stands a quote; the first piece has none before it, which a state of 10 and more tells.
        quoted = F.when(state == START, QUOTED).when(state == CELL, CELL).when(state == QUOTED, QUOTE).otherwise(QUOTED)
        return after_piece(F.when(state >= 10, state - 10).otherwise(quoted), piece)

    pieces = F.split(text, _literal(dialect.quote), -1)
    end = F.aggregate(pieces, F.lit(10 + (QUOTED if inside else START)), step, lambda s: s == QUOTED)
    return F.when(F.contains(text, F.lit(dialect.quote)), end).otherwise(F.lit(inside))


def _literal(char: str) -> str:
    return "\\" + char if char in "|^$.*+?()[]{}\\" else char


def entered(steps: DataFrame, by: Sequence[str], order: str, start: Column) -> DataFrame:
    """Adds `inside`, the state before each step, to steps with their effects `from_out` and `from_in`.

    `start` is the state before the first step of each group.  A step either sets the
    state, keeps it or turns it round; so what counts is the last step that set it and how
    many turned it since.
    """
    group = Window.partitionBy(*by).orderBy(order)
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("from_out") & ~F.col("from_in")).cast("int")
    sets = F.col("from_out") == F.col("from_in")
    counted = steps.withColumn("_turns", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    mark = F.when(sets, F.struct(F.col(order).alias("at"), F.col("from_out").alias("to"), F.col("_turns").alias("turns")))
    marked = counted.withColumn("_set", F.max(mark).over(before))
    since = F.coalesce(F.col("_set.to"), start).cast("int") + F.col("_turns") - F.coalesce(F.col("_set.turns"), F.lit(0))
    return marked.withColumn("inside", since % 2 == 1).drop("_turns", "_set")


def _composed(lines: DataFrame) -> DataFrame:
    """(path, block, from_out, from_in): the effect of each block as a whole."""
    in_block = Window.partitionBy("path", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("from_out") & ~F.col("from_in")).cast("int")
    counted = lines.withColumn("_turns", F.coalesce(F.sum(turns).over(in_block), F.lit(0)))
    mark = F.when(
        F.col("from_out") == F.col("from_in"),
        F.struct("row", F.col("from_out").alias("to"), F.col("_turns").alias("turns")),
    )
    ends = counted.groupBy("path", "block").agg(F.max(mark).alias("s"), F.sum(turns).alias("t"))
    end = lambda start: (F.coalesce(F.col("s.to").cast("int"), F.lit(start)) + F.col("t") - F.coalesce(F.col("s.turns"), F.lit(0))) % 2 == 1
    return ends.select("path", "block", end(0).alias("from_out"), end(1).alias("from_in"))


def _numbered_starts(lines: DataFrame) -> DataFrame:
    """Adds `record`, from 1 on in each file, to lines that tell by `starts` whether they begin one."""
    in_block = Window.partitionBy("path", "block").orderBy("row")
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        lines.groupBy("path", "block")
        .agg(F.count_if("starts").alias("_s"))
        .select("path", "block", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before"))
    )
    return lines.join(counts, ["path", "block"]).withColumn(
        "record", F.col("_before") + F.sum(F.col("starts").cast("int")).over(in_block)
    ).drop("_before")


def join_records(lines: DataFrame, dialect: Dialect, long_record: int = LONG_RECORD) -> DataFrame:
    """(path, record, block, row, text): lines (path, block, row, text) with the number of their record.

    Work on lines stays within one block, and over blocks there is one row each.  Lines of
    a record that is longer than `long_record`, or begins with a quote that the file never
    closes, are records of their own.  Staged.
    """
    told = lines.select(
        "path", "block", "row", "text", ends_inside(F.col("text"), dialect, False).alias("from_out"),
        ends_inside(F.col("text"), dialect, True).alias("from_in"),
    )
    blocks = entered(_composed(told), ["path"], "block", F.lit(False))
    carried = told.join(blocks.select("path", "block", F.col("inside").alias("_start")), ["path", "block"])
    starts = entered(carried, ["path", "block"], "row", F.col("_start")).withColumn("starts", ~F.col("inside"))
    numbered = stage(_numbered_starts(starts).select("path", "record", "block", "row", "text", "starts", "from_in", "from_out"))
    last = F.max_by(F.when(F.col("starts"), F.col("from_out")).otherwise(F.col("from_in")), F.struct("block", "row"))
    sizes = numbered.groupBy("path", "record").agg(F.sum(F.char_length("text") + 1).alias("_size"), last.alias("_open"))
    apart = stage(sizes.filter((F.col("_size") > long_record) | F.col("_open")).select("path", "record", F.lit(True).alias("_apart")))
    if apart.isEmpty():
        return numbered.drop("starts", "from_in", "from_out")
    again = numbered.join(apart, ["path", "record"], "left").withColumn("starts", F.col("starts") | F.col("_apart").isNotNull())
    return stage(_numbered_starts(again.drop("record", "_apart")).select("path", "record", "block", "row", "text"))


# --- records put together where they are read ------------------------------------------


def _states(out: np.ndarray, into: np.ndarray, start: bool) -> tuple[np.ndarray, bool]:
    """Whether each of consecutive lines begins inside a quoted cell, and whether the last ends there."""
    at = np.arange(len(out))
    turned = np.cumsum(out & ~into)
    last = np.maximum.accumulate(np.where(out == into, at, -1))
    since = turned - np.where(last >= 0, turned[last], 0)
    after = np.where(last >= 0, out[last], start) ^ (since % 2 == 1)
    return np.r_[start, after[:-1]], bool(after[-1])


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The lines of one block of a file that stand together: path, block, lines."""
    if not batch.num_rows:
        return
    path, block = batch.column("path").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
    edge = np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip(np.r_[0, edge].tolist(), np.r_[edge, len(path)].tolist()):
        yield batch.column("path")[a].as_py(), int(block[a]), batch.slice(a, b - a)


def _flags(lines: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(lines.column(c).to_numpy(zero_copy_only=False) for c in ("from_out", "from_in"))


_MEASURES = ("n", "head", "tail", "most", "head_parts", "tail_parts", "most_parts")
_EFFECTS = "path string, block bigint, row bigint, from_out boolean, from_in boolean, cells bigint, " + ", ".join(
    f"{m}_{s} bigint" for s in ("out", "in") for m in _MEASURES
)


def _effect_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What runs of lines do from both states: how they end, the records that begin in them, and the sizes of what they hold of records."""
    names = [c.split()[0] for c in _EFFECTS.split(", ")]
    for batch in batches:
        rows = []
        for path, block, lines in _segments(batch):
            out, into = _flags(lines)
            size, parts = (lines.column(c).to_numpy() for c in ("size", "parts"))
            ends, told = [], []
            for start in (False, True):
                before, end = _states(out, into, start)
                begins = np.flatnonzero(~before)
                ends.append(end)
                told.append(len(begins))
                for measure in (size, parts):
                    edge = begins if len(begins) else np.array([len(measure)])
                    sums = np.add.reduceat(measure, edge) if len(begins) else np.zeros(1, np.int64)
                    told += [int(measure[: edge[0]].sum()), int(sums[-1]), int(sums[:-1].max(initial=0))]
            rows.append((path, block, lines.column("row")[0].as_py(), *ends, int(parts.sum()) + len(parts), *told))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * (len(names) - 5)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)


_PIECES = "path string, record bigint, block bigint, row bigint, text string, whole boolean"


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records put together from the lines of blocks, whose first and last pieces may belong to records that run over the edge."""
    names = [c.split()[0] for c in _PIECES.split(", ")]
    here, record, inside = None, 0, False
    carry: list[str] = []  # lines of a record that may go on
    first, row = False, 0  # whether it began before the block, and its first line

    def put(texts: pa.Array, records: np.ndarray, rows: np.ndarray, whole: bool) -> pa.RecordBatch:
        n = len(texts)
        kinds = [pa.array([here[0]] * n, pa.string()), pa.array(records, pa.int64()), pa.array([here[1]] * n, pa.int64())]
        return pa.RecordBatch.from_arrays([*kinds, pa.array(rows, pa.int64()), texts, pa.array([whole] * n, pa.bool_())], names=names)

    def put_carry(whole: bool) -> pa.RecordBatch:
        return put(pa.array(["\n".join(carry)], pa.string()), np.array([record]), np.array([row]), whole)

    for batch in batches:
        for path, block, lines in _segments(batch):
            if (path, block) != here:
                if carry:
                    yield put_carry(False)
                here, carry, first = (path, block), [], True
                record, inside = lines.column("before")[0].as_py(), lines.column("inside")[0].as_py()
            before, inside = _states(*_flags(lines), inside)
            begins, rows = np.flatnonzero(~before), lines.column("row").to_numpy()
            text = lines.column("text").cast(pa.string())
            ahead = int(begins[0]) if len(begins) else len(text)
            if ahead:
                row = row if carry else int(rows[0])
                carry += text.slice(0, ahead).to_pylist()
            if not len(begins):
                continue
            if carry:
                yield put_carry(not first)
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), text)  # of all records but the last
            if len(begins) > 1:
                yield put(pc.binary_join(lists, "\n"), record + 1 + np.arange(len(begins) - 1), rows[begins[:-1]], True)
            record, row, first = record + len(begins), int(rows[begins[-1]]), False
            carry = text.slice(int(begins[-1])).to_pylist()
    if carry:
        yield put_carry(False)


def _run_starts(lines: DataFrame, long_record: int) -> tuple[DataFrame, DataFrame]:
    """Of files given as lines with their effects: (path, block, row, inside, before, n), the state and the number of records before
    each run of lines, staged; and (path, apart, cells, widest, records), staged.

    `apart` tells files with a record that is longer than `long_record` or never closed; `cells` and `widest` bound the cells of a
    file and of a record.
    """
    effects = lines.select("path", "block", "row", "from_out", "from_in", "size", "parts").mapInArrow(_effect_batches, _EFFECTS)
    told = entered(effects.withColumn("place", F.struct("block", "row")), ["path"], "place", F.lit(False))
    own = lambda m: F.when(F.col("inside"), F.col(f"{m}_in")).otherwise(F.col(f"{m}_out")).alias(m)
    ends = F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")).alias("open")
    ahead = Window.partitionBy("path").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, -1)
    runs = told.select("path", "block", "row", "inside", ends, "cells", *[own(m) for m in _MEASURES])
    runs = stage(runs.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))))
    # What a run holds of the record before it, and of the last that begins in it.
    pieces = runs.select("path", F.col("before").alias("record"), F.col("head").alias("size"), F.col("head_parts").alias("w")).unionByName(
        runs.filter("n > 0").select("path", (F.col("before") + F.col("n")).alias("record"), F.col("tail").alias("size"), F.col("tail_parts").alias("w"))
    )
    over = pieces.groupBy("path", "record").agg(F.sum("size").alias("size"), F.sum("w").alias("w")).groupBy("path").agg(
        F.max("size").alias("size"), F.max("w").alias("w")
    )
    files = runs.groupBy("path").agg(
        F.max("most").alias("most"), F.max("most_parts").alias("most_parts"), F.sum("cells").alias("cells"), F.sum("n").alias("records"),
        F.max_by("open", F.struct("block", "row")).alias("open"),
    )
    files = files.join(over, "path").select(
        "path", (F.col("open") | (F.greatest("most", "size") > long_record)).alias("apart"), "cells",
        (F.greatest("most_parts", "w") + 1).alias("widest"), "records",
    )
    return runs.select("path", "block", "row", "inside", "before", "n"), stage(files)


def put_together(lines: DataFrame, dialect: Dialect, long_record: int = LONG_RECORD) -> tuple[DataFrame, int, int, int]:
    """(path, record, text) of files given as lines (path, block, row, text), and the most cells of a file, of a record, and the records.

    Lines come as they were read: those of a block together and in their order.  What a
    block does to the state is told first, by runs of lines; then each task puts together
    the lines of its blocks.  Files with records that are longer than `long_record` or never
    closed go by `join_records`.
    """
    told = lines.select(
        "path", "block", "row", "text", ends_inside(F.col("text"), dialect, False).alias("from_out"),
        ends_inside(F.col("text"), dialect, True).alias("from_in"), (F.char_length("text") + 1).cast("bigint").alias("size"),
        (F.char_length("text") - F.char_length(F.translate("text", dialect.delimiter, ""))).cast("bigint").alias("parts"),
    )
    runs, files = _run_starts(told, long_record)
    n_files, apart, most, widest, records = files.agg(
        F.count(F.lit(1)), F.count_if("apart"), F.max("cells"), F.max("widest"), F.sum("records")
    ).first()
    found = []
    if apart < n_files:
        starts = runs.join(files.filter(~F.col("apart")).select("path"), "path", "left_semi").groupBy("path", "block").agg(
            F.min_by(F.struct("inside", "before"), "row").alias("s")
        ).select("path", "block", "s.inside", "s.before")
        few = starts.count() <= SENT_NAMES
        begun = told.select("path", "block", "row", "text", "from_out", "from_in").join(F.broadcast(starts) if few else starts, ["path", "block"])
        if not few:
            begun = begun.repartition("path", "block").sortWithinPartitions("path", "block", "row")
        pieces = stage_table(begun.select("path", "block", "row", "text", "from_out", "from_in", "inside", "before").mapInArrow(_piece_batches, _PIECES))
        found += [pieces.filter("whole").select("path", "record", "text"), record_texts(pieces.filter(~F.col("whole")))]
    if apart:
        numbered = join_records(lines.join(files.filter("apart").select("path"), "path", "left_semi"), dialect, long_record)
        found.append(record_texts(numbered))
    return reduce(DataFrame.unionByName, found), most or 0, widest or 1, records or 0


def record_texts(numbered: DataFrame) -> DataFrame:
    """(path, record, text): lines put together; one group is one record of limited length."""
    part = F.struct("block", "row", "text")
    return numbered.groupBy("path", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n").alias("text")
    )


# --- cells ---------------------------------------------------------------------------


def cells(record: Column, dialect: Dialect) -> Column:
    """Cells of one record.  Records without a quote are split; the others go to the standard reader."""

    @F.pandas_udf("array<string>")
    def parsed(records: pd.Series) -> pd.Series:
        csv.field_size_limit(1 << 31)
        how = {"delimiter": dialect.delimiter, "quotechar": dialect.quote, "skipinitialspace": dialect.skip_space}
        return records.map(lambda text: None if text is None else next(csv.reader(io.StringIO(text, newline=""), **how), []))

    plain = F.split(record, _literal(dialect.delimiter), -1)
    if dialect.skip_space:
        plain = F.transform(plain, lambda c: F.ltrim(c))
    quoted = F.contains(record, F.lit(dialect.quote))
    return F.when(quoted, parsed(F.when(quoted, record))).otherwise(plain)


@dataclass(frozen=True)
class CsvItems:
    """Cells of one dialect and what is needed to place what was found in them.

    `items` has path, ftype, block, row, `cell` (position among all cells of the record),
    `nth` (position among its filled cells), text and error; a record without filled cells
    has one item without cell and text.  A row is a line or, where records were put
    together, a record, and a block so many of them.
    """

    items: DataFrame
    rows: DataFrame  # path, block, row, n: filled cells per record
    headers: DataFrame  # path, cell, name
    width: int
    most_cells: int  # no file has more


def read_csv_items(spark: SparkSession, files: DataFrame) -> list[CsvItems]:
    """Cells of CSV files (uri, file, type), one entry per dialect and kind of record.

    File names by dialect pass through the driver, as they do when Spark lists files; no
    content does.  Compressed files are read one by one.
    """
    groups: dict[Dialect, list[tuple[str, str]]] = {}
    for uri, file, *rest in sniff(files).toLocalIterator():
        groups.setdefault(Dialect(*rest), []).append((uri, file))
    found = []
    for dialect, own in groups.items():
        plain = [u for u, file in own if not file.lower().endswith(".gz")]
        packed = [(u, "csv") for u, file in own if file.lower().endswith(".gz")]
        parts = []
        if plain:
            parts.append(
                spark.read.text([escape_globs(u) for u in plain]).select(
                    F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"), F.make_valid_utf8("value").alias("text"),
                    F.lit(None).cast("string").alias("error"),
                )
            )
        if packed:
            listed = spark.createDataFrame(packed, "uri string, type string")
            parts.append(read_guarded_lines(listed).select("path", "block", "row", "text", "error"))
        for lines in parts:
            found += line_items(lines, dialect)
    return found


def line_items(lines: DataFrame, dialect: Dialect) -> list[CsvItems]:
    """Cells of files given as lines (path, block, row, text, error), all of one dialect.

    A first pass counts what decides how to go on: the lines that open a cell which runs
    on, the widest line, and the first block of each file.
    """
    width = F.char_length("text") - F.char_length(F.translate("text", dialect.delimiter, "")) + 1
    profile = stage(
        lines.groupBy("path", "block").agg(
            F.count_if(ends_inside(F.col("text"), dialect, False)).alias("open"), F.max(width).alias("width"),
            F.sum(width).alias("cells"), F.count("row").alias("lines"),
        )
    )
    files = profile.groupBy("path").agg(
        F.sum("open").alias("open"), F.max("width").alias("width"), F.sum("cells").alias("cells"),
        F.min(F.when(F.col("lines") > 0, F.col("block"))).alias("block"),
    )
    joined, widest, most = files.agg(F.count_if(F.col("open") > 0), F.max("width"), F.max("cells")).first()
    running = files.filter(F.col("open") > 0).select("path")
    running = F.broadcast(running) if joined <= SENT_NAMES else running
    found = []
    if joined < files.count():
        own = lines.join(running, "path", "left_anti") if joined else lines
        begins = files.filter((F.col("open") == 0) & F.col("block").isNotNull()).select("path", "block")
        begins = F.broadcast(begins) if files.count() <= SENT_NAMES else begins
        head = own.join(begins, ["path", "block"]).groupBy("path").agg(F.min_by("text", "row").alias("text"))
        found.append(_csv_items(own, head, dialect, widest or 1, most or 0))
    if joined:
        own = lines.filter(F.col("text").isNotNull()).join(running, "path", "left_semi").select("path", "block", "row", "text")
        if joined > SENT_NAMES:
            own = own.repartition("path", "block").sortWithinPartitions("path", "block", "row")
        records, most, widest, n = put_together(own, dialect)
        placed = records.select(
            "path", F.floor(F.col("record") / RECORD_RUN).alias("block"), F.col("record").alias("row"), "text", F.lit(None).cast("string").alias("error")
        )
        failed = lines.filter(F.col("error").isNotNull()).join(running, "path", "left_semi")
        head = records.filter(F.col("record") == 1).select("path", "text")
        # By the blocks that what is found is put together by, so that records move and not what is found in them.
        tasks = max(lines.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_RECORDS))
        placed = placed.unionByName(failed.select(*placed.columns)).repartition(tasks, "path", "block")
        found.append(_csv_items(placed, head, dialect, widest, most))
    return found


def _csv_items(records: DataFrame, head: DataFrame, dialect: Dialect, width: int, most: int) -> CsvItems:
    split = cells(F.col("text"), dialect)
    filled = F.filter(
        F.transform(F.col("_cells"), lambda v, i: F.struct(i.alias("cell"), v.alias("text"))), lambda c: c["text"] != ""
    )
    split_rows = records.withColumn("_cells", split)
    items = split_rows.select("path", "block", "row", "error", F.posexplode_outer(filled).alias("_nth", "_c")).select(
        "path", F.lit("csv").alias("ftype"), "block", "row", (F.col("_nth") + 1).alias("nth"), "_c.cell", "_c.text", "error"
    )
    names = head.withColumn("_cells", split).select("path", F.posexplode("_cells").alias("cell", "name"))
    rows = split_rows.select("path", "block", "row", F.coalesce(F.size(filled), F.lit(0)).alias("n"))
    return CsvItems(items, rows, names, width, most)


def place_cells(blocks: DataFrame, source: CsvItems) -> DataFrame:
    """What was found in the cells of `source` (see `lines.block_counts`) with `file`, `item_idx` and `location` (`row R, <header>`).

    The header of a column is its cell in the first record; without one, and in that
    record itself, `col N` is used.  path, block, row and nth are kept.
    """
    named = number(blocks).join(source.headers, ["path", "cell"], "left")
    name = F.when(
        (F.col("line") > 1) & (F.coalesce("name", F.lit("")) != ""), F.col("name")
    ).otherwise(F.concat(F.lit("col "), (F.col("cell") + 1).cast("string")))
    return (
        named.withColumn("file", plain_path(F.col("path")))
        .withColumn("location", F.concat(F.lit("row "), F.col("line").cast("string"), F.lit(", "), name))
        .withColumn("item_idx", ((F.col("line") - 1) * source.width + F.col("cell") + 1).cast("bigint"))
        .drop("line", "cell", "name")
    )
