"""Tables as items: every cell that holds something."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

ROW_RUN = 1 << 16


def cell_text(field: T.StructField) -> Column:
    """A value as text: True/False for booleans, JSON for nested values."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(column)
    if isinstance(field.dataType, T.BinaryType):
        return F.decode(column, "UTF-8")
    return column.cast("string")


def filled_cells(table: DataFrame, columns: Sequence[str]) -> Column:
    """The cells of a row that hold something: array of (pos, name, text)."""
    fields = [table.schema[c] for c in columns]
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(f.name).alias("name"), cell_text(f).alias("text"))
            for i, f in enumerate(fields)
        ]
    )
    return F.filter(cells, lambda c: c["text"] != "")


def table_items(
    table: DataFrame, file: Column | str, row: Column, columns: Sequence[str] | None = None, ftype: str = "parquet",
    place: bool = False,
) -> DataFrame:
    """Cells of `table` as items: (file, ftype, item_idx, location, text).

    `row` is the 1-based row number.  Name the columns to scan to read only
    those.  One pass without a shuffle.  With `place`, `row` and `nth` (position
    among the filled cells of the row) are kept.
    """
    names = list(columns or table.columns)
    path = file if isinstance(file, Column) else F.lit(file)
    extra = ["row", (F.col("_nth") + 1).alias("nth")] if place else []
    return table.select(
        path.alias("file"), row.cast("bigint").alias("row"), F.posexplode(filled_cells(table, names)).alias("_nth", "_c")
    ).select(
        "file", F.lit(ftype).alias("ftype"),
        ((F.col("row") - 1) * len(names) + F.col("_c.pos") + 1).alias("item_idx"),
        F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(", "), "_c.name").alias("location"),
        F.col("_c.text").alias("text"), *extra,
    )


def by_shape(files: DataFrame) -> list[list[str]]:
    """URIs of Parquet files (uri, shape) by the shape that their footers tell, so that columns of other types do not meet."""
    shapes: dict[str, list[str]] = {}
    for row in files.select("shape", "uri").toLocalIterator():
        shapes.setdefault(row["shape"], []).append(row["uri"])
    return list(shapes.values())


def read_parquet(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None, ignore_corrupt: bool = False
) -> tuple[DataFrame, list[str]]:
    """Parquet files with `__file` and `__row`, the row number in the file, and the names of their columns.

    With `ignore_corrupt` a file that turns out to be broken ends there, and others are read.
    """
    from .lines import plain_path

    table = spark.read.options(mergeSchema=True, ignoreCorruptFiles=ignore_corrupt).parquet(*paths)
    names = list(columns or table.columns)
    numbered = table.select(
        *[F.col(f"`{c}`") for c in names], plain_path(F.col("_metadata.file_path")).alias("__file"),
        (F.col("_metadata.row_index") + 1).alias("__row"),
    )
    return numbered, names


def read_parquet_items(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Cells of Parquet files; the row number is the one in the file."""
    table, names = read_parquet(spark, paths, columns)
    return table_items(table, F.col("__file"), F.col("__row"), names)


def cell_edges(rows: DataFrame, key: str, place: Sequence[str], limit: int) -> DataFrame:
    """Where each file reaches `limit` cells: (key, edge, left).

    `rows` has key, place and `n`, the filled cells of each row.  Cells are summed
    up by runs of rows, which leads to the one run, and in it to the row, where
    the limit falls; files below the limit have no edge.
    """
    run = [F.col(c) for c in place[:-1]] + [F.floor(F.col(place[-1]) / ROW_RUN).alias("_run")]
    names = [*place[:-1], "_run"]
    ahead = Window.partitionBy(key).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        rows.groupBy(key, *run)
        .agg(F.sum("n").alias("_m"))
        .withColumn("_before", F.coalesce(F.sum("_m").over(ahead), F.lit(0)))
        .filter((F.col("_before") <= limit) & (F.col("_before") + F.col("_m") > limit))
        .select(key, *names, "_before")
    )
    inside = Window.partitionBy(key, *names).orderBy(place[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_run", F.floor(F.col(place[-1]) / ROW_RUN))
        .join(runs, [key, *names])
        .withColumn("_start", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .filter((F.col("_start") <= limit) & (F.col("_start") + F.col("n") > limit))
        .select(key, F.struct(*place).alias("edge"), (F.lit(limit) - F.col("_start")).alias("left"))
    )


def within_edges(found: DataFrame, edges: DataFrame, key: str, place: Sequence[str]) -> DataFrame:
    """What was found in cells before the edge of their file.

    Applied to what was found, so the cells themselves are never shuffled.
    """
    here = F.struct(*place)
    return (
        found.join(edges, key, "left")
        .filter(
            F.col("edge").isNull() | (here < F.col("edge")) | ((here == F.col("edge")) & (F.col("nth") <= F.col("left")))
        )
        .drop("edge", "left")
    )


def renumber(items: DataFrame) -> DataFrame:
    """`item_idx` as 1, 2, 3, … over the items a file really has, in order.

    Empty cells are not items, so the limit on items per file needs dense
    numbers.  Counts per run of item numbers give the offset of each run; the
    rank inside a run is local to it.
    """
    runs = items.withColumn("_run", F.floor(F.col("item_idx") / ROW_RUN))
    ahead = Window.partitionBy("file").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        runs.groupBy("file", "_run")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("file", "_run", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("file", "_run").orderBy("item_idx")
    return (
        runs.join(offsets, ["file", "_run"])
        .withColumn("item_idx", F.col("_before") + F.row_number().over(inside))
        .drop("_run", "_before")
    )
