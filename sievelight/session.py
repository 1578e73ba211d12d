"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Keep map-side combining of the merge in memory for more keys than the default 128.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def build_session(app: str = "sievelight", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, for staged tables."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sievelight-"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it back.

    Used where a result is needed more than once and is far smaller than its
    input.  The folder is the one the cluster names in `spark.checkpoint.dir`;
    only a session whose master is local may go without, and gets a local folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame) -> DataFrame:
    """Like `stage`, for wide tables of which later steps read some columns or some rows: kept as Parquet."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that one task works on at most, where they are costly.
ROWS_PER_TASK = 1 << 17


def parts_for(rows: int, per_task: int) -> int:
    """Parts that so many rows are shuffled into: those the session sets, or as many more as the rows ask for."""
    return max(int(SparkSession.active().conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def spread(table: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Give a table that was read in few parts to all cores, and to as many tasks as its rows ask for.

    It is for files whose rows are costly to work on: small ones, and those that hold very
    many short rows in few bytes.  A table of long rows comes in enough parts and is left as it is.
    """
    if table.isStreaming:
        return table
    parts = table.rdd.getNumPartitions()
    wanted = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // rows_per_task))
    return table.repartition(wanted) if parts < wanted else table
