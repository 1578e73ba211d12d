"""Line rules on a stream, and running a stream over what is there now."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators import detect
from ..session import shared_folder


def line_signals(items: DataFrame, *, year: int, families: Iterable[str] = detect.FAMILIES) -> DataFrame:
    """The batch rules on a streaming table of items; they keep no state."""
    return detect.signals(items, year=year, families=families)


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything a stream holds now and give the written result.

    Append results go to a Parquet sink; update results are written batch by
    batch, so a row may come several times as it grows.
    """
    spark = stream.sparkSession
    folder = work_folder(spark)
    out = f"{folder}/out"
    spark.createDataFrame([], stream.schema).write.parquet(out)  # a stream without rows writes nothing
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        running = writer.format("parquet").outputMode("append").start(out)
    else:

        def write(batch: DataFrame, _: int) -> None:
            batch.write.mode("append").parquet(out)

        running = writer.outputMode(mode).foreachBatch(write).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
