from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sievelight.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ITEM = "file string, ftype string, item_idx bigint, location string, text string"


@pytest.fixture(scope="session")
def make_items(spark):
    def build(lines, file="f.txt", ftype="text"):
        rows = [(file, ftype, i, f"line {i}", t) for i, t in enumerate(lines, 1)]
        return spark.createDataFrame(rows, ITEM)

    return build
