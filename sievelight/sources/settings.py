"""Settings files as (key path, value) rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .classify import extension, file_name

#: Settings of Spark's recursive queries: no limit of levels, none of rows.
UNLIMITED = {"spark.sql.cteRecursionLevelLimit": "-1", "spark.sql.cteRecursionRowLimit": "-1"}

FLATTEN = """
WITH RECURSIVE node(file, path, value) AS (
  SELECT file, '', try_parse_json(text) FROM {documents}
  UNION ALL
  SELECT file, path || CASE WHEN child.key IS NULL THEN '[' || child.pos || ']' WHEN path = '' THEN child.key ELSE '.' || child.key END, child.value
  FROM node, LATERAL variant_explode(node.value) AS child
)
SELECT * FROM node WHERE value IS NOT NULL
"""


def settings_format(path: Column) -> Column:
    name = F.lower(file_name(path))
    return F.when(name == ".env", "env").otherwise(F.regexp_replace(extension(name), r"^\.", ""))


def flatten_json(documents: DataFrame, text: str = "text") -> DataFrame:
    """JSON documents as rows (file, path, value, value_type), by a recursive query over VARIANT values.  Staged.

    Each step opens the containers found by the one before; objects and lists of any depth
    and length are opened whole, nulls are dropped.  Documents that are no JSON give no
    rows; see `is_json`.
    """
    spark = documents.sparkSession
    before = {name: spark.conf.get(name, None) for name in UNLIMITED}
    for name, value in UNLIMITED.items():
        spark.conf.set(name, value)
    try:
        nodes = spark.sql(FLATTEN, documents=documents.select("file", F.col(text).alias("text")))
        kind = F.schema_of_variant("value")
        value_type = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "bool").when(kind == "BIGINT", "int").when(
            kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float"
        )
        leaf = F.try_variant_get("value", "$", "string")
        leaves = nodes.select(
            "file", "path", F.when(kind == "BOOLEAN", F.initcap(leaf)).otherwise(leaf).alias("value"), value_type.alias("value_type")
        )
        return stage(leaves.filter(F.col("value_type").isNotNull()))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def read_env(lines: DataFrame) -> DataFrame:
    """`KEY=value` lines of .env files as rows (file, path, value, value_type); the last setting of a key wins.

    `lines` has file, item_idx and text.
    """
    pattern = r"(?Ud)^\s*(?:export\s+)?([A-Za-z_][A-Za-z_0-9]*)\s*=\s*(.*)\s*$"
    raw = F.btrim(F.regexp_extract("text", pattern, 2))
    quote = F.left(raw, F.lit(1))
    quoted = (F.char_length(raw) > 1) & (quote == F.right(raw, F.lit(1))) & quote.isin('"', "'")
    value = F.when(quoted, F.substring(raw, F.lit(2), F.char_length(raw) - 2)).otherwise(F.substring_index(raw, " #", 1))
    rows = lines.select(
        "file", "item_idx", F.regexp_extract("text", pattern, 1).alias("path"), value.alias("value")
    ).filter((F.col("path") != ""))
    return (
        rows.groupBy("file", "path")
        .agg(F.max_by("value", "item_idx").alias("value"))
        .withColumn("value_type", F.lit("string"))
    )


def _sections(text: str) -> dict:
    import configparser

    read = configparser.ConfigParser(interpolation=None)
    read.read_string(text)
    return {name: dict(read[name]) for name in read.sections()}


def _json_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json
    import tomllib

    import yaml

    loaders = {"toml": tomllib.loads, "ini": _sections, "yaml": yaml.safe_load, "yml": yaml.safe_load}
    for batch in batches:
        texts = []
        for kind, text in zip(batch["format"], batch["text"]):
            try:  # what JSON has no type for, such as a date, is no setting that a rule looks at
                texts.append(json.dumps(loaders[kind](text), default=lambda _: None, skipkeys=True, allow_nan=False))
            except Exception:  # any failure of a parser means: read the file line by line
                texts.append(None)
        yield pd.DataFrame({"file": batch["file"], "text": texts})


def as_json(documents: DataFrame) -> DataFrame:
    """(file, text): INI, TOML, YAML and JSON documents (file, format, text) as JSON texts, null where malformed.

    JSON passes through; the others go to the standard parsers on the executors.
    Documents are limited in size by the caller.
    """
    other = documents.filter(F.col("format") != "json").select("file", "format", "text").mapInPandas(_json_batches, "file string, text string")
    return documents.filter(F.col("format") == "json").select("file", "text").unionByName(other)
