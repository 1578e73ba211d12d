"""File types by name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.text import let

# --- Fixed values: extensions and well-known names ------------------------------
CONFIG_EXTS = (
    ".conf", ".cfg", ".ini", ".yaml", ".yml", ".json", ".xml", ".env", ".properties", ".toml", ".config", ".plist",
    ".jsonl", ".ndjson", ".sql",
)
LOG_EXTS = (".log", ".logs", ".out", ".syslog", ".audit")
CSV_EXTS = (".csv", ".tsv")
XLSX_EXTS = (".xlsx", ".xlsm", ".xltx")
XLS_EXTS = (".xls",)
ODS_EXTS = (".ods",)
PDF_EXTS = (".pdf",)
PARQUET_EXTS = (".parquet", ".pq")
EVTX_EXTS = (".evtx",)
TEXT_EXTS = (".txt", ".text", ".md")
CONFIG_NAMES = (".env", "dockerfile", "nginx.conf", "my.cnf", "httpd.conf", "sshd_config", "web.config")
STRUCTURED_EXTS = (".json", ".toml", ".ini", ".yaml", ".yml", ".env")
STRUCTURED_MAX_BYTES = 2_000_000

BY_EXTENSION = (
    ("xlsx", XLSX_EXTS), ("xls", XLS_EXTS), ("ods", ODS_EXTS), ("pdf", PDF_EXTS), ("parquet", PARQUET_EXTS),
    ("evtx", EVTX_EXTS), ("csv", CSV_EXTS), ("config", CONFIG_EXTS),
)
SUPPORTED_EXTS = tuple(e for _, group in BY_EXTENSION for e in group) + LOG_EXTS + TEXT_EXTS


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Extension of a lower-case name: the last dot on, unless only dots lie before it."""
    return F.regexp_extract(name, r"[^.].*?(\.[^.]*)$", 1)


def _inner(path: Column) -> Column:
    return F.regexp_replace(F.lower(file_name(path)), r"\.gz$", "")


def _named(path: Column, body) -> Column:
    """`body(name, extension)` with both worked out once."""
    return let(_inner(path), lambda name: let(F.when(name == ".env", ".env").otherwise(extension(name)), lambda ext: body(name, ext)))


def classify(path: Column) -> Column:
    """xlsx, xls, ods, pdf, parquet, evtx, csv, config, log or text.

    A trailing `.gz` is looked through; any other name that contains "log" is a log.
    """

    def kind(name: Column, ext: Column) -> Column:
        label = F.when(F.lit(False), F.lit(None).cast("string"))
        for value, extensions in BY_EXTENSION:
            hit = ext.isin(*extensions)
            label = label.when(hit | name.isin(*CONFIG_NAMES) if value == "config" else hit, value)
        return label.when(ext.isin(*LOG_EXTS) | name.contains("log"), "log").otherwise("text")

    return _named(path, kind)


def is_supported(path: Column) -> Column:
    """Files of a directory that take part in a scan."""
    return _named(path, lambda name, ext: ext.isin(*SUPPORTED_EXTS)) | classify(path).isin("log", "config")


def is_structured(path: Column, length: Column) -> Column:
    """Settings files small enough to be parsed as a tree."""
    name = F.lower(file_name(path))
    return let(
        name,
        lambda n: F.when(n == ".env", ".env").otherwise(extension(n)).isin(*STRUCTURED_EXTS)
    ) & (length <= STRUCTURED_MAX_BYTES)
