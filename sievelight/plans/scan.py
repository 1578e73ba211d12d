"""The scan: files or items in, findings and file table out.

    read once -> signals -> staged
    staged signals -> line findings, roll-ups, login correlation
    + settings findings -> relevance -> masking pass -> merge -> staged
    staged findings -> limit per file -> limit per scan -> catalog, fingerprints, baseline

The large input is read by one wide detection pass.  What it finds is staged in
the checkpoint folder, since everything later needs it more than once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import catalog as CAT
from ..operators import auth, baseline as BL, config_tree, detect, enrich, findings as FN, rollup, ruletable
from ..session import stage
from ..sources import delimited, discovery, hidden, lines as L, settings as S, tables

NOT_READ = ("xlsx", "xls", "ods", "pdf", "evtx")
MISSING_READER = "optional dependency unavailable"

SIGNAL_COLUMNS = (
    "file", "ftype", "item_idx", "location", "kind", "det", "k", "check_id", "evidence", "detail", "count",
    "confidence_score", "value", "user", "ip", "ts", "fail", "success",
)


@dataclass(frozen=True)
class Options:
    frameworks: Sequence[str] = ("all",)
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    year: int | None = None  # of syslog times, which have none
    item_limit: int | None = None  # items searched in a file
    file_limit: int | None = None  # findings kept of a file
    scan_limit: int | None = None  # findings kept of a scan
    max_text: int | None = None  # characters searched in an item
    rules: Sequence[tuple[str, str, str]] = ()
    rule_table: DataFrame | None = None  # more rules (check_id, pattern, detail), for items
    baseline: DataFrame | None = None
    crosswalk: DataFrame | str | None = None
    root: str | None = None

    @property
    def selected(self) -> list[str]:
        return CAT.resolve_frameworks(self.frameworks)

    @property
    def stamp_year(self) -> int:
        return self.year or self.now.year


@dataclass(frozen=True)
class ScanResult:
    findings: DataFrame  # active findings with attributes, fingerprints and mappings
    suppressed: DataFrame
    files: DataFrame
    catalog: CAT.Catalog
    options: Options
    root: str | None


def raw_findings(signals: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """All raw findings of staged signals and of settings rows."""
    direct = signals.filter(F.col("kind") == "finding").select(
        "check_id", "file", "location", "evidence", "detail", "count", "confidence_score",
        FN.order_key(0, F.col("item_idx"), F.col("det"), F.col("k")).alias("ord"),
    )
    logins = signals.filter(F.col("kind") == "auth")
    parts = [direct, rollup.bulk_contacts(signals), rollup.untimed_failures(logins), auth.correlate(logins)]
    if settings is not None:
        parts.append(config_tree.settings_findings(settings))
    return reduce(DataFrame.unionByName, parts)


def collect_findings(raw: DataFrame, options: Options, catalog: CAT.Catalog) -> DataFrame:
    """Relevance, masking pass, merge and both limits."""
    relevant = enrich.keep_relevant(raw, catalog, options.selected)
    merged = stage(FN.merge(FN.insert(relevant)))
    limited = FN.limit_per_file(merged, options.file_limit)
    return FN.limit_per_scan(limited, options.scan_limit)


def finish(found: DataFrame, files: DataFrame, options: Options, catalog: CAT.Catalog, root: str | None) -> ScanResult:
    """Catalog attributes, fingerprints, mappings and the baseline."""
    full = enrich.with_mappings(
        enrich.with_check(enrich.with_confidence(enrich.with_fingerprints(found, root)), catalog), catalog,
        options.selected,
    )
    if options.baseline is None:
        active = stage(full.withColumn("expired_suppression", F.lit(False)))
        suppressed = active.filter(F.lit(False))
    else:
        marked = stage(BL.apply_baseline(full, options.baseline, options.now))
        active = marked.filter(~F.col("suppressed")).drop("suppressed")
        suppressed = marked.filter("suppressed").drop("suppressed")
    omitted = (
        active.unionByName(suppressed)
        .filter(F.col("location") == FN.FILE_LIMIT_TEXT[0])
        .groupBy("file")
        .agg(F.sum("count").alias("distinct_findings_omitted"))
    )
    files = files.join(omitted, "file", "left").withColumn(
        "distinct_findings_omitted", F.coalesce("distinct_findings_omitted", F.lit(0)).cast("bigint")
    )
    return ScanResult(active, suppressed, files, catalog, options, root)


def file_status(files: DataFrame, item_limit: int | None) -> DataFrame:
    """Adds truncated, status and error from `items`, the number of items a file holds.

    `error`, when present, tells files that could not be read to the end.
    """
    cut = F.lit(False) if item_limit is None else F.col("items") > item_limit
    shown = F.col("items") if item_limit is None else F.least("items", F.lit(item_limit))
    unread = F.col("type").isin(*NOT_READ)
    broken = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    status = (
        F.when(unread | (broken.isNotNull() & (F.col("items") == 0)), "unable_to_evaluate")
        .when(broken.isNotNull() | cut, "partially_scanned")
        .otherwise("fully_scanned")
    )
    return files.select(
        "file", "type", F.when(unread, F.lit(0)).otherwise(shown).cast("bigint").alias("lines"),
        F.when(unread, MISSING_READER).otherwise(broken).alias("error"), (cut & ~unread).alias("truncated"),
        status.alias("status"), "config_parser",
    )


def scan_items(items: DataFrame, options: Options | None = None) -> ScanResult:
    """Scan any numbered items (file, ftype, item_idx, location, text), such as those of a table."""
    options = options or Options()
    more = [] if options.rule_table is None else [
        (r.check_id, "", r.detail) for r in options.rule_table.groupBy("check_id").agg(F.min("detail").alias("detail")).toLocalIterator()
    ]
    catalog = CAT.with_rules(CAT.tables(items.sparkSession, options.crosswalk), [*options.rules, *more])
    counts = items.groupBy("file", F.col("ftype").alias("type")).agg(F.count("*").alias("items"))
    if options.item_limit is not None:
        items = FN.first_items(items, options.item_limit)
    found = detect.signals(items, year=options.stamp_year, rules=options.rules, max_text=options.max_text).select(*SIGNAL_COLUMNS)
    if options.rule_table is not None:
        found = found.unionByName(ruletable.rule_signals(items, options.rule_table, year=options.stamp_year).select(*SIGNAL_COLUMNS))
    signals = stage(found)
    files = file_status(counts.withColumn("config_parser", F.lit(None).cast("string")), options.item_limit)
    found = collect_findings(raw_findings(signals), options, catalog)
    return finish(found, files, options, catalog, options.root)


def _within(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.filter(F.col("item_idx") <= limit)


def _searched_lines(lines, families, options):
    """Findings in lines (path, ftype, block, row, text) and the line counts of their files, in one pass."""
    found = detect.signals(
        lines, year=options.stamp_year, families=families, rules=options.rules, max_text=options.max_text, inside=("row", "ftype")
    )
    blocks = L.block_counts(found)
    return _within(L.numbered_lines(blocks), options.item_limit), L.file_counts(blocks)


def _text_part(spark, files, options):
    parts = []
    for ftype in L.LINE_TYPES:
        uris = discovery.names(files, ftype)
        if uris:
            parts.append(_searched_lines(L.read_lines(spark, uris, ftype), families_of(ftype), options))
    return parts


def _guarded_part(files, options):
    """Files read one by one, where one that fails leaves the others alone."""
    chosen = files.filter(discovery.one_by_one() & F.col("type").isin(*L.LINE_TYPES) & F.col("error").isNull() & (F.col("length") > 0))
    return _searched_lines(hidden.read_guarded_lines(chosen), detect.FAMILIES, options)


def families_of(ftype: str) -> tuple[str, ...]:
    """Rule families that can fire on files of this type."""
    extra = {"text": ("config", "log"), "config": ("config",), "log": ("log",), "evtx": ("log",), "pdf": ("log",)}
    return ("content", "contact", *extra.get(ftype, ()))


def _csv_part(spark, files, options):
    parts = []
    limit = options.item_limit
    for source in delimited.read_csv_items(spark, files.filter((F.col("type") == "csv") & ~F.col("hidden") & F.col("error").isNull())):
        searched = detect.signals(
            source.items, year=options.stamp_year, families=families_of("csv"), rules=options.rules, max_text=options.max_text,
            inside=("row", "ftype", "cell", "nth"),
        )
        blocks = L.block_counts(searched)
        found = delimited.place_cells(blocks, source)
        if limit is not None and source.most_cells > limit:
            edges = tables.cell_edges(source.rows, "path", ("block", "row"), limit)
            found = tables.within_edges(found, edges, "path", ("block", "row"))
        parts.append((found, L.file_counts(blocks, "n_cells")))
    return parts


def _parquet_part(spark, files, options):
    """Parquet files, those of one shape read together.  Where fewer rows come than the footer tells, the file is broken."""
    chosen = files.filter((F.col("type") == "parquet") & ~F.col("hidden") & F.col("error").isNull() & (F.col("length") > 0))
    parts = []
    for uris in tables.by_shape(chosen):
        table, names = tables.read_parquet(spark, [L.escape_globs(u) for u in uris], ignore_corrupt=True)
        items = tables.table_items(table, F.col("__file"), F.col("__row"), names, place=True)
        found = detect.signals(items, year=options.stamp_year, families=families_of("parquet"), rules=options.rules, max_text=options.max_text)
        rows = table.select(
            F.col("__file").alias("file"), F.col("__row").alias("row"), F.size(tables.filled_cells(table, names)).alias("n")
        )
        counts = stage(rows.groupBy("file").agg(F.sum("n").alias("items"), F.count("*").alias("rows")))
        if options.item_limit is not None and not counts.filter(F.col("items") > options.item_limit).isEmpty():
            found = tables.within_edges(found, tables.cell_edges(rows, "file", ["row"], options.item_limit), "file", ["row"])
        own = chosen.filter(F.col("uri").isin(uris)).select("file", "n_rows").join(counts, "file", "left")
        short = F.coalesce("rows", F.lit(0)) < F.col("n_rows")
        parts.append((found, own.select("file", F.coalesce("items", F.lit(0)).alias("items"), F.when(short, "OSError").alias("error"))))
    return parts


def documents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Settings files small enough to be parsed: (file, format, text)."""
    chosen = files.filter("structured AND error IS NULL")
    unseen = hidden.read_guarded_lines(chosen.filter("hidden")).filter(F.col("text").isNotNull())
    # One group is one file of limited size.
    texts = unseen.groupBy("path").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), "\n"
        ).alias("text")
    ).select(L.plain_path(F.col("path")).alias("file"), "text")
    uris = [row.uri for row in chosen.filter(~F.col("hidden")).select("uri").toLocalIterator()]
    if uris:
        visible = spark.read.format("binaryFile").load([L.escape_globs(u) for u in uris]).select(
            L.plain_path(F.col("path")).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")
        )
        texts = visible.unionByName(texts)
    return texts.select("file", S.settings_format(F.col("file")).alias("format"), "text")


def parse_settings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settings rows, files that could be parsed)."""
    kind = F.col("format")
    trees, env_docs = stage(S.as_json(docs.filter(kind != "env"))), docs.filter(kind == "env")
    columns = ("file", "path", "value", "value_type")
    env_lines = L.split_lines(env_docs, F.col("file"), F.col("text"))
    rows = S.flatten_json(trees).select(*columns).unionByName(S.read_env(env_lines).select(*columns))
    return rows, trees.filter(S.is_json(F.col("text"))).select("file").unionByName(env_docs.select("file"))


def drop_parsed_lines(signals: DataFrame, parsed: DataFrame) -> DataFrame:
    """Leave out line findings of settings files that were parsed; what else their lines hold stays."""
    by_line = (F.col("ftype") == "config") & F.col("det").between(*detect.CONFIG_DETS)
    marked = signals.join(parsed.withColumn("_parsed", F.lit(True)), "file", "left")
    return marked.filter(~(by_line & F.col("_parsed").isNotNull())).drop("_parsed")


def scan(spark: SparkSession, inputs: Sequence[str], options: Options | None = None) -> ScanResult:
    """Scan files and directories."""
    options = options or Options()
    catalog = CAT.with_rules(CAT.tables(spark, options.crosswalk), options.rules)
    inputs, named = discovery.usable_inputs(spark, inputs)
    if not inputs:
        raise ValueError("no readable input files found")
    files = stage(discovery.list_files(spark, inputs, named))
    if files.isEmpty():
        raise ValueError("no readable input files found")
    parts = _text_part(spark, files, options) + _csv_part(spark, files, options) + _parquet_part(spark, files, options)
    if not parts or not files.filter(discovery.one_by_one() & (F.col("length") > 0)).isEmpty():
        parts.append(_guarded_part(files, options))
    settings, parsed = parse_settings(stage(documents(spark, files)))
    parsed = stage(parsed.distinct())
    signals = reduce(DataFrame.unionByName, [p.select(*SIGNAL_COLUMNS) for p, _ in parts])
    signals = stage(drop_parsed_lines(signals, parsed))
    counts = reduce(DataFrame.unionByName, [c for _, c in parts]).groupBy("file").agg(
        F.sum("items").alias("items"), F.max("error").alias("_broken")
    )
    table = (
        files.join(counts, "file", "left")
        .join(parsed.withColumn("_parsed", F.lit(True)), "file", "left")
        .select(
            "file", "type", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("error", "_broken").alias("error"),
            F.when(F.col("type") == "config", F.when(F.col("_parsed"), "structured").otherwise("line_fallback")).alias(
                "config_parser"
            ),
        )
    )
    root = options.root
    if root is None:
        root = enrich.common_root(files).first().root
    found = collect_findings(raw_findings(signals, settings), options, catalog)
    return finish(found, stage(file_status(table, options.item_limit)), options, catalog, root)
