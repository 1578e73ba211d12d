"""Registered queries: every operator of the engine on the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import catalog as CAT
from ..functions import patterns as P, stamps, text as X
from ..operators import auth, baseline as BL, config_tree, detect, enrich, findings as FN, report, rollup, ruletable, sarif
from ..session import stage
from ..sources import classify as C, delimited, discovery, lines as L, settings as S, tables as T
from ..streaming import auth as stream_auth, findings as stream_findings, lines as stream_lines
from . import feeds

Query = Callable[[SparkSession, str], DataFrame]

YEAR = 2026
NOW = datetime(2026, 6, 1, tzinfo=timezone.utc)
ROOT = "/srv/evidence"
SELECTED = ["pci-dss", "gdpr", "nist-csf", "soc2", "iso50001", "tcfd"]
FILE_LIMIT = 40
SCAN_LIMIT = 300
BLOCK = 512
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def long(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


# --- content -------------------------------------------------------------------------


def _cards(items: DataFrame) -> DataFrame:
    line = P.Line(F.col("text"), P.fold(F.col("text")), P.is_ascii(F.col("text")))
    hits = F.filter(P.spans(line, P.PAN), lambda m: detect.card_ok(m["value"]))
    return items.select("file", "item_idx", F.posexplode(hits).alias("nth", "m")).select(
        "file", long("item_idx").alias("line"), long("nth").alias("nth"),
        X.mask_middle(F.col("m.value")).alias("masked"), long("m.start").alias("start"),
    )


@query
def card_numbers(spark, sf_dir):
    return _cards(feeds.document_items(spark, sf_dir))


@query
def page_card_numbers(spark, sf_dir):
    return _cards(feeds.page_items(spark, sf_dir)).drop("start")


def _secret(check_id: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect.signals(feeds.secret_items(spark, sf_dir), year=YEAR, families=("content",))
        return found.filter(F.col("check_id") == check_id).select(
            long("o_orderkey").alias("o_orderkey"), "evidence", "detail", "confidence_score"
        )

    return build


for _name, _check in (
    ("social_security_numbers", "DATA-SSN"), ("medical_record_numbers", "DATA-MRN"), ("private_keys", "SECRET-PRIVKEY"),
    ("cloud_keys", "SECRET-CLOUD-KEY"), ("passwords", "SECRET-PASSWORD"), ("high_entropy_secrets", "SECRET-HIGH-ENTROPY"),
):
    QUERIES[_name] = _secret(_check)


@query
def contact_counts(spark, sf_dir):
    found = detect.signals(feeds.language_items(spark, sf_dir), year=YEAR, families=("contact",))
    return rollup.contact_counts(found).select("file", "kind", long("n").alias("n"), "location", "masked")


@query
def bulk_contacts(spark, sf_dir):
    found = detect.signals(feeds.language_items(spark, sf_dir), year=YEAR, families=("contact",))
    return rollup.bulk_contacts(found, threshold=2).drop("ord")


@query
def masked_values(spark, sf_dir):
    names = feeds.table(spark, sf_dir, "customer")
    mail = F.concat(F.lower("c_mktsegment"), F.lit("@"), F.lower("c_name"), F.lit(".example"))
    return names.select(
        long("c_custkey").alias("c_custkey"), X.mask_middle(F.col("c_name"), 4).alias("name4"),
        X.mask_middle(F.col("c_mktsegment"), 1).alias("segment1"), X.mask_email(mail).alias("mail"),
        X.mask_email(F.col("c_name")).alias("no_mail"),
    )


@query
def entropy_scores(spark, sf_dir):
    value = F.md5(F.col("o_orderkey").cast("string"))
    mixed = F.concat(F.lit("zQ"), F.left(value, F.lit(9)), F.upper(F.substring(value, 10, 9)))
    return feeds.table(spark, sf_dir, "orders").select(
        long("o_orderkey").alias("o_orderkey"), F.round(X.shannon_entropy(value), 6).alias("hex_bits"),
        F.round(X.shannon_entropy(F.col("o_orderpriority")), 6).alias("word_bits"),
        X.looks_high_entropy(value).alias("hex_high"), X.looks_high_entropy(mixed).alias("mixed_high"),
        X.likely_nonsecret(F.lit("token"), F.concat(value, F.left(value, F.lit(8))), F.lit("x")).alias("digest"),
        X.confidence_band(F.col("o_totalprice") / 500_000).alias("band"),
    )


@query
def luhn_valid_keys(spark, sf_dir):
    digits = F.lpad((F.col("o_orderkey") * 7919 + 13).cast("string"), 16, "4")
    return feeds.table(spark, sf_dir, "orders").select(long("o_orderkey").alias("o_orderkey"), X.luhn_ok(digits).alias("ok"))


@query
def content_findings(spark, sf_dir):
    """All content findings of the documents with sanitized evidence."""
    found = detect.signals(feeds.document_items(spark, sf_dir), year=YEAR, families=("content",))
    return found.select("file", "location", "check_id", X.sanitize(F.col("evidence")).alias("evidence"), "detail")


@query
def sanitized_documents(spark, sf_dir):
    """Every line of the documents after one masking pass (which cuts at 500 characters)."""
    items = feeds.document_items(spark, sf_dir)
    return items.select("file", "item_idx", X.sanitize(F.col("text")).alias("text"))


# --- settings -------------------------------------------------------------------------


@query
def config_line_rules(spark, sf_dir):
    found = detect.signals(feeds.config_items(spark, sf_dir), year=YEAR, families=("config",))
    return found.select(long("p_partkey").alias("p_partkey"), "check_id", "detail", "confidence_score")


@query
def config_tree_rules(spark, sf_dir):
    settings = S.flatten_json(feeds.setting_documents(spark, sf_dir))
    return config_tree.settings_findings(settings).select("file", "check_id", "location", "evidence")


@query
def flattened_settings(spark, sf_dir):
    return S.flatten_json(feeds.setting_documents(spark, sf_dir)).select("file", "path", "value", "value_type")


@query
def env_settings(spark, sf_dir):
    return S.read_env(feeds.env_items(spark, sf_dir)).select("file", "path", "value")


@query
def custom_rules(spark, sf_dir):
    """Rules given as rows: two patterns over the lines of the conversations."""
    talk = feeds.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("talk/"), F.col("conv_id").cast("string")).alias("file"), F.lit("note").alias("ftype"),
        "turn", "text",
    )
    rules = [("USER-QUESTION", r"\?", "asks"), ("USER-THE", r"\bthe\b", "says the")]
    found = detect.signals(talk, year=YEAR, families=(), rules=rules)
    return found.select("file", long("turn").alias("turn"), "check_id", "detail")


#: Rules of the rule table.
RULE_WORDS = 1000


@query
def rule_table(spark, sf_dir):
    """A thousand rules from a table, the commonest words of the documents, over all their lines."""
    docs = feeds.table(spark, sf_dir, "documents")
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w")
    often = docs.select(word).groupBy("w").count().orderBy(F.desc("count"), "w").limit(RULE_WORDS)
    rules = often.select(
        F.concat(F.lit("WORD-"), "w").alias("check_id"), F.concat(F.lit(r"\b"), "w", F.lit(r"\b")).alias("pattern"), F.lit("word").alias("detail")
    )
    found = ruletable.rule_signals(feeds.document_items(spark, sf_dir), rules, year=YEAR)
    return found.groupBy("check_id").agg(long(F.count("*")).alias("lines"), long(F.countDistinct("file")).alias("files"))


# --- logs -------------------------------------------------------------------------------


@query
def log_line_rules(spark, sf_dir):
    lines = feeds.log_items(feeds.spread_table(spark, sf_dir, "events"))
    found = detect.signals(lines, year=YEAR, families=("log",))
    return found.filter(F.col("kind") == "finding").select(
        long("event_id").alias("event_id"), "check_id", "confidence_score"
    )


def _logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = feeds.auth_items(feeds.spread_table(spark, sf_dir, "events"))
    return detect.signals(lines, year=YEAR, families=("log",)).filter(F.col("kind") == "auth")


@query
def login_events(spark, sf_dir):
    return _logins(spark, sf_dir).select(
        long("event_id").alias("event_id"), "user", "ip", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        "fail", "success",
    )


@query
def untimed_login_failures(spark, sf_dir):
    return rollup.untimed_failures(_logins(spark, sf_dir), threshold=2).select("file", "detail", long("count").alias("count"))


def _correlated(check_id: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = auth.correlate(stage(_logins(spark, sf_dir)), block=BLOCK)
        return found.filter(F.col("check_id") == check_id).select(
            "file", "location", "detail", long("count").alias("count"), "confidence_score"
        )

    return build


for _name, _check in (
    ("brute_force", "LOG-BRUTEFORCE"), ("success_after_failures", "LOG-FAIL-SUCCESS"), ("password_spraying", "LOG-SPRAY"),
    ("distributed_attack", "LOG-DISTRIBUTED"),
):
    QUERIES[_name] = _correlated(_check)


@query
def log_aggregates(spark, sf_dir):
    """Everything a log gives away beyond single lines."""
    logins = stage(_logins(spark, sf_dir))
    both = auth.correlate(logins, block=BLOCK).unionByName(rollup.untimed_failures(logins))
    return both.groupBy("check_id").agg(long(F.count(F.lit(1))).alias("findings"), long(F.sum("count")).alias("events"))


@query
def syslog_times(spark, sf_dir):
    """Syslog stamps take the given year; a month or day out of range gives none."""
    month = F.element_at(F.array(*[F.lit(m) for m in ("Jan", "Feb", "Sep", "Dec")]), (F.col("event_id") % 4 + 1).cast("int"))
    line = F.concat(
        month, F.lit(" "), F.lpad((F.col("event_id") % 31 + 1).cast("string"), 2, " "), F.lit(" "),
        F.lpad((F.col("event_id") % 26).cast("string"), 2, "0"), F.lit(":05:09 host app: failed login"),
    )
    return feeds.table(spark, sf_dir, "events").select(
        long("event_id").alias("event_id"),
        F.date_format(stamps.timestamp(line, 2025), "yyyy-MM-dd HH:mm:ss").alias("ts"),
    )


# --- findings ----------------------------------------------------------------------------


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FN.merge(feeds.raw_findings(spark, sf_dir))


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings with ranks, fingerprints and confidence."""
    found = FN.limit_per_file(_merged(spark, sf_dir))
    return enrich.with_confidence(enrich.with_fingerprints(found, ROOT))


def _shown(findings: DataFrame, *extra: str) -> DataFrame:
    return findings.select(
        "check_id", "file", "location", "evidence", "detail", long("count").alias("count"), "confidence_score", *extra
    )


@query
def merged_findings(spark, sf_dir):
    return _shown(_merged(spark, sf_dir).withColumn("samples", F.array_join("sample_locations", "; ")), "samples")


@query
def remerged_findings(spark, sf_dir):
    """The merge of findings that were reported before."""
    return _shown(FN.merge_reported(feeds.raw_findings(spark, sf_dir)))


@query
def masked_insertion(spark, sf_dir):
    """The masking pass on insertion, over findings whose evidence holds an address."""
    raw = feeds.raw_findings(spark, sf_dir).withColumn(
        "evidence", F.concat("evidence", F.lit(" by "), F.lower("check_id"), F.lit("@mail.example "))
    )
    return FN.insert(raw).groupBy("evidence").agg(long(F.count(F.lit(1))).alias("n"))


@query
def file_limit(spark, sf_dir):
    return _shown(FN.limit_per_file(_merged(spark, sf_dir), FILE_LIMIT), "pos")


@query
def scan_limit(spark, sf_dir):
    return _shown(FN.limit_per_scan(FN.limit_per_file(_merged(spark, sf_dir), FILE_LIMIT), SCAN_LIMIT))


@query
def fingerprints(spark, sf_dir):
    found = enrich.with_fingerprints(_merged(spark, sf_dir), ROOT)
    return found.select("check_id", "file", "evidence", "detail", "fingerprint", "legacy_fingerprint").distinct()


@query
def common_root(spark, sf_dir):
    return enrich.common_root(feeds.raw_findings(spark, sf_dir).select("file"))


# --- catalog -----------------------------------------------------------------------------


@query
def relevant_findings(spark, sf_dir):
    catalog = CAT.tables(spark)
    found = enrich.keep_relevant(feeds.raw_findings(spark, sf_dir), catalog, ["ccpa", "sox"])
    return found.groupBy("check_id").agg(long(F.count(F.lit(1))).alias("n"))


@query
def finding_attributes(spark, sf_dir):
    found = enrich.with_check(feeds.raw_findings(spark, sf_dir), CAT.tables(spark))
    return found.groupBy("check_id", "title", "severity", "category").agg(
        long(F.count(F.lit(1))).alias("n"), long(F.min("rank")).alias("rank")
    )


@query
def control_expansion(spark, sf_dir):
    found = enrich.explode_controls(feeds.raw_findings(spark, sf_dir), CAT.tables(spark), SELECTED)
    return found.groupBy("framework", "control").agg(
        long(F.count(F.lit(1))).alias("findings"), long(F.sum("count")).alias("occurrences")
    )


@query
def mapping_provenance(spark, sf_dir):
    """Provenance of every mapping of the checks that occur."""
    seen = feeds.raw_findings(spark, sf_dir).select("check_id").distinct()
    return enrich.provenance(CAT.tables(spark)).join(seen, "check_id", "left_semi").withColumn("pos", long("pos"))


@query
def finding_mappings(spark, sf_dir):
    found = enrich.with_mappings(feeds.raw_findings(spark, sf_dir).select("check_id", "file"), CAT.tables(spark), SELECTED)
    return found.select("file", "check_id", F.explode("mappings").alias("framework", "controls")).groupBy(
        "check_id", "framework"
    ).agg(F.max(F.array_join("controls", "; ")).alias("controls"), long(F.count(F.lit(1))).alias("n"))


@query
def framework_list(spark, sf_dir):
    """Frameworks with the number of findings of the given tables their checks cover."""
    catalog = CAT.tables(spark)
    per_check = feeds.raw_findings(spark, sf_dir).groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))
    covered = catalog.coverage.join(per_check, "check_id").groupBy("framework").agg(F.sum("n").alias("n"))
    return (
        CAT.list_frameworks(catalog)
        .join(covered, F.col("framework") == F.col("id"), "left")
        .select("id", "name", "long", long(F.coalesce("n", F.lit(0))).alias("findings"))
    )


@query
def check_list(spark, sf_dir):
    """Checks with their frameworks and the number of findings of the given tables."""
    per_check = feeds.raw_findings(spark, sf_dir).groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))
    listed = CAT.list_checks(CAT.tables(spark)).withColumn("frameworks", F.array_join("frameworks", ", "))
    return listed.join(per_check, "check_id", "left").select(
        "severity", "check_id", "title", "frameworks", long(F.coalesce("n", F.lit(0))).alias("findings")
    )


@query
def uncovered_frameworks(spark, sf_dir):
    """Frameworks none of the findings bear on."""
    catalog = CAT.tables(spark)
    seen = feeds.raw_findings(spark, sf_dir).select("check_id").distinct()
    touched = catalog.coverage.join(seen, "check_id", "left_semi").select(F.col("framework").alias("id"))
    never = CAT.uncovered_frameworks(catalog).withColumn("covered", F.lit(False))
    return catalog.frameworks.join(touched, "id", "left_anti").join(never.select("id", "covered"), "id", "left").select(
        "id", F.coalesce("covered", F.lit(True)).alias("has_checks")
    )


# --- baseline ------------------------------------------------------------------------------

EXPIRES = "CASE length(evidence) % 4 WHEN 0 THEN '2026-01-01T00:00:00Z' WHEN 1 THEN '2027-01-01T00:00:00+02:00' " \
          "WHEN 2 THEN '' ELSE '2027-01-01' END"
ACCEPTED = "length(check_id) % 2 = 0"
ACCEPTED_BY_NAME = "length(check_id) % 5 = 0"


def baseline_rows(findings: DataFrame) -> DataFrame:
    """A baseline made of some of the findings; part of it knows only the old, name-based id."""
    by_path = findings.filter(ACCEPTED).select("fingerprint", F.expr(EXPIRES).alias("expires"))
    by_name = findings.filter(ACCEPTED_BY_NAME).select(
        F.col("legacy_fingerprint").alias("fingerprint"), F.lit(None).cast("string").alias("expires")
    )
    return (
        by_path.withColumn("pos", F.lit(1)).unionByName(by_name.withColumn("pos", F.lit(0)))
        .groupBy("fingerprint").agg(F.max_by("expires", F.struct("pos", F.coalesce("expires", F.lit("")))).alias("expires"))
    )


@query
def baseline_split(spark, sf_dir):
    found = _reported(spark, sf_dir)
    marked = BL.apply_baseline(found, baseline_rows(found), NOW)
    return marked.select("check_id", "file", "evidence", "detail", "pos", "suppressed", "expired_suppression")


@query
def baseline_entries(spark, sf_dir):
    return BL.baseline_entries(_reported(spark, sf_dir), NOW, ROOT)


@query
def baseline_latest(spark, sf_dir):
    """The last entry of each fingerprint, over entries made of the orders."""
    rows = feeds.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 50 == 0, "").otherwise(F.concat(F.lit("fp"), (F.col("o_custkey") % 400).cast("string"))).alias("fingerprint"),
        F.col("o_orderpriority").alias("reason"), F.col("o_orderkey").alias("pos"),
    )
    return BL.latest_entries(rows)


# --- sinks and report -------------------------------------------------------------------------


@query
def sarif_rules(spark, sf_dir):
    rules = sarif.rules(_reported(spark, sf_dir), CAT.tables(spark), ["gdpr", "soc2"])
    return rules.drop("first_seen")


@query
def sarif_results(spark, sf_dir):
    rows = sarif.results(_reported(spark, sf_dir), CAT.tables(spark), ROOT)
    return rows.select(
        "rule_id", "level", "message", "uri", "start_line", "fingerprint", "confidence", "confidence_score",
        long("occurrence_count").alias("occurrence_count"),
    )


#: Rows of a SARIF or baseline document.
DOCUMENT_ROWS = 1000
SARIF_SHAPE = (
    "version string, runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,"
    "results:array<struct<ruleId:string,properties:struct<occurrenceCount:bigint>>>>>"
)


@query
def sarif_document(spark, sf_dir):
    """SARIF documents of all findings, read back: by document the place, results and occurrences of each rule."""
    texts = sarif.documents(_reported(spark, sf_dir), CAT.tables(spark), SELECTED, ROOT, per_document=DOCUMENT_ROWS)
    run = texts.select("shard", F.from_json("value", SARIF_SHAPE).alias("d")).select("shard", "d.version", F.col("d.runs")[0].alias("run"))
    rules = F.transform("run.tool.driver.rules", lambda r: r["id"])
    results = run.select("shard", "version", rules.alias("rules"), F.inline("run.results"))
    return results.groupBy("shard", "version", "ruleId").agg(
        long(F.max(F.array_position("rules", F.col("ruleId")))).alias("place"), long(F.count(F.lit(1))).alias("results"),
        long(F.sum("properties.occurrenceCount")).alias("occurrences"),
    )


@query
def baseline_documents(spark, sf_dir):
    """Baseline documents of all findings, written and read back by the reader of baselines."""
    folder = stream_lines.work_folder(spark)
    entries = BL.baseline_entries(_reported(spark, sf_dir), NOW, ROOT)
    BL.baseline_documents(entries, NOW, DOCUMENT_ROWS).write.partitionBy("shard").text(folder)
    return BL.read_baseline(spark, folder).select("fingerprint", "check", "file", "evidence", "created")


@query
def severity_counts(spark, sf_dir):
    counts = report.severity_counts(feeds.raw_findings(spark, sf_dir), CAT.tables(spark))
    return counts.select("severity", long("rank").alias("rank"), long("findings").alias("findings"))


@query
def framework_impact(spark, sf_dir):
    return report.framework_impact(feeds.raw_findings(spark, sf_dir), CAT.tables(spark), SELECTED)


@query
def top_controls(spark, sf_dir):
    found = report.top_controls(FN.rank_in_file(_merged(spark, sf_dir)), CAT.tables(spark), SELECTED)
    return found.select("framework", long("place").alias("place"), "control", long("findings").alias("findings"))


@query
def finding_groups(spark, sf_dir):
    found = _reported(spark, sf_dir).withColumn("expired_suppression", F.col("count") > 5)
    return report.finding_groups(found, CAT.tables(spark)).select(
        long("rank").alias("rank"), "check_id", "file", long("findings").alias("findings"),
        long("occurrences").alias("occurrences"), "confidence", "expired_suppression",
    )


@query
def evidence_bands(spark, sf_dir):
    return report.evidence_bands(_reported(spark, sf_dir), shown=1, listed=3).select(
        "check_id", "file", "band", long("place").alias("place"), long("n").alias("n"), "location", "evidence"
    )


@query
def suppressed_list(spark, sf_dir):
    """The report's list of what a baseline suppressed."""
    found = _reported(spark, sf_dir)
    marked = BL.apply_baseline(found, baseline_rows(found), NOW)
    return report.suppressed_list(marked.filter("suppressed"))


@query
def severity_gate(spark, sf_dir):
    """The gate at each severity, over all findings."""
    catalog = CAT.tables(spark)
    found = feeds.raw_findings(spark, sf_dir)
    gates = None
    for severity in CAT.SEVERITY_RANK:
        row = report.gate(found, catalog, severity).withColumn("fail_on", F.lit(severity))
        gates = row if gates is None else gates.unionByName(row)
    return gates


ITEM_LIMIT = 12


def _document_files(spark: SparkSession, sf_dir: str, limit: int | None) -> DataFrame:
    from .scan import file_status

    items = feeds.document_items(spark, sf_dir)
    counts = items.groupBy("file", F.col("ftype").alias("type")).agg(F.max("item_idx").alias("items"))
    return file_status(counts.withColumn("config_parser", F.lit(None).cast("string")), limit)


@query
def file_coverage(spark, sf_dir):
    files = _document_files(spark, sf_dir, ITEM_LIMIT)
    return report.coverage_counts(files).select("status", long("files").alias("files"))


@query
def file_table(spark, sf_dir):
    files = _document_files(spark, sf_dir, None)
    found = detect.signals(feeds.document_items(spark, sf_dir), year=YEAR, families=("contact",))
    return report.file_table(files, found).select(
        "file", "type", "lines", "truncated", "status", long("findings").alias("findings")
    )


@query
def omission_totals(spark, sf_dir):
    limited = FN.limit_per_scan(FN.limit_per_file(_merged(spark, sf_dir), FILE_LIMIT), SCAN_LIMIT)
    over = limited.filter(F.col("location") == FN.FILE_LIMIT_TEXT[0])
    files = over.groupBy("file").agg(F.sum("count").alias("distinct_findings_omitted"))
    totals = report.omission_totals(files, limited)
    return totals.select(*[long(c).alias(c) for c in totals.columns])


# --- sources -----------------------------------------------------------------------------------


@query
def table_cells(spark, sf_dir):
    nation = feeds.table(spark, sf_dir, "nation")
    row = F.col("n_nationkey") + 1
    return T.table_items(nation, "nation.parquet", row).select("file", long("item_idx").alias("item_idx"), "location", "text")


@query
def parquet_cells(spark, sf_dir):
    """Cells of whole Parquet files, counted by column."""
    items = T.read_parquet_items(spark, [f"{sf_dir}/supplier.parquet"])
    name = F.regexp_extract("location", r"^row \d+, (.*)$", 1)
    return items.groupBy(name.alias("column")).agg(
        long(F.count(F.lit(1))).alias("cells"), long(F.max("item_idx")).alias("last")
    )


@query
def item_numbers(spark, sf_dir):
    """Dense item numbers where every third cell is empty."""
    table = feeds.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("a"),
        F.col("o_orderpriority").alias("b"),
    )
    items = T.table_items(table, "orders", F.col("k") + 1, ["a", "b"])
    return T.renumber(items).select(long("item_idx").alias("item_idx"), "location", "text")


NAME_ENDINGS = (
    ".log", ".CONF", ".json.gz", ".csv", ".tsv", ".xlsx", ".xls", ".ods", ".pdf", ".parquet", ".pq", ".evtx", ".txt",
    ".md", "", ".env", ".log.gz", "-changelog.md", "blog.html", ".yaml", ".sql", ".syslog", ".tar.gz",
)


@query
def file_types(spark, sf_dir):
    pages = feeds.table(spark, sf_dir, "pages")
    ending = F.element_at(
        F.array(*[F.lit(e) for e in NAME_ENDINGS]), (F.col("page_id") % len(NAME_ENDINGS) + 1).cast("int")
    )
    path = F.concat(F.lit("in/p"), F.col("page_id").cast("string"), ending)
    return pages.select(path.alias("path"), C.classify(path).alias("type"), C.is_supported(path).alias("supported"))


def _written(rows: DataFrame, kind: str) -> str:
    """Write derived data as files, in order of its first column, and give the folder."""
    folder = f"{stream_lines.work_folder(rows.sparkSession)}/data"
    key = rows.columns[0]
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key)
    (ordered.drop(key) if kind == "text" else ordered).write.format(kind).save(folder)
    return folder


@query
def numbered_lines(spark, sf_dir):
    """Line numbers of text files made of the orders, checked against the order they were written in."""
    orders = feeds.table(spark, sf_dir, "orders")
    folder = _written(orders.select("o_orderkey", F.concat(F.lit("order "), "o_orderkey").alias("value")), "text")
    files = discovery.list_files(spark, [folder])
    lines = L.read_lines(spark, discovery.names(files, "text"), "text")
    found = lines.select("path", "block", "row", F.struct("row", F.split("text", " ")[1].cast("bigint").alias("k")).alias("found"))
    numbered = L.numbered_lines(L.block_counts(found))
    first = numbered.groupBy("file").agg(F.min("k").alias("k0"), F.max("item_idx").alias("n"))
    # Keys are dense, so a line's key tells its place in the file.
    return numbered.join(first, "file").agg(
        long(F.count(F.lit(1))).alias("lines"), long(F.count_if(F.col("item_idx") != F.col("k") - F.col("k0") + 1)).alias("wrong")
    )


@query
def csv_cells(spark, sf_dir):
    """Cells of CSV files made of the orders, by column name: quotes within cells, cells over lines, short and long records."""
    files = discovery.list_files(spark, [feeds.csv_folder(spark, sf_dir)])
    found = None
    for source in delimited.read_csv_items(spark, files):
        hit = F.when(F.col("cell").isNotNull(), F.struct("row", "cell", "nth", "text")).alias("found")
        blocks = L.block_counts(source.items.select("path", "block", "row", "cell", "error", hit))
        cells = delimited.place_cells(blocks, source)
        name = F.regexp_extract("location", r"^row \d+, (.*)$", 1)
        part = cells.select(name.alias("column"), "text", F.regexp_extract("location", r"^row (\d+)", 1).cast("bigint").alias("r"))
        found = part if found is None else found.unionByName(part)
    texts = found.groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"))
    return texts.groupBy("column").agg(
        long(F.sum("n")).alias("cells"), long(F.count("text")).alias("texts"), F.max("text").alias("last"), long(F.sum("r")).alias("rows")
    )


@query
def folder_scan(spark, sf_dir):
    """Full scan of text files made of the events."""
    from .scan import Options, scan

    lines = feeds.log_items(feeds.table(spark, sf_dir, "events"))
    folder = _written(lines.select("event_id", F.col("text").alias("value")), "text")
    result = scan(spark, [folder], Options(now=NOW, year=YEAR))
    return result.findings.groupBy("check_id", "severity").agg(long(F.sum("count")).alias("occurrences"))


@query
def mixed_folder_scan(spark, sf_dir):
    """Full scan of files of several kinds made of the events: statuses, items and occurrences by kind.

    Broken files are told of and the others searched; Parquet files differ in the type of a column.
    """
    from .scan import Options, scan

    result = scan(spark, [feeds.mixed_folder(spark, sf_dir)], Options(now=NOW, year=YEAR))
    kind = F.regexp_extract("file", r"-([^-]*)$", 1).alias("kind")
    found = result.findings.groupBy("file").agg(F.sum("count").alias("n"))
    return result.files.join(found, "file", "left").groupBy(kind, "status", F.col("error").isNotNull().alias("failed")).agg(
        long(F.count("*")).alias("files"), long(F.sum("lines")).alias("items"), long(F.coalesce(F.sum("n"), F.lit(0))).alias("occurrences")
    )


# --- whole scans ---------------------------------------------------------------------------------


@query
def document_scan(spark, sf_dir):
    """Full scan of the documents: findings by check and severity."""
    from .scan import Options, scan_items

    result = scan_items(feeds.document_items(spark, sf_dir), Options(now=NOW, year=YEAR))
    return result.findings.groupBy("check_id", "severity").agg(
        long(F.countDistinct("file")).alias("files"), long(F.sum("count")).alias("occurrences")
    )


@query
def table_scan(spark, sf_dir):
    """Full scan of the cells of the page table."""
    from .scan import Options, scan_items

    items = T.read_parquet_items(spark, [f"{sf_dir}/pages.parquet"]).withColumn("file", F.lit("pages.parquet"))
    result = scan_items(items, Options(now=NOW, year=YEAR, item_limit=None))
    return result.findings.groupBy("file", "check_id").agg(long(F.sum("count")).alias("occurrences"))


@query
def rule_scan(spark, sf_dir):
    """Custom rules through a whole scan: relevance, merge, catalog and mappings."""
    from .scan import Options, scan_items

    talk = feeds.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("talk/"), F.col("conv_id").cast("string")).alias("file"), F.lit("note").alias("ftype"),
        F.col("turn").cast("bigint").alias("item_idx"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("location"), "text",
    )
    rules = [("USER-QUESTION", r"\?", "asks"), ("USER-THE", r"\bthe\b", "says the")]
    found = scan_items(talk, Options(frameworks=["gdpr"], now=NOW, year=YEAR, rules=rules)).findings
    own = found.filter(F.col("check_id").startswith("USER-"))
    return own.groupBy("file", "check_id", "severity", "title", "category").agg(long(F.sum("count")).alias("occurrences"))


@query
def upload_scan(spark, sf_dir):
    """Scan of uploads: documents as base64 texts whose names repeat."""
    from .payload import scan_uploads
    from .scan import Options

    uploads = feeds.spread_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("../up/note?"), (F.col("doc_id") % 50).cast("string"), F.lit(".txt")).alias("name"),
        F.base64(F.encode("text", "UTF-8")).alias("data"), F.col("doc_id").alias("ord"),
    )
    result = scan_uploads(uploads, Options(now=NOW, year=YEAR))
    return result.findings.groupBy("file", "check_id").agg(long(F.sum("count")).alias("occurrences"))


# --- streams ----------------------------------------------------------------------------------------


@query
def stream_line_rules(spark, sf_dir):
    """Log line rules on the event table as a stream."""
    lines = feeds.log_items(feeds.event_stream(spark, sf_dir))
    found = stream_lines.line_signals(lines, year=YEAR, families=("log",)).filter(F.col("kind") == "finding")
    return stream_lines.run_available(found.select(long("event_id").alias("event_id"), "check_id", "confidence_score"))


@query
def stream_document_findings(spark, sf_dir):
    """All rule families on the documents as a stream: merged evidence and contacts kept as state, findings by check."""
    docs = feeds.table_stream(spark, sf_dir, "documents")
    state = stream_findings.merged_signals(feeds.text_items(docs), year=YEAR)
    found = stream_findings.findings(stream_findings.latest(stream_lines.run_available(state, mode="update")))
    return enrich.with_check(found, CAT.tables(spark)).groupBy("check_id", "severity").agg(
        long(F.countDistinct("file")).alias("files"), long(F.sum("count")).alias("occurrences")
    )


def _login_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = feeds.auth_items(feeds.event_stream(spark, sf_dir))
    return stream_lines.line_signals(lines, year=YEAR, families=("log",)).filter(F.col("kind") == "auth")


@query
def stream_login_correlation(spark, sf_dir):
    found = stream_lines.run_available(stream_auth.correlate(_login_stream(spark, sf_dir)))
    return found.select("file", "check_id", "location", "detail", "count", "confidence_score")


@query
def stream_login_alerts(spark, sf_dir):
    """Accounts and addresses with a burst of failures, each told of once."""
    alerts = stream_auth.burst_alerts(_login_stream(spark, sf_dir))
    return stream_lines.run_available(alerts.select("file", "key_type", "key"))


@query
def stream_login_windows(spark, sf_dir):
    """Sliding failure counts; of the updates of a window the last is taken."""
    counted = stream_auth.sliding_failures(_login_stream(spark, sf_dir))
    updates = stream_lines.run_available(counted.drop("w"), mode="update")
    latest = updates.groupBy("file", "key_type", "key", "window_start").agg(F.max("failures").alias("failures"))
    return latest.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
