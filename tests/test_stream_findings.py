from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.operators import detect, findings as FN, rollup
from sievelight.plans import feeds
from sievelight.plans.queries import QUERIES
from sievelight.plans.scan import raw_findings
from sievelight.streaming import findings as stream_findings, lines as stream_lines

TEXTS = [
    "card 4111 1111 1111 1111", "mail a@x.org and b@x.org", "password=Hunter2xyz", "debug = on", "useradd bob", "call 555.123.4567",
    "nothing", "a@x.org again, c@x.org", "card 4111 1111 1111 1111", "verify_ssl=false", "555-123-4567 or (555) 222-3333", "555-444-3333", "debug = on",
]


def told(df):
    return sorted((r.check_id, r.file, r.location, r.evidence, r.detail, r["count"], r.confidence_score) for r in df.collect())


def test_a_stream_in_parts_gives_what_a_batch_gives(spark, make_items, tmp_path):
    items = None
    for file, texts in (("a.txt", TEXTS), ("b.txt", TEXTS[4:] + TEXTS[:6]), ("c.txt", ["no one"])):
        one = make_items(texts, file=file)
        items = one if items is None else items.unionByName(one)
    source = str(tmp_path / "in")
    for part in range(4):  # files of the stream; a file's lines are dealt over all of them
        items.filter(F.col("item_idx") % 4 == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(source)
    updates = stream_lines.run_available(stream_findings.merged_signals(stream, year=2026), mode="update")
    assert updates.count() > stream_findings.latest(updates).count()
    got = stream_findings.findings(stream_findings.latest(updates))
    batch = FN.merge(FN.insert(raw_findings(detect.signals(items, year=2026))))
    assert told(got) == told(batch) and any(r[0] == "DATA-PII-EMAIL" for r in told(got))
    assert rollup.BULK_THRESHOLD == 3


def test_a_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path):
    rows = [(i, f"card 4111 1111 1111 1111\nmail a{i}@x.org", "en", "web", 40) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, parts in (("folder", 4), ("none", 1)):
        docs.filter(F.lit(name != "none")).repartition(parts).write.parquet(str(tmp_path / name / "documents.parquet"))
    (tmp_path / "file").mkdir()
    docs.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    told = {n: QUERIES["stream_document_findings"](spark, str(tmp_path / n)).collect() for n in ("file", "folder", "none")}
    assert told["file"] == told["folder"] and [r.occurrences for r in told["file"]] == [8] and told["none"] == []
    assert feeds.table_stream(spark, str(tmp_path / "folder"), "documents").isStreaming
