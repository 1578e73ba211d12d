from __future__ import annotations

import base64
import csv
import gzip
import io
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sievelight.functions import text as X
from sievelight.plans import scan as SC
from sievelight.plans.payload import name_uploads, scan_uploads
from sievelight.sources import classify as C, delimited, discovery, hidden, lines as L, settings as S, tables

NOW = datetime(2026, 10, 1, tzinfo=timezone.utc)


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def failures(n, step):
    clock = lambda s: f"{8 + s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}"
    return "".join(f"2026-02-11T{clock(i * step)} sshd: invalid user; failed password for root7 from 192.168.7.9 port {i}\n" for i in range(n))


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("evidence")
    put(folder, "safe.conf", "# proxy\nssl_verify: on\ninsecure_skip_verify = no\n")
    put(folder, "nested.json", json.dumps({"edge": [{"pool": {"ssl-verify": "off"}}]}))
    put(folder, "broken.json", "{ 'edge':\nssl_verify: off\n")
    put(folder, "bad.conf", "[pool]\ninsecure-skip-verify: yes\n")
    put(folder, "spaced.log", failures(6, 900))
    put(folder, "burst.log", failures(6, 4))
    put(folder, "untimed.log", "gate: failed password for root7\n" * 5)
    put(folder, "audit.log", "groupadd staff\nuseradd -m carol\nsudo: carol : user NOT in sudoers ; pwd: Tr0ub4dor9x\n")
    put(folder, "cards.txt", "5500 0000 0000 0004\r\n5500 0000 0000 0005\r\n")
    put(folder, "my [odd]*name.txt", "x\n4111 1111 1111 1111")
    put(folder, "app/service.json", '{"security":{"verify_ssl":false,"mfa_enabled":false,"debug":true}}')
    put(folder, "app/service.toml", "[security]\nverify_ssl = false\nmfa_enabled = false\ndebug = true\n")
    put(folder, "app/service.ini", "[security]\nverify_ssl = false\nmfa_enabled = false\ndebug = true\n")
    put(folder, "app/.env", "VERIFY_SSL=false\nMFA_ENABLED=false\nDEBUG=true\n# NOTE=1\n")
    put(folder, "app/service.yaml", "security:\n  verify_ssl: false\n  mfa_enabled: false\n")
    put(folder, "old/app.log.gz", gzip.compress(b"a\nuseradd carol\n"))
    put(folder, "people.csv", 'name,mail\na,a@x.com\n"b\nb",b@x.com\nc,c@x.com\n')
    put(folder, "plain.csv", "id;card\n1;4111 1111 1111 1111\n")
    put(folder, "sheet.xlsx", "not read")
    put(folder, "empty.txt", "")
    put(folder, "picture.png", "useradd x")
    spark.createDataFrame([(1, "4111 1111 1111 1111", True), (2, None, False)], "id int, card string, ok boolean").coalesce(
        1
    ).write.parquet(str(folder / "table"))
    result = SC.scan(spark, [str(folder)], SC.Options(now=NOW))
    found: dict[str, list] = {}
    for r in result.findings.collect():
        found.setdefault(r.file[len(str(folder)) + 1 :], []).append(r)
    files = {r.file[len(str(folder)) + 1 :]: r for r in result.files.collect()}
    return found, files, result


def ids(found, name):
    return {r.check_id for r in found.get(name, [])}


def test_safe_values_do_not_fire(scanned):
    found, *_ = scanned
    assert ids(found, "safe.conf") == set()
    assert ids(found, "nested.json") == {"CFG-TLS-VERIFY-OFF"}
    assert ids(found, "bad.conf") == {"CFG-TLS-VERIFY-OFF"}


def test_time_windows(scanned):
    found, *_ = scanned
    assert "LOG-BRUTEFORCE" not in ids(found, "spaced.log")
    assert {r.confidence for r in found["burst.log"]} == {"high"}
    assert {(r.check_id, r.confidence, r["count"]) for r in found["untimed.log"]} == {("LOG-BRUTEFORCE", "low", 5)}


def test_changes_refusals_and_masking(scanned):
    found, *_ = scanned
    assert {"LOG-PRIV-CHANGE", "LOG-PRIV-FAIL"} <= ids(found, "audit.log")
    assert "LOG-PRIV-ESC" not in ids(found, "audit.log")
    assert all("Tr0ub4dor9x" not in str(r.asDict(True)) for r in found["audit.log"])


def test_coverage_and_luhn(scanned):
    found, files, _ = scanned
    assert [r.location for r in found["cards.txt"]] == ["line 1"]
    assert files["cards.txt"].status == "fully_scanned" and files["cards.txt"].lines == 2
    assert "5500 0000 0000 0004" not in str(found)
    assert [r.location for r in found["my [odd]*name.txt"]] == ["line 2"]
    assert (files["empty.txt"].lines, files["empty.txt"].status) == (0, "fully_scanned")
    assert files["sheet.xlsx"].status == "unable_to_evaluate"
    assert "picture.png" not in files


def test_settings_formats_and_fallback(scanned):
    found, files, _ = scanned
    for name in ("app/service.json", "app/service.toml", "app/service.ini", "app/.env"):
        assert files[name].config_parser == "structured", name
        assert ids(found, name) == {"CFG-TLS-VERIFY-OFF", "CFG-MFA-OFF", "CFG-DEBUG"}, name
    assert "CFG-TLS-VERIFY-OFF" in ids(found, "app/service.yaml")
    assert files["broken.json"].config_parser == "line_fallback"
    assert ids(found, "broken.json") == {"CFG-TLS-VERIFY-OFF"}


def test_compressed_csv_and_parquet(scanned):
    found, files, _ = scanned
    assert [(r.check_id, r.location) for r in found["old/app.log.gz"]] == [("LOG-PRIV-CHANGE", "line 2")]
    assert [(r.check_id, r.location, r["count"]) for r in found["people.csv"]] == [("DATA-PII-EMAIL", "row 2, mail", 3)]
    assert files["people.csv"].lines == 8
    assert [r.location for r in found["plain.csv"]] == ["row 2, card"]
    (table,) = [n for n in found if n.startswith("table/")]
    assert [r.location for r in found[table]] == ["row 1, card"]
    assert files[table].lines == 5


def test_result_columns(scanned):
    found, _, result = scanned
    row = found["cards.txt"][0]
    assert row.mappings["pci-dss"] == ["Req 3.4.1", "Req 3.5.1"]
    assert row.mapping_provenance["nist-csf"]["PR.DS-01"].review_status == "source_reviewed"
    assert row.mapping_provenance["pci-dss"]["Req 3.4.1"].reviewed_on is None
    assert row.fingerprint == model_fingerprint("DATA-PAN", "cards.txt", row.evidence)
    assert result.root and not result.root.endswith("/")


def model_fingerprint(check, path, evidence):
    import hashlib

    return hashlib.sha256(f"{check}|{path}|{evidence}".encode()).hexdigest()[:16]


def test_limits_and_named_files(spark, tmp_path):
    path = put(tmp_path, "data.bin", "".join(f"4111 1111 1111 1111 item {i}\n" for i in range(30)))
    with pytest.warns(UserWarning, match="not found"):
        result = SC.scan(spark, [path, str(tmp_path / "gone")], SC.Options(now=NOW, item_limit=10, file_limit=4))
    rows = result.findings.orderBy("pos").collect()
    assert [r["count"] for r in rows] == [1, 1, 1, 1, 6]
    meta = result.files.first()
    assert (meta.type, meta.lines, meta.truncated, meta.status, meta.distinct_findings_omitted) == (
        "text", 10, True, "partially_scanned", 6,
    )


def test_no_input(spark, tmp_path):
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        SC.scan(spark, [str(tmp_path / "none")])


def test_spellings_of_a_folder(spark, tmp_path):
    put(tmp_path, "a.txt", "4111 1111 1111 1111\n")
    put(tmp_path, ".env", "DEBUG=true\n")
    put(tmp_path, "c.csv", "k,v\n1,4111 1111 1111 1111\n")
    assert {L.as_uri(lead + str(tmp_path)) for lead in ("", "file:", "file://")} == {"file://" + str(tmp_path)}
    found = SC.scan(spark, ["file:" + str(tmp_path)], SC.Options(now=NOW)).findings.collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.check_id) for r in found) == [
        (".env", "CFG-DEBUG"), ("a.txt", "DATA-PAN"), ("c.csv", "DATA-PAN"),
    ]


def test_baseline_in_a_scan(spark, make_items):
    items = make_items(["4111 1111 1111 1111", "378282246310005"], file="a/b.txt")
    first = SC.scan_items(items, SC.Options(now=NOW)).findings
    one = first.filter("location = 'line 1'").select("fingerprint", F.lit(None).cast("string").alias("expires"))
    again = SC.scan_items(items, SC.Options(now=NOW, baseline=one))
    assert [r.location for r in again.findings.collect()] == ["line 2"]
    assert [r.location for r in again.suppressed.collect()] == ["line 1"]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield set_to
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_numbers_over_many_blocks(spark, tmp_path, small_splits):
    paths = [put(tmp_path, f"big{k}.txt", "".join(f"line {k} {i} {'x' * (i % 50)}\n" for i in range(1, 20_001))) for k in (1, 2)]
    small_splits(20_000)
    lines = L.read_lines(spark, ["file://" + p for p in paths], "text")
    assert lines.select("path", "block").distinct().count() > 40
    third = F.when(F.split("text", " ")[2].cast("int") % 3 == 0, F.struct("row", "text")).alias("found")
    blocks = L.block_counts(lines.select("path", "block", "row", third))
    got = L.numbered_lines(blocks)
    assert got.count() == 2 * 6666 and got.filter(F.col("item_idx").cast("string") != F.split("text", " ")[2]).isEmpty()
    assert sorted(r["items"] for r in L.file_counts(blocks).collect()) == [20_000, 20_000]


def test_lines_are_read_once(spark, tmp_path):
    from sievelight.operators import detect

    path = put(tmp_path, "a.log", "x\n" * 50 + "useradd bob\n")
    searched = detect.signals(L.read_lines(spark, ["file://" + path], "log"), year=2026, inside=("row", "ftype"))
    counted = searched.groupBy("path", "block").agg(F.min("row"), F.max("row"), F.collect_list("found"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    (row,) = L.numbered_lines(L.block_counts(searched)).collect()
    assert (row.location, row.check_id) == ("line 51", "LOG-PRIV-CHANGE")


CSV_TEXTS = {
    "a.csv": 'id,name\n1,"x, ""y"""\n2,\n,z\n', "b.csv": "a;b;c\n1;2;3\n4;5\n6;7;8;9\n", "c.tsv": "one\ttwo\n1\t\n\n3\t4\n",
    "d.csv": 'k,v\n1,"two\nlines"\n2,"three\n\nmore"\n3,x\n', "e.csv": "only\nvalues\n", "f.csv": "a|b\n1|2\n",
    "stray.csv": 'k,v,w\n1,5" pipe,4111111111111111\n2,6",b\n3,"c, d",e\n4,x"y"z,"f" g\n',
    "both.csv": 'k,v,w\n1,5" pipe,a\n2,"open\nin 6"" pipe, \nend",b\n3,7",c\n4,"x""",d\n5,"y"" ""\n",e\n6,only\n7,a,b,c,"d\n"\n',
    "heads.csv": '"first\nname",b\n1,2\n"3\n4",5\n',
}


def test_csv_like_the_standard_reader(spark, tmp_path):
    for name, text in CSV_TEXTS.items():
        put(tmp_path, name, text)
    files = discovery.list_files(spark, [str(tmp_path)])
    got: dict[str, list] = {n: [] for n in CSV_TEXTS}
    for source in delimited.read_csv_items(spark, files):
        hit = F.when(F.col("cell").isNotNull(), F.struct("row", "cell", "nth", "text")).alias("found")
        blocks = L.block_counts(source.items.select("path", "block", "row", "cell", "error", hit))
        for r in delimited.place_cells(blocks, source).orderBy("item_idx").collect():
            got[r.file.rsplit("/", 1)[1]].append((r.location, r.text))
    for name, text in CSV_TEXTS.items():
        d = delimited.guess_dialect(name, text)
        want, header = [], []
        reader = csv.reader(io.StringIO(text, newline=""), delimiter=d.delimiter, quotechar=d.quote, skipinitialspace=d.skip_space)
        for r, record in enumerate(reader, 1):
            header = record if r == 1 else header
            for c, cell in enumerate(record):
                if cell:
                    label = header[c] if r > 1 and c < len(header) and header[c] else f"col {c + 1}"
                    want.append((f"row {r}, {label}", cell))
        assert got[name] == want, name


def csv_lines(spark, path):
    return spark.read.text("file://" + path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"),
    )


def test_records_over_many_blocks(spark, tmp_path, small_splits):
    """Blocks that begin and end anywhere in records, with quotes that open nothing in between."""
    text = "k,v,w\n" + "".join(f'{i},"first {i}\n5"" wide\nsecond, {i}",{i % 7}" pipe\n' for i in range(3000))
    path = put(tmp_path, "x.csv", text)
    small_splits(5000)
    lines = csv_lines(spark, path)
    assert lines.select("block").distinct().count() > 20
    rows = delimited.record_texts(delimited.join_records(lines, delimited.Dialect(",", '"', False))).orderBy("record").collect()
    assert [r.record for r in rows] == list(range(1, 3002))
    assert all(r.text == f'{i},"first {i}\n5"" wide\nsecond, {i}",{i % 7}" pipe' for i, r in enumerate(rows[1:]))


@pytest.mark.parametrize("skip_space", [False, True])
def test_line_effects_like_the_standard_reader(spark, skip_space):
    """Whether a line ends inside a quoted cell, from both states, against the reader's own line count."""
    import random

    rng = random.Random(7)
    texts = sorted({"".join(rng.choice('",, a"') for _ in range(rng.randint(0, 9))) for _ in range(1500)})
    d = delimited.Dialect(",", '"', skip_space)
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", *[delimited.ends_inside(F.col("text"), d, s).alias(str(s)) for s in (False, True)]
    )

    def goes_on(lines):
        reader = csv.reader(iter([*lines, "end\n"]), skipinitialspace=skip_space)
        while reader.line_num < len(lines):
            next(reader)
        return reader.line_num > len(lines)

    for r in df.collect():
        assert r["False"] == goes_on([r.text + "\n"]), r.text
        assert r["True"] == goes_on(['"\n', r.text + "\n"]), r.text


def test_a_quote_never_closed_throws_nothing_away(spark, tmp_path):
    put(tmp_path, "q.csv", 'k,v\n1,4111 1111 1111 1111\n2,"open\n' + "filler, line\n" * 500 + "9,378282246310005\n")
    result = SC.scan(spark, [str(tmp_path)], SC.Options(now=NOW))
    meta = result.files.first()
    assert (meta.status, meta.error, meta.lines) == ("fully_scanned", None, 6 + 1000 + 2)
    assert sorted(r.location for r in result.findings.collect()) == ["row 2, v", "row 504, v"]


def test_long_records_are_read_by_line(spark, tmp_path):
    path = put(tmp_path, "l.csv", 'k,v\n1,"a\nb"\n2,"' + "x\n" * 400 + '"\n3,"c\nd"\n')
    numbered = delimited.join_records(csv_lines(spark, path), delimited.Dialect(",", '"', False), long_record=500)
    texts = [r.text for r in delimited.record_texts(numbered).orderBy("record").collect()]
    assert texts == ["k,v", '1,"a\nb"', '2,"x', *["x"] * 399, '"', '3,"c\nd"']


def test_files_that_fail_leave_others_alone(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    whole = gzip.compress(b"".join(b"useradd u%d x%d\n" % (i, i * i) for i in range(20_000)))
    put(tmp_path, "cut.log.gz", whole[: len(whole) // 2])
    put(tmp_path, "no.log.gz", b"not gzip at all")
    put(tmp_path, "cut.csv.gz", gzip.compress(b"k,v\n1,4111 1111 1111 1111\n" + os.urandom(60_000).hex().encode())[:-30_000])
    put(tmp_path, "bad.parquet", b"PAR1 not really PAR1")
    put(tmp_path, "good.log", "useradd bob\n")
    os.symlink(tmp_path / "good.log", tmp_path / "again.log")
    cards = [f"4111 1111 1111 1111 n{i}" for i in range(5)]
    pq.write_table(pa.table({"a": cards}), tmp_path / "s.parquet")
    pq.write_table(pa.table({"a": [4111111111111111]}), tmp_path / "i.parquet")
    pq.write_table(pa.table({"a": [1.5], "b": [cards[0]]}), tmp_path / "d.parquet")
    body = bytearray((tmp_path / "s.parquet").read_bytes())
    body[4:40] = b"\xff" * 36
    put(tmp_path, "torn.parquet", bytes(body))
    result = SC.scan(spark, [str(tmp_path)], SC.Options(now=NOW))
    files = {r.file.rsplit("/", 1)[1]: r for r in result.files.collect()}
    found = {}
    for r in result.findings.collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append(r.check_id)
    assert files["cut.log.gz"].status == "partially_scanned" and files["cut.log.gz"].error and found["cut.log.gz"]
    assert (files["no.log.gz"].status, files["no.log.gz"].lines) == ("unable_to_evaluate", 0) and files["no.log.gz"].error
    assert files["cut.csv.gz"].status in ("partially_scanned", "unable_to_evaluate") and files["cut.csv.gz"].error
    assert (files["bad.parquet"].status, files["bad.parquet"].error) == ("unable_to_evaluate", "ArrowInvalid")
    assert files["torn.parquet"].status == "unable_to_evaluate" and files["torn.parquet"].error == "OSError"
    assert {files[n].status for n in ("good.log", "s.parquet", "i.parquet", "d.parquet")} == {"fully_scanned"}
    assert found["good.log"] == ["LOG-PRIV-CHANGE"] and len(found["s.parquet"]) == 5 and found["i.parquet"] == ["DATA-PAN"] == found["d.parquet"]
    assert "again.log" not in files


def test_cell_limit_in_a_scan(spark, tmp_path):
    body = "".join(f"{i},4111 1111 1111 1111 x{i}\n" for i in range(1, 50))
    put(tmp_path, "c.csv", "k,v\n" + body)
    table = spark.createDataFrame([(i, None if i % 2 else f"4111 1111 1111 1111 x{i}") for i in range(1, 51)], "k int, v string")
    table.orderBy("k").coalesce(1).write.parquet(str(tmp_path / "t"))
    result = SC.scan(spark, [str(tmp_path)], SC.Options(now=NOW, item_limit=13))
    found: dict[str, list] = {}
    for r in result.findings.collect():
        found.setdefault(r.file.rsplit(".", 1)[1], []).append(int(r.location.split()[1].strip(",")))
    # CSV: 13 cells are the header, rows 2 to 6 and the first cell of row 7.
    assert sorted(found["csv"]) == [2, 3, 4, 5, 6]
    # Parquet: rows hold 1, 2, 1, 2, ... cells; the 13th is the only one of row 9.
    assert sorted(found["parquet"]) == [2, 4, 6, 8]
    assert {(r.lines, r.truncated, r.status) for r in result.files.collect()} == {(13, True, "partially_scanned")}


NAMES = {
    "a/x.LOG": "log", "x.conf": "config", "b.json.gz": "config", "c.csv.gz": "csv", ".env": "config", "Dockerfile": "config",
    "sshd_config": "config", "blog.txt": "log", "changelog.md": "log", "notes.md": "text", "q.xlsm": "xlsx", "q.xls": "xls",
    "q.ods": "ods", "q.pdf": "pdf", "q.pq": "parquet", "q.evtx": "evtx", "login.csv": "csv", "x": "text", "syslog": "log",
    "a.b.yaml": "config", ".hidden": "text", "a.log.gz": "log", "prod.env": "config",
}


def test_file_types(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "p string")
    got = {r[0]: r[1] for r in df.select("p", C.classify(F.col("p"))).collect()}
    assert got == NAMES


def test_env_reader(spark):
    lines = ['export A="x # y"', "B=val # note", "B = later", "#C=1", "  D='q'", "E=", 'F="', "1G=x", "not a setting"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, item_idx bigint, text string")
    assert {r.path: r.value for r in S.read_env(df).collect()} == {"A": "x # y", "B": "later", "D": "q", "E": "", "F": '"'}


def test_uploads(spark):
    def enc(text):
        return base64.b64encode(text.encode()).decode()

    def b64(data):
        return base64.b64encode(data).decode()

    def parquet(values):
        import pyarrow as pa
        import pyarrow.parquet as pq

        out = io.BytesIO()
        pq.write_table(pa.table({"card": values}), out)
        return out.getvalue()

    rows = [
        ("../../etc/a?b.txt", enc("4111 1111 1111 1111"), 1), ("x/a_b.txt", enc("4111 1111 1111 1111\n"), 2),
        ("s.json", enc('{"debug": true}'), 3), ("m.csv", enc("name,mail\n1,a@x.de\n2,b@x.de\n3,c@x.de\n"), 4), ("", enc("x"), 5),
        ("p.xlsx", enc("zz"), 6), ("z.log.gz", b64(gzip.compress(b"a\nuseradd bob\n")), 7), ("cut.log.gz", b64(gzip.compress(b"useradd eve\n" * 50)[:30]), 8),
        ("stray.csv", enc('k,v\n1,5" pipe\n2,"4111\n"\n3,378282246310005\n'), 9), ("bad.parquet", enc("no"), 10),
        ("t.parquet", b64(parquet(["x", "4111 1111 1111 1111"])), 11),
    ]
    uploads = spark.createDataFrame(rows, "name string, data string, ord int")
    assert {r.file for r in name_uploads(uploads).collect()} == {
        "a_b.txt", "a_b_1.txt", "s.json", "m.csv", "upload", "p.xlsx", "z.log.gz", "cut.log.gz", "stray.csv", "bad.parquet", "t.parquet",
    }
    result = scan_uploads(uploads, SC.Options(now=NOW))
    got = {(r.file, r.check_id, r.location, r.fingerprint) for r in result.findings.collect() if r.file != "cut.log.gz"}
    card = "4111********1111"
    assert got == {
        ("a_b.txt", "DATA-PAN", "line 1", model_fingerprint("DATA-PAN", "a_b.txt", card)),
        ("a_b_1.txt", "DATA-PAN", "line 1", model_fingerprint("DATA-PAN", "a_b_1.txt", card)),
        ("s.json", "CFG-DEBUG", "debug", model_fingerprint("CFG-DEBUG", "s.json", "debug = True")),
        ("m.csv", "DATA-PII-EMAIL", "row 2, mail", model_fingerprint("DATA-PII-EMAIL", "m.csv", "e.g. a***@x.de")),
        ("z.log.gz", "LOG-PRIV-CHANGE", "line 2", model_fingerprint("LOG-PRIV-CHANGE", "z.log.gz", "useradd bob")),
        ("stray.csv", "DATA-PAN", "row 4, v", model_fingerprint("DATA-PAN", "stray.csv", "3782*******0005")),
        ("t.parquet", "DATA-PAN", "row 2, card", model_fingerprint("DATA-PAN", "t.parquet", card)),
    }
    files = {r.file: r for r in result.files.collect()}
    assert files["s.json"].config_parser == "structured" and files["p.xlsx"].status == "unable_to_evaluate"
    assert files["cut.log.gz"].error and files["cut.log.gz"].status != "fully_scanned"
    assert (files["bad.parquet"].status, files["bad.parquet"].error) == ("unable_to_evaluate", "ArrowInvalid")


def test_uploads_are_named_without_their_data(spark, monkeypatch):
    """Data are neither shuffled nor sorted for their names, and a name keeps its own data."""
    from sievelight.plans import payload

    rows = [(f"d/a{i % 2}.txt" + ".gz" * (i % 5 == 0), base64.b64encode(str(i).encode()).decode(), i) for i in range(40)]
    uploads = spark.createDataFrame(rows, "name string, data string, ord bigint").repartition(3)
    want, seen = {}, {}
    for name, _, i in rows:
        stem, dot, ext = name[2:].rpartition(".")
        n = seen[name] = seen.get(name, -1) + 1
        want[f"{stem}_{n}{dot}{ext}" if n else name[2:]] = str(i)
    for sent in (payload.SENT_NAMES, 0):
        monkeypatch.setattr(payload, "SENT_NAMES", sent)
        named = name_uploads(uploads)
        assert {r.file: bytes(r.bytes).decode() for r in named.collect()} == want
        assert "Window" not in named._jdf.queryExecution().executedPlan().toString()


def test_cells_of_a_table(spark):
    df = spark.createDataFrame(
        [(1, True, [1, 2], 1.5, None, b"ab"), (2, False, None, None, "", None)],
        "id int, ok boolean, l array<int>, d double, s string, b binary",
    )
    rows = tables.table_items(df, "t", F.col("id")).orderBy("item_idx").collect()
    assert [(r.location, r.text) for r in rows] == [
        ("row 1, id", "1"), ("row 1, ok", "True"), ("row 1, l", "[1,2]"), ("row 1, d", "1.5"), ("row 1, b", "ab"),
        ("row 2, id", "2"), ("row 2, ok", "False"),
    ]


def test_uploaded_documents_like_files(spark):
    """Documents as uploads give what they give as items."""
    from sievelight.plans import feeds

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    uploads = docs.select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.base64(F.encode("text", "UTF-8")).alias("data"), F.col("doc_id").alias("ord"),
    )
    kinds = ("DATA-PAN", "DATA-SSN", "SECRET")

    def told(findings):
        return sorted((r.file.rsplit("/", 1)[-1], r.check_id, r.location, r.evidence) for r in findings.collect() if r.check_id.startswith(kinds))

    got = told(scan_uploads(uploads, SC.Options(now=NOW)).findings)
    items = feeds.document_items(spark, "/root/testdata/sf0.001")
    assert got and got == told(SC.scan_items(items, SC.Options(now=NOW)).findings)


def test_files_read_one_by_one_are_dealt_to_tasks(spark, tmp_path):
    for i in range(40):
        put(tmp_path, f"part{i}.log.gz", gzip.compress(f"line {i}\nlast\n".encode()))
        put(tmp_path, f".part{i}.log", "hidden\n")
    files = discovery.list_files(spark, [str(tmp_path)])
    assert files.count() == 80
    # However few parts the list comes in.
    lines = hidden.read_guarded_lines(files.coalesce(1)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.text for r in lines) == sorted([f"line {i}" for i in range(40)] + ["last"] * 40 + ["hidden"] * 40)
    assert len({r.task for r in lines}) > 1


def test_records_are_put_together_where_they_are_read(spark, tmp_path, small_splits, monkeypatch):
    """Files of many blocks, edges anywhere in records; only a file with a quote that is never closed goes by `join_records`."""
    several = [f'{i},"first {i}\n5"" wide\n\nsecond, {i}",{i % 7}" pipe' if i % 3 else f"{i},x,y,z" for i in range(2000)]
    one = ['1,"' + "line, of one cell\n" * 3000 + '",end', "2,b,c"]
    texts = {n: "\n".join(["k,v,w", *r]) + "\n" for n, r in {"several.csv": several, "one.csv": one, "open.csv": ['1,"a\nb",c', '2,"open', "3,c,d"]}.items()}
    for name, text in texts.items():
        put(tmp_path, name, text)
    small_splits(5000)
    apart = []
    by_window = delimited.join_records
    monkeypatch.setattr(delimited, "join_records", lambda lines, *rest: apart.append({r.path.rsplit("/", 1)[1] for r in lines.collect()}) or by_window(lines, *rest))
    got: dict[str, list] = {n: [] for n in texts}
    sources = delimited.read_csv_items(spark, discovery.list_files(spark, [str(tmp_path)]))
    for source in sources:
        for r in source.items.filter(F.col("cell").isNotNull()).orderBy("path", "row", "cell").collect():
            got[r.path.rsplit("/", 1)[1]].append((r.row, r.cell, r.text))
            assert r.cell < source.width and source.most_cells >= 1
    for name in ("several.csv", "one.csv"):
        reader = csv.reader(io.StringIO(texts[name], newline=""), skipinitialspace=True)
        assert got[name] == [(i, c, t) for i, record in enumerate(reader, 1) for c, t in enumerate(record) if t], name
        assert max(s.most_cells for s in sources) >= len(got[name])
    assert [t for r, _, t in got["open.csv"]] == ["k", "v", "w", "1", "a\nb", "c", "2", "open", "3", "c", "d"]
    assert apart == [{"open.csv"}]
