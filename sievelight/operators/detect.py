"""Line rules: what one item of text gives away.

Every rule adds to one array per item, so the input is read once and exploded
once, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as P, stamps, text as X
from ..functions.built import once

HIT = (
    "struct<kind:string,det:int,k:int,check_id:string,style:string,start:int,value:string,"
    "keep:int,detail:string,confidence_score:double>"
)
HITS = f"array<{HIT}>"

# --- Fixed values: order, wording and confidence of rules -------------------
DEFAULT_CONFIDENCE = 0.65
PRIVATE_KEY_EVIDENCE = "-----BEGIN … PRIVATE KEY----- block detected"
CONFIG_LINE_RULES = (
    ("CFG-WEAK-TLS", P.WEAK_TLS, "Deprecated protocol version enabled"),
    ("CFG-WEAK-CIPHER", P.WEAK_CIPHER, "Weak algorithm referenced"),
    ("CFG-ENCRYPTION-OFF", P.ENCRYPTION_OFF, "Encryption/TLS explicitly disabled"),
    ("CFG-TLS-VERIFY-OFF", P.TLS_VERIFY_OFF, "Certificate verification disabled"),
    ("CFG-DEBUG", P.DEBUG_ON, "Debug/verbose errors enabled"),
    ("CFG-DEFAULT-CREDS", P.DEFAULT_CREDS, "Default/vendor credential value"),
    ("CFG-MFA-OFF", P.MFA_OFF, "MFA disabled"),
    ("CFG-AUDIT-OFF", P.AUDIT_OFF, "Audit/access logging disabled"),
    ("CFG-ANON-ACCESS", P.ANON_ACCESS, "Anonymous/guest/public access"),
    ("CFG-CLEARTEXT-PROTO", P.CLEARTEXT_PROTO, "Cleartext protocol enabled"),
    ("CFG-BIND-ALL", P.BIND_ALL, "Service bound to all interfaces"),
    ("CFG-RETENTION", P.RETENTION, "Indefinite/excessive retention"),
)
LINE_CONFIDENCE = {"CFG-TLS-VERIFY-OFF": 0.9, "LOG-PRIV-FAIL": 0.85, "LOG-PRIV-CHANGE": 0.8}
LOCKOUT_DETAIL = "Account lockout disabled/unlimited"
MIN_PASSWORD_LENGTH = 12
COMMENT_MARKS = ("#", ";", "//", "!")
LOG_TYPES = ("log", "text", "evtx", "pdf")

DET = {"pan": 1, "ssn": 2, "mrn": 3, "private_key": 4, "cloud_key": 5, "password": 6, "entropy": 7,
       "config": 10, "log": 30, "auth": 40, "rule": 45, "email": 50, "phone": 51}
CONFIG_DETS = (DET["config"], DET["config"] + len(CONFIG_LINE_RULES) + 1)


def _hit(
    kind: str, det: int, check_id: str | None, style: str, *, k: Column | int = 0, start: Column | int = 0,
    value: Column | None = None, keep: int = 0, detail: Column | str = "", confidence: float | None = None,
) -> Column:
    score = confidence if confidence is not None else LINE_CONFIDENCE.get(check_id or "", DEFAULT_CONFIDENCE)
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(det).alias("det"), as_column(k).alias("k"),
        F.lit(check_id).alias("check_id"), F.lit(style).alias("style"), as_column(start).alias("start"),
        (value if value is not None else F.lit("")).alias("value"), F.lit(keep).alias("keep"),
        as_column(detail).alias("detail"), F.lit(score).alias("confidence_score"),
    ).cast(HIT)


def _none() -> Column:
    return F.array().cast(HITS)


def _if(condition: Column, hits: Column) -> Column:
    return F.when(condition, hits).otherwise(_none())


def card_ok(value: Column) -> Column:
    """13 to 19 ASCII digits that pass the Luhn test and are not all the same."""
    digits = F.regexp_replace(value, "[ -]", "")
    return digits.rlike("^[0-9]{13,19}$") & X.luhn_ok(digits) & (X.distinct_chars(digits) > 1)


def _spotted(det: str, check_id: str, found: Column) -> Column:
    return F.transform(
        found, lambda m, k: _hit("finding", DET[det], check_id, "snippet", k=k, start=m["start"], value=m["value"])
    )


def secret_pairs(line: P.Line) -> Column:
    """`key`, `value` of every assignment to a secret-like key."""
    return F.zip_with(
        P.extract_all(line, P.SECRET_KEY_VALUE, 1),
        P.extract_all(line, P.SECRET_KEY_VALUE, 2),
        lambda key, value: F.struct(key.alias("key"), value.alias("value")),
    )


def content_hits(line: P.Line) -> Column:
    """Card numbers, identifiers and secrets."""
    text = line.text
    cards = F.filter(P.spans(line, P.PAN), lambda m: card_ok(m["value"]))
    passwords = P.extract_all(line, P.PASSWORD, 2)
    known = F.concat(P.extract_all(line, P.CLOUD_KEY), passwords)
    pairs = F.when(
        P.rlike(line, P.SECRET_KEY_VALUE),
        X.let(
            known,
            lambda seen: F.filter(
                secret_pairs(line),
                lambda p: ~F.exists(seen, lambda h: h.contains(p["value"]) | p["value"].contains(h))
                & X.looks_high_entropy(p["value"])
                & ~X.likely_nonsecret(p["key"], p["value"], text),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return F.concat(
        _spotted("pan", "DATA-PAN", cards),
        _spotted("ssn", "DATA-SSN", P.spans(line, P.SSN)),
        _spotted("mrn", "DATA-MRN", P.spans(line, P.MRN)),
        _if(
            P.rlike(line, P.PRIVATE_KEY),
            F.array(
                _hit("finding", DET["private_key"], "SECRET-PRIVKEY", "fixed", value=F.lit(PRIVATE_KEY_EVIDENCE))
            ),
        ),
        _spotted("cloud_key", "SECRET-CLOUD-KEY", P.spans(line, P.CLOUD_KEY)),
        F.transform(
            F.filter(passwords, lambda v: ~P.rlike(v, P.PLACEHOLDER)),
            lambda v, k: _hit("finding", DET["password"], "SECRET-PASSWORD", "line", k=k, value=v, keep=1),
        ),
        F.transform(
            pairs,
            lambda p, k: _hit(
                "finding", DET["entropy"], "SECRET-HIGH-ENTROPY", "line", k=k, value=p["value"], keep=2,
                detail=X.entropy_detail(p["value"]),
            ),
        ),
    )


def contact_hits(line: P.Line) -> Column:
    """Email addresses and phone numbers, for the per-file roll-ups."""
    return F.concat(
        F.transform(
            P.extract_all(line, P.EMAIL),
            lambda v, k: _hit("email", DET["email"], None, "none", k=k, value=F.lower(v), detail=X.mask_email(v)),
        ),
        F.transform(
            P.extract_all(line, P.PHONE),
            lambda v, k: _hit(
                "phone", DET["phone"], None, "none", k=k, value=X.digits_only(v), detail=X.mask_middle(v, 3)
            ),
        ),
    )


def config_line_hits(line: P.Line) -> Column:
    """Insecure settings on one line; comments and blank lines give nothing."""
    text = line.text
    active = (text != "") & ~reduce(lambda a, b: a | b, [text.startswith(m) for m in COMMENT_MARKS])
    extra = {
        "CFG-ANON-ACCESS": ~P.rlike(text, P.ANON_OFF)
        & ~P.rlike(text, P.AUTH_ON)
        & (P.rlike(text, P.AUTH_OFF) | P.rlike(text, P.ANON_WORD)),
        "CFG-AUDIT-OFF": ~P.rlike(text, P.LOG_LEVEL) | P.rlike(text, P.LOG_LEVEL_OFF),
    }
    found = []
    for i, (check_id, pattern, detail) in enumerate(CONFIG_LINE_RULES):
        fires = P.rlike(line, pattern)
        if check_id in extra:
            fires = fires & extra[check_id]
        found.append(F.when(fires, _hit("finding", DET["config"] + i, check_id, "config", detail=detail)))
    policy = DET["config"] + len(CONFIG_LINE_RULES)
    length = P.extract(line, P.PASSWORD_MIN_LENGTH, 1)
    found.append(
        F.when(
            P.rlike(line, P.PASSWORD_MIN_LENGTH) & (length.cast("int") < MIN_PASSWORD_LENGTH),
            _hit(
                "finding", policy, "CFG-WEAK-PASS-POLICY", "config",
                detail=F.concat(F.lit("Minimum password length set to "), length, F.lit(" (< 12)")),
            ),
        )
    )
    found.append(
        F.when(
            P.rlike(line, P.LOCKOUT_OFF),
            _hit("finding", policy + 1, "CFG-WEAK-PASS-POLICY", "config", detail=LOCKOUT_DETAIL),
        )
    )
    return _if(active, F.array_compact(F.array(*found)))


def log_line_hits(line: P.Line) -> Column:
    """Privileged operations and cleartext protocols in log lines, and login events."""
    change = DET["log"]
    return F.array_compact(
        F.array(
            F.when(P.rlike(line, P.PRIV_FAIL), _hit("finding", change, "LOG-PRIV-FAIL", "log")).when(
                P.rlike(line, P.PRIV_CHANGE), _hit("finding", change, "LOG-PRIV-CHANGE", "log")
            ),
            F.when(P.rlike(line, P.CLEARTEXT_USE), _hit("finding", change + 1, "LOG-CLEARTEXT-USE", "log")),
            F.when(
                P.rlike(line, P.AUTH_FAIL) | P.rlike(line, P.AUTH_SUCCESS), _hit("auth", DET["auth"], None, "log")
            ),
        )
    )


def rule_hits(line: P.Line, rules: Iterable[tuple[str, str, str]]) -> Column:
    """Rules given by the caller: (check id, regular expression, detail), case ignored."""
    found = [
        F.when(P.rlike(line.text, P.Pattern(regex, True)), _hit("finding", DET["rule"], check_id, "config", k=i, detail=detail))
        for i, (check_id, regex, detail) in enumerate(rules)
    ]
    return F.array_compact(F.array(*found)) if found else _none()


FAMILIES = ("content", "contact", "config", "log")


def signals(
    items: DataFrame,
    *,
    year: int,
    families: Iterable[str] = FAMILIES,
    rules: Iterable[tuple[str, str, str]] = (),
    max_text: int | None = None,
    inside: Iterable[str] | None = None,
) -> DataFrame:
    """One row per thing found in `items`; all columns of an item but its text are kept.

    `items` needs `ftype` and `text`.  `kind` tells the four row types apart:
    finding, email, phone, auth.  Items are searched whole unless `max_text` is given.
    With `inside`, items without a hit are kept too, and a hit is one column `found`, a
    struct that also holds the columns named.
    """
    carried = [c for c in items.columns if c != "text"]
    families, rules = tuple(families), tuple(rules)
    hits = once(("hits", families, rules), lambda: _hits(families, rules))
    found_columns = once(("found", year), lambda: _found_columns(year))
    lines = (
        items.withColumn("text", F.col("text") if max_text is None else F.left("text", F.lit(max_text)))
        .withColumn("_ascii", P.is_ascii(F.col("text")))
        .withColumn("_digits", P.has_digits(F.col("text"), F.col("_ascii")))
        .withColumn("_fold", P.fold(F.col("text")))
        .withColumn("_strip", X.strip(F.col("text")))
    )
    # The array goes straight into `inline`: as a named column it would be worked
    # out once more for the "is it empty" filter that Catalyst adds below it.
    if inside is not None:
        every = lines.select(*carried, "text", F.inline_outer(hits))
        return every.select(*carried, F.when(F.col("kind").isNotNull(), F.struct(*inside, *found_columns)).alias("found"))
    found = lines.select(*carried, "text", F.inline(hits))
    return found.select(*carried, *found_columns)


def _hits(families: tuple[str, ...], rules: tuple) -> Column:
    ftype = F.col("ftype")
    line = P.Line(F.col("text"), F.col("_fold"), F.col("_ascii"), F.col("_digits"))
    stripped = P.Line(F.col("_strip"), F.col("_fold"), F.col("_ascii"))
    parts = []
    if "content" in families:
        parts.append(content_hits(line))
    if "config" in families:
        parts.append(_if(ftype.isin("text", "config"), config_line_hits(stripped)))
    if rules:
        parts.append(rule_hits(stripped, rules))
    if "log" in families:
        parts.append(_if(ftype.isin(*LOG_TYPES), log_line_hits(line)))
    if "contact" in families:
        parts.append(contact_hits(line))
    return F.concat(*parts)


def _found_columns(year: int) -> list[Column]:
    text, value, style = F.col("text"), F.col("value"), F.col("style")
    head = X.line_evidence(text)
    shown = F.when(style == "snippet", X.snippet(text, F.col("start"), value)).when(style.isin("config", "log"), head)
    masked = F.when(F.col("keep") == 1, X.mask_middle(value, 1)).otherwise(X.mask_middle(value, 2))
    evidence = (
        F.when(style == "fixed", value)
        .when(style == "line", F.replace(head, value, masked))
        .when(style != "none", X.sanitize(shown))
    )
    login = F.col("kind") == "auth"
    return [
        F.col("kind"), F.col("det"), F.col("k"), F.col("check_id"), evidence.alias("evidence"), F.col("detail"),
        F.lit(1).cast("bigint").alias("count"), F.col("confidence_score"),
        F.when(F.col("kind").isin("email", "phone"), value).alias("value"),
        F.when(login, stamps.actor(text)).alias("user"),
        F.when(login, stamps.source_ip(text)).alias("ip"),
        F.when(login, stamps.timestamp(text, year)).alias("ts"),
        F.when(login, P.rlike(text, P.AUTH_FAIL)).alias("fail"),
        F.when(login, P.rlike(text, P.AUTH_SUCCESS)).alias("success"),
    ]
