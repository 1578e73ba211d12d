"""Validation, masking and scoring of values, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import patterns as P
from .built import once

# Characters removed at the ends of a line: Unicode white space and the four
# separators U+001C..U+001F.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: limits and thresholds -----------------------------------
EVIDENCE_CUT = 160
SANITIZE_CUT = 500
SNIPPET_SIDE = 30
ENTROPY_MIN_MIXED = 3.8
ENTROPY_MIN_HEX = 3.6
HEX_MIN_LENGTH = 20
HIGH_CONFIDENCE = 0.85
MEDIUM_CONFIDENCE = 0.60


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def distinct_chars(text: Column) -> Column:
    return F.size(F.array_distinct(F.split(text, "")))


def mask_middle(text: Column, keep: int = 4) -> Column:
    def masked(raw: Column) -> Column:
        n = F.char_length(raw)
        return F.when(n <= 2 * keep, F.repeat(F.lit("*"), n)).otherwise(
            F.concat(F.left(raw, F.lit(keep)), F.repeat(F.lit("*"), n - 2 * keep), F.right(raw, F.lit(keep)))
        )

    return let(F.regexp_replace(text, "[^0-9A-Za-z]", ""), masked)


def mask_email(text: Column) -> Column:
    at = F.instr(text, "@")
    return F.when(at == 0, F.lit("***")).otherwise(
        F.concat(F.left(text, F.lit(1)), F.lit("***"), F.substring(text, at, F.char_length(text)))
    )


def shannon_entropy(text: Column) -> Column:
    """Bits per character; summed in order of first appearance."""

    def bits(value: Column) -> Column:
        n = F.char_length(value)
        return F.aggregate(
            F.array_distinct(F.split(value, "")),
            F.lit(0.0),
            lambda acc, ch: acc
            - let((n - F.char_length(F.replace(value, ch, F.lit("")))) / n, lambda p: p * F.log2(p)),
        )

    return F.when(F.char_length(text) == 0, F.lit(0.0)).otherwise(let(text, bits))


def looks_high_entropy(value: Column) -> Column:
    entropy = shannon_entropy(value)
    is_hex = value.rlike(P.HEX_ONLY.plain)
    return (
        ~P.rlike(value, P.PLACEHOLDER)
        & ~value.rlike(P.UUID.plain)
        & F.when(
            is_hex,
            (F.char_length(value) >= HEX_MIN_LENGTH)
            & (F.instr(F.lit("0123456789abcdef" * 9), F.lower(value)) == 0)
            & (entropy >= ENTROPY_MIN_HEX),
        ).otherwise(entropy >= ENTROPY_MIN_MIXED)
    )


def likely_nonsecret(key: Column, value: Column, line: Column) -> Column:
    context = F.lower(F.concat(key, F.lit(" "), line))
    return (
        P.rlike(context, P.EXAMPLE_CONTEXT)
        | P.rlike(key, P.DIGEST_KEY)
        | (value.rlike(P.DIGEST_VALUE.plain) & ~P.rlike(key, P.CREDENTIAL_KEY))
        | (distinct_chars(value) <= 3)
    )


def entropy_detail(value: Column) -> Column:
    """`entropy x.xx bits/char`, half-even at the second decimal."""
    rounded = F.bround(F.round(shannon_entropy(value), 10), 2)
    return F.format_string("entropy %.2f bits/char", rounded)


def confidence_band(score: Column) -> Column:
    return F.when(score >= HIGH_CONFIDENCE, "high").when(score >= MEDIUM_CONFIDENCE, "medium").otherwise("low")


def _redact(text: Column, pattern: P.Pattern, mask: Callable[[Column], Column]) -> Column:
    masked = F.array_join(
        F.transform(P.pieces(text, pattern), lambda part, i: F.when(i % 2 == 1, mask(part)).otherwise(part)), ""
    )
    return F.when(P.rlike(text, pattern), masked).otherwise(text)


def _redact_assigned(text: Column) -> Column:
    """Mask the value of `key = value` pairs whose key names a secret."""
    marked = P.replace(
        F.translate(text, P.CUT, "\ufffd"), P.ASSIGNED_SECRET, "$1" + P.CUT + "$2" + P.CUT
    )
    masked = F.array_join(
        F.transform(
            F.split(marked, P.CUT, -1),
            lambda part, i: F.when(i % 2 == 1, mask_middle(part, 1)).otherwise(part),
        ),
        "",
    )
    return F.when(P.rlike(text, P.ASSIGNED_SECRET), masked).otherwise(text)


def sanitize(text: Column) -> Column:
    """One masking pass over a piece of evidence.

    Not idempotent: a second pass measures the already masked value again, so
    callers decide how many passes a value gets.
    """

    def card(part: Column) -> Column:
        # Card numbers are told by ASCII digits only.
        return F.when(part.rlike("^[0-9 -]+$") & luhn_ok(digits_only(part)), mask_middle(part, 2)).otherwise(part)

    steps = [
        lambda v: _redact(v, P.CLOUD_KEY, lambda part: mask_middle(part, 2)),
        lambda v: _redact(v, P.PAN, card),
        lambda v: _redact(v, P.SSN, lambda part: mask_middle(part, 2)),
        lambda v: _redact(v, P.EMAIL, mask_email),
        lambda v: _redact(v, P.PHONE, lambda part: mask_middle(part, 2)),
        _redact_assigned,
    ]
    value = F.left(text, F.lit(SANITIZE_CUT))
    for step in steps:
        value = let(value, step)
    return let(value, lambda v: P.replace(v, P.BASIC_AUTH, "$1[REDACTED]"))


def sanitized(column: str) -> Column:
    """`sanitize` of a named column, under the same name."""
    return once(("sanitized", column), lambda: sanitize(F.col(column))).alias(column)


def snippet(line: Column, start: Column, value: Column) -> Column:
    """The match with 30 characters on each side, every copy of the value masked; to be sanitized."""
    stop = start + F.char_length(value)
    left_edge = F.greatest(F.lit(0), start - SNIPPET_SIDE)
    right_edge = F.least(F.char_length(line), stop + SNIPPET_SIDE)
    shown = F.replace(
        F.substring(line, left_edge + 1, right_edge - left_edge),
        value,
        F.when(F.instr(value, "@") > 0, mask_email(value)).otherwise(mask_middle(value)),
    )
    framed = F.concat(
        F.when(left_edge > 0, "…").otherwise(""), shown, F.when(right_edge < F.char_length(line), "…").otherwise("")
    )
    return strip(framed)


def line_evidence(line: Column) -> Column:
    """Trimmed line, at most 160 characters."""
    return F.left(strip(line), F.lit(EVIDENCE_CUT))
