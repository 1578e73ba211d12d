"""Insecure settings among parsed keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as P, text as X
from . import findings as FN

# --- Fixed values: keys, values, wording ------------------------------------------
FALSE_LIKE = ("false", "off", "no", "0", "disabled")
TRUE_LIKE = ("true", "on", "yes", "1", "enabled")
ANY_ADDRESS = ("0.0.0.0", "::", "*")
WITHOUT_END = ("forever", "never", "unlimited", "0", "-1")
KEYS = {
    "verify": ("ssl_verify", "verify_ssl", "verify_certs", "verify_peer", "check_hostname", "curlopt_ssl_verifypeer"),
    "skip_verify": ("insecure_skip_verify",),
    "encryption": (
        "encrypt", "encryption", "encryption_enabled", "storage_encrypted", "require_ssl", "force_https", "tls", "ssl",
    ),
    "mfa": ("mfa", "mfa_enabled", "mfa_required", "2fa", "2fa_enabled", "otp_enabled"),
    "audit": ("audit", "audit_log", "audit_logging", "access_log", "logging", "syslog"),
    "debug": ("debug", "debug_mode", "display_errors", "flask_debug", "app_debug"),
    "anonymous": ("anonymous", "anonymous_enable", "allow_guest", "allow_anonymous", "guest_ok", "public_read"),
    "auth": ("auth_required", "authentication_required"),
    "min_length": ("min_password_length", "password_min_length", "minlen"),
    "lockout": ("lockout", "account_lockout"),
    "bind": ("bind", "bind_address", "listen_address", "host"),
    "retention": ("retention", "retention_days", "data_retention", "delete_after"),
    "tls_version": ("ssl_protocols", "tls_min_version", "min_tls", "protocols"),
}
MIN_PASSWORD_LENGTH = 12
DETAIL = "Parsed configuration key/value"
CONFIDENCE = 0.9


def final_key(path: Column) -> Column:
    """Last part of a key path in lower case with `_` for `-`; for a list element its number."""
    last = F.regexp_extract(path, r"([^.\[]*)$", 1)
    return F.translate(F.lower(F.rtrim(last, F.lit("]"))), "-", "_")


def setting_check(path: Column, value: Column, value_type: Column) -> Column:
    """Check id a setting fires, or null.  The first rule that fits wins; floats never fit."""
    key, text = final_key(path), F.lower(value)
    off, on = text.isin(*FALSE_LIKE), text.isin(*TRUE_LIKE)
    named = lambda group: key.isin(*KEYS[group])
    rule = (
        F.when((named("verify") & off) | (named("skip_verify") & on), "CFG-TLS-VERIFY-OFF")
        .when(named("encryption") & off, "CFG-ENCRYPTION-OFF")
        .when(named("mfa") & off, "CFG-MFA-OFF")
        .when(named("audit") & off, "CFG-AUDIT-OFF")
        .when(named("debug") & on, "CFG-DEBUG")
        .when((named("anonymous") & on) | (named("auth") & off), "CFG-ANON-ACCESS")
        .when(
            named("min_length") & (value_type == "int") & (value.try_cast("decimal(38,0)") < MIN_PASSWORD_LENGTH),
            "CFG-WEAK-PASS-POLICY",
        )
        .when(named("lockout") & off, "CFG-WEAK-PASS-POLICY")
        .when(named("bind") & text.isin(*ANY_ADDRESS), "CFG-BIND-ALL")
        .when(named("retention") & text.isin(*WITHOUT_END), "CFG-RETENTION")
        .when(named("tls_version") & P.rlike(text, P.WEAK_TLS_VALUE), "CFG-WEAK-TLS")
    )
    return F.when(value_type.isin("bool", "int", "string"), rule)


def settings_findings(settings: DataFrame) -> DataFrame:
    """Raw findings of settings rows (file, path, value, value_type).

    One finding per setting; `pos`, when present, keeps the order of the
    document, otherwise the order of key paths is taken.
    """
    check = setting_check(F.col("path"), F.col("value"), F.col("value_type"))
    place = F.col("pos") if "pos" in settings.columns else F.lit(0)
    return (
        settings.select("file", "path", "value", place.alias("_pos"), check.alias("check_id"))
        .filter(F.col("check_id").isNotNull())
        .select(
            "check_id", "file", X.sanitize(F.col("path")).alias("location"),
            X.sanitize(F.concat("path", F.lit(" = "), "value")).alias("evidence"), F.lit(DETAIL).alias("detail"),
            F.lit(1).cast("bigint").alias("count"), F.lit(CONFIDENCE).alias("confidence_score"),
            FN.order_key(2, F.col("_pos"), F.lit(0), F.lit(0)).alias("ord"),
        )
    )
