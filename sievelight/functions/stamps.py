"""Time stamps, accounts and addresses in log lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P

VALID_IPV4 = r"^(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"


def timestamp(line: Column, year: int) -> Column:
    """First ISO time of the line as wall-clock time (its offset is dropped), else syslog time in `year`.

    An offset written with it, such as `+02:00`, does not shift the result.
    """
    iso = P.extract(line, P.ISO_TIME)
    iso_wall = F.regexp_replace(F.left(iso, F.lit(19)), "T", " ")
    fraction = F.regexp_extract(iso, r"^.{19}(\.[0-9]+)", 1)
    # Stamps with any number of decimals are read, six of them kept.
    iso_time = (F.concat(iso_wall, F.left(fraction, F.lit(7)))).try_cast("timestamp_ntz")
    syslog = F.regexp_replace(P.extract(line, P.SYSLOG_TIME), r"\s+", " ")
    syslog_time = F.try_to_timestamp(
        F.concat(F.lit(f"{year:04d} "), syslog), F.lit("yyyy MMM d HH:mm:ss")
    ).cast("timestamp_ntz")
    return F.coalesce(F.when(iso != "", iso_time), F.when(syslog != "", syslog_time))


def actor(line: Column) -> Column:
    return F.nullif(P.extract(line, P.ACTOR, 1), F.lit(""))


def source_ip(line: Column) -> Column:
    """Address of the leftmost dotted quad; null when it is no valid address."""
    found = F.coalesce(
        F.nullif(P.extract(line, P.SOURCE_IP, 1), F.lit("")), F.nullif(P.extract(line, P.SOURCE_IP, 2), F.lit(""))
    )
    return F.when(found.rlike(VALID_IPV4), found)
