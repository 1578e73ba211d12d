"""The registered queries once more, in SQL for a second engine, to compare results.

The second engine's regular expressions know no look-around.  Where a pattern
uses it, digit groups are marked first (a control character before and after
each), so that the marks stand for the boundaries.
"""

from __future__ import annotations

from .. import catalog as CAT
from ..catalog.frameworks import FRAMEWORKS, REVIEW_SOURCE, REVIEWED, SEVERITIES
from ..functions import patterns as P, text as X
from ..operators import auth, config_tree as CT, detect, findings as FN
from ..sources import classify as C
from . import feeds
from .queries import (
    ACCEPTED, ACCEPTED_BY_NAME, DOCUMENT_ROWS, EXPIRES, FILE_LIMIT, ITEM_LIMIT, NAME_ENDINGS, NOW, ROOT, RULE_WORDS, SCAN_LIMIT, SELECTED,
)

SQL: dict[str, str] = {}


def q(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def rows(name: str, columns: str, values) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in values)
    return f"{name}({columns}) AS (SELECT * FROM (VALUES {body}))"


def listed(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def re2(pattern: P.Pattern) -> str:
    return q(("(?i)" if pattern.ignore_case else "") + pattern.regex)


def mask(value: str, keep: int) -> str:
    raw = f"regexp_replace({value}, '[^0-9A-Za-z]', '', 'g')"
    return (
        f"CASE WHEN length({raw}) <= {2 * keep} THEN repeat('*', length({raw})) ELSE left({raw}, {keep}) || "
        f"repeat('*', length({raw}) - {2 * keep}) || right({raw}, {keep}) END"
    )


def mail(value: str) -> str:
    return f"left({value}, 1) || '***' || substr({value}, strpos({value}, '@'))"


def luhn(digits: str) -> str:
    def digit(i: str) -> str:
        return f"CAST(substr({digits}, length({digits}) - {i} + 1, 1) AS INTEGER)"

    return (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit('i')} "
        f"WHEN {digit('i')} > 4 THEN {digit('i')} * 2 - 9 ELSE {digit('i')} * 2 END)) % 10 = 0"
    )


def entropy(value: str) -> str:
    share = f"(length({value}) - length(replace({value}, ch, ''))) * 1.0 / length({value})"
    return (
        f"-list_sum(list_transform(list_distinct(string_split({value}, '')), lambda ch: ({share}) * log2({share})))"
    )


def lines(table: str, path: str, column: str) -> str:
    return (
        f"(SELECT file, i AS item_idx, parts[i] AS text FROM (SELECT {path} AS file, parts, "
        f"unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split({column}, chr(10)) AS parts FROM {table})) "
        f"WHERE NOT (i = len(parts) AND parts[i] = ''))"
    )


DOC_LINES = lines("documents", "'documents/' || source || '/' || doc_id || '.txt'", "text")
PAGE_LINES = lines("pages", "'pages/' || page_id || '.html'", "html")

MARK_STARTS = "regexp_replace({t}, '(^|[^0-9])([0-9])', '\\1' || chr(1) || '\\2', 'g')"
MARK_ENDS = "regexp_replace({t}, '([0-9])([^0-9]|$)', '\\1' || chr(2) || '\\2', 'g')"
CARD = r"'\x01(?:[0-9](?:\x02[ -]\x01)?){12,18}[0-9]\x02'"
BARE = r"regexp_replace({t}, '[\x01\x02]', '', 'g')"


def cards(source: str) -> str:
    """file, item_idx, value, start of every number that passes as a card."""
    marked = MARK_ENDS.format(t=MARK_STARTS.format(t="text"))
    size = lambda part: f"list_sum(list_transform({part}, lambda p: length({BARE.format(t='p')})))"
    return f"""
    (SELECT file, item_idx, {BARE.format(t='found[j]')} AS value,
            coalesce({size('between[1:j]')}, 0) + coalesce({size('found[1:j - 1]')}, 0) AS start, j
     FROM (SELECT file, item_idx, found, between, unnest(range(1, len(found) + 1)) AS j
           FROM (SELECT file, item_idx, regexp_extract_all(t2, {CARD}) AS found, regexp_split_to_array(t2, {CARD}) AS between
                 FROM (SELECT file, item_idx, {marked} AS t2 FROM {source})))
     WHERE {luhn("regexp_replace(found[j], '[^0-9]', '', 'g')")}
       AND len(list_distinct(string_split(regexp_replace(found[j], '[^0-9]', '', 'g'), ''))) > 1)"""


SQL["card_numbers"] = f"""
SELECT file, item_idx AS line, row_number() OVER (PARTITION BY file, item_idx ORDER BY j) - 1 AS nth,
       {mask('value', 4)} AS masked, CAST(start AS BIGINT) AS start FROM {cards(DOC_LINES)}"""
SQL["page_card_numbers"] = f"""
SELECT file, item_idx AS line, row_number() OVER (PARTITION BY file, item_idx ORDER BY j) - 1 AS nth,
       {mask('value', 4)} AS masked FROM {cards(PAGE_LINES)}"""

SECRETS = f"(SELECT o_orderkey, {feeds.SECRET_LINE} AS text FROM orders)"


def secret(value: str, keep: int, condition: str, detail: str = "''") -> str:
    return f"""
    SELECT o_orderkey, replace(text, v, {mask('v', keep)}) AS evidence, {detail} AS detail, 0.65 AS confidence_score
    FROM (SELECT o_orderkey, text, {value} AS v FROM {SECRETS}) WHERE v <> '' AND {condition}"""


SQL["social_security_numbers"] = secret(
    r"regexp_extract(text, '(?:^|[^0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?:$|[^0-9-])', 1)", 4,
    "left(v, 3) NOT IN ('000', '666') AND left(v, 1) <> '9' AND substr(v, 5, 2) <> '00' AND right(v, 4) <> '0000'",
)
SQL["medical_record_numbers"] = secret(f"regexp_extract(text, {re2(P.MRN)})", 4, "true")
SQL["private_keys"] = f"""
SELECT o_orderkey, {q(detect.PRIVATE_KEY_EVIDENCE)} AS evidence, '' AS detail, 0.65 AS confidence_score
FROM {SECRETS} WHERE regexp_matches(text, {re2(P.PRIVATE_KEY)})"""
SQL["cloud_keys"] = secret(f"regexp_extract(text, {re2(P.CLOUD_KEY)})", 4, "true")
PASSWORD_VALUE = r"""regexp_extract(text, '(?i)\b(?:pass(?:word|wd|phrase)?|pwd)\b\s*[:=]\s*([^\s''";,#]{4,})', 1)"""
SQL["passwords"] = secret(PASSWORD_VALUE, 1, "NOT regexp_matches(v, '(?i)^(?:changeme|hash|null|none|x{3,}|true)')")
SECRET_VALUE = f"regexp_extract(text, {re2(P.SECRET_KEY_VALUE)}, 2)"
SQL["high_entropy_secrets"] = secret(
    SECRET_VALUE, 2,
    f"""NOT regexp_matches(lower(text), {re2(P.EXAMPLE_CONTEXT)}) AND NOT regexp_matches(v, {re2(P.DIGEST_VALUE)})
    AND len(list_distinct(string_split(v, ''))) > 3
    AND CASE WHEN regexp_matches(v, {re2(P.HEX_ONLY)}) THEN length(v) >= {X.HEX_MIN_LENGTH} AND {entropy('v')} >= {X.ENTROPY_MIN_HEX}
        ELSE {entropy('v')} >= {X.ENTROPY_MIN_MIXED} END""",
    f"printf('entropy %.2f bits/char', {entropy('v')})",
)

LANGUAGE_LINES = """
(SELECT 'documents/' || lang || '.txt' AS file, doc_id * 100000 + i - 1 AS item_idx,
        'document ' || doc_id || ', part ' || i AS location, parts[i] AS text
 FROM (SELECT lang, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
       FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents)))"""
PHONE = (
    r"'(?:^|[^\p{L}\p{N}\p{M}_./\x02-])((?:\+?1(?:\x02?[ .-])?)?\(?[0-9]{3}\x02?\)?[ .-][0-9]{3}\x02?[ .-][0-9]{4})\x02'"
)
MARK_PHONES = r"regexp_replace(text || ' ', '([0-9])([^\p{L}\p{N}\p{M}_-])', '\1' || chr(2) || '\2', 'g')"


def contacts(source: str) -> str:
    """file, kind, value, item_idx, k, location, masked."""
    found = "regexp_replace(v, '\\x02', '', 'g')"
    return f"""
    (SELECT file, 'email' AS kind, lower(found[k]) AS value, item_idx, k, location, {mail('found[k]')} AS masked
     FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k
           FROM (SELECT *, regexp_extract_all(text, {re2(P.EMAIL)}) AS found FROM {source}))
     UNION ALL
     SELECT file, 'phone', regexp_replace(v, '[^0-9]', '', 'g'), item_idx, k, location, {mask(found, 3)}
     FROM (SELECT *, found[k] AS v
           FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k
                 FROM (SELECT *, regexp_extract_all({MARK_PHONES}, {PHONE}, 1) AS found FROM {source}))))"""


CONTACT_COUNTS = f"""
SELECT file, kind, least(count(DISTINCT value), 10000) AS n,
       arg_min(location, {{'i': item_idx, 'k': k}}) AS location, arg_min(masked, {{'i': item_idx, 'k': k}}) AS masked
FROM {contacts(LANGUAGE_LINES)} GROUP BY file, kind"""
SQL["contact_counts"] = CONTACT_COUNTS
SQL["bulk_contacts"] = f"""
SELECT CASE kind WHEN 'email' THEN 'DATA-PII-EMAIL' ELSE 'DATA-PHONE' END AS check_id, file, location,
       'e.g. ' || masked AS evidence,
       CASE WHEN n >= 10000 THEN 'at least ' ELSE '' END || n || ' unique ' ||
       CASE kind WHEN 'email' THEN 'email addresses' ELSE 'phone numbers' END || ' in file' AS detail,
       n AS count, 0.65 AS confidence_score
FROM ({CONTACT_COUNTS}) WHERE n >= 2"""

SQL["masked_values"] = f"""
SELECT c_custkey, {mask('c_name', 4)} AS name4, {mask('c_mktsegment', 1)} AS segment1,
       {mail("(lower(c_mktsegment) || '@' || lower(c_name) || '.example')")} AS mail, '***' AS no_mail FROM customer"""
SQL["entropy_scores"] = f"""
SELECT o_orderkey, round({entropy('v')}, 6) AS hex_bits, round({entropy('o_orderpriority')}, 6) AS word_bits,
       {entropy('v')} >= {X.ENTROPY_MIN_HEX} AND strpos(repeat('0123456789abcdef', 9), v) = 0 AS hex_high,
       {entropy('m')} >= {X.ENTROPY_MIN_MIXED} AS mixed_high, true AS digest,
       CASE WHEN o_totalprice / 500000 >= 0.85 THEN 'high' WHEN o_totalprice / 500000 >= 0.6 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT *, 'zQ' || substr(v, 1, 9) || upper(substr(v, 10, 9)) AS m
      FROM (SELECT *, md5(CAST(o_orderkey AS VARCHAR)) AS v FROM orders))"""
SQL["luhn_valid_keys"] = f"""
SELECT o_orderkey, {luhn('d')} AS ok
FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 13 AS VARCHAR), 16, '4') AS d FROM orders)"""

# --- settings ---------------------------------------------------------------------------
LOOKAROUND_FREE = {
    "CFG-WEAK-TLS": r"(?i)\b(ssl_?protocols?|tls_?(?:min_)?version|protocols?|min_?tls)\b[^#\n]*\b(SSLv2|SSLv3|TLSv1(?:\.0|\.1)?)(?:[^.0-9]|$)",
    "CFG-WEAK-CIPHER": r"(?i)\b(cipher|ciphers?|ssl_ciphers|hash|digest|algorithm)\b[^#\n]*\b(RC4|DES|3DES|MD5|SHA1|NULL|EXPORT|arcfour)\b",
}


def config_hits(source: str, keep: str) -> str:
    """Columns `keep` with check_id, detail and confidence for every setting that fires."""
    rules = rows(
        "rules", "check_id, pattern, detail",
        [(c, LOOKAROUND_FREE.get(c, "(?i)" + p.regex), d) for c, p, d in detect.CONFIG_LINE_RULES],
    )
    return f"""
    (WITH {rules}, given AS (SELECT *, trim(text) AS s FROM {source}),
     active AS (SELECT * FROM given WHERE s <> '' AND NOT regexp_matches(s, '^(#|;|//|!)')),
     fired AS (SELECT {keep}, check_id, detail, s FROM active, rules WHERE regexp_matches(s, pattern))
     SELECT {keep}, check_id, detail, CASE check_id WHEN 'CFG-TLS-VERIFY-OFF' THEN 0.9 ELSE 0.65 END AS confidence_score
     FROM fired WHERE CASE check_id
       WHEN 'CFG-ANON-ACCESS' THEN NOT regexp_matches(s, {re2(P.ANON_OFF)}) AND NOT regexp_matches(s, {re2(P.AUTH_ON)})
            AND (regexp_matches(s, {re2(P.AUTH_OFF)}) OR regexp_matches(s, {re2(P.ANON_WORD)}))
       WHEN 'CFG-AUDIT-OFF' THEN NOT regexp_matches(s, {re2(P.LOG_LEVEL)}) OR regexp_matches(s, {re2(P.LOG_LEVEL_OFF)})
       ELSE true END
     UNION ALL
     SELECT {keep}, 'CFG-WEAK-PASS-POLICY', 'Minimum password length set to ' || n || ' (< 12)', 0.65
     FROM (SELECT {keep}, regexp_extract(s, {re2(P.PASSWORD_MIN_LENGTH)}, 1) AS n FROM active)
     WHERE n <> '' AND TRY_CAST(n AS INTEGER) < 12
     UNION ALL
     SELECT {keep}, 'CFG-WEAK-PASS-POLICY', {q(detect.LOCKOUT_DETAIL)}, 0.65 FROM active
     WHERE regexp_matches(s, {re2(P.LOCKOUT_OFF)}))"""


SQL["config_line_rules"] = f"""
SELECT p_partkey, check_id, detail, confidence_score
FROM {config_hits(f"(SELECT p_partkey, {feeds.CONFIG_LINE} AS text FROM part)", 'p_partkey')}"""

SETTINGS = f"""
(SELECT file, regexp_replace(replace(t.fullkey, '"', ''), '^\\$\\.?', '') AS path,
        CASE t.type WHEN 'BOOLEAN' THEN CASE t.atom::VARCHAR WHEN 'true' THEN 'True' ELSE 'False' END
             ELSE t.atom ->> '$' END AS value,
        CASE t.type WHEN 'BOOLEAN' THEN 'bool' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END AS value_type
 FROM (SELECT 'part/' || p_partkey || '.json' AS file, {feeds.SETTING_DOCUMENT} AS text FROM part), json_tree(text) AS t
 WHERE t.type IN ('BOOLEAN', 'VARCHAR', 'DOUBLE', 'UBIGINT', 'BIGINT'))"""
SQL["flattened_settings"] = f"SELECT file, path, value, value_type FROM {SETTINGS}"


def among(group: str) -> str:
    return f"k IN {listed(CT.KEYS[group])}"


SQL["config_tree_rules"] = f"""
WITH s AS (SELECT *, replace(lower(regexp_extract(path, '([^.\\[]*)$', 1)), '-', '_') AS k0, lower(value) AS v FROM {SETTINGS}),
 t AS (SELECT *, rtrim(k0, ']') AS k, v IN {listed(CT.FALSE_LIKE)} AS off, v IN {listed(CT.TRUE_LIKE)} AS yes FROM s),
 c AS (SELECT file, path, value, CASE
   WHEN ({among('verify')} AND off) OR ({among('skip_verify')} AND yes) THEN 'CFG-TLS-VERIFY-OFF'
   WHEN {among('encryption')} AND off THEN 'CFG-ENCRYPTION-OFF'
   WHEN {among('mfa')} AND off THEN 'CFG-MFA-OFF'
   WHEN {among('audit')} AND off THEN 'CFG-AUDIT-OFF'
   WHEN {among('debug')} AND yes THEN 'CFG-DEBUG'
   WHEN ({among('anonymous')} AND yes) OR ({among('auth')} AND off) THEN 'CFG-ANON-ACCESS'
   WHEN {among('min_length')} AND value_type = 'int' AND TRY_CAST(value AS BIGINT) < 12 THEN 'CFG-WEAK-PASS-POLICY'
   WHEN {among('lockout')} AND off THEN 'CFG-WEAK-PASS-POLICY'
   WHEN {among('bind')} AND v IN {listed(CT.ANY_ADDRESS)} THEN 'CFG-BIND-ALL'
   WHEN {among('retention')} AND v IN {listed(CT.WITHOUT_END)} THEN 'CFG-RETENTION'
   WHEN {among('tls_version')} AND regexp_matches(v, '\\b(?:sslv[23]|tlsv?1(?:\\.0|\\.1)?)(?:[^.0-9]|$)') THEN 'CFG-WEAK-TLS'
   END AS check_id FROM t WHERE value_type <> 'float')
SELECT file, check_id, path AS location, path || ' = ' || value AS evidence FROM c WHERE check_id IS NOT NULL"""

SQL["env_settings"] = """
SELECT 'site' || p_partkey % 7 || '/.env' AS file, 'KEY_' || p_size AS path,
       arg_max(CASE p_partkey % 5 WHEN 1 THEN p_name WHEN 4 THEN p_brand || ' # kept' ELSE p_type END, p_partkey) AS value
FROM part WHERE p_partkey % 5 <> 3 GROUP BY 1, 2"""
SQL["custom_rules"] = r"""
SELECT 'talk/' || conv_id AS file, turn, 'USER-QUESTION' AS check_id, 'asks' AS detail FROM conversations WHERE regexp_matches(text, '\?')
UNION ALL
SELECT 'talk/' || conv_id, turn, 'USER-THE', 'says the' FROM conversations WHERE regexp_matches(text, '(?i)\bthe\b')"""

SQL["rule_scan"] = f"""
SELECT file, check_id, 'medium' AS severity, detail AS title, 'Custom rule' AS category, count(*) AS occurrences
FROM ({SQL["custom_rules"]}) GROUP BY file, check_id, detail"""

# --- logs ----------------------------------------------------------------------------------


def log_hits(source: str, keep: str) -> str:
    m = lambda p: f"regexp_matches(text, {re2(p)})"
    return f"""
    (SELECT {keep}, CASE WHEN {m(P.PRIV_FAIL)} THEN 'LOG-PRIV-FAIL' ELSE 'LOG-PRIV-CHANGE' END AS check_id,
            CASE WHEN {m(P.PRIV_FAIL)} THEN 0.85 ELSE 0.8 END AS confidence_score
     FROM {source} WHERE {m(P.PRIV_FAIL)} OR {m(P.PRIV_CHANGE)}
     UNION ALL
     SELECT {keep}, 'LOG-CLEARTEXT-USE', 0.65 FROM {source} WHERE {m(P.CLEARTEXT_USE)})"""


SQL["log_line_rules"] = f"""
SELECT * FROM {log_hits(f"(SELECT event_id, {feeds.LOG_LINE} AS text FROM events)", 'event_id')}"""

LOGINS = f"""
(SELECT event_id, log AS file, event_id + 1 AS item_idx, 'line ' || (event_id + 1) AS location,
        nullif(regexp_extract(text, {re2(P.ACTOR)}, 1), '') AS usr,
        CASE WHEN ip4 LIKE '%.300' THEN NULL ELSE ip4 END AS ip, ts,
        regexp_matches(text, {re2(P.AUTH_FAIL)}) AS fail, regexp_matches(text, {re2(P.AUTH_SUCCESS)}) AS success
 FROM (SELECT *, regexp_extract(text, 'from ([0-9.]+)', 1) AS ip4,
              TRY_CAST(replace(regexp_extract(text, '^[0-9]{{4}}-[0-9-]+T[0-9:]+'), 'T', ' ') AS TIMESTAMP) AS ts
       FROM (SELECT event_id, {feeds.AUTH_FILE} AS log, {feeds.AUTH_LINE} AS text FROM events)))"""
SQL["login_events"] = f"""
SELECT event_id, usr AS "user", ip, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, fail, success FROM {LOGINS}"""
SQL["untimed_login_failures"] = f"""
SELECT file, n || ' failures for ' || who || '; temporal correlation unavailable' AS detail, n AS count
FROM (SELECT file, coalesce(usr, ip, '(unattributed)') AS who, count(*) AS n FROM {LOGINS}
      WHERE ts IS NULL AND fail GROUP BY 1, 2) WHERE n >= 2"""

KEYED = f"""
keyed AS (
  SELECT file, item_idx, location, 'user' AS kt, usr AS key, ip AS peer, ip, ts, fail, success FROM {LOGINS} WHERE ts IS NOT NULL AND usr IS NOT NULL
  UNION ALL
  SELECT file, item_idx, location, 'ip', ip, usr, ip, ts, fail, success FROM {LOGINS} WHERE ts IS NOT NULL AND ip IS NOT NULL),
stepped AS (SELECT *, ts < lag(ts) OVER (PARTITION BY file, kt, key ORDER BY item_idx) AS back FROM keyed),
runs AS (SELECT *, sum(CASE WHEN back THEN 1 ELSE 0 END) OVER (PARTITION BY file, kt, key ORDER BY item_idx) AS run FROM stepped),
held AS (SELECT *,
  list({{'ts': ts, 'fail': fail, 'peer': peer}}) OVER (PARTITION BY file, kt, key, run ORDER BY item_idx ROWS BETWEEN {auth.HISTORY_EVENTS - 1} PRECEDING AND CURRENT ROW) AS latest,
  list({{'ts': ts, 'fail': fail, 'peer': peer}}) OVER (PARTITION BY file, kt, key, run ORDER BY item_idx ROWS BETWEEN {auth.HISTORY_EVENTS} PRECEDING AND 1 PRECEDING) AS earlier
  FROM runs)"""


def _recent(seconds: int) -> str:
    return f"list_filter(latest, lambda e: e.fail AND e.ts >= ts - INTERVAL '{seconds} seconds')"


SQL["brute_force"] = f"""
WITH {KEYED},
counted AS (SELECT *, {', '.join(f'len({_recent(s)}) AS c{s}' for _, s in auth.WINDOWS)} FROM held WHERE fail),
hit AS (SELECT *, CASE {' '.join(f'WHEN c{s} >= {n} THEN {s}' for n, s in auth.WINDOWS)} END AS secs,
        CASE {' '.join(f'WHEN c{s} >= {n} THEN c{s}' for n, s in auth.WINDOWS)} END AS n FROM counted),
first AS (SELECT *, row_number() OVER (PARTITION BY file, kt, key ORDER BY item_idx) AS rn FROM hit WHERE secs IS NOT NULL)
SELECT file, location, n || ' failures in ' || secs || 's for ' || kt || ' ' || key AS detail, n AS count, 0.9 AS confidence_score
FROM first WHERE rn = 1"""
SQL["success_after_failures"] = f"""
WITH {KEYED},
counted AS (SELECT *, len(list_filter(coalesce(earlier, []), lambda e: e.fail AND e.ts >= ts - INTERVAL '1800 seconds' AND (ip IS NULL OR coalesce(e.peer = ip, false)))) AS n
            FROM held WHERE success AND kt = 'user'),
first AS (SELECT *, row_number() OVER (PARTITION BY file, kt, key ORDER BY item_idx) AS rn FROM counted WHERE n >= 3)
SELECT file, location, n || ' recent failures followed by success for account ' || key AS detail, n + 1 AS count, 0.9 AS confidence_score
FROM first WHERE rn = 1"""


def _peers(kind: str, words: str) -> str:
    return f"""
WITH {KEYED},
counted AS (SELECT *, len({_recent(auth.PEER_WINDOW)}) AS n,
            len(list_distinct(list_filter(list_transform({_recent(auth.PEER_WINDOW)}, lambda e: e.peer), lambda p: p IS NOT NULL))) AS d
            FROM held WHERE fail AND kt = '{kind}'),
first AS (SELECT *, row_number() OVER (PARTITION BY file, kt, key ORDER BY item_idx) AS rn FROM counted WHERE d >= 5)
SELECT file, location, d || ' distinct {words} in 5 minutes' AS detail, n AS count, 0.85 AS confidence_score FROM first WHERE rn = 1"""


SQL["password_spraying"] = _peers("ip", "accounts")
SQL["distributed_attack"] = _peers("user", "source IPs")
SQL["log_aggregates"] = " UNION ALL ".join(
    f"SELECT '{check}' AS check_id, count(*) AS findings, CAST(sum(count) AS BIGINT) AS events FROM ({body}) HAVING count(*) > 0"
    for check, body in (
        ("LOG-BRUTEFORCE", f"SELECT count FROM ({SQL['brute_force']}) UNION ALL SELECT n FROM (SELECT count(*) AS n FROM {LOGINS} "
         "WHERE ts IS NULL AND fail GROUP BY file, coalesce(usr, ip, '(unattributed)')) WHERE n >= 5"),
        ("LOG-FAIL-SUCCESS", SQL["success_after_failures"]), ("LOG-SPRAY", SQL["password_spraying"]),
        ("LOG-DISTRIBUTED", SQL["distributed_attack"]),
    )
)
SQL["syslog_times"] = """
SELECT event_id, strftime(TRY_CAST('2025-' || CASE event_id % 4 WHEN 0 THEN '01' WHEN 1 THEN '02' WHEN 2 THEN '09' ELSE '12' END
  || '-' || lpad(CAST(event_id % 31 + 1 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(event_id % 26 AS VARCHAR), 2, '0') || ':05:09' AS TIMESTAMP),
  '%Y-%m-%d %H:%M:%S') AS ts FROM events"""

# --- findings -------------------------------------------------------------------------------
RAW = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in feeds.FINDING_COLUMNS.items()) + " FROM orders)"
MERGED = f"""
(SELECT check_id, file, arg_min(location, item_idx) AS location, evidence, arg_min(detail, item_idx) AS detail,
        CAST(sum(count) AS BIGINT) AS count, arg_min(confidence_score, item_idx) AS confidence_score,
        array_to_string(list(location ORDER BY item_idx)[1:5], '; ') AS samples, min(item_idx) AS first_idx
 FROM {RAW} GROUP BY check_id, file, evidence, CASE WHEN count > 1 THEN detail ELSE '' END)"""
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY file ORDER BY first_idx) AS pos FROM {MERGED})"
_KEPT = "check_id, file, location, evidence, detail, count, confidence_score"
LIMITED = f"""
(SELECT {_KEPT}, pos FROM {RANKED} WHERE pos <= {FILE_LIMIT}
 UNION ALL
 SELECT check_id, file, {', '.join(q(t) for t in FN.FILE_LIMIT_TEXT)}, CAST(sum(count) AS BIGINT), 0.4, min(pos)
 FROM {RANKED} WHERE pos > {FILE_LIMIT} GROUP BY check_id, file)"""
SCAN_RANKED = f"(SELECT *, row_number() OVER (ORDER BY file, pos) AS rn FROM {LIMITED})"
SCAN_LIMITED = f"""
(SELECT {_KEPT} FROM {SCAN_RANKED} WHERE rn <= {SCAN_LIMIT}
 UNION ALL
 SELECT check_id, {q(FN.SCAN_WIDE)}, {', '.join(q(t) for t in FN.SCAN_LIMIT_TEXT)}, CAST(sum(count) AS BIGINT), 0.4
 FROM {SCAN_RANKED} WHERE rn > {SCAN_LIMIT} GROUP BY check_id)"""
SQL["merged_findings"] = f"SELECT {_KEPT}, samples FROM {MERGED}"
SQL["remerged_findings"] = f"SELECT {_KEPT} FROM {MERGED}"
SQL["masked_insertion"] = f"""
SELECT evidence || ' by ' || left(lower(check_id), 1) || '***@mail.example ' AS evidence, count(*) AS n FROM {RAW} GROUP BY 1"""
SQL["file_limit"] = f"SELECT * FROM {LIMITED}"
SQL["scan_limit"] = f"SELECT * FROM {SCAN_LIMITED}"

REL = f"substr(file, {len(ROOT) + 2})"
NAME = "regexp_extract(file, '[^/]*$')"


def hashed(path: str) -> str:
    return f"left(sha256(check_id || '|' || {path} || '|' || evidence), 16)"


SQL["fingerprints"] = f"""
SELECT DISTINCT check_id, file, evidence, detail, {hashed(REL)} AS fingerprint, {hashed(NAME)} AS legacy_fingerprint FROM {MERGED}"""
SQL["common_root"] = f"""
WITH e AS (SELECT string_split(min(file), '/') AS a, string_split(max(file), '/') AS b FROM {RAW})
SELECT array_to_string(a[1:(SELECT min(i) - 1 FROM e, range(1, 100) AS t(i) WHERE a[i] IS DISTINCT FROM b[i])], '/') AS root FROM e"""

# --- catalog --------------------------------------------------------------------------------------
COVERAGE = rows("coverage", "check_id, framework", CAT.coverage_rows())
CONTROLS = rows("links", "check_id, framework, control, pos", CAT.control_rows())
CHECKS = rows("checks", "check_id, severity, category, title, description, remediation, ord", CAT.check_rows())
SEVS = rows("sevs", "severity, rank, sarif_level, sarif_score", SEVERITIES)
FRAMES = rows("frames", "id, name, long, ord", [(*f, i) for i, f in enumerate(FRAMEWORKS)])
CHOSEN = listed(SELECTED)

SQL["relevant_findings"] = f"""
WITH {COVERAGE} SELECT check_id, count(*) AS n FROM {RAW}
WHERE check_id IN (SELECT check_id FROM coverage WHERE framework IN ('ccpa', 'sox')) GROUP BY 1"""
SQL["finding_attributes"] = f"""
WITH {CHECKS}, {SEVS} SELECT check_id, title, severity, category, count(*) AS n, min(rank) AS rank
FROM {RAW} JOIN checks USING (check_id) JOIN sevs USING (severity) GROUP BY 1, 2, 3, 4"""
SQL["control_expansion"] = f"""
WITH {CONTROLS} SELECT framework, control, count(*) AS findings, CAST(sum(count) AS BIGINT) AS occurrences
FROM {RAW} JOIN links USING (check_id) WHERE framework IN {CHOSEN} GROUP BY 1, 2"""
_V, _U, _D = (q(v) for v in REVIEW_SOURCE)
SQL["mapping_provenance"] = f"""
WITH {CONTROLS}, {FRAMES}, {rows('reviewed', 'check_id, framework, control', REVIEWED)}
SELECT l.check_id, l.framework, l.control, l.pos, CASE WHEN r.control IS NULL THEN 'inferred' ELSE 'supporting' END AS mapping_type,
 CASE WHEN r.control IS NULL THEN 'unreviewed' ELSE 'source_reviewed' END AS review_status,
 CASE WHEN r.control IS NULL THEN f.name ELSE {_V} END AS source_version,
 CASE WHEN r.control IS NOT NULL THEN {_U} END AS source_url, CASE WHEN r.control IS NOT NULL THEN {_D} END AS reviewed_on,
 false AS independently_verified
FROM links l JOIN frames f ON f.id = l.framework
LEFT JOIN reviewed r ON r.check_id = l.check_id AND r.framework = l.framework AND r.control = l.control
WHERE l.check_id IN (SELECT check_id FROM {RAW})"""
SQL["finding_mappings"] = f"""
WITH {CONTROLS}, m AS (SELECT check_id, framework, array_to_string(list(control ORDER BY pos), '; ') AS controls FROM links
                       WHERE framework IN {CHOSEN} GROUP BY 1, 2)
SELECT check_id, framework, controls, count(*) AS n FROM {RAW} JOIN m USING (check_id) GROUP BY 1, 2, 3"""
SQL["framework_list"] = f"""
WITH {FRAMES}, {COVERAGE}
SELECT id, name, long, (SELECT count(*) FROM {RAW} r JOIN coverage c ON c.check_id = r.check_id WHERE c.framework = f.id) AS findings FROM frames f"""
SQL["check_list"] = f"""
WITH {CHECKS}, {COVERAGE}
SELECT severity, check_id, title, (SELECT string_agg(framework, ', ' ORDER BY framework) FROM coverage v WHERE v.check_id = c.check_id) AS frameworks,
 (SELECT count(*) FROM {RAW} r WHERE r.check_id = c.check_id) AS findings FROM checks c"""
SQL["uncovered_frameworks"] = f"""
WITH {FRAMES}, {COVERAGE}
SELECT id, id IN (SELECT framework FROM coverage) AS has_checks FROM frames
WHERE id NOT IN (SELECT framework FROM coverage WHERE check_id IN (SELECT check_id FROM {RAW}))"""

# --- baseline ---------------------------------------------------------------------------------------
HASHED = f"(SELECT *, {hashed(REL)} AS fp, {hashed(NAME)} AS old_fp FROM {RANKED})"
SQL["baseline_split"] = f"""
WITH found AS (SELECT * FROM {HASHED}),
entries AS (SELECT DISTINCT fp AS id, {EXPIRES} AS expires FROM found WHERE {ACCEPTED}
            UNION SELECT DISTINCT old_fp, NULL FROM found WHERE {ACCEPTED_BY_NAME}),
judged AS (SELECT id, coalesce(expires IN ('2026-01-01T00:00:00Z', '2027-01-01'), false) AS expired FROM entries)
SELECT check_id, file, evidence, detail, pos, e IS NOT NULL AND NOT e AS suppressed, coalesce(e, false) AS expired_suppression
FROM (SELECT f.*, coalesce(a.expired, b.expired) AS e FROM found f LEFT JOIN judged a ON a.id = f.fp LEFT JOIN judged b ON b.id = f.old_fp)"""
_STAMP = q(NOW.isoformat())
SQL["baseline_entries"] = f"""
SELECT fp AS fingerprint, check_id AS check, {REL} AS file, evidence, '' AS reason, '' AS approved_by, {_STAMP} AS created,
       CAST(NULL AS VARCHAR) AS expires
FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY file, pos) AS rn FROM {HASHED}) WHERE rn = 1"""
SQL["baseline_latest"] = """
SELECT fingerprint, arg_max(o_orderpriority, o_orderkey) AS reason
FROM (SELECT *, 'fp' || o_custkey % 400 AS fingerprint FROM orders WHERE o_custkey % 50 <> 0) GROUP BY 1"""

SQL["rule_table"] = f"""
WITH often AS (SELECT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM documents) GROUP BY w ORDER BY count(*) DESC, w LIMIT {RULE_WORDS}),
t AS (SELECT DISTINCT file, item_idx, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]+')) AS w FROM {DOC_LINES})
SELECT 'WORD-' || w AS check_id, count(*) AS lines, count(DISTINCT file) AS files FROM t SEMI JOIN often USING (w) GROUP BY w"""

# --- sinks and report ---------------------------------------------------------------------------------
SQL["sarif_rules"] = f"""
WITH {CHECKS}, {SEVS}, {FRAMES}, {CONTROLS},
m AS (SELECT check_id, string_agg(name || ': ' || cs, '; ' ORDER BY framework) AS mapped
      FROM (SELECT check_id, framework, string_agg(control, ', ' ORDER BY pos) AS cs FROM links WHERE framework IN ('gdpr', 'soc2') GROUP BY 1, 2)
      JOIN frames ON id = framework GROUP BY 1)
SELECT check_id AS id, replace(check_id, '-', '') AS name, title AS short_description, description AS full_description,
 remediation || chr(10) || chr(10) || 'Candidate assessment mappings — ' || coalesce(mapped, '') || '. These do not establish compliance.' AS help,
 sarif_level AS level, sarif_score AS security_severity, category
FROM checks JOIN sevs USING (severity) LEFT JOIN m USING (check_id) WHERE check_id IN (SELECT check_id FROM {RANKED})"""
BAND = "CASE WHEN confidence_score >= 0.85 THEN 'high' WHEN confidence_score >= 0.6 THEN 'medium' ELSE 'low' END"
SQL["sarif_results"] = f"""
WITH {CHECKS}, {SEVS}
SELECT check_id AS rule_id, sarif_level AS level,
 title || ' — ' || location || CASE WHEN detail <> '' THEN ' (' || detail || ')' ELSE '' END || '. Evidence: ' || evidence AS message,
 {REL} AS uri, coalesce(TRY_CAST(nullif(regexp_extract(location, '\\bline ([0-9]+)', 1), '') AS BIGINT), 1) AS start_line,
 fp AS fingerprint, {BAND} AS confidence, confidence_score, count AS occurrence_count
FROM {HASHED} JOIN checks USING (check_id) JOIN sevs USING (severity)"""
SQL["severity_counts"] = f"""
WITH {CHECKS}, {SEVS} SELECT s.severity, s.rank, count(r.check_id) AS findings FROM sevs s LEFT JOIN checks c USING (severity)
LEFT JOIN {RAW} r ON r.check_id = c.check_id GROUP BY 1, 2"""
SQL["framework_impact"] = f"""
WITH {FRAMES}, {COVERAGE}, n AS (SELECT framework, count(*) AS n FROM {RAW} JOIN coverage USING (check_id) GROUP BY 1)
SELECT id AS framework, name, coalesce(n, 0) AS findings,
 CASE WHEN id NOT IN (SELECT framework FROM coverage) THEN 'out_of_scope' WHEN coalesce(n, 0) = 0 THEN 'no_finding' ELSE 'findings' END AS status
FROM frames LEFT JOIN n ON framework = id WHERE id IN {CHOSEN}"""
SQL["top_controls"] = f"""
WITH {CONTROLS},
c AS (SELECT framework, control, count(*) AS n, min({{'f': file, 'p': r.pos, 'c': l.pos}}) AS seen
      FROM {RANKED} r JOIN links l USING (check_id) WHERE framework IN {CHOSEN} GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY framework ORDER BY n DESC, seen) AS place FROM c)
SELECT framework, place, control, n AS findings FROM o WHERE place <= 6"""
SQL["finding_groups"] = f"""
WITH {CHECKS}, {SEVS}
SELECT rank, check_id, file, count(*) AS findings, CAST(sum(count) AS BIGINT) AS occurrences,
 array_to_string(list_sort(list_distinct(list({BAND}))), ', ') AS confidence, bool_or(count > 5) AS expired_suppression
FROM {RANKED} JOIN checks USING (check_id) JOIN sevs USING (severity) GROUP BY 1, 2, 3"""
SQL["evidence_bands"] = f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY check_id, file ORDER BY pos) AS p FROM {RANKED})
SELECT check_id, file, CASE WHEN p <= 1 THEN 'shown' WHEN p <= 3 THEN 'listed' ELSE 'counted' END AS band, least(p, 4) AS place,
 count(*) AS n, min(CASE WHEN p <= 3 THEN location END) AS location, min(CASE WHEN p <= 3 THEN evidence END) AS evidence
FROM o GROUP BY 1, 2, 3, 4"""
SQL["suppressed_list"] = SQL["baseline_split"].replace(
    "SELECT check_id, file, evidence, detail, pos, e IS NOT NULL AND NOT e AS suppressed, coalesce(e, false) AS expired_suppression",
    "SELECT check_id, file, fp AS fingerprint, left(evidence, 80) AS evidence",
) + " WHERE NOT e ORDER BY file, pos LIMIT 200"
SQL["severity_gate"] = f"""
WITH {CHECKS}, {SEVS}, low AS (SELECT min(rank) AS r FROM {RAW} JOIN checks USING (check_id) JOIN sevs USING (severity))
SELECT severity AS fail_on, coalesce(r <= rank, false) AS failed FROM sevs, low"""
DOC_FILES = f"(SELECT file, count(*) AS items FROM {DOC_LINES} GROUP BY 1)"
SQL["file_coverage"] = f"""
SELECT CASE WHEN items > {ITEM_LIMIT} THEN 'partially_scanned' ELSE 'fully_scanned' END AS status, count(*) AS files FROM {DOC_FILES} GROUP BY 1"""
_LINES = f"(SELECT *, '' AS location FROM {DOC_LINES})"
SQL["file_table"] = f"""
WITH n AS (SELECT file, count(*) AS n FROM {contacts(_LINES)} GROUP BY 1)
SELECT file, 'text' AS type, items AS lines, false AS truncated, 'fully_scanned' AS status, coalesce(n, 0) AS findings
FROM {DOC_FILES} LEFT JOIN n USING (file)"""
SQL["omission_totals"] = f"""
WITH s AS (SELECT * FROM {SCAN_LIMITED})
SELECT CAST(coalesce(sum(count) FILTER (location = {q(FN.FILE_LIMIT_TEXT[0])}), 0) AS BIGINT) AS distinct_findings_omitted,
 CAST(0 AS BIGINT) AS auth_actors_evicted, CAST(coalesce(sum(count) FILTER (file = {q(FN.SCAN_WIDE)}), 0) AS BIGINT) AS scan_wide_omitted FROM s"""

# --- sources ---------------------------------------------------------------------------------------------
SQL["table_cells"] = " UNION ALL ".join(
    f"SELECT 'nation.parquet' AS file, n_nationkey * 3 + {i + 1} AS item_idx, 'row ' || (n_nationkey + 1) || ', {c}' AS location, "
    f"CAST({c} AS VARCHAR) AS text FROM nation"
    for i, c in enumerate(("n_nationkey", "n_name", "n_regionkey"))
)
SQL["parquet_cells"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS cells, (count(*) - 1) * 4 + {i + 1} AS last FROM supplier"
    for i, c in enumerate(("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))
)
SQL["item_numbers"] = """
SELECT row_number() OVER (ORDER BY k, c) AS item_idx, 'row ' || (k + 1) || ', ' || c AS location, text
FROM (SELECT o_orderkey AS k, 'a' AS c, o_orderstatus AS text FROM orders WHERE o_orderkey % 3 <> 0
      UNION ALL SELECT o_orderkey, 'b', o_orderpriority FROM orders)"""
_ENDING = feeds.case(f"page_id % {len(NAME_ENDINGS)}", [q(e) for e in NAME_ENDINGS])
_NAME = f"regexp_replace(lower(regexp_extract(path, '[^/]*$')), '\\.gz$', '')"
SQL["file_types"] = f"""
WITH n AS (SELECT path, name, regexp_extract(name, '\\.[^.]*$') AS ext
           FROM (SELECT path, {_NAME} AS name FROM (SELECT 'in/p' || page_id || {_ENDING} AS path FROM pages))),
t AS (SELECT path, ext, CASE {' '.join(f"WHEN ext IN {listed(e)} THEN '{k}'" for k, e in C.BY_EXTENSION)}
 WHEN ext IN {listed(C.LOG_EXTS)} OR contains(name, 'log') THEN 'log' ELSE 'text' END AS type FROM n)
SELECT path, type, ext IN {listed(C.SUPPORTED_EXTS)} OR type IN ('log', 'config') AS supported FROM t"""

# --- whole scans ---------------------------------------------------------------------------------------------


def bulk(source: str) -> str:
    return f"""SELECT file, CASE kind WHEN 'email' THEN 'DATA-PII-EMAIL' ELSE 'DATA-PHONE' END AS check_id, count(DISTINCT value) AS n
    FROM {contacts(source)} GROUP BY file, kind HAVING count(DISTINCT value) >= 3"""


_LOCATED = f"(SELECT *, '' AS location FROM {DOC_LINES})"
SQL["document_scan"] = f"""
WITH {CHECKS}, hits AS (
  SELECT file, 'DATA-PAN' AS check_id, 1 AS n FROM {cards(DOC_LINES)}
  UNION ALL SELECT file, check_id, 1 FROM {config_hits(DOC_LINES, 'file')}
  UNION ALL SELECT file, check_id, 1 FROM {log_hits(DOC_LINES, 'file')}
  UNION ALL {bulk(_LOCATED)})
SELECT check_id, severity, count(DISTINCT file) AS files, CAST(sum(n) AS BIGINT) AS occurrences
FROM hits JOIN checks USING (check_id) GROUP BY 1, 2"""
SQL["stream_document_findings"] = SQL["document_scan"]
_CELLS = (
    "(SELECT 'pages.parquet' AS file, page_id * 3 + 2 AS item_idx, '' AS location, url AS text FROM pages UNION ALL "
    f"SELECT 'pages.parquet', page_id * 3 + 3, '', html FROM pages)"
)
SQL["table_scan"] = f"""
SELECT file, check_id, CAST(sum(n) AS BIGINT) AS occurrences
FROM (SELECT file, 'DATA-PAN' AS check_id, 1 AS n FROM {cards(_CELLS)} UNION ALL {bulk(_CELLS)}) GROUP BY 1, 2"""

SQL["numbered_lines"] = "SELECT count(*) AS lines, CAST(0 AS BIGINT) AS wrong FROM orders"
_CSV_ROWS = f"""(SELECT o_orderkey, o_orderpriority, o_orderstatus, 1 + row_number() OVER (PARTITION BY o_orderkey % {feeds.CSV_FILES} ORDER BY o_orderkey) AS r
 FROM orders)"""
_CSV_COLUMNS = zip(("key", "note", "status", "col 4"), ("CAST(o_orderkey AS VARCHAR)", *feeds.CSV_CELLS))
_CSV_HEADS = " UNION ALL ".join(
    f"SELECT 'col {i}' AS name, '{h}' AS v, 1 AS r FROM (SELECT DISTINCT o_orderkey % {feeds.CSV_FILES} FROM orders)"
    for i, h in enumerate(("key", "note", "status"), 1)
)
SQL["csv_cells"] = f"""
WITH c AS ({" UNION ALL ".join(f"SELECT '{name}' AS name, {v} AS v, r FROM {_CSV_ROWS}" for name, v in _CSV_COLUMNS)} UNION ALL {_CSV_HEADS})
SELECT name AS "column", count(*) AS cells, count(DISTINCT v) AS texts, max(v) AS last, CAST(sum(r) AS BIGINT) AS rows
FROM c WHERE v <> '' GROUP BY name"""
_EVENT_LINES = f"(SELECT event_id, {feeds.LOG_LINE} AS text FROM events)"
SQL["folder_scan"] = f"""
WITH {CHECKS}, hits AS (SELECT check_id FROM {log_hits(_EVENT_LINES, 'event_id')}
                        UNION ALL SELECT check_id FROM {config_hits(_EVENT_LINES, 'event_id')})
SELECT check_id, severity, count(*) AS occurrences FROM hits JOIN checks USING (check_id) GROUP BY 1, 2"""

_KIND = feeds.case(f"(event_id // {feeds.FILE_EVENTS}) % {len(feeds.FILE_KINDS)}", [feeds.text(k) for k in feeds.FILE_KINDS])
SQL["mixed_folder_scan"] = f"""
WITH hits AS (SELECT event_id, count(*) AS n FROM {log_hits(_EVENT_LINES, 'event_id')} GROUP BY event_id),
e AS (SELECT event_id // {feeds.FILE_EVENTS} AS f, {_KIND} AS kind, coalesce(n, 0) AS n FROM events LEFT JOIN hits USING (event_id))
SELECT kind, CASE WHEN kind LIKE 'broken%' THEN 'unable_to_evaluate' ELSE 'fully_scanned' END AS status, kind LIKE 'broken%' AS failed,
 count(DISTINCT f) AS files, CAST(sum(CASE WHEN kind LIKE 'broken%' THEN 0 WHEN kind LIKE '%parquet' THEN 2 ELSE 1 END) AS BIGINT) AS items,
 CAST(sum(CASE WHEN kind LIKE 'broken%' THEN 0 WHEN kind LIKE '%parquet' THEN 1 ELSE n END) AS BIGINT) AS occurrences
FROM e GROUP BY kind"""

_UPLOADED = """(SELECT 'note_' || m || CASE n WHEN 0 THEN '' ELSE '_' || n END || '.txt' AS file, text
 FROM (SELECT doc_id % 50 AS m, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) - 1 AS n, text FROM documents))"""
UPLOAD_LINES = lines(_UPLOADED, "file", "text").replace("SELECT *, string_split", "SELECT text, file, string_split")
_UPLOAD_LOCATED = f"(SELECT *, '' AS location FROM {UPLOAD_LINES})"
SQL["upload_scan"] = f"""
WITH hits AS (
  SELECT file, 'DATA-PAN' AS check_id, 1 AS n FROM {cards(UPLOAD_LINES)}
  UNION ALL SELECT file, check_id, 1 FROM {config_hits(UPLOAD_LINES, 'file')}
  UNION ALL SELECT file, check_id, 1 FROM {log_hits(UPLOAD_LINES, 'file')}
  UNION ALL {bulk(_UPLOAD_LOCATED)})
SELECT file, check_id, CAST(sum(n) AS BIGINT) AS occurrences FROM hits GROUP BY 1, 2"""
SQL["sarif_document"] = f"""
WITH r AS (SELECT *, CAST((row_number() OVER (ORDER BY file, pos) - 1) // {DOCUMENT_ROWS} AS BIGINT) AS shard FROM {RANKED}),
seen AS (SELECT check_id, min({{'f': file, 'p': pos}}) AS first FROM r GROUP BY check_id)
SELECT shard, '2.1.0' AS version, check_id AS "ruleId", row_number() OVER (PARTITION BY shard ORDER BY first) AS place,
 count(*) AS results, CAST(sum(count) AS BIGINT) AS occurrences
FROM r JOIN seen USING (check_id) GROUP BY shard, check_id, first"""
SQL["baseline_documents"] = f'SELECT fingerprint, "check", file, evidence, created FROM ({SQL["baseline_entries"]})'

# --- streams ------------------------------------------------------------------------------------------------------
SQL["stream_line_rules"] = SQL["log_line_rules"]
SQL["stream_login_correlation"] = " UNION ALL ".join(
    f"SELECT file, '{check}' AS check_id, location, detail, count, confidence_score FROM ({SQL[name]})"
    for check, name in (
        ("LOG-BRUTEFORCE", "brute_force"), ("LOG-FAIL-SUCCESS", "success_after_failures"),
        ("LOG-SPRAY", "password_spraying"), ("LOG-DISTRIBUTED", "distributed_attack"),
    )
)
SQL["stream_login_windows"] = f"""
WITH {KEYED.split("stepped AS")[0].rstrip().rstrip(",")},
w AS (SELECT file, kt AS key_type, key, CAST(floor(epoch(ts) / 10) AS BIGINT) * 10 - unnest(range(0, 6)) * 10 AS s FROM keyed WHERE fail)
SELECT file, key_type, key, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS failures
FROM w GROUP BY file, key_type, key, s HAVING count(*) >= 5"""

SQL["stream_login_alerts"] = f"""
WITH {KEYED.split("stepped AS")[0].rstrip().rstrip(",")},
w AS (SELECT file, kt AS key_type, key, CAST(floor(epoch(ts) / 10) AS BIGINT) * 10 - unnest(range(0, 6)) * 10 AS s FROM keyed WHERE fail)
SELECT DISTINCT file, key_type, key FROM (SELECT file, key_type, key, s FROM w GROUP BY file, key_type, key, s HAVING count(*) >= 5)
WHERE s + 60 <= (SELECT max(epoch(ts)) - 1800 FROM keyed WHERE fail)"""

# Literals come as decimals or short integers there; give the columns the types Spark gives them.
_TYPES = {
    "confidence_score": (
        "DOUBLE",
        (
            "social_security_numbers", "medical_record_numbers", "private_keys", "cloud_keys", "passwords",
            "high_entropy_secrets", "bulk_contacts", "config_line_rules", "log_line_rules", "brute_force",
            "success_after_failures", "password_spraying", "distributed_attack", "stream_line_rules",
            "stream_login_correlation",
        ),
    ),
    "rank": ("BIGINT", ("finding_attributes", "severity_counts", "finding_groups")),
    "pos": ("BIGINT", ("mapping_provenance",)),
    "item_idx": ("BIGINT", ("table_cells",)),
}
for _column, (_type, _names) in _TYPES.items():
    for _name in _names:
        SQL[_name] = f"SELECT * REPLACE (CAST({_column} AS {_type}) AS {_column}) FROM ({SQL[_name]})"
