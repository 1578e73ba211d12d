"""Rules given as a table, any number of them searched in one pass.

Nearly every rule needs some fixed characters to match at all.  The longest of them go into
one automaton that finds all that occur in a text at once; only for those does the text
meet the full patterns.  Rules without fixed characters are tried on every text.  A rule that
is one word between word borders is looked up among the words of the text, and meets the
text as a pattern only where characters stand by it whose nature Java alone tells.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import patterns as P, text as X
from . import detect

#: Characters of patterns that are sent to all tasks together; more go in further passes.
SENT_CHARS = 4 << 20
#: Fixed characters below this number tell too little.
LEAST_LITERAL = 3
_QUANTIFIERS = "?*{"
_BREAKS = "^$."
_WORD_RULE = re.compile(r"\\b[0-9A-Za-z_]+\\b")
#: Stretches without an ASCII character that is none of a word, and those that are words in any reading.
_STRETCH = re.compile(r"[^\x00-/:-@\[-^`{-\x7f]+")
_SURE_WORD = re.compile(r"[0-9A-Z_a-zÀ-ÖØ-öø-ɏ]+")


def required_literal(pattern: str) -> str | None:
    """Characters, in lower case, that every match of the pattern holds one after the other; None where none are sure.

    Looks at the outermost level only: groups and classes end a run, and a choice between
    branches leaves nothing that is sure.  Only ASCII counts, whose cases are plain.
    """
    if "(?" in pattern and "x" in pattern[pattern.index("(?") :].split(")")[0].split(":")[0]:
        return None  # blanks may mean nothing
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        literal = ""
        if c == "\\":
            i += 1
            follows = pattern[i : i + 1]
            if follows == "Q":
                return None
            literal = follows if follows and not follows.isalnum() else ""
        elif c == "[":
            i += 1 + (pattern[i + 1 : i + 2] == "^")
            i += pattern[i : i + 1] == "]"
            inside = 1
            while i < len(pattern) and inside:
                inside += {"[": 1, "]": -1}.get(pattern[i], 0)
                i += 2 if pattern[i] == "\\" else 1
            i -= 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|":
            if depth == 0:
                return None
        elif c not in _BREAKS + _QUANTIFIERS + "+}":
            literal = c
        follows = pattern[i + 1 : i + 2]
        if depth == 0 and literal.isascii() and literal and not (follows and follows in _QUANTIFIERS):
            run += literal
            if follows == "+":
                runs, run = [*runs, run], ""
        else:
            runs, run = [*runs, run], ""
            if c == "{":
                i = max(pattern.find("}", i), i)
        i += 1
    best = max([*runs, run], key=len).lower()
    return best if len(best) >= LEAST_LITERAL else None


@dataclass(frozen=True)
class Rule:
    number: int
    check_id: str
    pattern: str
    detail: str


def _groups(rules: DataFrame) -> Iterator[list[Rule]]:
    """Rules by check, pattern and detail, in groups of bounded size."""
    group: list[Rule] = []
    size = 0
    ordered = rules.select("check_id", "pattern", F.coalesce("detail", F.lit("")).alias("detail")).distinct().orderBy("check_id", "pattern", "detail")
    for number, row in enumerate(ordered.toLocalIterator()):
        chars = len(row.pattern) + len(row.check_id) + len(row.detail)
        if group and size + chars > SENT_CHARS:
            yield group
            group, size = [], 0
        group.append(Rule(number, row.check_id, row.pattern, row.detail))
        size += chars
    if group:
        yield group


_BUILT: dict[str, tuple] = {}


def _automaton(literals: dict[str, list[int]]) -> object:
    import ahocorasick

    made = ahocorasick.Automaton()
    for literal, numbers in literals.items():
        made.add_word(literal, numbers)
    if literals:
        made.make_automaton()
    return made


def _automata(sent) -> tuple:
    """The words that were sent, and automata of them and of other characters, built once in each worker."""
    if sent.id not in _BUILT:
        words, literals = sent.value
        made = words, _automaton(words), _automaton(literals)
        _BUILT.clear()
        _BUILT[sent.id] = made
    return _BUILT[sent.id]


def _numbers(automaton, text: str) -> set[int]:
    return {n for _, numbers in automaton.iter(text) for n in numbers} if len(automaton) else set()


def _candidates(folded: str, words: dict[str, list[int]], among, others) -> tuple[list[int], list[int]]:
    """Numbers of rules that match for sure, and of those whose patterns have to tell.

    A stretch of word characters is a word as a whole.  In one with other characters beyond
    ASCII, marks or letters of other scripts, words may begin and end in its midst.
    """
    tried = _numbers(others, folded)
    stretches = set(_STRETCH.findall(folded)) if words else set()
    sure = {n for w in stretches & words.keys() for n in words[w]}
    for mixed in stretches:
        if not mixed.isascii() and not _SURE_WORD.fullmatch(mixed):
            tried |= _numbers(among, mixed)
    return sorted(sure), sorted(tried - sure)


class _Sent:
    """A broadcast value and a name no other has: workers outlive a table of rules."""

    def __init__(self, broadcast) -> None:
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _searched(items: DataFrame, group: list[Rule], year: int) -> DataFrame:
    spark = items.sparkSession
    words: dict[str, list[int]] = {}
    literals: dict[str, list[int]] = {}
    always = []
    for rule in group:
        literal = required_literal(rule.pattern)
        known = words if literal and _WORD_RULE.fullmatch(rule.pattern) else literals
        known.setdefault(literal, []).append(rule.number) if literal else always.append(rule.number)
    sent = _Sent(spark.sparkContext.broadcast((words, literals)))

    def candidates(folded: pd.Series) -> pd.DataFrame:
        rows = [([], []) if t is None else _candidates(t, *_automata(sent)) for t in folded]
        return pd.DataFrame(rows, columns=["sure", "open"])

    carried = [c for c in items.columns if c != "text"]
    lines = items.withColumn("_fold", P.fold(F.col("text"))).withColumn("_strip", X.strip(F.col("text")))
    some = F.pandas_udf(candidates, "sure array<int>, open array<int>")(F.col("_fold"))
    told = lines.select(*carried, "text", "_strip", P.is_ascii(F.col("_strip")).alias("_plain"), some.alias("_c"))
    tried = F.concat("_c.open", F.array(*[F.lit(n) for n in always]).cast("array<int>"))
    pair = lambda sure: lambda n: F.struct(n.alias("_rule"), F.lit(sure).alias("_sure"))
    pairs = F.concat(F.transform("_c.sure", pair(True)), F.transform(tried, pair(False)))
    met = told.select(*carried, "text", "_strip", "_plain", F.inline(pairs))
    rows = [(r.number, r.check_id, r.pattern, r.detail) for r in group]
    table = spark.createDataFrame(rows, "_rule int, _check string, _pattern string, _detail string")
    full = F.concat(F.when(F.col("_plain"), "(?id)").otherwise("(?iUd)"), F.col("_pattern"))
    # The group is of bounded size.
    matched = met.join(F.broadcast(table), "_rule").filter(F.when(F.col("_sure"), True).otherwise(F.regexp_like("_strip", full)))
    hit = detect._hit("finding", detect.DET["rule"], None, "config", k=F.col("_rule"), detail=F.col("_detail"))
    return matched.select(*carried, "text", "_check", hit.alias("_hit")).select(*carried, "text", "_check", "_hit.*").withColumn(
        "check_id", F.col("_check")).select(*carried, *detect._found_columns(year))


def rule_signals(items: DataFrame, rules: DataFrame, *, year: int) -> DataFrame:
    """What rules (check_id, pattern, detail) find in items, one row per item and rule, as `detect.signals` gives it.

    Patterns are Java regular expressions, case ignored.  Rules that are repeated count
    once.  The table of rules passes through the driver, its items never.
    """
    parts = [_searched(items, group, year) for group in _groups(rules)]
    if not parts:
        return detect.signals(items, year=year, families=("log",)).filter(F.lit(False))
    return reduce(DataFrame.unionByName, parts)
