"""Language identification as inference of a mixture.

Each language is a distribution over byte trigrams of words, learned from labelled
texts.  A text's words are draws from a mixture of languages; expectation-
maximisation finds its proportions.  Which languages take part is settled by
penalised likelihood: the set grows in order of the proportions while the gain in
log likelihood exceeds a penalty for each further language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, text_of
from .textbytes import LOWER, chunks, runs

#: Trigrams are hashed to so many buckets; a language's model is that many numbers.
BUCKETS = 1 << 16
#: Added to each count.
SMOOTH = 0.1
#: Languages a model may have: it is sent to every task, 4 * BUCKETS bytes for each.
MOST_LANGUAGES = 400
#: Log likelihood that a further language has to gain, times the logarithm of the words.
PENALTY = 2.0
STEPS = 12
#: What a text is called that is null or has no letter.
UNKNOWN = "und"
#: A mixture's leading language must hold this share for the text to be kept by `identified`.
LEAST_SHARE = 0.3

_LETTER = np.array([97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in range(256)])
_LETTERS_AT_ONCE = 1 << 21


def _trigrams(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter; first letter and text number of each word."""
    inside = _LETTER[data]
    start, end, text = runs(inside, begins)
    low = np.where(inside, LOWER[data], 32).astype(np.uint32)
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    if len(low):
        before[start], after[end - 1] = 32, 32
    key = ((before << np.uint32(16)) | (low << np.uint32(8)) | after)[inside] * np.uint32(0x9E3779B1)
    size = end - start
    return (key >> np.uint32(16)).astype(np.int64), np.cumsum(size) - size, text


def learn(documents: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and a table of log probabilities (bucket, language), from rows whose text and lang are not null."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"]
                )
            sums.clear()

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, last, data, begins in chunks(batch.column(1)):
                key, word, text_no = _trigrams(data, begins)
                owner = np.repeat(text_no, np.diff(np.r_[word, len(key)]))
                own = np.array([names[first + i] for i in range(last - first)], dtype=object)
                for name in set(own.tolist()):
                    got = np.bincount(key[(own == name)[owner]], minlength=BUCKETS)
                    sums[name] = sums[name] + got if name in sums else got
            if len(sums) > 32:
                yield from flush()
        yield from flush()

    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r.lang for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = counts.toArrow()
    number = {name: i for i, name in enumerate(names)}
    n = np.zeros((BUCKETS, len(names)))
    n[np.asarray(table["bucket"]), np.array([number[x] for x in table["lang"].to_pylist()], dtype=int)] = np.asarray(table["n"])
    return names, np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32)


def _word_scores(table: np.ndarray, key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.empty((len(word), table.shape[1]), dtype=np.float32)
    most = max(1, _LETTERS_AT_ONCE // table.shape[1])
    at = 0
    while at < len(word):
        upto = max(int(np.searchsorted(word, word[at] + most, "right")) - 1, at + 1)
        stop = word[upto] if upto < len(word) else len(key)
        out[at:upto] = np.add.reduceat(table[key[word[at] : stop]], word[at:upto] - word[at], axis=0)
        at = upto
    return out


def _proportions(logp: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for many texts at once: proportions and log likelihood of each.

    `first` is each text's first word, `allowed` (text, language) the set of each.
    """
    size = np.diff(np.r_[first, len(logp)])
    top = logp.max(axis=1, keepdims=True)
    p = np.exp(logp - top)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(STEPS):
        each = p * np.repeat(share, size, axis=0).astype(np.float32)
        each /= np.maximum(each.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(each, first, axis=0, dtype=np.float64) / size[:, None]
    like = np.log(np.maximum((p * np.repeat(share, size, axis=0)).sum(axis=1), 1e-30)) + top[:, 0]
    return share, np.add.reduceat(like, first, dtype=np.float64)


def _infer(logp: np.ndarray, text: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that have words; leading language and its proportion in each one's chosen set."""
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[first, len(text)])
    n, languages = len(first), logp.shape[1]
    share, like = _proportions(logp, first, np.ones((n, languages)))
    order = np.argsort(-share, axis=1, kind="stable")
    alone = np.add.reduceat(logp, first, axis=0, dtype=np.float64)
    lead = alone.argmax(axis=1)
    best, chosen = alone.max(axis=1), np.ones(n)
    cost = penalty * np.log(size + 1.0)
    # No set can gain more than the whole one does, so only texts that gain a penalty by that are looked at further.
    open_ = np.flatnonzero(like - best > cost)
    for k in range(2, languages + 1):
        if not len(open_):
            break
        words = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in open_])
        allowed = np.zeros((len(open_), languages))
        np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
        part, gained = _proportions(logp[words], np.cumsum(size[open_]) - size[open_], allowed)
        better = gained - best[open_] > cost[open_]
        now = open_[better]
        best[now], lead[now], chosen[now] = gained[better], part[better].argmax(axis=1), part[better].max(axis=1)
        # The second language may gain only together with a third, so texts go on until a set of three fails.
        open_ = now if k > 2 else open_
    return text[first], lead, chosen


def identify(documents: DataFrame, names: list[str], table: np.ndarray, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """`documents` with lang_pred and score (the leading language's proportion); columns of those names are replaced.

    A text that is null or has no letter is `und` with score 0, as is any text where
    no language was learned.  Every row gives one row; texts are used whole.
    """
    spark = documents.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((names, table))
    usable = F.when(F.col(text).cast("string").rlike(r"\p{L}"), text_of(text)).otherwise("").alias("_text")
    kept = documents.drop("lang_pred", "score").select("*", usable)
    schema = kept.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        for batch in batches:
            told, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for at, _, data, begins in chunks(batch.column(batch.num_columns - 1)) if names else ():
                key, word, owner = _trigrams(data, begins)
                if len(word):
                    which, lead, share = _infer(_word_scores(table, key, word), owner, penalty)
                    score[at + which] = np.clip(share, 0, 1)
                    for i, language in zip((at + which).tolist(), lead.tolist(), strict=True):
                        told[i] = names[language]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(told, pa.string()), pa.array(score)], names=schema.names
            )

    return kept.mapInArrow(predict, schema)


def identified(documents: DataFrame, training: DataFrame) -> DataFrame:
    """The documents whose language can be told: not `und`, and one language holds at least `LEAST_SHARE` of the words."""
    names, table = learn(training)
    told = identify(documents, names, table)
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*documents.columns)
