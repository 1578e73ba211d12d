"""Vectorised steps over the UTF-8 bytes of many texts at once: words and their hashes.

Texts come as one buffer of bytes plus the places where each begins, as Arrow
keeps them.  A word is a run of bytes of one class; a hash of 64 bits stands for
its (folded) bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Words that white space parts.
WORDS = ~SPACE
#: Words of ASCII letters, digits and whatever is not ASCII.
LETTERS = np.array([48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; a one-to-one map."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _tables or len(_tables["up"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _ODD), ("down", _BACK)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["up"], _tables["down"]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about `limit` bytes: first row, row after the last, bytes, begins (one more than rows).

    A text is never cut: one longer than the limit comes alone.
    """
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(inside: np.ndarray, begins: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of each run of true bytes; runs end with their text, and where `part` changes."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, dtype=bool)
    edge[begins] = True
    edge[0] = edge[n] = True
    if part is not None:
        edge[1:n] |= part[1:] != part[:-1]
    opens = inside & edge[:-1]
    opens[1:] |= inside[1:] & ~inside[:-1]
    closes = inside & edge[1:]
    closes[:-1] |= inside[:-1] & ~inside[1:]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(begins, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run (runs in order, none overlapping)."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        upto = max(int(np.searchsorted(end, start[at] + CHUNK, "right")), at + 1)
        base, stop = int(start[at]), int(end[upto - 1])
        up, down = _powers(stop - base + 1)
        total = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum(_VALUES[data[base:stop]] * up[: stop - base], out=total[1:])
        s, e = start[at:upto] - base, end[at:upto] - base
        out[at:upto] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _ODD)
        at = upto
    return out


def words(data: np.ndarray, begins: np.ndarray, inside: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of texts, letters A-Z folded."""
    start, end, text = runs(inside[data], begins)
    return hashes(LOWER[data], start, end), text


def shingles(word: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of `width` words within a text; a shorter text, if not empty, is one run."""
    n = len(word)
    if not n:
        return word, text
    out, owner = [], []
    if n >= width:
        h = np.zeros(n - width + 1, dtype=np.uint64)
        for j in range(width):
            h = h * _ODD + word[j : n - width + 1 + j]
        whole = text[: n - width + 1] == text[width - 1 :]
        out.append(mix(h[whole] + np.uint64(width)))
        owner.append(text[: n - width + 1][whole])
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[first, n])
    short = np.flatnonzero(size < width)
    if len(short):
        h = np.zeros(len(short), dtype=np.uint64)
        for j in range(width - 1):
            on = size[short] > j
            h[on] = h[on] * _ODD + word[first[short[on]] + j]
        out.append(mix(h + size[short].astype(np.uint64)))
        owner.append(text[first[short]])
    h, t = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(t, kind="stable")
    return h[order], t[order]


def packed(bucket: np.ndarray, *columns: np.ndarray) -> tuple[pa.Array, list[pa.Array]]:
    """The buckets that occur, and each column's bytes by bucket, in the order given within one."""
    order = np.argsort(bucket, kind="stable")
    which, first = np.unique(bucket[order], return_index=True)
    parts = [[p.tobytes() for p in np.split(c[order], first[1:])] if len(which) else [] for c in columns]
    return pa.array(which, pa.int32()), [pa.array(p, pa.binary()) for p in parts]
