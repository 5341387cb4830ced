"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that one step works on: bounds memory, keeps arrays in cache
STEP = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words of everything but space, tab, newline, vertical tab, form feed and carriage return
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: words of ASCII letters, digits and all that is not ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        _POW[0] = _powers(_BASE, n)
        _POW[1] = _powers(pow(_BASE, -1, 1 << 64), n)
    return _POW


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and len+1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about STEP, cut where no word is cut."""
    at, end = 0, len(data)
    starts = offsets[:-1]
    while at < end:
        to = min(end, at + STEP)
        if to < end:
            k = int(starts[np.searchsorted(starts, to, "right") - 1])
            if k > at:
                to = k
            else:
                while to < end and is_word[data[to]]:
                    to += 1
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``; for each text, the number of its first word."""
    starts, ends = [], []
    for a, b in _pieces(data, offsets, is_word):
        w = is_word[data[a:b]]
        edge = offsets[(offsets > a) & (offsets < b)] - a
        new = w.copy()
        new[1:] &= ~w[:-1]
        new[edge] = w[edge]
        last = w.copy()
        last[:-1] &= ~w[1:]
        last[edge - 1] = w[edge - 1]
        starts.append(np.flatnonzero(new) + a)
        ends.append(np.flatnonzero(last) + a + 1)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    e = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word (of its first ``most`` bytes); for each text, the number of its first word."""
    s, e, first = word_spans(data, offsets, is_word)
    if most is not None:
        e = np.minimum(e, s + most)
    out = np.empty(len(s), np.uint64)
    for a, b in _pieces(data, offsets, is_word):
        i, j = np.searchsorted(s, (a, b))
        if i == j:
            continue
        up, down = _tables(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((LOWER[data[a:b]].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        x, y = s[i:j] - a, e[i:j] - a
        out[i:j] = mix((sums[y] - sums[x]) * down[x] + (y - x).astype(np.uint64))
    return out, first


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one shingle."""
    n = len(words)
    whole = np.zeros(max(0, n - k + 1), np.uint64)
    for d in range(k if n >= k else 0):
        whole += words[d : n - k + 1 + d] * _MULT[d]
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _MULT[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out
