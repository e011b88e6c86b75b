"""Vectorised word and shingle hashes over the UTF-8 bytes of whole Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_pow = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """The base's first n powers modulo 2**64."""
    global _pow
    while len(_pow) < n:
        _pow = np.concatenate([_pow, _pow * np.uint64(pow(_BASE, len(_pow), 1 << 64))])
    return _pow


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tidy() -> None:
    """Give freed memory back to the system, as idle workers keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(batches: Iterator[pa.RecordBatch], every: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, with freed memory given back after each so many bytes and at the end."""
    seen = 0
    for b in batches:
        seen += b.nbytes
        yield b
        if seen > every:
            seen = 0
            tidy()
    tidy()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    column = pa.concat_arrays([column]) if column.offset else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes; a longer text stands alone."""
    if len(column) == 0:
        return
    _, offsets = utf8(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, len(column))
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of words between ASCII white space; first[i]:first[i+1] are the words of text i."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = ~_IS_SPACE[data[lo:hi]]
    edge = np.zeros(hi - lo + 1, bool)
    edge[offsets[:-1] - lo] = True
    before = np.concatenate([[False], inside[:-1]]) if hi > lo else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1])) + lo
    after = np.concatenate([inside[1:], [False]]) if hi > lo else inside
    ends = np.flatnonzero(inside & (~after | np.append(edge[1:-1], True))) + 1 + lo if hi > lo else starts
    return starts, ends, np.searchsorted(starts, offsets)


def _word_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sum over each word's bytes of the byte's number times a power of the base, its length)."""
    lens = ends - starts
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    rel = np.arange(int(lens.sum()), dtype=np.int32) - np.repeat(first, lens).astype(np.int32)
    b = data[rel + np.repeat(starts, lens)]
    if lower:
        b = _LOWER[b]
    return np.add.reduceat(_BYTE[b] * _powers(int(lens.max()) + 1)[rel], first), lens.astype(np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix(np.add(*_word_sums(data, starts, ends, lower)))


def long_text_hashes(text: np.ndarray, lower: bool, block: int = 1 << 19) -> np.ndarray:
    """word_hashes of one text, block by block: what is held beside the hashes does not grow with the text or its words."""
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        total, length = np.uint64(0), 0  # of the word that the block before left open
        for at in range(0, len(text), block):
            body = text[at : at + block]
            starts, ends, _ = word_spans(body, np.array([0, len(body)]))
            sums, lens = _word_sums(body, starts, ends, lower) if len(starts) else (np.zeros(0, np.uint64),) * 2
            if length and len(starts) and starts[0] == 0:
                sums[0] = total + sums[0] * np.uint64(pow(_BASE, length, 1 << 64))
                lens[0] += np.uint64(length)
            elif length:
                out.append(mix(np.array([total + np.uint64(length)], np.uint64)))
            total, length = np.uint64(0), 0
            if len(ends) and ends[-1] == len(body) and at + block < len(text):
                total, length = sums[-1], int(lens[-1])
                sums, lens = sums[:-1], lens[:-1]
            out.append(mix(sums + lens))
        if length:
            out.append(mix(np.array([total + np.uint64(length)], np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, by the position of the first."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(h)


def texts_words(column: pa.Array, lower: bool, size: int = 1 << 19) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order. A text of more than size bytes is hashed block by block."""
    data, offsets = utf8(column)
    for lo, hi in slices(column, size):
        if hi - lo == 1 and offsets[hi] - offsets[lo] > size:
            yield long_text_hashes(data[offsets[lo] : offsets[hi]], lower, size)
            continue
        starts, ends, first = word_spans(data, offsets[lo : hi + 1])
        hashes = word_hashes(data, starts, ends, lower)
        for i in range(hi - lo):
            yield hashes[first[i] : first[i + 1]]


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words make one shingle; no words, none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return mix(shingle_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(shingle_hashes(words, k))
