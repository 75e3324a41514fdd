"""Whole-text word hashing on Arrow batches, vectorised over bytes.

Spark partitions the documents; inside a task these helpers turn an Arrow string column into
words and 64-bit word hashes without a Python loop over words.  A chunk holds whole documents of
about ``CHUNK_BYTES`` together (a longer document is a chunk of its own), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

# Workers live on between tasks: what a batch took goes back to the system, not into a pool of the worker's own.
pa.set_memory_pool(pa.system_memory_pool())

_BASE = 0x9E3779B97F4A7C15
#: Bytes of spans that are hashed at a time, which bounds memory even for one very long span.
_BLOCK = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (splitmix finaliser)."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and the value each contributes to a word's hash."""

    inside: np.ndarray
    value: np.ndarray


def alphabet(separators: bytes, fold_case: bool) -> Alphabet:
    """Words are the runs of bytes outside ``separators``; ``fold_case`` maps A-Z to a-z."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    of = np.arange(256)
    if fold_case:
        of[65:91] += 32
    return Alphabet(inside, np.where(inside, mix(of.astype(np.uint64), 7) | np.uint64(1), np.uint64(0)))


#: ASCII white space separates words: [^\x20\x09-\x0D]+
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Everything in ASCII but letters and digits separates words.
ASCII_PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())


@dataclass(frozen=True)
class Words:
    """Words of a chunk in order; ``bounds[i]:bounds[i + 1]`` are the words of its document i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, of: Alphabet) -> Words:
    """The words of a chunk.  Words never run across documents."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = of.inside[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(start, end, span_hashes(data, start, end, of), np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, of: Alphabet, seed: int = 0) -> np.ndarray:
    """A hash of the bytes ``start`` to ``end`` of each span, equal wherever the span stands; each ``seed`` gives another.

    It adds up a mix of every byte with its place in the span, so that no arithmetic of sequences (as of Thue-Morse
    words in polynomials modulo 2^64) makes two spans alike; the length goes in too.
    """
    length = end - start
    upto = np.cumsum(length)
    before = upto - length
    sums = np.zeros(len(start), np.uint64)
    step, salt = np.uint64(_BASE), np.uint64((seed * 0xD6E8FEB86659FD93) & (2**64 - 1))
    for lo in range(0, int(upto[-1]) if len(upto) else 0, _BLOCK):
        hi = min(lo + _BLOCK, int(upto[-1]))
        first, last = int(np.searchsorted(upto, lo, "right")), int(np.searchsorted(before, hi, "left"))
        spans = first + np.flatnonzero(length[first:last])
        from_, to = np.maximum(before[spans], lo), np.minimum(upto[spans], hi)
        place = np.arange(lo, hi) - np.repeat(before[spans], to - from_)
        values = of.value[data[place + np.repeat(start[spans], to - from_)]]
        values += place.view(np.uint64) * step + salt
        sums[spans] += np.add.reduceat(mix(values), from_ - lo)
    return mix(sums + length.astype(np.uint64) * step, 1 + seed)


def windows(hashes: np.ndarray, offsets_in_window: list[int]) -> np.ndarray:
    """A hash for each window start i of the words at ``i + o``; windows may run across documents."""
    span = max(offsets_in_window) + 1
    m = max(0, len(hashes) - span + 1)
    total = np.zeros(m, np.uint64)
    for k, o in enumerate(offsets_in_window):
        total += hashes[o : o + m] * np.uint64((_BASE * (2 * k + 3)) & (2**64 - 1) | 1)
    return mix(total, 2 + len(offsets_in_window))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct ``size``-word shingles of one document's word hashes.

    Fewer words make one shingle, the whole sequence; no words make none.
    """
    if not len(h):
        return h
    s = np.sort(windows(h, list(range(min(size, len(h))))))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]
