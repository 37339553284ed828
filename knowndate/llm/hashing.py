"""Vectorised hashing of words and word n-grams for code that runs inside tasks (numpy over Arrow buffers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Multipliers of the mixing steps (odd 64-bit constants).
K1, K2, K3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
CHUNK = 1 << 20

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Low ``k`` bytes of a little-endian 8-byte load.
LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * K1
    x = x ^ (x >> U(27))
    x = x * K2
    return x ^ (x >> U(31))


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * K3) | U(1)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and n + 1 offsets into them; NULL counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def eights(data: np.ndarray) -> np.ndarray:
    """At every position the 8 bytes that start there, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def hash_runs(loads: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One 64-bit hash per byte run."""
    h = mix((loads[starts] & LOW_BYTES[np.minimum(lengths, 8)]) ^ (lengths.astype(U) * K3))
    at, done = np.flatnonzero(lengths > 8), 8
    while len(at):
        part = loads[starts[at] + done] & LOW_BYTES[np.minimum(lengths[at] - done, 8)]
        h[at] = mix(h[at] * K3 + part)
        done += 8
        at = at[lengths[at] > done]
    return h


def sliced(batches, rows: int = 250):
    """The record batches in slices of few rows, so that working arrays stay small."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def runs(member: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run also ends before each position in ``breaks``."""
    cut = np.zeros(len(member) + 1, dtype=bool)
    cut[breaks] = True
    before = np.concatenate([[False], member[:-1]])
    behind = np.concatenate([member[1:], [False]])
    return np.flatnonzero(member & (~before | cut[:-1])), np.flatnonzero(member & (~behind | cut[1:])) + 1


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``CHUNK`` that end at white space or between texts."""
    at, end = 0, len(data)
    while at < end:
        stop = min(at + CHUNK, end)
        while stop < end:
            k = int(np.searchsorted(offsets, stop))
            edge = int(offsets[k]) if k < len(offsets) else end
            blank = np.flatnonzero(BLANK[data[stop : min(edge, stop + CHUNK)]])
            if len(blank):
                stop += int(blank[0])
                break
            if edge <= stop + CHUNK:
                stop = edge
                break
            stop += CHUNK
        yield at, stop
        at = stop


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and n + 1 offsets that say which belong to which text.

    Works through the bytes in ranges of bounded size, so a very long text costs eight bytes a word.
    """
    data, offsets = raw(column)
    found, firsts = [], []
    for at, stop in pieces(data, offsets):
        part = LOWER[data[at:stop]] if lower else data[at:stop]
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, side="right")] - at
        starts, ends = runs(~BLANK[part], inside)
        found.append(hash_runs(eights(part), starts, ends - starts))
        firsts.append(starts + at)
    if not found:
        return np.zeros(0, dtype=U), np.zeros(len(offsets), dtype=np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(firsts), offsets)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words of one text (none if it is shorter)."""
    if len(words) < n:
        return np.zeros(0, dtype=U)
    last = len(words) - n + 1
    total = np.zeros(last, dtype=U)
    for k, m in enumerate(multipliers(n)):
        total += words[k : k + last] * m
    return mix(total)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return np.zeros(0, dtype=U)
    if len(words) < n:
        return mix(np.array([(words * multipliers(len(words))).sum(dtype=U) + U(len(words))], dtype=U) ^ K3)
    return np.unique(grams(words, n))
