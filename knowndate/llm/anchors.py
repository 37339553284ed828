"""Content-defined anchors: which windows of a unit sequence belong together, and hashes of any stretch (numpy, in tasks).

A unit is one 64-bit value per position (a word's hash, or the hash of the eight bytes that start there). The anchor of
a window is the position in it whose gram hash is smallest, the leftmost of equal ones. It depends on nothing but the
window's content, so equal windows have equal grams at their anchors, at the same distance. Consecutive windows with
one anchor form a segment.
"""

from __future__ import annotations

import numpy as np

from knowndate.llm.hashing import K3, U, mix, multipliers

#: Longest stretch hashed at once; longer texts are worked off in parts that overlap by a window.
PART = 1 << 20
PLACE_BITS = 30
PLACE = U((1 << PLACE_BITS) - 1)
BASE = int(K3) | 1

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0..BASE^(n-1) and their inverses modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 14)
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, BASE, dtype=U)]))
            back = U(pow(BASE, -1, 1 << 64))
            down = np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, back, dtype=U)]))
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


class Stretches:
    """Hashes of stretches [start, end) of a unit array."""

    def __init__(self, units: np.ndarray):
        up, self.down = powers(len(units) + 1)
        self.sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(units * up[: len(units)], dtype=U)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def gram_hashes(units: np.ndarray, gram: int, stride: int) -> np.ndarray:
    """Hash of ``gram`` units at distance ``stride`` from each position."""
    n = len(units) - (gram - 1) * stride
    if n <= 0:
        return np.zeros(0, dtype=U)
    total = np.zeros(n, dtype=U)
    for k, m in enumerate(multipliers(gram)):
        total += units[k * stride : k * stride + n] * m
    return mix(total)


def smallest_in(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by running minima inside blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=U)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(grams: np.ndarray, places: int) -> np.ndarray:
    """The anchor of each window; a window has ``places`` gram places."""
    if len(grams) < places:
        return np.zeros(0, dtype=np.int64)
    placed = (grams & ~PLACE) | np.arange(len(grams), dtype=U)
    return (smallest_in(placed, places) & PLACE).astype(np.int64)
