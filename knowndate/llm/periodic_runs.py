"""Periodic runs of words by longest common extensions in suffix trees.

1. Words that occur once in a stretch cannot lie in a run (each word of a run stands again one period away), so a text
   is first cut at them, again and again up to ``ROUNDS`` times. What is left, hardly anything in plain prose, goes on;
   a cut never lies inside a run, and no neighbour beyond a cut can extend one.
2. A suffix tree of the stretch and one of its reversal are built online (Ukkonen). An Euler tour with sorted children
   gives the rank of every suffix and the string depths met between neighbouring leaves; a sparse table of their minima
   answers lowest common ancestors, hence longest common extensions, in constant time.
3. For the order of the words and for its reverse, the longest Lyndon word that starts at each word is found from the
   ranks. Every run has such a word as a root (the runs theorem), so at most 2n candidates are extended to the left and
   to the right. A candidate at least twice as long as its root is a run, and the root's length its smallest period.

A text is one row's work: time is n log n and memory about a kilobyte per word of its longest stretch, whatever the
other rows hold; there is no shuffle.

Words are runs of characters other than white space (space, tab, line feed, VT, FF, CR). Defined cases: NULL, empty and
blank texts have no runs and collapse to an empty text; repeated rows and repeated or NULL ids are rows of their own; no
rows give no rows; other columns pass through, those named like a result (``runs``, ``collapsed``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from knowndate.llm.hashing import sliced

#: Shortest run in words, and how often a stretch is cut at its single words before it is taken as it is.
SHORTEST, ROUNDS = 12, 12
#: The mark behind the last word: smaller than every word, in both orders.
END = -1

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def stretches(ids: np.ndarray, shortest: int) -> Iterator[tuple[int, int]]:
    """Parts of ``ids`` that hold all runs of ``shortest`` words or more, with their places on both sides cut."""
    todo = [(0, len(ids), 0)]
    while todo:
        lo, hi, cuts = todo.pop()
        if hi - lo < shortest:
            continue
        _, which, n = np.unique(ids[lo:hi], return_inverse=True, return_counts=True)
        single = np.flatnonzero(n[which] == 1)
        if not len(single) or cuts == ROUNDS:
            yield lo, hi
        else:
            edges = [lo - 1, *(single + lo).tolist(), hi]
            todo += [(a + 1, b, cuts + 1) for a, b in zip(edges, edges[1:]) if b - a > shortest]


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers >= 0, closed by ``END``; the root is node 0."""

    def __init__(self, numbers: list[int]):
        self.text = text = [*numbers, END]
        size = len(text)
        self.start, self.stop, self.kids = start, stop, kids = [0], [0], [{}]
        link = [0]
        node, edge, along, waiting = 0, 0, 0, 0  # the active point, and suffixes not yet in the tree
        for i, number in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not along:
                    edge = i
                first = text[edge]
                child = kids[node].get(first)
                if child is None:
                    kids[node][first] = len(start)
                    start.append(i), stop.append(size), link.append(0), kids.append(None)
                    link[unlinked], unlinked = node, 0
                else:
                    at = start[child]
                    length = stop[child] - at
                    if along >= length:
                        node, edge, along = child, edge + length, along - length
                        continue
                    if text[at + along] == number:
                        link[unlinked] = node
                        along += 1
                        break
                    middle = len(start)
                    start.append(at), stop.append(at + along), link.append(0)
                    kids.append({number: middle + 1, text[at + along]: child})
                    start.append(i), stop.append(size), link.append(0), kids.append(None)
                    kids[node][first] = middle
                    start[child] = at + along
                    link[unlinked], unlinked = middle, middle
                waiting -= 1
                if node:
                    node = link[node]
                elif along:
                    along, edge = along - 1, i - waiting + 1

    def tour(self, falling: bool = False) -> tuple[list[int], list[int]]:
        """Euler tour: (suffixes in the order of their leaves, least string depth met since the leaf before).

        ``falling`` takes words in falling order; a prefix stays smaller than what it begins.
        """
        start, stop, kids, size = self.start, self.stop, self.kids, len(self.text)
        order, depths, low = [], [], size
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if depth < low:
                low = depth
            depth += stop[node] - start[node]
            below = kids[node]
            if below is None:
                order.append(size - depth)
                depths.append(low)
                low = size
            else:
                words = sorted(below, key=_last_falling) if falling else sorted(below, reverse=True)
                stack += [(below[word], depth) for word in words]  # the last one is met first
        return order, depths


def _last_falling(word: int) -> float:
    return word if word >= 0 else float("inf")


class Extensions:
    """Longest common extensions of suffixes, from the leaves of a tour and the depths between them."""

    def __init__(self, order: list[int], depths: list[int]):
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.levels = [np.array(depths, dtype=np.int32)]
        while 1 << len(self.levels) <= len(order):
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def __call__(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Common length of the suffixes that start at ``one`` and ``other`` (different places)."""
        a, b = self.rank[one], self.rank[other]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            depths = self.levels[k]
            out[at] = np.minimum(depths[low[at]], depths[high[at] - (1 << int(k)) + 1])
        return out


def lyndon_ends(rank: list[int]) -> list[int]:
    """For each place the end of the longest Lyndon word that starts there: the next smaller suffix."""
    end = [len(rank)] * len(rank)
    for i in range(len(rank) - 2, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = end[j]
        end[i] = j
    return end[:-1]


def runs_of(numbers: list[int]) -> np.ndarray:
    """All runs of a sequence of numbers >= 0: rows (start, length, period), by start, then period."""
    n = len(numbers)
    if n < 2:
        return np.zeros((0, 3), dtype=np.int64)
    tree = SuffixTree(numbers)
    order, depths = tree.tour()
    forward = Extensions(order, depths)
    ranks = [forward.rank.tolist()]
    falling = np.empty(n + 1, dtype=np.int64)
    falling[tree.tour(falling=True)[0]] = np.arange(n + 1)
    ranks.append(falling.tolist())
    del tree
    backward = Extensions(*SuffixTree(numbers[::-1]).tour())
    start = np.tile(np.arange(n), 2)
    end = np.concatenate([np.array(lyndon_ends(rank), dtype=np.int64) for rank in ranks])
    period = end - start
    left, right = backward(n - start, n - end), forward(start, end)
    length = left + period + right
    found = np.stack([start - left, length, period], axis=1)[length >= 2 * period]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def word_runs(words: list[bytes], shortest: int = SHORTEST) -> np.ndarray:
    """Runs of a text's words of at least ``shortest`` words: rows (start, length, period), by start, then period."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for lo, hi in stretches(ids, shortest):
        runs = runs_of(ids[lo:hi].tolist())
        found.append(runs[runs[:, 1] >= shortest] + np.array([lo, 0, 0]))
    found = np.concatenate(found)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)])


def find_runs(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period in words; by start, then period) and ``collapsed`` (text)."""
    rows = docs.drop("runs", "collapsed")
    out = T.StructType([
        *rows.schema.fields, T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())
    ])

    def run(batches):
        for batch in sliced(batches):
            found, texts = [], []
            for text in batch.column(text_col).cast(pa.binary()).to_pylist():
                words = (text or b"").split()  # of bytes: cut at exactly the six characters above
                runs = word_runs(words, shortest)
                found.append(runs)
                texts.append(collapsed(words, runs))
            flat = np.concatenate([np.zeros((0, 3), dtype=np.int64), *found])
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], [f.name for f in RUN.fields])
            yield batch.append_column("runs", pa.ListArray.from_arrays(pa.array(offsets), each)).append_column(
                "collapsed", pa.array(texts, pa.binary()).cast(pa.string())
            )

    return rows.mapInArrow(run, out)
