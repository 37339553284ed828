"""Which windows of fixed length occur more than once in a corpus, exactly and without listing all windows.

Texts are cut at content-defined anchors (see ``anchors``). A segment, the windows that share an anchor, is looked at
as a whole first, and in finer pieces only where that leaves a doubt:

1. Segments with equal content are repeated, all windows of them. A segment whose anchor gram is unique holds no
   repeated window. Segments that share a gram but differ go on, one of each content.
2. Their windows are dealt into cells of ``cell`` neighbouring distances to the anchor. The stretch that all windows
   of a cell have in common decides in the same way: unique, equal, or shared by cells that differ.
3. Windows of the cells in doubt are compared one by one.

Groups are counted on the map side first and joined back on hashes, so a gram or passage that a third of all texts
share is no hot task; rows are 64-bit hashes and positions. Two different contents collide with odds n*n / 2^65.
A Bloom filter of fixed size tells which texts' segments to cut up again; what it lets through by error changes
nothing but the amount of work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowndate.llm.anchors import PART, Stretches, anchors_of, gram_hashes
from knowndate.llm.bloom import likely, passes, sent
from knowndate.llm.frames import written
from knowndate.llm.hashing import K1, K3, U, eights, mix, raw, sliced, word_hashes


@dataclass(frozen=True)
class Bytes:
    """Windows of ``window`` bytes; the unit at a position is the hash of its eight bytes."""

    window: int = 200
    gram: int = 3
    stride: int = 8
    cell: int = 24

    @property
    def units(self) -> int:
        return self.window - 7

    @property
    def places(self) -> int:
        return self.window - self.gram * self.stride + 1

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return raw(column)

    def unit_array(self, flat: np.ndarray) -> np.ndarray:
        return mix(eights(flat)[: max(len(flat) - 7, 0)])


@dataclass(frozen=True)
class Words:
    """Windows of ``window`` words; the unit at a position is the word's hash."""

    window: int = 35
    gram: int = 4
    stride: int = 1
    cell: int = 1

    @property
    def units(self) -> int:
        return self.window

    @property
    def places(self) -> int:
        return self.window - self.gram + 1

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes(column)

    def unit_array(self, flat: np.ndarray) -> np.ndarray:
        return flat


def stretches_of(flat: np.ndarray, offsets: np.ndarray, use: np.ndarray, window: int):
    """(part, offsets in it, numbers of its texts, windows left out before it): whole texts together, or a part of one.

    Parts of a long text overlap such that each window lies in exactly one of them. Texts not in use have no length.
    """
    k, n = 0, len(offsets) - 1
    while k < n:
        last = max(int(np.searchsorted(offsets, offsets[k] + PART, side="right")) - 1, k + 1)
        text = flat[offsets[k] : offsets[last]]
        if len(text) <= PART:
            if use[k:last].any():
                yield text, offsets[k : last + 1] - offsets[k], np.arange(k, last), 0
        elif use[k]:
            windows = len(text) - window + 1
            for at in range(0, windows, PART):
                part = text[at : min(at + PART, windows) + window - 1]
                yield part, np.array([0, len(part)]), np.array([k]), at
        k = last


def cut(kind, flat: np.ndarray, offsets: np.ndarray, use: np.ndarray):
    """(first window, last window, anchor, gram at the anchor, hashes of stretches) of the segments of all used texts."""
    units = kind.unit_array(flat)
    grams = gram_hashes(units, kind.gram, kind.stride)
    anchor = anchors_of(grams, kind.places)
    start, end = offsets[:-1], offsets[1:] - kind.window + 1
    some = use & (end > start)
    edge = np.zeros(len(anchor) + 1, dtype=np.int32)
    np.add.at(edge, start[some], 1)
    np.add.at(edge, end[some], -1)
    inside = np.cumsum(edge[: len(anchor)]) > 0  # windows that lie in one text
    new = inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~inside[:-1]])[: len(anchor)]
    lo = np.flatnonzero(new)
    hi = np.flatnonzero(inside & ~np.concatenate([inside[1:] & ~new[1:], [False]])[: len(anchor)])
    return lo, hi, anchor[lo], grams[anchor[lo]], Stretches(units)


def segments_of(kind, keys: np.ndarray, column: pa.Array, seen: set[int]):
    """Per part: (key, first window, last window, anchor) as places in the text, grams, content hashes, and the same
    windows as places in the part with the part itself. A text whose key was seen is left out."""
    flat, offsets = kind.flat(column)
    use = np.array([key not in seen and not seen.add(key) for key in keys.tolist()], dtype=bool)
    for part, starts, numbers, shift in stretches_of(flat, offsets, use, kind.window):
        lo, hi, at, grams, hashes = cut(kind, part, starts, use[numbers])
        if len(lo):
            text = np.searchsorted(starts, lo, side="right") - 1
            move = shift - starts[text]
            f = content_hash(kind, hashes, lo, hi, at)
            yield keys[numbers[text]], lo + move, hi + move, at + move, grams, f, lo, hi, part


def content_hash(kind, hashes: Stretches, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of all that windows lo..hi cover, and of where the anchor lies in it."""
    return mix(hashes(lo, hi + kind.units) ^ mix((at - lo).astype(U) * K3))


def item(key: np.ndarray | int, lo: np.ndarray) -> np.ndarray:
    return mix(mix(np.asarray(key, dtype=np.int64).view(U) ^ K1) + lo.astype(U) * K3)


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))


def segment_rows(kind, docs: DataFrame, text_col: str) -> DataFrame:
    """Written (c, f, key, lo, hi, at) of all segments; a task emits a text once."""

    def run(batches):
        seen: set[int] = set()
        for batch in sliced(batches):
            for key, lo, hi, at, grams, f, *_ in segments_of(kind, batch.column(0).to_numpy(), batch.column(1), seen):
                yield pa.RecordBatch.from_arrays(
                    list(map(pa.array, (grams.view(np.int64), f.view(np.int64), key, lo, hi, at))), ["c", "f", "key", "lo", "hi", "at"]
                )

    return written(keyed(docs, text_col).mapInArrow(run, "c long, f long, key long, lo long, hi long, at long"))


def decided(rows: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """From rows (c, f, key, lo, hi, extra): the repeated stretches (key, lo, hi), and one row of each content in doubt."""
    shared = rows.groupBy("c").agg(F.count("*").alias("n"), F.min("f").alias("least"), F.max("f").alias("most"))
    # written, so that adaptive joins can split a gram that many rows have
    shared = written(shared.filter("n > 1").select("c", (F.col("least") != F.col("most")).alias("mixed")))
    rows = written(rows.join(shared, "c"))
    doubt = rows.filter("mixed").groupBy("c", "f").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi", *extra)).alias("one")
    )
    doubt = written(doubt.select("c", "f", "n", "one.*"))
    equal = rows.filter("mixed").join(doubt.filter("n > 1").select("c", "f"), ["c", "f"], "left_semi")
    hits = rows.filter("not mixed").select("key", "lo", "hi").union(equal.select("key", "lo", "hi"))
    return hits, doubt.select("key", "lo", "hi", *extra)


def item_column(items: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            key, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(item(key, lo).view(np.int64))], ["item"])

    return items.mapInArrow(run, "item long")


def doubtful_segments(kind, docs: DataFrame, doubt: DataFrame, text_col: str) -> DataFrame:
    """Written (key, lo, hi, at, content) of the segments in doubt (and of a few that the Bloom filter lets through)."""
    bits = sent(item_column(doubt.select("key", "lo")), "item")

    def run(batches):
        seen: set[int] = set()
        for batch in sliced(batches):
            for key, lo, hi, at, _, _, first, last, part in segments_of(kind, batch.column(0).to_numpy(), batch.column(1), seen):
                some = np.flatnonzero(passes(bits.value, item(key, lo)))
                content = [part[first[k] : last[k] + kind.window].tobytes() for k in some]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[some]) for x in (key, lo, hi, at)), pa.array(content, pa.binary())],
                    ["key", "lo", "hi", "at", "content"],
                )

    rows = keyed(docs, text_col).mapInArrow(run, "key long, lo long, hi long, at long, content binary")
    return written(rows.dropDuplicates(["key", "lo"]))


def cell_rows(kind, segs: DataFrame, width: int) -> DataFrame:
    """(c, f, key, lo, hi, seg) of the cells of segments; with a column ``only`` of (lo, hi), of those windows alone."""
    some = "only" in segs.columns

    def cells(key, lo, hi, at, content: pa.Array, only: pa.Array | None):
        form = np.uint8 if isinstance(kind, Bytes) else U
        flat = np.frombuffer(b"".join(content.to_pylist()), dtype=form)
        size = np.frombuffer(content.buffers()[1], dtype=np.int32)[content.offset : content.offset + len(content) + 1]
        base = (size[:-1] - size[0]) // flat.itemsize - lo  # from a place in the text to one in ``flat``
        seg = np.arange(len(key))
        a, b = lo, hi
        if only is not None:
            seg = np.repeat(seg, [len(x) for x in only.to_pylist()])
            each = only.flatten()
            a, b = each.field("lo").to_numpy(), each.field("hi").to_numpy()
        n = (at[seg] - a) // width - (at[seg] - b) // width + 1
        row = np.repeat(np.arange(len(n)), n)
        cell = (at[seg] - b)[row] // width + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        seg, a, b = seg[row], a[row], b[row]
        late = at[seg] - cell * width  # last and first window that a whole cell has
        early = late - width + 1
        first, last, move = np.maximum(early, a), np.minimum(late, b), base[seg]
        hashes = Stretches(kind.unit_array(flat))
        c = mix(hashes(late + move, early + kind.units + move) ^ mix((cell + 1).astype(U) * K1))
        f = content_hash(kind, hashes, first + move, last + move, at[seg] + move)
        return [pa.array(x) for x in (c.view(np.int64), f.view(np.int64), key[seg], first, last, lo[seg])]

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 2000):
                part = batch.slice(k, 2000)
                names = part.schema.names
                column = lambda name: part.column(names.index(name))
                numbers = (column(name).to_numpy() for name in ("key", "lo", "hi", "at"))
                yield pa.RecordBatch.from_arrays(
                    cells(*numbers, column("content"), column("only") if some else None), ["c", "f", "key", "lo", "hi", "seg"]
                )

    return segs.mapInArrow(run, "c long, f long, key long, lo long, hi long, seg long")


def repeated_windows(kind, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, lo, hi): windows lo..hi of the text with that hash occur elsewhere too; rows may repeat or overlap.

    A text that occurs twice as a whole may lack rows: all its windows are repeated anyhow.
    """
    hits, doubt = decided(segment_rows(kind, docs, text_col), ["at"])
    segs = doubtful_segments(kind, docs, doubt, text_col)
    if kind.cell > 1:
        more, doubt = decided(written(cell_rows(kind, segs, kind.cell)), ["seg"])
        hits = hits.union(more)
        only = doubt.groupBy("key", F.col("seg").alias("lo")).agg(F.collect_list(F.struct("lo", "hi")).alias("only"))
        segs = segs.join(only, ["key", "lo"])
    last = written(cell_rows(kind, segs, 1).select("c", "key", "lo"))
    twice = written(last.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").select("c"))
    single = last.join(twice, "c", "left_semi").select("key", "lo", F.col("lo").alias("hi"))
    return hits.union(single)


def spans_of(windows: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal covered stretches [start, end) of windows (lo, hi) of a given length."""
    out: list[list[int]] = []
    for lo, hi in sorted((w["lo"], w["hi"] + length) for w in windows):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def copied_whole(docs: DataFrame, text_col: str) -> DataFrame:
    """Hashes (key) of texts that several rows have."""
    return docs.groupBy(F.xxhash64(F.col(text_col)).alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select("key")


def per_text(kind, docs: DataFrame, windows: DataFrame, whole: DataFrame, text_col: str, make, schema: str) -> DataFrame:
    """``make(text, spans)`` for each text with repeated windows that isn't copied as a whole: (key, what make gives).

    Spans of one text are bounded by the text. A Bloom filter keeps other texts out of the shuffle.
    """
    spans = windows.join(whole, "key", "left_anti").groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("windows"))
    spans = written(spans)

    def run(batches):
        for batch in batches:
            made = [
                make(text or "", spans_of(found, kind.window))
                for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*made))], names)

    texts = likely(keyed(docs, text_col), "key", sent(spans, "key"))
    rows = texts.join(spans, "key").select("key", "text", "windows")
    schema = f"key long, {schema}"
    names = [part.split()[0] for part in schema.split(", ")]
    return written(rows.mapInArrow(run, schema))
