"""Concatenate and cut: all token ids of the corpus, one after the other, are cut into windows of fixed length.

Pass one tokenizes every document once, appends the end id and writes the ids with the partition's number and the
count of ids before the document in that partition. Totals per partition, summed from left to right, give each
partition its global offset; pass two adds the two and cuts. A document that crosses a window's end leaves a boundary
record (piece) on either side. Only the last window can be short.

The totals are one row per partition of the input, whatever the corpus holds; they are the only rows that meet in one
task, and the only ones that are broadcast. Written ids survive lost executors, and pass two reads them instead of
tokenizing again.

Words repeat, so ids are looked up per word: the text is cut only before a space or line feed that stands alone between
two visible characters, where the pre-tokenizer of the vocabulary always cuts too. Texts with other
white space go through the tokenizer itself, long ones in chunks cut at such places.

Defined cases: a NULL or empty text is the end id alone; repeated rows and repeated or NULL ids are documents of their
own; no rows give no rows; ids of any type are kept; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowndate.llm.frames import written

WINDOW = 2048
END_ID = 1
CACHED_PIECES = 250_000
CHUNK = 65_536


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: White space other than the space and the line feed.
OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


class Pieces(dict):
    """Piece → ids as bytes, filled on demand."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.encode(piece)
        return ids


class Ids:
    """Text → little-endian ids as bytes, with a cache of pieces.

    Single pieces go to the merge loop of tiktoken over the ranks in the tokenizer's own file, if these rank merges by
    id; it takes a third of the time of a tokenizers call and gives the same ids.
    """

    CUT = re.compile(r"\S(?= \S)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 65_536 else "I"
        self.kind = "<u2" if self.code == "H" else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = ranks_of(path, set(self.special))
        if ranks is None:
            one = lambda text: self.packed([text])[0]
        else:
            import public_tokenizers
            import tiktoken

            merge = tiktoken.Encoding(
                path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            ).encode_ordinary
            one = lambda text: array(self.code, merge(text)).tobytes()
        self.first = Pieces(one)
        self.rest = Pieces(lambda piece: one(piece if piece[0] == "\n" else " " + piece))

    def packed(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, dtype=self.kind).tobytes()
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def chunks(self, text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > CHUNK and (m := self.CUT.search(text, at + CHUNK)):
            out.append(text[at : m.end()])
            at = m.end()
        return [*out, text[at:]]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.replace("\n", " \n").split(" ")
        crowded = not head or "" in rest or "\n" in rest or any(c in text for c in OTHER_SPACES)
        if crowded or any(s in text for s in self.special):
            return b"".join(self.packed(self.chunks(text)))
        if len(self.rest) > CACHED_PIECES:
            self.rest.clear()
        if len(self.first) > CACHED_PIECES // 10:
            self.first.clear()
        return self.first[head] + b"".join(map(self.rest.__getitem__, rest))


def ranks_of(path: str, special: set[str]) -> dict[bytes, int] | None:
    """Token bytes → id of a byte-level BPE file with the well-known pre-tokenizer, if ids follow its merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"] != plain or spec["normalizer"]:
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in special}
    merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
    if [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    return Ids(path)


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """Written rows (id, part, first, n, ids): ids as little-endian bytes, ``first`` ids before it in its partition."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([
        rows.schema[0], T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches):
        ids, part, first = ids_of(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=ids.kind).tobytes()
        width = len(end)
        for batch in batches:
            got = [ids(text or "") + end for text in batch.column(1).to_pylist()]
            n = np.array([len(b) // width for b in got], dtype=np.int64)
            starts = first + np.cumsum(n) - n
            first += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (np.full(len(n), part, np.int32), starts, n, np.full(len(n), width, np.int32))),
                 pa.array(got, pa.binary())],
                schema.names,
            )
        ids.rest.clear()  # a worker lives on for other work

    return written(rows.mapInArrow(run, schema))


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids`` if asked for)."""
    stored = tokenized(docs, id_col, text_col, vocabulary or vocabulary_path(), end_id)
    totals = stored.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    placed = stored.join(F.broadcast(bases), "part").select(
        id_col, (F.col("base") + F.col("first")).alias("at"), "n", "width", "ids"
    )
    fields = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
              ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    fields += [("ids", T.ArrayType(T.LongType()))] if with_ids else []
    schema = T.StructType([placed.schema[0], *[T.StructField(n, t) for n, t in fields]])

    def cut(batches):
        for batch in batches:
            from_row: list[int] = []
            out: list[tuple] = []
            at_n_width_ids = zip(*(batch.column(k).to_pylist() for k in range(1, 5)))
            for k, (at, n, width, raw) in enumerate(at_n_width_ids):
                ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    length = min(n - start, window - (at + start) % window)
                    part = ids[start : start + length]
                    row = (start, length, zlib.crc32(part.tobytes()), n, (at + start) // window, (at + start) % window)
                    out.append((*row, part.tolist()) if with_ids else row)
                    from_row.append(k)
                    start += length
            if out:
                arrays = [pa.array(column) for column in zip(*out)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(from_row)), *arrays], schema.names)

    return placed.mapInArrow(cut, schema)
