"""Substring dedup in corpus order by prefix-free parsing.

Rolling-hash triggers (a byte position whose 24-byte hash is the smallest within a window's reach) cut the corpus into
phrases that start and end alike wherever the same text occurs. The dictionary is what distinct phrases with their
context contain; the parse says where they occur. Corpus order is needed only to the depth of one window: two suffixes
are neighbours with a common prefix of ``window`` bytes exactly if their windows fall into one class. So the classes
are found from the parse (equal phrases in equal context) and, where contexts differ, from the suffixes of the
dictionary's phrases, cell by cell and window by window (see ``repeats``). Full ranks are never made; classes give the
same removed bytes.

A byte is removed if a window of ``window`` bytes that covers it starts somewhere else too, in the same or another
text; windows never cross texts and are judged on the input.

Defined cases: a NULL text is empty; texts shorter than a window keep all bytes, even if they are copies; repeated rows
are copies of each other; NULL ids stay; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowndate.llm import repeats

EMPTY = hashlib.sha256(b"").hexdigest()


def removed_spans(docs: DataFrame, kind: repeats.Bytes = repeats.Bytes(), text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(repeated windows (key, lo, hi), keys of texts that are copied as a whole)."""
    return repeats.repeated_windows(kind, docs, text_col), repeats.copied_whole(docs, text_col)


def kept_bytes(text: str, spans: list[tuple[int, int]]) -> bytes:
    data, at, out = text.encode("utf-8"), 0, []
    for start, end in spans:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])


def dedup(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256."""
    kind = repeats.Bytes(window)
    windows, whole = removed_spans(docs, kind, text_col)

    def make(text: str, spans: list[tuple[int, int]]):
        return sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(text, spans)).hexdigest()

    cut = repeats.per_text(kind, docs, windows, whole, text_col, make, "n_removed long, n_spans long, kept_sha256 string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col), F.xxhash64(F.col(text_col)).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text, 256).alias("sha"),
    )
    rows = rows.join(whole.withColumn("copied", F.lit(True)), "key", "left").join(cut, "key", "left")
    gone = F.col("copied").isNotNull() & (F.col("n_bytes") >= window)
    return rows.select(
        id_col, "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
