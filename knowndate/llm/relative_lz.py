"""Substring dedup with the result of relative Lempel-Ziv factors of ``window`` words or more.

No factors are built: there is no reference index, greedy factoring or factor length. Windows are grouped by the
segments between content-defined words (see ``repeats``) as equal, unique or in doubt; those in doubt are checked one by
one. Each word of a window that occurs a second time is removed.

A word is removed if a window of ``window`` words that covers it starts somewhere else too, in the same or another
text; windows never cross texts and are judged on the input.

Defined cases: a NULL or blank text has no words; texts shorter than a window keep all words, even if they are copies;
repeated rows are copies of each other; NULL ids stay; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowndate.llm import repeats
from knowndate.llm.frames import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def factors(docs: DataFrame, window: int = 35, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(factored windows (key, lo, hi), keys of texts that are one factor as a whole)."""
    return repeats.repeated_windows(repeats.Words(window), docs, text_col), repeats.copied_whole(docs, text_col)


def kept_words(text: str, spans: list[tuple[int, int]]) -> list[str]:
    words, at, out = WORD.findall(text), 0, []
    for start, end in spans:
        out += words[at:start]
        at = end
    return out + words[at:]


def dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256."""
    kind = repeats.Words(window)
    windows, whole = factors(docs, window, text_col)

    def make(text: str, spans: list[tuple[int, int]]):
        return sum(b - a for a, b in spans), hashlib.sha256(" ".join(kept_words(text, spans)).encode("utf-8")).hexdigest()

    cut = repeats.per_text(kind, docs, windows, whole, text_col, make, "n_removed long, kept_sha256 string")
    words = words_of(F.col(text_col).cast("string"))
    rows = docs.select(
        F.col(id_col), F.xxhash64(F.col(text_col)).alias("key"), F.size(words).cast("long").alias("n_words"),
        F.sha2(F.array_join(words, " "), 256).alias("sha"),
    )
    rows = rows.join(whole.withColumn("copied", F.lit(True)), "key", "left").join(cut, "key", "left")
    gone = F.col("copied").isNotNull() & (F.col("n_words") >= window)
    return rows.select(
        id_col, "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
