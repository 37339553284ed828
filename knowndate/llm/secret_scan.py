"""Secret scans: fixed patterns plus a token-efficiency test.

A public BPE vocabulary was fitted on natural text, so words cost few tokens while random strings fall apart into
many: a run with few characters per token is a likely key. A run is tested as a whole and, unless it is random as a
whole, by its pieces between / = _ + - characters, so that a key in a path or behind a name is not diluted by words:
neighbouring pieces that each look random (or are numbers or short) are tested as one stretch. Known digests (hex of
a digest's length), identifiers (UUIDs, dates, plain numbers, a caller's list) are left out before the test. Keys of
fewer than ``LEAST`` characters are not looked for. Pattern matches are never taken back.

One pass without a shuffle; texts stream through ``mapInArrow``. Python is used because no built-in
gives the positions of matches or tokens.

Defined cases: a NULL or empty text has no spans; repeated rows and repeated or NULL ids are rows of their own; spans
are in code points, sorted by start and then by kind in the order of ``KINDS``; texts are read whole; no rows give no
rows; other columns of the input are passed through unread and may have any name but ``spans``.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]

#: Fixed patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters or more

#: Runs that may be random, the pieces they are joined of, and what is known to be something else.
LEAST = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
PIECE = re.compile(rf"(?<![A-Za-z0-9]){UUID}(?![A-Za-z0-9])|[A-Za-z0-9]+", re.I)
SHORT = 3  # a piece so short says nothing by its ratio
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
IDENTIFIER = re.compile(rf"(?:{UUID}|[0-9/_=+-]+)\Z", re.I)

SPANS = "array<struct<kind:string,start:long,end:long>>"


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def stretches(text: str, start: int, end: int, few, ruled_out) -> list[tuple[int, int]]:
    """Longest chains of neighbouring pieces of one run that look random; numbers and short pieces only inside a chain."""
    found, first, last = [], None, None
    for m in PIECE.finditer(text, start, end):
        piece = m.group()
        out = ruled_out(m.start(), m.end())
        if not out and not piece.isdigit() and few(piece):
            first, last = (m.start() if first is None else first), m.end()
        elif first is not None and (out and not piece.isdigit() or not out and len(piece) > SHORT):
            found.append((first, last))
            first = None
    return found + ([(first, last)] if first is not None else [])


class Taken:
    """What base spans cover, as sorted stretches apart from each other."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end) - 1  # the last stretch that starts before the end
        return before >= 0 and self.ends[before] > start


def random_spans(text: str, taken: Taken, enc, most: float, known: frozenset[str]) -> list[tuple[int, int, str]]:
    def few(part: str) -> bool:
        return len(part) < most * len(enc.encode_ordinary(part))

    def ruled_out(start: int, end: int) -> bool:
        part = text[start:end]
        return bool(DIGEST.match(part) or IDENTIFIER.match(part) or part in known or taken.meets(start, end))

    found = []
    for m in RUN.finditer(text):
        if taken.meets(*m.span()) or not few(m.group()):
            spans = stretches(text, *m.span(), few, ruled_out)
        else:
            spans = [m.span()]
        found += [
            (a, b, "random") for a, b in spans if b - a >= LEAST and not ruled_out(a, b) and few(text[a:b])
        ]
    return found


def scan(text: str | None, enc, most: float, known: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """All (start, end, kind) of one text, sorted."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + random_spans(text, Taken(base), enc, most, known), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(
    docs: DataFrame,
    text_col: str = "text",
    vocabulary: str | None = None,
    chars_per_token: float = 2.0,
    known: frozenset[str] = frozenset(),
) -> DataFrame:
    """``docs`` with a column ``spans``. A run with fewer than ``chars_per_token`` characters a token is random.

    ``known`` are strings that are not secrets; it is sent with the task and meant for short lists.
    """
    path = vocabulary or vocabulary_path()
    rows = docs.drop("spans")
    out = T.StructType([*rows.schema.fields, T.StructField("spans", T._parse_datatype_string(SPANS))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            found = [
                [{"kind": kind, "start": start, "end": end} for start, end, kind in scan(text, enc, chars_per_token, known)]
                for text in batch.column(text_col).to_pylist()
            ]
            yield batch.append_column("spans", pa.array(found, type=kind))

    return rows.mapInArrow(run, out)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with each stretch that spans cover replaced by ``mark``; spans come sorted by their start."""
    parts, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(
    docs: DataFrame,
    text_col: str = "text",
    mark: str = "[SECRET]",
    vocabulary: str | None = None,
    chars_per_token: float = 2.0,
    known: frozenset[str] = frozenset(),
) -> DataFrame:
    """``docs`` with each stretch covered by spans replaced by ``mark``; every row stays."""
    path = vocabulary or vocabulary_path()

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            clean = [text and redacted(text, scan(text, enc, chars_per_token, known), mark) for text in texts]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, text_col, pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
