"""Brute-force helpers and small awkward tables for the training-data operators."""

import os
import random
import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(n))


def awkward_texts() -> list:
    """NULL, empty, blank, short, very long, copies, near copies, shared passages, odd white space, other scripts."""
    passage, base = prose(1, 60), prose(2, 220)
    words = base.split()
    near = [" ".join(w if k % 97 != j else "changed" for k, w in enumerate(words)) for j in range(4)]
    return [
        None, "", " \n\t ", "one", "one two", "\x0b\x0cthree\r\n", base, base, *near,
        f"{prose(3, 80)} {passage} {prose(4, 30)}", f"{passage}\n{prose(5, 50)}", f"{prose(6, 10)}\t{passage} {passage}",
        "a" * 900, "ab " * 400, prose(7, 60_000), "Übergröße été naïve 東京タワー 😀 " * 30, "line\n" * 40,
        f"token = \"{'0123456789abcdef' * 3}\" <|endoftext|> {prose(8, 20)}",
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    """Texts above with ids, one NULL id, a repeated row, and extra columns whose names clash with working columns."""
    rows = [(k, t, "x", 1) for k, t in enumerate(awkward_texts())]
    rows += [(None, prose(9, 50), "x", 1), (6, rows[6][1], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, score int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, spans string, score int")
