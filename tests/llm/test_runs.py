"""Periodic runs against a search over all periods, and the registered query against its SQL."""

import random

import pytest

import __spark_entry__ as entry_points
from knowndate.llm import periodic_runs
from tests.compare import connect, differences
from tests.llm.conftest import SF, WORD, needs_tables


def all_runs(s, shortest=1):
    """(start, length, smallest period) of every maximal stretch at least twice as long as its period."""
    n, out = len(s), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, 2 * q):
                part = s[i : i + length]
                if not any(part[p:] == part[: length - p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(rng, s):
    a = rng.randrange(len(s))
    p = 1 + rng.randrange((len(s) - a) // 3 + 1)
    return [s[a + (i - a) % p] if i >= a else s[i] for i in range(len(s))]


def test_runs_of_random_and_periodic_sequences():
    rng = random.Random(3)
    for _ in range(800):
        s = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 40))]
        s = looped(rng, s) if s and rng.random() < 0.4 else s
        assert [tuple(r) for r in periodic_runs.runs_of(s).tolist()] == all_runs(s)
        assert [tuple(r) for r in periodic_runs.word_runs([b"%d" % x for x in s]).tolist()] == all_runs(s, 12)


def test_words_that_peel_off_one_by_one_are_bounded():
    s = [k // 2 if k % 2 else k // 2 + 2 for k in range(4000)]  # every cut makes one more word a single one
    assert len(periodic_runs.word_runs([b"%d" % x for x in s])) == 0
    assert periodic_runs.word_runs([b"a"] * 50_000).tolist() == [[0, 50_000, 1]]


def test_awkward_texts(spark, awkward, no_docs):
    got = periodic_runs.find_runs(awkward.withColumnRenamed("spans", "runs"))
    assert got.columns == ["doc_id", "text", "score", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        words = WORD.findall(r.text or "")
        if len(words) > 5000:
            continue
        want = all_runs(words, 12)
        assert [tuple(x) for x in r.runs] == want
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert periodic_runs.find_runs(no_docs).count() == 0


@needs_tables
@pytest.mark.parametrize("name", ["op11_periodic_runs"])
def test_query_against_sql(spark, name):
    ours, theirs, (more, less) = differences(entry_points.queries()[name](spark, SF), connect(SF), entry_points.oracle_sql()[name])
    assert ours == theirs and not more and not less
