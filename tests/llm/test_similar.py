"""Jaccard join, substring dedup and nearest neighbours against brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from knowndate.llm import ann, jaccard_join, relative_lz, repeats, suffix_dedup
from knowndate.llm.components import components
from tests.llm.conftest import WORD, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return grams or ({tuple(words)} if words else set())


def brute_classes(rows, like):
    sets = [shingles(t, like.words) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and like.of * both >= like.at_least * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return collections.Counter((rows[k][0], len(sets[k]), least.get(find(k)) if sets[k] else rows[k][0]) for k in range(len(rows)))


def family(seed, copies, edits, n=150):
    """Copies of one text with a few words replaced, some of them with edits of other copies."""
    rng, base = random.Random(seed), prose(seed, n).split()
    out = []
    for k in range(copies):
        words = list(rng.choice(out).split() if out and rng.random() < 0.3 else base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(n)] = f"x{rng.randrange(400)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("words, at_least", [(3, 90), (5, 80)])
def test_classes_equal_brute_force(spark, awkward, words, at_least):
    like = jaccard_join.Likeness(words, at_least)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    rows += [(1000 + k, t) for k, t in enumerate(family(11, 90, 5) + family(12, 40, 9, 60) + family(13, 30, 2, 12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes(docs, like).collect())
    assert got == brute_classes(rows, like)


def test_one_of_each_class_stays(spark, awkward, no_docs):
    like = jaccard_join.Likeness()
    kept = jaccard_join.one_of_each(awkward, like)
    assert kept.columns == awkward.columns
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    worded = {c for _, n, c in brute_classes(rows, like) if n}
    assert sum(bool(shingles(r.text, 5)) for r in kept.collect()) == len(worded)
    assert sum(not shingles(r.text, 5) for r in kept.collect()) == sum(not shingles(t, 5) for _, t in rows)
    assert jaccard_join.one_of_each(no_docs, like).count() == 0 and jaccard_join.classes(no_docs, like).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(7, 7), (300, 300), (61, 60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(62)) and all(got[k] == 100 for k in range(100, 150)) and got[300] == 300


def covered(units, window, seen):
    out = np.zeros(len(units), dtype=bool)
    for i in range(len(units) - window + 1):
        if seen[hash(units[i : i + window])] > 1:
            out[i : i + window] = True
    return out


def brute_removed(texts, window):
    seen = collections.Counter(hash(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    return [covered(t, window, seen) for t in texts]


def repeat_texts(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect() if len(r.text or "") < 60_000]
    lone = prose(21, 300)
    rows += [(500 + k, f"{prose(30 + k, 40)} {lone[k * 37 : k * 37 + 400 + 90 * k]} {prose(60 + k, 25)}") for k in range(12)]
    return rows


def test_removed_bytes_equal_brute_force(spark, awkward, no_docs):
    rows = repeat_texts(awkward)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    data = [(t or "").encode() for _, t in rows]
    want = collections.Counter()
    for (doc, _), text, gone in zip(rows, data, brute_removed(data, 200)):
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        kept = bytes(b for b, g in zip(text, gone) if not g)
        want[(doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.dedup(docs).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert suffix_dedup.dedup(no_docs).count() == 0


def test_removed_words_equal_brute_force(spark, awkward, no_docs):
    rows = repeat_texts(awkward)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = [tuple(WORD.findall(t or "")) for _, t in rows]
    want = collections.Counter()
    for (doc, _), text, gone in zip(rows, words, brute_removed(words, 35)):
        kept = " ".join(w for w, g in zip(text, gone) if not g)
        want[(doc, len(text), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = relative_lz.dedup(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert relative_lz.dedup(no_docs).count() == 0


def test_long_texts_are_cut_without_loss(monkeypatch):
    """Segments of texts worked off together or in parts cover each window of each text once."""
    monkeypatch.setattr(repeats, "PART", 700)
    kind, texts = repeats.Bytes(), [prose(5, 400), "short", prose(6, 60), None, prose(7, 30), prose(8, 50), prose(9, 1000)]
    seen = [np.zeros(max(len(t or "") - 199, 0), dtype=int) for t in texts]
    for key, lo, hi, at, *_ in repeats.segments_of(kind, np.arange(7), pa.array(texts), {5}):
        assert ((at >= hi) & (at < lo + 200)).all()
        for k, a, b in zip(key, lo, hi):
            seen[k][a : b + 1] += 1
    assert all((s == (k != 5)).all() for k, s in enumerate(seen))


def test_neighbours_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24))
    x[300:330] = x[300] + rng.normal(size=(30, 24)) * 0.01
    x[400:420] = x[400]  # equal vectors
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5, x[5].tolist())]
    rows += [(700, None), (800, [0.0] * 24), (900, [float("nan")] * 24), (1000, [1.0, None] * 12), (None, x[0].tolist()), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.neighbours(df, df.filter("vec_id % 100 = 0"), calibration=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    hits = 0
    for q, found in got.items():
        away = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [int(k) for k in np.lexsort((np.arange(600), away)) if k != q][:10]
        hits += len({k for k, _ in found} & set(order))
        assert len(found) == 10 and found == sorted(found, key=lambda f: (f[1], f[0]))
        assert all(abs(s - away[k]) < 1e-12 for k, s in found)
    assert hits >= 0.9 * 60 and [k for k, _ in got[400]] == list(range(401, 411))
    few = ann.neighbours(df.filter("vec_id in (0, 1, 2)"), df.filter("vec_id = 0"))
    assert few.count() == 2 and ann.neighbours(df.limit(0), df.limit(0)).count() == 0
