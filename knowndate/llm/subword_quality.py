"""Quality by supervised subword embeddings.

A text is a bag of hashed features: its words, pairs of neighbouring words (a pair of the same word, and a pair seen before
in the text, also as such), and the byte n-grams (3 to 5) of each word between marks of its beginning and end. Letters
keep their case and punctuation stays part of a word, since shouting and junk symbols tell quality. Every feature falls into one of ``buckets`` buckets, each bucket has a learned vector, a text is the
average of the vectors of its features, and a softmax over two classes reads it. Vectors and output weights are
trained together by stochastic gradient descent in numpy, one text a step, with a step size that falls to zero.

As a text is an average and the output is linear, a bucket's vector counts through its product with the output weights
only: scoring adds up one number per feature (``Model.logit_of``), equal to averaging vectors first.

Training looks at a bounded sample of labelled rows: one row per id (the smallest hash of the text), at most
``sample_rows`` ids, those with the smallest hash. One task holds that sample's bucket shares, at most ``buckets`` a row.
The model (``buckets`` numbers for scoring) travels with the tasks, and every text is scored
whole, in one pass without a shuffle. Label, language, source and id are never inputs of a score.

Defined cases: a NULL or empty text has no feature and scores by the bias alone; without any labelled row, or with one
class only, scores are 0.0 or 1.0 by what there is (0.0 without labels); several labels of one id count as their
largest, NULL labels as none; repeated rows and repeated or NULL ids are scored as rows of their own; no rows give no rows;
other columns of the scored rows pass through, except one named like the result (``score``), which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowndate.llm.frames import bounded_sample
from knowndate.llm.hashing import BLANK, CHUNK, K3, LOW_BYTES, U, eights, hash_runs, mix, multipliers, raw, runs, sliced

#: Lengths of byte n-grams, marks included.
GRAMS = (3, 4, 5)
SEEDS = multipliers(8)


@dataclass(frozen=True)
class Model:
    """``vectors``: one row per bucket; ``output``: one row per class; ``bias``: one number per class."""

    vectors: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), dtype=np.float32))
    output: np.ndarray = field(default_factory=lambda: np.zeros((2, 1)))
    bias: np.ndarray = field(default_factory=lambda: np.array([0.0, -np.inf]))

    def logit_of(self) -> np.ndarray:
        """What one feature of each bucket adds to the log odds of class 1, before the average is taken."""
        return self.vectors @ (self.output[1] - self.output[0])

    def embed(self, column: pa.Array) -> np.ndarray:
        """One averaged vector per text."""
        out, n = np.zeros((len(column), self.vectors.shape[1])), np.zeros(len(column))
        for doc, bucket in features(column, len(self.vectors)):
            np.add.at(out, doc, self.vectors[bucket])
            n += np.bincount(doc, minlength=len(column))
        return out / np.maximum(n, 1)[:, None]


def ranges(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of whole texts, ``CHUNK`` or less together; a longer text is cut at white space, counted from its own start.

    So a text has the same features whatever stands beside it in a batch.
    """
    k, n = 0, len(offsets) - 1
    while k < n:
        last = max(int(np.searchsorted(offsets, offsets[k] + CHUNK, side="right")) - 1, k + 1)
        at, end = int(offsets[k]), int(offsets[last])
        while end - at > CHUNK:
            blank = np.flatnonzero(BLANK[data[at + CHUNK : min(at + 2 * CHUNK, end)]])
            stop = min(at + CHUNK + int(blank[0]) if len(blank) else at + 2 * CHUNK, end)
            yield at, stop
            at = stop
        if end > at:
            yield at, end
        k = last


def features(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of every feature, range by range; features repeat. ``buckets`` is a power of two."""
    mask = U(buckets - 1)
    data, offsets = raw(column)
    for at, stop in ranges(offsets, data):
        part = data[at:stop]
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, side="right")] - at
        starts, ends = runs(~BLANK[part], inside)
        if not len(starts):
            continue
        doc, lengths = np.searchsorted(offsets, starts + at, side="right") - 1, ends - starts
        word = hash_runs(eights(part), starts, lengths)
        yield doc, (mix(word ^ SEEDS[0]) & mask).astype(np.int64)
        near = np.flatnonzero(doc[1:] == doc[:-1])
        of, pair = doc[near], mix(word[near] * K3 + word[near + 1])
        yield of, (pair & mask).astype(np.int64)
        order = np.lexsort((pair, of))
        again = order[1:][(of[order[1:]] == of[order[:-1]]) & (pair[order[1:]] == pair[order[:-1]])]
        for k, some in ((1, np.flatnonzero(word[near] == word[near + 1])), (2, again)):
            yield of[some], np.full(len(some), int(SEEDS[k] & mask))
        # words between marks (a blank on each side), one after the other
        size = lengths + 2
        edge = np.cumsum(size) - size
        marked = np.full(int(size.sum()), 0x20, dtype=np.uint8)
        marked[np.arange(len(marked) - 2 * len(size)) + 2 * np.repeat(np.arange(len(size)), lengths) + 1] = part[~BLANK[part]]
        loads, of = eights(marked), np.repeat(doc, size)
        left = np.repeat(edge + size, size) - np.arange(len(marked))  # bytes up to the end of the marked word
        for n in GRAMS:
            first = np.flatnonzero(left >= n)
            yield of[first], (mix((loads[first] & LOW_BYTES[n]) ^ SEEDS[n]) & mask).astype(np.int64)


def bags(column: pa.Array, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets and the share of its features in each."""
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), *features(column, buckets)]
    doc, bucket = (np.concatenate(x) for x in zip(*found))
    both, n = np.unique(doc * buckets + bucket, return_counts=True)
    doc, bucket = both // buckets, both % buckets
    cut = np.searchsorted(doc, np.arange(len(column) + 1))
    return [(bucket[a:b], n[a:b] / max(n[a:b].sum(), 1)) for a, b in zip(cut, cut[1:])]


def descend(
    texts: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, buckets: int, size: int, epochs: int, step: float, seed: int = 1
) -> Model:
    """Vectors, output weights and bias after ``epochs`` passes of stochastic gradient descent, one text a step."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / size, 1 / size, (buckets, size)).astype(np.float32)
    output, bias = np.zeros((2, size)), np.log(np.bincount(label, minlength=2) / len(label))
    done, total = 0, epochs * len(texts)
    for _ in range(epochs):
        for k in random.permutation(len(texts)):
            rate = step * (1 - done / total)
            done += 1
            bucket, share = texts[k]
            share = share.astype(np.float32)
            hidden = share @ vectors[bucket]
            logit = output @ hidden + bias
            miss = np.exp(logit - logit.max())
            miss /= miss.sum()
            miss[label[k]] -= 1
            back = (miss @ output).astype(np.float32)
            output -= rate * np.outer(miss, hidden)
            bias -= 0.01 * rate * miss
            vectors[bucket] -= np.float32(rate) * np.outer(share, back)
    return Model(vectors, output, bias)


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    label: str = "quality",
    sample_rows: int = 4000,
    buckets: int = 1 << 14,
    size: int = 8,
    epochs: int = 8,
    step: float = 2.0,
) -> Model:
    """Fit on the texts of at most ``sample_rows`` ids of ``labels`` (doc_id, ``label``) that are ``usable``.

    The descent runs in one task over that bounded sample; only the model comes to the driver.
    """
    rows = bounded_sample(docs, labels, usable, sample_rows, label)
    n, n_pos = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n_pos in (0, n):
        return Model(bias=np.array([-np.inf, 0.0])) if n and n_pos else Model()

    def fit(batches):
        texts, truth, ids = [], [], []
        for batch in sliced(batches):
            texts += bags(batch.column(1), buckets)
            truth += batch.column(2).to_pylist()
            ids += batch.column(0).to_pylist()
        order = np.argsort(np.array([str(i) for i in ids]), kind="stable")  # the same steps however the rows arrive
        model = descend([texts[k] for k in order], np.array(truth)[order], buckets, size, epochs, step)
        yield pa.RecordBatch.from_pydict({
            "vectors": [model.vectors.tobytes()], "output": [model.output.tobytes()], "bias": [model.bias.tobytes()]
        })

    got = rows.coalesce(1).mapInArrow(fit, "vectors binary, output binary, bias binary").first()
    vectors = np.frombuffer(got.vectors, dtype=np.float32).reshape(buckets, size)
    return Model(vectors, np.frombuffer(got.output).reshape(2, size), np.frombuffer(got.bias))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1)."""
    rows = docs.drop("score")
    out = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    weight, bias = model.logit_of(), float(model.bias[1] - model.bias[0])

    def run(batches):
        for batch in sliced(batches):
            column = batch.column(text_col)
            total, n = np.zeros(len(column)), np.zeros(len(column))
            for doc, bucket in features(column, len(weight)):
                total += np.bincount(doc, weights=weight[bucket], minlength=len(column))
                n += np.bincount(doc, minlength=len(column))
            with np.errstate(over="ignore"):
                yield batch.append_column("score", pa.array(1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))))

    return rows.mapInArrow(run, out)
