"""Toxicity by weak supervision.

1. Voters. Lexicon voters (words) and stem patterns (first 3 to 8 bytes of a word), each at several densities, are mined from labelled rows by a
   likelihood-ratio test; style voters (shouting, exclamation marks) are fixed patterns.
2. Label model. Correlations of the voters are estimated first, and voters that say the same (spellings of one stem)
   become one. A generative model of the votes, with hit rates per voter and class, is then fitted by EM, the given label
   being one more voter of known accuracy.
3. Classifier. An L1-penalised logistic regression on words and stems is trained on the label model's posteriors. Its
   weights (at most ``features``) travel with the task, and every text is scored in one pass without a shuffle.

Training looks at a bounded sample of labelled rows (``sample_rows`` ids with the smallest hashes, one row each); what
visits the driver is that sample's votes and feature numbers. Texts are scored whole. Label, language, source and id
are never inputs of a score.

Defined cases: a NULL or empty text scores by the intercept alone; without any labelled row, or with one class only,
scores are 0.0 or 1.0 by what there is (0.0 without labels); several labels of one id count as their largest, NULL
labels as none; repeated rows and repeated or NULL ids are rows of their own; no rows give no rows; other columns of
the scored rows pass through, except one named like the result (``score``), which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowndate.llm.frames import bounded_sample, written
from knowndate.llm.hashing import LOW_BYTES, LOWER, U, eights, hash_runs, mix, multipliers, pieces, raw, runs, sliced

STEMS = (3, 4, 5, 6, 7, 8)
#: A feature counts at four levels: present, one in 256 words, one in 128, and that with two occurrences or more.
LEVELS = 4
SEEDS = multipliers(10)

LETTER = np.zeros(256, dtype=bool)
LETTER[0x30:0x3A] = LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True

#: Style voters: share of capitals among ASCII letters, exclamation marks per hundred bytes.
STYLES = ("shouting", "exclaiming")


@dataclass(frozen=True)
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=U))  # sorted feature hashes
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, LEVELS)))
    intercept: float = float("-inf")

    def score(self, column: pa.Array) -> np.ndarray:
        logit = np.full(len(column), self.intercept)
        doc, at, level = hits(column, self.keys)
        np.add.at(logit, doc, self.weights[at, level])
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-logit))


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, feature hash) of all words and stems, range by range; features repeat."""
    data, offsets = raw(column)
    for at, stop in pieces(data, offsets):
        part = LOWER[data[at:stop]]
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, side="right")] - at
        starts, ends = runs(LETTER[part], inside)
        doc, lengths, loads = np.searchsorted(offsets, starts + at, side="right") - 1, ends - starts, eights(part)
        yield doc, mix(hash_runs(loads, starts, lengths) ^ SEEDS[9])
        first = loads[starts]
        for k in STEMS:
            long = np.flatnonzero(lengths > k)
            yield doc[long], mix((first[long] & LOW_BYTES[k]) ^ SEEDS[k])


def levelled(doc: np.ndarray, key: np.ndarray, n: np.ndarray, words: np.ndarray):
    """(text, key, level) for ``n`` occurrences in a text of ``words`` words, each level that holds."""
    w = words[doc]
    holds = (n > 0, 256 * n >= w, 128 * n >= w, (128 * n >= w) & (n > 1))
    at = [np.flatnonzero(h) for h in holds]
    level = np.repeat(np.arange(LEVELS), [len(x) for x in at])
    at = np.concatenate(at)
    return doc[at], key[at], level


def hits(column: pa.Array, keys: np.ndarray):
    """(text, index into ``keys``, level) of the features that the texts have."""
    may = np.zeros(1 << 16, dtype=bool)
    may[(keys & U(0xFFFF)).astype(np.int64)] = True
    found, words = [np.zeros(0, dtype=np.int64)], np.zeros(len(column), dtype=np.int64)
    for k, (doc, feature) in enumerate(features(column)):
        if k % (len(STEMS) + 1) == 0:
            words += np.bincount(doc, minlength=len(column))
        if len(keys):
            some = np.flatnonzero(may[(feature & U(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, feature[some]), len(keys) - 1)
            real = keys[at] == feature[some]
            found.append(doc[some][real] * len(keys) + at[real])
    pairs, n = np.unique(np.concatenate(found), return_counts=True)
    return levelled(pairs // max(len(keys), 1), pairs % max(len(keys), 1), n, words)


def styles(column: pa.Array) -> np.ndarray:
    """One row per text, one column per style voter."""
    out = np.zeros((len(column), len(STYLES)), dtype=bool)
    data, offsets = raw(column)
    for k in range(len(column)):
        text = data[offsets[k] : offsets[k + 1]]
        upper = np.count_nonzero((text >= 0x41) & (text <= 0x5A))
        lower = np.count_nonzero((text >= 0x61) & (text <= 0x7A))
        out[k] = upper > lower, 100 * np.count_nonzero(text == 0x21) > 2 * len(text)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int, label: str) -> DataFrame:
    """Written (text, label) of at most ``sample_rows`` usable labelled rows, one per id, those with the smallest id hashes."""
    return bounded_sample(docs, labels, usable, sample_rows, label).select("text", "label")


def counted(train: DataFrame) -> DataFrame:
    """(key, level, pos, neg): labelled texts with the feature."""

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = list(features(batch.column(0)))
            if not parts:
                continue
            words = sum(np.bincount(doc, minlength=len(label)) for doc, _ in parts[:: len(STEMS) + 1])
            docs, keys = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((docs, keys))
            docs, keys = docs[order], keys[order]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])[: len(keys)])
            n = np.diff(np.concatenate([new, [len(keys)]]))
            docs, keys, level = levelled(docs[new], keys[new], n, words)
            if not len(docs):
                continue
            order = np.lexsort((keys, level))
            docs, keys, level = docs[order], keys[order], level[order]
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (level[1:] != level[:-1])]))
            pos = np.add.reduceat(label[docs], first)
            n = np.diff(np.concatenate([first, [len(keys)]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[first].view(np.int64)), pa.array(level[first]), pa.array(pos), pa.array(n - pos)],
                ["key", "level", "pos", "neg"],
            )

    return train.mapInArrow(run, "key long, level long, pos long, neg long").groupBy("key", "level").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    ).filter("pos + neg >= 3")


def strength(n_pos: int, n_neg: int) -> tuple[Column, Column]:
    """Share of label 1 among texts with the feature, and half the likelihood ratio against the overall share."""
    share = n_pos / (n_pos + n_neg)
    p = (F.col("pos") + F.lit(0.5)) / (F.col("pos") + F.col("neg") + F.lit(1.0))
    return p, F.col("pos") * F.log(p / F.lit(share)) + F.col("neg") * F.log((1 - p) / F.lit(1 - share))


def covering(candidates: np.ndarray, doc: np.ndarray, at: np.ndarray, truth: np.ndarray, most: int, times: int = 4) -> np.ndarray:
    """Of the candidates, in their order, those that speak for rows of label 1 which fewer than ``times`` others found."""
    order = np.argsort(at, kind="stable")
    first, last = np.searchsorted(at[order], candidates), np.searchsorted(at[order], candidates, side="right")
    found, out = np.where(truth == 1, 0, times), []
    for k, a, b in zip(candidates, first, last):
        rows = doc[order[a:b]]
        if np.count_nonzero(found[rows] < times) >= 2:
            found[rows] += 1
            out.append(k)
            if len(out) == most:
                break
    return np.array(out, dtype=np.int64)


def correlations(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Correlation of voters among texts of label 1 (weighted by their posterior)."""
    apart = (votes - (post @ votes) / post.sum()) * np.sqrt(post)[:, None]
    cov = apart.T @ apart
    spread = np.sqrt(np.diag(cov))
    return np.nan_to_num(cov / np.maximum(np.outer(spread, spread), 1e-12))


def merged(votes: np.ndarray, shared: np.ndarray, most: float) -> np.ndarray:
    """Voters that correlate by more than ``most`` become one, which votes if any of them does; strongest first."""
    left, out = list(np.argsort(-votes.sum(axis=0), kind="stable")), []
    while left:
        group = [k for k in left if k == left[0] or shared[left[0], k] > most]
        out.append(votes[:, group].max(axis=1))
        left = [k for k in left if k not in group]
    return np.stack(out, axis=1)


def fit_label_model(votes: np.ndarray, start: np.ndarray, most: float = 0.6, rounds: int = 25) -> np.ndarray:
    """Posterior of label 1 per row of the 0/1 matrix ``votes``, by EM; ``start`` is what the label alone says.

    The label is a voter of known accuracy. Without it two classes could settle on any split of the votes, such as one
    language's lexicon against all others.
    """
    votes = merged(votes, correlations(votes, start), most)
    post = start
    for _ in range(rounds):
        hit = np.clip((post @ votes + 0.5) / (post.sum() + 1), 1e-4, 1 - 1e-4)
        false_hit = np.minimum(((1 - post) @ votes + 0.05) / ((1 - post).sum() + 1), hit * 0.95)
        logit = np.log(start / (1 - start)) + votes @ np.log(hit / false_hit) + (1 - votes) @ np.log((1 - hit) / (1 - false_hit))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post


def fit_classifier(doc: np.ndarray, at: np.ndarray, post: np.ndarray, n_features: int, penalty: float, steps: int = 500):
    """L1 logistic regression on 0/1 features by accelerated proximal gradient steps; (weights, intercept).

    Features are scaled to one mean square, so rare words converge as fast as common ones.
    """
    n = len(post)
    scale = 1 / np.sqrt(np.maximum(np.bincount(at, minlength=n_features), 1) / n)
    by_doc = lambda w: np.bincount(doc, weights=(w * scale)[at], minlength=n)
    by_feature = lambda r: scale * np.bincount(at, weights=r[doc], minlength=n_features) / n
    w, b = np.zeros(n_features), float(np.log((post.mean() + 1e-4) / (1 - post.mean() + 1e-4)))
    v, c, t, top = w.copy(), b, 1.0, 1.0
    x = np.ones(n_features) / max(n_features, 1) ** 0.5
    for _ in range(30):  # the curvature of the mean loss is at most a quarter of the largest eigenvalue of X'X / n
        x = by_feature(by_doc(x))
        top = float(np.linalg.norm(x)) or 1.0
        x = x / top
    rate = 4 / (1.1 * top + 1)
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(c + by_doc(v), -30, 30))) - post
        new_w = v - rate * by_feature(miss)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * penalty, 0)
        new_b = c - rate * miss.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w * scale, b


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    label: str = "toxic",
    sample_rows: int = 12_000,
    voters: int = 384,
    features: int = 8192,
    penalty: float = 1e-3,
) -> Model:
    """Fit on at most ``sample_rows`` rows of ``labels`` (doc_id, ``label``) that are ``usable``."""
    rows = training_rows(docs, labels, usable, sample_rows, label)
    n, n_pos = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n_pos in (0, n):
        return Model(intercept=float("inf") if n and n_pos else float("-inf"))
    share, gain = strength(n_pos, n - n_pos)
    table = written(counted(rows).select("key", "level", "pos", "neg", share.alias("share"), gain.alias("gain")))
    told = F.col("share") >= 2 * n_pos / n
    inputs = table.filter(told).orderBy(F.desc("gain"), "level", "key").limit(features).collect()  # a short list
    mined = [r for r in inputs if r.share >= 0.8 and r.pos >= 3 and r.gain >= 7]
    keys = np.unique(np.array([r.key for r in inputs], dtype=np.int64).view(U))

    def place(chosen) -> np.ndarray:
        at = np.searchsorted(keys, np.array([r.key for r in chosen], dtype=np.int64).view(U))
        return at * LEVELS + np.array([r.level for r in chosen], dtype=np.int64)

    def active(batches):
        for batch in batches:
            of: list[list[int]] = [[] for _ in range(len(batch))]
            for d, at, level in zip(*(x.tolist() for x in hits(batch.column(0), keys))):
                of[d].append(at * LEVELS + level)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.list_(pa.int32())), pa.array(styles(batch.column(0)).tolist(), pa.list_(pa.bool_())),
                 batch.column(1)],
                ["at", "style", "label"],
            )

    sample = rows.mapInArrow(active, "at array<int>, style array<boolean>, label int").collect()  # at most sample_rows
    doc = np.repeat(np.arange(len(sample)), [len(r["at"]) for r in sample])
    at = np.concatenate([np.array(r["at"], dtype=np.int64) for r in sample])
    truth = np.array([r["label"] for r in sample], dtype=float)
    voter = np.sort(covering(place(mined), doc, at, truth, voters))
    votes = np.zeros((len(sample), len(voter) + len(STYLES)))
    said = np.isin(at, voter)
    votes[doc[said], np.searchsorted(voter, at[said])] = 1
    votes[:, len(voter):] = [r["style"] for r in sample]
    hit = (truth @ votes + 0.5) / (n_pos + 1)
    false_hit = ((1 - truth) @ votes + 0.05) / (n - n_pos + 1)
    better = np.flatnonzero(hit > 2 * false_hit)  # voters that speak for label 1
    if not len(better):
        return Model(intercept=float(np.log(n_pos / (n - n_pos))))
    post = fit_label_model(votes[:, better], np.where(truth == 1, 0.95, 0.01))
    column = np.unique(place(inputs))
    known = np.isin(at, column)
    fitted, intercept = fit_classifier(
        doc[known], np.searchsorted(column, at[known]), post, len(column), penalty
    )
    weights = np.zeros((len(keys), LEVELS))
    weights.flat[column] = fitted
    used = np.flatnonzero(weights.any(axis=1))
    return Model(keys[used], weights[used], intercept)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1)."""
    rows = docs.drop("score")
    out = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in sliced(batches):
            yield batch.append_column("score", pa.array(model.score(batch.column(text_col))))

    return rows.mapInArrow(run, out)
