"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives every document a posterior over domains. Rates (expected numbers of
copies, >= 0) are then fitted so that the expected token totals of the domains, sum of rate * tokens * posterior, meet
the targets: least squares over the domains, with residuals whitened by the token-weighted Gram matrix of the
posteriors, minimised by projected gradient steps from rate 1. With that weighting the step 1 is safe and few steps
are needed.

A step of a document depends only on its posterior and a vector with one number per domain. The steps so far travel as
literals, rates are recomputed from them in each pass, and a pass returns one sum per domain: nothing is stored or
moved per document.

The classifier (multinomial logistic regression on text shape and on mined words) is fitted on a bounded sample of
labelled rows (``sample_rows``, smallest id hashes). Tokens are words unless a column of counts is named.

Defined cases: a NULL or empty text has no tokens and keeps what its posterior gives; without labels every posterior
is uniform; targets are normalised; targets that are missed (a domain without tokens, or bounds on the rates) are told by
``Steps.met`` and a warning, next to the totals reached;
repeated rows and repeated or NULL ids are rows of their own; no rows give no rows; other columns pass through, those
named like a result (``posterior``, ``tokens``, ``rate``, ``copies``) are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowndate.llm import toxicity
from knowndate.llm.frames import written
from knowndate.llm.hashing import U, raw, sliced, word_hashes

#: Text shape: shares of byte classes, of distinct words, and the length.
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
N_SHAPE = 7


def shapes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(one row of shape features, number of words) per text."""
    data, offsets = raw(column)
    words, at = word_hashes(column)
    out, tokens = np.zeros((len(column), N_SHAPE)), np.diff(at)
    for k in range(len(column)):
        counts = np.bincount(data[offsets[k] : offsets[k + 1]], minlength=256)
        n, w = max(int(counts.sum()), 1), max(int(tokens[k]), 1)
        letters = max(int(counts[0x41:0x5B].sum() + counts[0x61:0x7B].sum()), 1)
        out[k] = (
            min(counts[SYMBOLS].sum() / w, 1), min(counts[0x21] / w, 1), counts[0x41:0x5B].sum() / letters,
            counts[0x30:0x3A].sum() / n, len(np.unique(words[at[k] : at[k + 1]])) / w, np.log1p(n) / 10, min(n / w, 20) / 10,
        )
    return out, tokens


def design(column: pa.Array, keys: np.ndarray):
    """Dense shape features, the word features present as (text, number), and the number of words."""
    shape, tokens = shapes(column)
    doc, at, level = toxicity.hits(column, keys)
    return shape, doc, at * toxicity.LEVELS + level, tokens


class Classifier:
    """Softmax over domains; without features it is uniform."""

    def __init__(self, domains: list[str], keys=None, used=None, w_shape=None, w_word=None, centre=0.0, scale=1.0):
        self.domains, self.keys, self.used = domains, np.zeros(0, dtype=U) if keys is None else keys, used
        self.w_shape, self.w_word, self.centre, self.scale = w_shape, w_word, centre, scale

    def posterior(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        shape, doc, at, tokens = design(column, self.keys)
        logit = np.zeros((len(column), len(self.domains)))
        if self.w_shape is not None:
            logit = np.c_[(shape - self.centre) / self.scale, np.ones(len(shape))] @ self.w_shape
            place = np.minimum(np.searchsorted(self.used, at), max(len(self.used) - 1, 0))
            real = self.used[place] == at if len(self.used) else np.zeros(len(at), dtype=bool)
            for k in range(len(self.domains)):
                logit[:, k] += np.bincount(doc[real], weights=self.w_word[place[real], k], minlength=len(logit))
        top = np.exp(logit - logit.max(axis=1, keepdims=True)) if len(logit) else logit
        return top / np.maximum(top.sum(axis=1, keepdims=True), 1e-300), tokens


def fit_softmax(dense: np.ndarray, doc: np.ndarray, at: np.ndarray, n_words: int, y: np.ndarray, k: int, steps=300, ridge=1e-3):
    """Weights of the dense and of the 0/1 word features, by accelerated gradient steps on the mean loss."""
    n = len(y)
    truth = np.eye(k)[y]
    scale = 1 / np.sqrt(np.maximum(np.bincount(at, minlength=n_words), 1) / n)
    w, v = np.zeros((dense.shape[1], k)), np.zeros((n_words, k))
    pw, pv, t = w.copy(), v.copy(), 1.0
    by_doc = lambda m: np.stack([np.bincount(doc, weights=(m[:, j] * scale)[at], minlength=n) for j in range(k)], axis=1)
    by_word = lambda r: np.stack([scale * np.bincount(at, weights=r[doc, j], minlength=n_words) for j in range(k)], axis=1) / n
    x = np.ones((n_words, 1)) / max(n_words, 1) ** 0.5
    top = 0.0
    for _ in range(20 if n_words else 0):
        x = scale[:, None] * np.bincount(at, weights=np.bincount(doc, weights=(x[:, 0] * scale)[at], minlength=n)[doc], minlength=n_words)[:, None] / n
        top = float(np.linalg.norm(x)) or 1.0
        x = x / top
    rate = 2 / (1.1 * top + np.linalg.norm(dense, 2) ** 2 / n + ridge)
    for _ in range(steps):
        logit = dense @ pw + by_doc(pv)
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        miss = p / p.sum(axis=1, keepdims=True) - truth
        nw, nv = pw - rate * (dense.T @ miss / n + ridge * pw), pv - rate * (by_word(miss) + ridge * pv)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pv = nw + (t - 1) / nt * (nw - w), nv + (t - 1) / nt * (nv - v)
        w, v, t = nw, nv, nt
    return w, v * scale[:, None]


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_rows: int = 6000, words: int = 1500) -> Classifier:
    """Fit on at most ``sample_rows`` rows of ``labelled`` (doc_id, domain)."""
    number = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    labels = labelled.filter(F.col("domain").isin(*domains)).select("doc_id", number.cast("int").alias("domain"))
    rows = toxicity.training_rows(docs, labels, F.lit(True), sample_rows, "domain")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(sizes.values())
    if len(sizes) < 2:
        return Classifier(domains)
    chosen: set[tuple[int, int]] = set()
    for k in sorted(sizes):
        one = written(rows.select("text", (F.col("label") == k).cast("int").alias("label")))
        share, gain = toxicity.strength(sizes[k], n - sizes[k])
        table = toxicity.counted(one).select("key", "level", share.alias("share"), gain.alias("gain"))
        best = table.filter(F.col("share") > sizes[k] / n).orderBy(F.desc("gain"), "level", "key").limit(words // len(sizes))
        chosen |= {(r.key, r.level) for r in best.collect()}
    keys = np.unique(np.array([k for k, _ in chosen], dtype=np.int64).view(U))

    def active(batches):
        for batch in batches:
            shape, doc, at, _ = design(batch.column(0), keys)
            of: list[list[int]] = [[] for _ in range(len(batch))]
            for d, a in zip(doc.tolist(), at.tolist()):
                of[d].append(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shape.tolist(), pa.list_(pa.float64())), pa.array(of, pa.list_(pa.int32())), batch.column(1)],
                ["shape", "at", "label"],
            )

    sample = rows.mapInArrow(active, "shape array<double>, at array<int>, label int").collect()  # at most sample_rows
    shape = np.array([r["shape"] for r in sample])
    doc = np.repeat(np.arange(len(sample)), [len(r["at"]) for r in sample])
    at = np.concatenate([np.array(r["at"], dtype=np.int64) for r in sample])
    at_of = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    used = np.unique([at_of[k] * toxicity.LEVELS + level for k, level in chosen])
    known = np.isin(at, used)
    centre, scale = shape.mean(axis=0), np.maximum(shape.std(axis=0), 1e-6)
    dense = np.c_[(shape - centre) / scale, np.ones(len(shape))]
    y = np.array([r["label"] for r in sample])
    w_shape, w_word = fit_softmax(dense, doc[known], np.searchsorted(used, at[known]), len(used), y, len(domains))
    return Classifier(domains, keys, used, w_shape, w_word, centre, scale)


def with_posteriors(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with ``posterior`` (one double per domain) and ``tokens`` (words)."""
    rows = docs.drop("posterior", "tokens")
    out = T.StructType([
        *rows.schema.fields, T.StructField("posterior", T.ArrayType(T.DoubleType())), T.StructField("tokens", T.LongType())
    ])

    def run(batches):
        for batch in sliced(batches):
            p, tokens = model.posterior(batch.column(text_col))
            yield batch.append_column("posterior", pa.array(p.tolist(), pa.list_(pa.float64()))).append_column(
                "tokens", pa.array(tokens.astype(np.int64))
            )

    return rows.mapInArrow(run, out)


class Steps(list):
    """Steps of ``fit_rates`` with the totals per domain: those wished, those reached, and whether they agree.

    ``most`` and ``whole`` are the bound and the place of the domain kept whole under which they were fitted, or None.
    """

    def __init__(self, steps=(), wished: Mapping[str, float] | None = None, reached: Mapping[str, float] | None = None,
                 met: bool = True, most: float | None = None, whole: int | None = None):
        super().__init__(steps)
        self.wished, self.reached, self.met = dict(wished or {}), dict(reached or {}), met
        self.most, self.whole = most, whole


def least_rate(posterior: Column, whole: int | None) -> Column:
    """1 where the domain at place ``whole`` is a most likely one, else 0."""
    if whole is None:
        return F.lit(0.0)
    return F.when(posterior[whole] >= F.array_max(posterior), 1.0).otherwise(0.0)


def rate_after(posterior: Column, steps: list[np.ndarray], most: float | None, whole: int | None = None) -> Column:
    """The rate after the given steps: each takes posterior · step away and cuts to the least rate, and to ``most`` if given."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    taken = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])
    dot = lambda step: F.aggregate(F.zip_with(posterior, step, lambda p, x: p * x), F.lit(0.0), lambda a, b: a + b)
    cut = (lambda r: r) if most is None else (lambda r: F.least(F.lit(float(most)), r))
    return F.aggregate(taken, rate, lambda r, step: cut(F.greatest(least_rate(posterior, whole), r - dot(step))))


def fit_rates(
    mixed: DataFrame, domains: list[str], targets: Mapping[str, float], total: float | None = None,
    keep: tuple[str, float] | None = None, most: float | None = None, tolerance: float = 1e-4, most_steps: int = 60,
    whole: str | None = None,
) -> Steps:
    """Steps that lead from rate 1 to rates whose expected domain totals meet the targets.

    Rates are not negative, and at most ``most`` if that is given; targets may then be out of reach. Totals that miss a
    target by more than ``tolerance`` of all tokens are flagged (``Steps.met``) and warned about.
    ``mixed`` has ``posterior`` and ``tokens`` and is read once a step. ``total`` is the wished number of tokens (as
    many as there are, by default); ``keep=(domain, x)`` raises it until that domain gets x times its tokens.
    Documents whose most likely domain is ``whole`` get a rate of 1 at least; the others are fitted around them.
    """
    k, at = len(domains), None if whole is None else domains.index(whole)
    weights = np.array([max(float(targets.get(d, 0.0)), 0.0) for d in domains])
    weights = weights / (weights.sum() or 1.0)
    part = lambda i: F.col("posterior")[i]
    gram = mixed.agg(*[
        F.coalesce(F.sum(F.col("tokens") * part(i) * part(j)), F.lit(0.0)) for i in range(k) for j in range(k)
    ]).first()
    gram = np.array(gram, dtype=float).reshape(k, k)
    now = gram.sum(axis=1)  # posteriors sum to one
    if not now.sum():
        return Steps(most=most, whole=at)
    wished = now.sum() if total is None else float(total)
    if keep is not None and (share := weights[domains.index(keep[0])]):
        wished = max(wished, keep[1] * now[domains.index(keep[0])] / share)
    target = wished * weights
    safe = np.linalg.pinv(gram, rcond=1e-9)
    whitened, steps, gaps = safe, Steps(most=most, whole=at), [np.inf]
    while True:
        gaps.append(float(np.abs(now - target).max()))
        if gaps[-1] <= tolerance * wished or len(steps) == most_steps:
            break
        # the Gram matrix of the rows that still can move makes longer steps; a step that went too far is followed
        # by one with the matrix of all rows, which never does
        steps.append((whitened if gaps[-1] < gaps[-2] else safe) @ (now - target))
        rate = rate_after(F.col("posterior"), steps, most, at)
        free = F.col("rate") > least_rate(F.col("posterior"), at)
        free = free if most is None else free & (F.col("rate") < most)
        sums = mixed.select("tokens", "posterior", rate.alias("rate")).agg(
            *[F.sum(F.col("rate") * F.col("tokens") * part(i)) for i in range(k)],
            *[
                F.sum(F.when(free, F.col("tokens") * part(i) * part(j)).otherwise(0.0))
                for i in range(k) for j in range(k)
            ],
        ).first()
        now = np.array(sums[:k], dtype=float)
        whitened = np.linalg.pinv(np.array(sums[k:], dtype=float).reshape(k, k), rcond=1e-9)
    steps.wished, steps.reached = dict(zip(domains, target.tolist())), dict(zip(domains, now.tolist()))
    steps.met = gaps[-1] <= tolerance * wished
    if not steps.met:
        warnings.warn(f"mixing misses its targets after {len(steps)} steps: wished {steps.wished}, reached {steps.reached}", stacklevel=2)
    return steps


def with_rates(mixed: DataFrame, steps: Steps, id_col: str = "doc_id") -> DataFrame:
    """``mixed`` with ``rate`` and ``copies``: the rate, rounded up with the odds of its fraction by a hash of the id."""
    out = mixed.withColumn("rate", rate_after(F.col("posterior"), steps, steps.most, steps.whole))
    chance = F.pmod(F.xxhash64(F.lit("mixing"), id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("rate")
    return out.withColumn("copies", (whole + F.when(chance < F.col("rate") - whole, 1).otherwise(0)).cast("long"))


#: Copies that one array numbers.
BLOCK = 1024


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says, without that column; blocks are numbered first, so no array grows with a rate."""
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK))
    spread = rows.filter("copies > 0").withColumn("__block", F.explode(blocks))
    inside = F.sequence(F.lit(1).cast("long"), F.least(F.lit(BLOCK).cast("long"), F.col("copies") - BLOCK * F.col("__block")))
    return spread.withColumn("__copy", F.explode(inside)).drop("__block", "__copy", "copies")


def quality_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labelled table: toxic, else good or poor by quality; rows without both labels are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).filter("domain is not null")


DOMAINS = ["good", "poor", "toxic"]
TARGETS = {"good": 0.9, "poor": 0.09, "toxic": 0.01}
