"""Toxicity by held-out accuracy, mixing against a plain solver, and the pipeline stage by stage."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from knowndate.llm import mixing, packing, toxicity
from knowndate.llm.frames import written
from tests.llm.conftest import needs_tables

SF1 = "/root/testdata/sf0.01"


def auc(truth, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for value in np.unique(score):
        same = score == value
        rank[same] = np.flatnonzero(score[order] == value).mean() + 1
    pos = truth == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@needs_tables
def test_held_out_toxicity(spark):
    rows = entry_points.queries()["op5_toxicity"](spark, SF1)
    got = rows.join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").filter("held_out").collect()
    truth, score = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    assert auc(truth, score) > 0.9
    said = np.array([r.predicted for r in got])
    assert said[truth == 1].mean() > 0.8 and said[truth == 0].mean() < 0.05
    assert rows.count() == spark.read.parquet(f"{SF1}/documents.parquet").count()


def test_scores_on_awkward_input(spark, awkward, no_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels, F.lit(True))
    got = toxicity.score(awkward, model)
    assert got.columns == ["doc_id", "text", "spans", "score"] and got.count() == awkward.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(no_docs, model).count() == 0
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.score(awkward, toxicity.train(awkward, some, F.lit(True))).collect()} == {0.0}


def test_label_model_merges_equal_voters_and_finds_the_class():
    rng = np.random.default_rng(1)
    truth = (rng.random(2000) < 0.2).astype(float)
    votes = np.stack([np.where(truth == 1, rng.random(2000) < 0.7, rng.random(2000) < 0.01) for _ in range(4)], axis=1).astype(float)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], axis=1)
    start = np.where(rng.random(2000) < 0.1, 1 - truth, truth) * 0.9 + 0.05  # a tenth of the labels is wrong
    assert toxicity.merged(votes, toxicity.correlations(votes, start), 0.6).shape[1] < 6
    post = toxicity.fit_label_model(votes, start)
    assert ((post > 0.5) == truth).mean() > 0.97


def test_rates_meet_targets_and_stay_non_negative(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], size=400)
    tokens = rng.integers(0, 500, size=400)
    mixed = spark.createDataFrame(
        [(k, p[k].tolist(), int(tokens[k])) for k in range(400)] + [(400, [0.0, 0.0, 1.0], 0), (None, [1.0, 0.0, 0.0], 3)],
        "doc_id long, posterior array<double>, tokens long",
    )
    targets = {"a": 0.7, "b": 0.29, "c": 0.01}
    steps = mixing.fit_rates(mixed, ["a", "b", "c"], targets)
    got = mixing.with_rates(mixed, steps).collect()
    total = sum(r.rate * r.tokens for r in got)
    assert min(r.rate for r in got) == 0.0 and all(abs(r.copies - r.rate) < 1 for r in got)
    for k, d in enumerate(targets):
        assert abs(sum(r.rate * r.tokens * r.posterior[k] for r in got) / total - targets[d]) < 1e-3
    # the steps are a fixed point of plain projected gradient: numpy moves on from these rates by next to nothing
    a, n = np.array([r.posterior for r in got]), np.array([r.tokens for r in got], dtype=float)
    rate, weight = np.array([r.rate for r in got]), np.linalg.pinv((a * n[:, None]).T @ a)
    miss = (a * n[:, None]).T @ rate - n.sum() * np.array(list(targets.values()))
    assert np.abs(np.maximum(0, rate - a @ (weight @ miss)) - rate).max() < 0.01
    assert mixing.fit_rates(mixed.limit(0), ["a", "b", "c"], targets) == []


def test_posteriors_on_awkward_input(spark, awkward, no_docs):
    labelled = spark.createDataFrame([(k, "good" if k % 2 else "poor") for k in range(12)], "doc_id long, domain string")
    for some in (labelled, labelled.limit(0)):
        model = mixing.train(awkward, some, mixing.DOMAINS)
        got = mixing.with_posteriors(awkward, model).collect()
        assert len(got) == awkward.count() and all(abs(sum(r.posterior) - 1) < 1e-9 for r in got)
        assert mixing.with_posteriors(no_docs, model).count() == 0


@needs_tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF1))
        seen.append((name, docs, out))
        docs = out
    by_name = {name: (before, after) for name, before, after in seen}
    assert [n for n, _, _ in seen] == ["toxicity", "jaccard_join", "secret_scan", "mixing", "packing"]
    assert all(after.columns == columns for _, _, after in seen[:-1])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in x.select("doc_id").collect()} for x in by_name["toxicity"])
    clean = [d for d, toxic in labels.items() if not toxic]
    assert sum(d not in after for d in clean) <= 0.01 * len(clean) and sum(labels.get(d) == 1 for d in after) <= 8
    before, after = by_name["secret_scan"]
    assert before.count() == after.count() and after.filter("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    assert after.filter("n_chars <> length(text)").count() == 0
    before, after = by_name["mixing"]
    copies = collections.Counter(r.doc_id for r in after.select("doc_id").collect())
    good = [r.doc_id for r in spark.read.parquet(f"{SF1}/labels.parquet").filter("quality = 1 and toxic = 0").collect()]
    kept = [d for d in good if before.filter(F.col("doc_id") == d).limit(1).count()][:40]
    assert all(copies[d] >= 1 for d in kept)
    before, after = by_name["packing"]
    assert after.agg(F.sum("length")).first()[0] == after.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert after.filter("start = 0").count() == before.count() and after.filter(f"offset + length > {packing.WINDOW}").count() == 0


def test_rates_are_not_bounded_and_missed_targets_are_told(spark):
    rows = [(k, [1.0, 0.0], 10) for k in range(10)] + [(100 + k, [0.0, 1.0], 10) for k in range(90)]
    mixed = spark.createDataFrame(rows, "doc_id long, posterior array<double>, tokens long")
    targets = {"good": 0.9, "poor": 0.1}
    steps = mixing.fit_rates(mixed, ["good", "poor"], targets)
    assert steps.met and abs(steps.reached["good"] - 900) <= 0.1 and abs(steps.wished["good"] - 900) < 1e-9
    got = mixing.with_rates(mixed, steps).collect()
    assert all(abs(r.rate - (9 if r.doc_id < 100 else 1 / 9)) < 1e-2 for r in got)  # nine times its tokens
    with pytest.warns(UserWarning, match="misses its targets"):
        bound = mixing.fit_rates(mixed, ["good", "poor"], targets, most=4.0)
    assert not bound.met and abs(bound.reached["good"] - 400) < 1 and abs(bound.wished["good"] - 900) < 1e-9
    assert max(r.rate for r in mixing.with_rates(mixed, bound).collect()) == 4.0
    with pytest.warns(UserWarning):
        assert not mixing.fit_rates(mixed.filter("doc_id >= 100"), ["good", "poor"], targets).met  # no good tokens


def test_documents_of_the_whole_domain_are_kept(spark):
    good = np.r_[np.full(100, 0.98), np.full(60, 0.55), np.full(100, 0.02)]
    mixed = spark.createDataFrame(
        [(k, [float(g), float(1 - g)], 50) for k, g in enumerate(good)], "doc_id long, posterior array<double>, tokens long"
    )
    targets, total = {"good": 0.75, "poor": 0.25}, dict(total=1.0, keep=("good", 1.05))
    free = mixing.with_rates(mixed, mixing.fit_rates(mixed, ["good", "poor"], targets, **total)).collect()
    assert any(r.copies == 0 for r in free if r.posterior[0] >= 0.5)  # what the lower bound is for
    steps = mixing.fit_rates(mixed, ["good", "poor"], targets, **total, whole="good")
    got = mixing.with_rates(mixed, steps).collect()
    assert all(r.rate >= 1 and r.copies >= 1 for r in got if r.posterior[0] >= 0.5)
    assert steps.met and min(r.rate for r in got) < 1
    for k, d in enumerate(targets):
        assert abs(sum(r.rate * r.tokens * r.posterior[k] for r in got) - steps.reached[d]) < 1e-6 * sum(steps.reached.values())


@needs_tables
def test_pipeline_keeps_all_good_documents(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    model = mixing.train(docs, mixing.quality_domains(labels), corpus_pipeline.DOMAINS)
    likely = mixing.with_posteriors(docs, model).filter("posterior[0] >= posterior[1]")
    likely = {r.doc_id for r in likely.select("doc_id").collect()}
    kept = {r.doc_id for r in corpus_pipeline.mix_domains(spark, docs, SF1).select("doc_id").collect()}
    told = {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").join(docs, "doc_id").collect()}
    assert likely - {r.doc_id for r in labels.collect()} and not likely - kept
    assert not told - kept, (len(told), len(told - kept))


def test_rows_are_repeated_in_blocks(spark):
    wanted = {1: 0, 2: 1, 3: 1023, 4: 1024, 5: 1025, 6: 1_000_000}
    rows = spark.createDataFrame([(k, n) for k, n in wanted.items()] + [(7, None)], "doc_id long, copies long")
    got = mixing.repeated(rows)
    assert got.columns == ["doc_id"]
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == {k: n for k, n in wanted.items() if n}
