"""Subword embeddings: held-out accuracy, scores against plain averages, and awkward input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from knowndate.llm import frames, subword_quality, toxicity
from tests.llm.conftest import WORD, awkward_texts, needs_tables, prose
from tests.llm.test_models import SF1, auc


@needs_tables
def test_held_out_quality(spark):
    rows = entry_points.queries()["op13_subword_quality"](spark, SF1)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    got = rows.join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").filter("held_out").collect()
    truth, score = np.array([r.quality for r in got]), np.array([r.score for r in got])
    assert auc(truth, score) > 0.95
    said = np.array([r.predicted for r in got])
    assert said[truth == 1].mean() > 0.95 and said[truth == 0].mean() < 0.3
    assert rows.count() == spark.read.parquet(f"{SF1}/documents.parquet").count()


def test_scores_equal_averages_of_vectors_read_by_the_softmax(spark, awkward):
    random = np.random.default_rng(2)
    model = subword_quality.Model(random.normal(size=(256, 5)).astype(np.float32), random.normal(size=(2, 5)), np.array([0.3, -0.2]))
    got = subword_quality.score(awkward, model).select("text", "score").collect()
    hidden = model.embed(pa.array([r.text for r in got], pa.string()))
    logits = hidden @ model.output.T + model.bias
    top = np.exp(logits - logits.max(axis=1, keepdims=True))
    assert np.abs(np.array([r.score for r in got]) - (top / top.sum(axis=1, keepdims=True))[:, 1]).max() < 1e-5


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [t or "" for t in awkward_texts()] + [prose(3, 300_000)]
    together = subword_quality.bags(pa.array(texts), 1 << 14)
    for text, (bucket, share) in zip(texts, together):
        (alone, own), = subword_quality.bags(pa.array([text]), 1 << 14)
        assert np.array_equal(alone, bucket) and np.array_equal(own, share)
        words = len(WORD.findall(text))
        assert (len(bucket) > 0) == (words > 0) and abs(share.sum() - (words > 0)) < 1e-9


def test_features_by_hand():
    n = sum(len(doc) for doc, _ in subword_quality.features(pa.array(["ab ab abc"]), 1 << 14))
    # words 3; pairs 2, one of them of one word; n-grams of " ab " (4 bytes) 2 + 1 twice, of " abc " 3 + 2 + 1
    assert n == 3 + 2 + 1 + 2 * 3 + 6


def test_awkward_training_and_scoring(spark, awkward, no_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = subword_quality.train(awkward, labels, F.lit(True))
    got = subword_quality.score(awkward, model)
    assert got.columns == ["doc_id", "text", "spans", "score"] and got.count() == awkward.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert subword_quality.score(no_docs, model).count() == 0
    for some, value in ((labels.limit(0), 0.0), (labels.filter("quality = 0"), 0.0), (labels.filter("quality = 1"), 1.0)):
        model = subword_quality.train(awkward, some, F.lit(True))
        assert {r.score for r in subword_quality.score(awkward, model).collect()} == {value}


def test_samples_stay_bounded_when_one_id_repeats(spark):
    many = spark.range(40_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    docs = many.union(spark.range(2, 200).select("id", F.lit("other")))
    labels = spark.range(1, 200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    assert frames.bounded_sample(docs, labels, F.lit(True), 1000, "toxic").count() == 199
    rows = toxicity.training_rows(docs, labels, F.lit(True), 100, "toxic")
    assert rows.columns == ["text", "label"] and rows.count() == 100
