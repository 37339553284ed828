"""Hard negatives against a full pass over all pairs, whatever the tree, cells and chunks look like."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from knowndate.llm import hard_negatives as hn
from tests.compare import connect, differences
from tests.llm.conftest import SF, needs_tables

SCHEMA = "vec_id long, label int, embedding array<float>, score int"


def brute(rows, positives=5, negatives=10, window=(30, 90), every=100):
    """``rows``: (id, label, integer vector)."""
    out, score = [], lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    for i, label, vec in rows:
        if i % every:
            continue
        all_scores = sorted((-score(vec, v), j, other == label) for j, other, v in rows if j != i)
        for s, p, _ in [r for r in all_scores if r[2]][:positives]:
            fits = [(-t, j) for t, j, same in all_scores if not same and window[0] * -s <= 100 * -t <= window[1] * -s]
            out += [(i, p, k + 1, j, -s, t) for k, (t, j) in enumerate(fits[:negatives])]
    return sorted(out)


def table(n, d, seed=5, labels=4):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(6, d))
    x = centres[random.integers(0, 6, n)] + 0.5 * random.normal(size=(n, d))
    return [(int(k), int(random.integers(0, labels)), v.astype(np.float32)) for k, v in enumerate(x)]


def integers(rows):
    return [(i, label, np.floor(256 * v.astype(float)).astype(np.int64)) for i, label, v in rows]


def frame(spark, rows):
    return spark.createDataFrame([(i, label, [float(x) for x in v], 0) for i, label, v in rows], SCHEMA)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_equal_to_a_full_pass_over_a_deep_tree(spark):
    rows = table(1200, 6)
    mined = hn.mine(frame(spark, rows), F.col("id") % 100 == 0, sample_rows=300, ways=4, cell_rows=40, chunk_rows=5)
    assert mined.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got(mined) == brute(integers(rows))


def test_ties_copies_and_unusable_rows(spark):
    rows = table(300, 3, labels=3)
    rows += [(1000 + k, k % 3, rows[0][2]) for k in range(60)]  # one vector under many ids: equal scores sort by id
    plain = frame(spark, rows)
    bad = spark.createDataFrame(
        [(2000, None, [1.0, 1.0, 1.0], 0), (2100, 1, None, 0), (2200, 1, [1.0, None, 1.0], 0), (2300, 1, [1.0, float("nan"), 1.0], 0),
         (None, 1, [1.0, 1.0, 1.0], 0), (2400, 1, [float("inf"), 0.0, 0.0], 0), (2500, 1, [1.0], 0)], SCHEMA,
    )
    mined = hn.mine(plain.union(bad).union(plain.limit(50)), F.col("id") % 100 == 0, cell_rows=32, sample_rows=100)
    assert got(mined) == brute(integers(rows))
    assert hn.mine(plain.limit(0), F.col("id") % 100 == 0).count() == 0
    assert hn.mine(plain.filter("vec_id % 100 <> 0"), F.col("id") % 100 == 0).count() == 0
    assert hn.mine(plain.withColumn("label", F.col("vec_id").cast("int")), F.col("id") % 100 == 0).count() == 0  # no positives


def test_large_components_and_negative_scores(spark):
    rows = [(100 * k, k % 2, [float(s * 3e5 * (k + 1)), 1e6 - k]) for k, s in enumerate([1, -1, 1, -1, 1, 1, -1, -1])]
    rows = [(i, label, np.array(v, dtype=np.float32)) for i, label, v in rows]
    assert got(hn.mine(frame(spark, rows), F.col("id") % 100 == 0)) == brute(integers(rows))
    zero = [(100, 0, [0.0, 0.0]), (101, 0, [0.0, 0.0]), (102, 1, [0.0, 0.0]), (200, 1, [-1.0, 0.0]), (201, 1, [1.0, 0.0])]
    zero = [(i, label, np.array(v, dtype=np.float32)) for i, label, v in zero]
    assert got(hn.mine(frame(spark, zero), F.col("id") % 100 == 0)) == brute(integers(zero))


def test_subtrees_are_left_out_on_rows_with_structure(spark):
    random = np.random.default_rng(1)
    sample = np.concatenate([100 * c + random.normal(size=(50, 4)) for c in range(20)])
    tree = hn.grow(sample, 30, 8)
    tree = tree.with_ranges(tree.ranges(sample))  # each (node, point, subtree) comes up once
    near, far, _ = tree.bounds(sample[:200])
    away, leaf = hn.distances(sample[:200], sample), tree.leaf_of(sample)
    for j in range(tree.leaves):
        assert (near[:, j] <= away[:, leaf == j].min(axis=1) + 1e-6).all() and (far[:, j] >= away[:, leaf == j].max(axis=1) - 1e-6).all()
    assert (near <= 10).mean() < 0.3


@needs_tables
@pytest.mark.parametrize("name", ["op12_hard_negatives"])
def test_query_against_sql(spark, name):
    ours, theirs, (more, less) = differences(entry_points.queries()[name](spark, SF), connect(SF), entry_points.oracle_sql()[name])
    assert ours == theirs and not more and not less
