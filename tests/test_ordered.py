"""Distributed order statistics against plain single-machine results."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowndate.operators import ordered, sequences


def skewed_filings(spark, n=600):
    """One issuer holds two thirds of the filings, many of them on one day."""
    rnd = random.Random(7)
    data = []
    for i in range(n):
        cik = "hot" if i % 3 else f"c{i % 7}"
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rnd.choice([0, 0, rnd.randrange(400)]))
        data.append((cik, f"a{rnd.randrange(10**9):09d}", day, float(rnd.randrange(1, 50)), float(i)))
    return spark.createDataFrame(data, "cik string, adsh string, filed date, assets double, revenue double")


def test_changes_do_not_depend_on_chunks(spark):
    f = skewed_filings(spark)
    w = W.partitionBy("cik").orderBy("filed", "adsh")
    want = f.select(
        "adsh",
        (F.try_divide(F.col("assets"), F.lag("assets").over(w)) - 1).alias("q"),
        (F.try_divide(F.col("assets"), F.lag("assets", 4).over(w)) - 1).alias("y"),
    )
    for chunk in (4, 7, 10_000):
        got = sequences.add_changes(f, ["assets"], chunk_rows=chunk).select("adsh", "assets__qoq", "assets__yoy")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_sequences_do_not_depend_on_chunks_or_later_rows(spark):
    f = skewed_filings(spark, 200)
    small = sequences.build_sequences(f, ["assets", "revenue"], chunk_rows=9)
    large = sequences.build_sequences(f, ["assets", "revenue"])
    key = lambda df: sorted((r.adsh, r.length, r.sequence) for r in df.collect())
    assert key(small) == key(large)
    cut = dt.date(2020, 6, 1)
    early = sequences.build_sequences(f.filter(F.col("filed") <= F.lit(cut)), ["assets", "revenue"])
    assert key(early) == key(large.filter(F.col("filed") <= F.lit(cut)))


def test_sequence_padding(rows):
    f = rows("cik string, adsh string, filed date, x double",
             [("1", str(i), dt.date(2020, 1, 1 + i), float(i)) for i in range(6)])
    out = sequences.build_sequences(f, ["x"], lookback=4).orderBy("adsh").collect()
    assert [r.length for r in out] == [2, 3, 4, 4, 4]
    assert out[0].sequence == [[0.0], [0.0], [0.0], [1.0]]


def test_running_totals(spark):
    rnd = random.Random(3)
    data = {(g, rnd.random()): rnd.randrange(9) for g in "ab" for _ in range(300)}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in data.items()], "g string, v double, n long")
    for desc in (False, True):
        got = {(r.g, r.v): (r.n__cum, r.n__total) for r in ordered.running_totals(df, "v", ["n"], ["g"], desc, 16).collect()}
        for g in "ab":
            run = 0
            for v in sorted((v for h, v in data if h == g), reverse=desc):
                run += data[(g, v)]
                assert got[(g, v)][0] == run
            assert got[(g, v)][1] == run


def test_exact_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(1)
    values = {"a": rnd.normal(size=501), "b": np.repeat([1.0, 2.0, 4.0, 9.0], [1, 1, 1, 1])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.975, 1.0]
    for r in ordered.exact_quantiles(df, "v", probs, ["k"]).collect():
        assert abs(r["quantile"] - np.quantile(values[r.k], r.probability)) < 1e-12


def test_dense_index_is_a_permutation(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    got = ordered.dense_index(df, "k", "i", 16).collect()
    assert sorted(r.i for r in got) == list(range(500)) and {r.i__n for r in got} == {500}


def test_ranges_of_ties_nulls_and_nan(spark):
    values = [None, float("nan"), float("-inf"), float("inf"), *([0.5] * 300), *(k / 100 for k in range(200))]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = sorted(((r["__range"], r.v) for r in ordered.with_ranges(df, "v", 8).collect()), key=lambda t: t[0])
    assert got[0][1] is None and got[-1][1] != got[-1][1] and len({r for r, _ in got}) > 4
    real = [v for _, v in got if v is not None and v == v]
    low = {}
    for r, v in got:
        if v is not None and v == v:
            low.setdefault(r, []).append(v)
    assert len(real) == len(values) - 2 and all(max(low[a]) < min(low[b]) for a, b in zip(sorted(low), sorted(low)[1:]))
