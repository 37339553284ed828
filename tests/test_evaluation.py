import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knowndate.operators import bootstrap, calibration, checks, metrics
from knowndate.operators.labels import LABEL
from knowndate.session import cut_lineage


def frame(spark, y, p):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id long, y int, p double")


def step_ap(y, p):
    ap = tp = n = 0
    for s in sorted(set(p), reverse=True):
        at = [a for a, b in zip(y, p) if b == s]
        tp, n = tp + sum(at), n + len(at)
        ap += sum(at) / sum(y) * tp / n
    return ap


def test_ranking_with_ties(spark):
    rnd = random.Random(2)
    y = [int(rnd.random() < 0.2) for _ in range(300)]
    p = [round(rnd.random() * 0.6 + 0.3 * a, 1) for a in y]
    r = metrics.ranking_metrics(frame(spark, y, p)).first()
    pairs = [(a > b) + 0.5 * (a == b) for a, i in zip(p, y) if i for b, j in zip(p, y) if not j]
    assert r.pr_auc == pytest.approx(step_ap(y, p)) and r.roc_auc == pytest.approx(np.mean(pairs))


def test_good_order_beats_bad(spark):
    y = [1, 1] + [0] * 998
    good = metrics.ranking_metrics(frame(spark, y, np.linspace(1, 0, 1000))).first()
    bad = metrics.ranking_metrics(frame(spark, y, np.linspace(0, 1, 1000))).first()
    assert good.pr_auc == 1.0 > bad.pr_auc
    a = {r.rate: r for r in metrics.alert_metrics(frame(spark, y, np.linspace(1, 0, 1000)), "id").collect()}
    assert a[0.005].lift > 1 and a[0.001].k == 1 and len(a) == 5


def test_alerts_inside_a_tied_score(spark):
    y = [0, 1, 0, 1, 1, 0, 0, 0, 0, 0]
    a = metrics.alert_metrics(frame(spark, y, [0.5] * 10), "id", [0.2, 0.4]).orderBy("rate").collect()
    assert [(r.k, r.true_positives) for r in a] == [(2, 1), (4, 2)]


def test_quantile_bins_keep_ties(spark):
    f = frame(spark, [0, 1] * 20, [0.1] * 30 + [0.2] * 5 + [0.9] * 5)
    out = calibration.quantile_bins(f).collect()
    assert sum(r.rows for r in out) == 40 and all(r.rows in (0, 30, 5, 35, 10) for r in out)
    flat = calibration.quantile_bins(frame(spark, [0, 1], [0.3, 0.3])).collect()
    assert [(r.rows, r.status) for r in flat] == [(2, "degenerate_constant_predictions")]


def test_offset_solves_its_equation(spark):
    rnd = np.random.default_rng(3)
    p = rnd.uniform(0.01, 0.6, 400)
    y = (rnd.uniform(size=400) < p * 0.5).astype(int)
    a = calibration.calibration_offset(frame(spark, y, p))
    z = np.log(p / (1 - p))
    assert abs(np.sum(y - 1 / (1 + np.exp(-(z + a))))) < 1e-6
    assert calibration.calibration_diagnostics(frame(spark, y, p))["status"] == "ok"


def test_diagnostic_statuses(spark):
    d = lambda y, p: calibration.calibration_diagnostics(frame(spark, y, p))
    assert d([0, 0], [0.1, 0.2])["status"] == "unavailable_single_class_test"
    assert d([0, 1], [0.1, 1.2])["status"] == "unavailable_invalid_inputs"
    assert d([0, 1], [0.3, 0.3])["status"] == "unavailable_constant_predictions"
    assert d([0, 0, 1], [0.1, 0.2, 0.3])["joint_status"] == "unavailable_complete_separation"
    assert d([0, 1, 1], [0.1, 0.1, 0.3])["joint_status"] == "unavailable_quasi_separation"


def test_calibrators_stay_in_range(spark):
    rnd = np.random.default_rng(5)
    p = rnd.uniform(size=300)
    y = (rnd.uniform(size=300) < p).astype(int)
    f = frame(spark, y, p)
    for method in ("platt", "isotonic"):
        got = [r.p_cal for r in calibration.Calibrator(method).fit(f).transform(f).select("p_cal").collect()]
        assert len(got) == 300 and min(got) >= 0 and max(got) <= 1
    same = calibration.calibration_report(f.withColumn("p_cal", F.col("p"))).first()
    assert same.raw_brier == same.calibrated_brier and same.raw_log_loss == same.calibrated_log_loss


def test_bootstrap(spark):
    f = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.8), ("b", 0, 0.2), ("b", 0, 0.1), ("c", 1, 0.6), ("c", 0, 0.3)], "cik string, y int, p double")
    one = {r.metric: r for r in bootstrap.paired_cluster_bootstrap(f, 0.3, 200).collect()}
    two = {r.metric: r for r in bootstrap.paired_cluster_bootstrap(f.repartition(5), 0.3, 200).collect()}
    assert one["brier"].unique_clusters == 3
    y, p = np.array([0, 1, 0, 0, 1, 0]), np.array([0.1, 0.8, 0.2, 0.1, 0.6, 0.3])
    assert one["brier"].baseline_minus_model == pytest.approx(np.mean((y - 0.3) ** 2 - (y - p) ** 2))
    for m in one:
        assert one[m].lower_95 == pytest.approx(two[m].lower_95) and one[m].lower_95 <= one[m].upper_95
        assert one[m].replicates_model_better + one[m].replicates_model_not_better == 200
    with pytest.raises(ValueError):
        bootstrap.paired_cluster_bootstrap(f.filter("cik = 'a'"), 0.3, 10)


def test_fit_guard(spark):
    data = [("validation", 1, 0.1), ("test", 1, 0.1)]
    f = spark.createDataFrame(data, "split string, y int, p double")
    assert not checks.fit_partition_guard(f, ["y", "p"]).first().passed
    g = spark.createDataFrame(data + [("test", 0, 0.2)], "split string, y int, p double")
    assert checks.fit_partition_guard(g, ["y", "p"]).first().passed


def test_missing_prices_leave_the_window(spark):
    """One NaN, or one huge volume, early in a history changes nothing once it has left the window."""
    import datetime

    from knowndate.operators.market import security_market_features

    day = datetime.date(2020, 1, 1)
    rows = [("s", day + datetime.timedelta(days=k), 10.0 + k % 7, 100.0 + k % 5) for k in range(200)]
    odd = [(s, d, c, float("nan") if k == 2 else 1e17 if k < 8 else v) for k, (s, d, c, v) in enumerate(rows)]
    schema = "security_id string, date date, close double, volume double"
    last = [
        security_market_features(spark.createDataFrame(x, schema)).orderBy("date").collect()[-1].volume_z_63d
        for x in (rows, odd)
    ]
    assert last[0] is not None and abs(last[0] - last[1]) < 1e-9


def _isotonic(score, n, tp):
    """Largest least mean over stretches around each place."""
    k = range(len(score))
    mean = lambda a, b: sum(tp[a : b + 1]) / sum(n[a : b + 1])
    return [max(min(mean(a, b) for b in k if b >= i) for a in k if a <= i) for i in k]


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_isotonic_blocks_do_not_depend_on_ranges(spark, ranges):
    rnd = random.Random(ranges)
    score = [i / 60 for i in range(60)]
    n = [rnd.randint(1, 9) for _ in score]
    tp = [rnd.randint(0, k) if rnd.random() < 0.8 else int(k * s) for k, s in zip(n, score)]
    counts = spark.createDataFrame(list(zip(score, n, tp)), "score double, n long, tp long")
    blocks = calibration.isotonic_blocks(counts, ranges).collect()
    got = {s: r.tp / r.n for r in blocks for s in score if r.low <= s <= r.high}
    assert [got[s] for s in score] == pytest.approx(_isotonic(score, n, tp))
    assert sum(r.n for r in blocks) == sum(n) and len({r.tp / r.n for r in blocks}) == len(blocks)


def test_isotonic_map_between_and_beyond_scores(spark):
    f = frame(spark, [0, 1, 0, 1], [0.2, 0.4, 0.4, 0.8])
    fitted = calibration.Calibrator("isotonic").fit(f)
    asked = spark.createDataFrame([(0.0,), (0.3,), (0.4,), (0.6,), (0.9,), (None,)], "p double")
    got = [r.p_cal for r in fitted.transform(asked).collect()]
    assert got[:5] == pytest.approx([0.0, 0.25, 0.5, 0.75, 1.0]) and got[5] is None


def test_logit_fits_meet_their_score_equations(spark):
    rnd = np.random.default_rng(8)
    z = np.round(rnd.normal(size=400), 2)
    y = (rnd.uniform(size=400) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(int)
    counts = spark.createDataFrame([(float(a), 1, int(b)) for a, b in zip(z, y)], "z double, n long, tp long")
    joint, ridged, shift = calibration.fit_logits(
        counts, [calibration.LogitFit(True), calibration.LogitFit(True, 1.0), calibration.LogitFit(False)]
    )
    for fit, slope_pull in ((joint, 0.0), (ridged, ridged.slope)):
        miss = y - 1 / (1 + np.exp(-(fit.intercept + fit.slope * z)))
        assert abs(miss.sum()) < 1e-8 and abs((miss * z).sum() - slope_pull) < 1e-8
    assert shift.slope == 1.0 and abs((y - 1 / (1 + np.exp(-(shift.intercept + z)))).sum()) < 1e-8


def test_bootstrap_in_blocks(spark):
    rnd = random.Random(4)
    rows = [(f"c{k % 37}", int(rnd.random() < 0.3), rnd.random()) for k in range(400)]
    f = spark.createDataFrame(rows, "cik string, y int, p double")
    one = {r.metric: r for r in bootstrap.paired_cluster_bootstrap(f, 0.3, 600).collect()}
    few = {r.metric: r for r in bootstrap.paired_cluster_bootstrap(f, 0.3, 600, block_rows=5).collect()}
    again = {r.metric: r for r in bootstrap.paired_cluster_bootstrap(f.repartition(7), 0.3, 600, block_rows=5).collect()}
    for m in one:
        assert few[m].lower_95 == pytest.approx(again[m].lower_95) and few[m].upper_95 == pytest.approx(again[m].upper_95)
        width = one[m].upper_95 - one[m].lower_95
        assert abs(few[m].lower_95 - one[m].lower_95) < 0.3 * width and abs(few[m].upper_95 - one[m].upper_95) < 0.3 * width
    sums = spark.createDataFrame([(k, 1, 1.0, 2.0) for k in range(37)], "idx long, n long, brier double, log_loss double")
    drawn = bootstrap.resampled_sums(sums, [5] * 7 + [2], 50, 1, 5).collect()
    assert len(drawn) == 50 and all(r.n == 37 and r.brier == 37 and r.log_loss == 74 for r in drawn)  # as many draws as clusters
    at = np.concatenate([bootstrap.draws_of(3, 0, rep, 37, 37) for rep in range(500)])
    assert abs(np.bincount(at, minlength=37) / 500 - 1).max() < 0.25


def test_yearly_high_from_quarterly_highs(spark):
    """Highs, drawdowns and losses against slices of the history, with gaps and a short start."""
    import datetime

    from knowndate.operators.market import issuer_market_features, security_market_features

    rnd = random.Random(4)
    day = datetime.date(2020, 1, 1)
    close = [None if rnd.random() < 0.1 else round(rnd.uniform(5, 50), 2) for _ in range(400)]
    rows = [("s", day + datetime.timedelta(days=k), c, 1.0) for k, c in enumerate(close)]
    prices = spark.createDataFrame(rows, "security_id string, date date, close double, volume double")
    by_security = security_market_features(prices).orderBy("date").collect()
    by_issuer = issuer_market_features(prices.withColumnRenamed("security_id", "cik")).orderBy("date").collect()

    def below(k, n):
        known = [c for c in close[max(0, k - n + 1) : k + 1] if c is not None]
        return close[k] / max(known) - 1 if close[k] is not None and len(known) >= 20 else None

    for k, r in enumerate(by_security):
        assert r.drawdown_63d == below(k, 63)
        assert r.drawdown_252d == r.distance_52w_high == below(k, 252) == by_issuer[k].drawdown_252d


def test_stopping_point():
    from knowndate.operators.modelling import stopping_point

    assert stopping_point([3.0, 2.0, 2.5, 2.0, 2.2], 3) == (2, True)  # equal losses: the earliest counts
    assert stopping_point([3.0, 2.0, 2.5, 1.9, 2.2], 3) == (4, False)
    assert stopping_point([1.0, 2.0, 0.5], 1) == (1, True)  # a gain after patience ran out is not seen
    assert stopping_point([1.0], 25) == (1, False)


@pytest.fixture(scope="module")
def learnable(spark):
    """Rows whose label follows x with noise; an eighth of x is missing."""
    rnd = random.Random(8)
    data = []
    for i in range(1200):
        x = rnd.gauss(0, 1)
        y = int(x + rnd.gauss(0, 0.8) > 1.2)
        split = "train" if i % 3 else "test" if i % 2 else "validation"
        data.append((i, split, y, None if i % 8 == 0 else x))
    schema = f"adsh long, split string, {LABEL} int, roa double"
    return cut_lineage(spark.createDataFrame(data, schema).repartition(2, "adsh"))


def test_boosted_trees_wait_and_are_cut_at_the_lowest_loss(spark, learnable):
    from pyspark.ml.feature import VectorAssembler

    from knowndate.operators import modelling

    fitted = modelling.train_boosted_tree(learnable, ["roa"], iterations=14, depth=2, patience=3)
    losses = fitted.config["held_out_loss"]
    kept = fitted.config["kept_iterations"]
    assert losses.index(min(losses)) + 1 == kept == fitted.model.getNumTrees
    assert fitted.config["iterations"] == len(losses) <= min(14, kept + 3)
    # the kept trees alone give the scores, and their weighted loss on the watched rows is the one reported
    prep = fitted.preprocessing
    ready = VectorAssembler(inputCols=prep.columns, outputCol="v").transform(prep.transform(learnable))
    watched = (
        ready.filter("split = 'train'")
        .filter(F.pmod(F.xxhash64("adsh"), F.lit(10_000)) < int(modelling.VALIDATION_SHARE * 10_000))
        .collect()
    )
    trees, steps = fitted.model.trees, fitted.model.treeWeights
    total = weight = 0.0
    for r in watched:
        margin = sum(s * t.predict(r["v"]) for s, t in zip(steps, trees))
        w = fitted.config["positive_weight"] if r[LABEL] else 1.0
        total += w * 2 * math.log1p(math.exp(-2 * margin * (1 if r[LABEL] else -1)))
        weight += w
    assert watched and abs(total / weight - min(losses)) < 1e-9
    rows = {r.split: r for r in modelling.scored_population(fitted, learnable).collect()}
    assert sum(r.rows for r in rows.values()) == 1200 and all(r.scored == r.rows for r in rows.values())


def test_metrics_of_a_model_are_those_of_its_scores(spark, learnable):
    """Average precision, AUC and Brier score against plain counting over the scored rows; the fit is at its optimum."""
    from knowndate.operators import modelling

    fitted = modelling.train_logistic(learnable, ["roa"])
    reported = {r.split: r for r in modelling.evaluate(fitted, learnable).collect()}
    scored = fitted.predict(learnable).collect()
    for split, r in reported.items():
        part = [(s.p, s[LABEL]) for s in scored if s.split == split]
        good, bad = [p for p, y in part if y], [p for p, y in part if not y]
        wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
        precision = [sum(p >= g for p in good) / sum(p >= g for p, _ in part) for g in good]
        assert abs(r.roc_auc - wins / len(good) / len(bad)) < 1e-9
        assert abs(r.pr_auc - sum(precision) / len(good)) < 1e-9
        assert abs(r.brier - sum((p - y) ** 2 for p, y in part) / len(part)) < 1e-9
    # balanced classes: at the optimum the weighted residuals add up to nothing
    train = [(s.p, s[LABEL]) for s in scored if s.split == "train"]
    positives = sum(y for _, y in train)
    weight = {1: len(train) / 2 / positives, 0: len(train) / 2 / (len(train) - positives)}
    assert abs(sum(weight[y] * (y - p) for p, y in train)) < 1e-3 * len(train)
