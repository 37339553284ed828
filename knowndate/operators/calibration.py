"""Calibration: fitting, reliability bins, offsets, diagnostics, evidence report.

Everything works on one table of counts: rows ``n`` and positives ``tp`` per distinct
score.  Logistic fits are Newton steps; each step is one aggregation of that table for all
fits at once, and brings back a few sums.  They start from a fit on a histogram of at most
``START_BINS`` bins, so two or three steps are left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowndate.operators.metrics import log_loss_terms, ranking_of, score_counts
from knowndate.operators.ordered import exact_quantiles, quantiles_of, running_totals, with_ranges
from knowndate.session import cut_lineage

# --- fixed values -----------------------------------------------------------
PLATT_CLIP = 1e-6
LOGIT_CLIP = 1e-12
MEAN_SCORE_TOLERANCE = 1e-7
BINS = 10
OFFSET_REACH = 40.0
# ----------------------------------------------------------------------------

#: Bins of the histogram that starts a fit, steps after which a fit gives up, ranges merged at once.
START_BINS, MOST_STEPS, MERGED = 4096, 100, 16


def logit(p: Column, clip: float = LOGIT_CLIP) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


@dataclass
class LogitFit:
    """A fit of sigmoid(intercept + slope * z); ``ridge`` penalises half the squared slope in the summed loss."""

    free_slope: bool
    ridge: float = 0.0
    intercept: float = 0.0
    slope: float = 1.0
    score: tuple[float, float] = (float("inf"), float("inf"))  # summed residuals, plain and times z
    done: bool = False

    def sums(self, z, n, tp, exp, total):
        """Gradient (2) and curvature (3) of the negative summed loss, by ``total`` of an expression."""
        mean = 1 / (1 + exp(-(z * self.slope + self.intercept)))
        miss, spread = tp - n * mean, n * mean * (1 - mean)
        return [total(x) for x in (miss, miss * z, spread, spread * z, spread * z * z)]

    def step(self, sums) -> None:
        f, g, aa, ab, bb = (float(x or 0.0) for x in sums)
        self.score = f, g
        g, bb = g - self.ridge * self.slope, bb + self.ridge
        if self.free_slope:
            det = aa * bb - ab * ab
            by = ((bb * f - ab * g) / det, (aa * g - ab * f) / det) if det > 0 else (0.0, 0.0)
        else:
            by = (f / aa if aa > 0 else 0.0, 0.0)
        self.intercept, self.slope = self.intercept + by[0], self.slope + by[1]
        self.done = max(map(abs, by)) <= 1e-11 * (1 + max(abs(self.intercept), abs(self.slope)))

    def start(self, z: np.ndarray, n: np.ndarray, tp: np.ndarray) -> None:
        """The fit on a histogram; a step that does not lower the loss is halved."""

        def loss() -> float:
            u = z * self.slope + self.intercept
            return float((n * np.logaddexp(0, u) - tp * u).sum()) + self.ridge / 2 * self.slope**2

        for _ in range(MOST_STEPS):
            before, at = loss(), (self.intercept, self.slope)
            with np.errstate(over="ignore"):
                self.step(self.sums(z, n, tp, np.exp, np.sum))
            if self.done:
                break
            for _ in range(40):
                if loss() <= before:
                    break
                self.intercept, self.slope = (at[0] + self.intercept) / 2, (at[1] + self.slope) / 2
        self.done = False


def fit_logits(counts: DataFrame, fits: list[LogitFit]) -> list[LogitFit]:
    """Fit on counts (z, n, tp).  Eager: a histogram, then one aggregation a step for all fits."""
    place = F.floor((F.col("z") + 28) / 56 * START_BINS)  # clipped logits lie within 28
    bins = counts.groupBy(place.alias("bin")).agg(
        (F.sum(F.col("n") * F.col("z")) / F.sum("n")).alias("z"), F.sum("n").alias("n"), F.sum("tp").alias("tp")
    ).collect()
    if not bins:
        return fits
    z, n, tp = (np.array([float(r[c]) for r in bins]) for c in ("z", "n", "tp"))
    for fit in fits:
        fit.start(z, n, tp)
    columns = F.col("z"), F.col("n").cast("double"), F.col("tp").cast("double")
    for _ in range(MOST_STEPS):
        left = [fit for fit in fits if not fit.done]
        if not left:
            break
        row = counts.agg(*[x.alias(f"s{k}_{i}") for k, fit in enumerate(left) for i, x in enumerate(fit.sums(*columns, F.exp, F.sum))]).first()
        for k, fit in enumerate(left):
            fit.step(row[5 * k : 5 * k + 5])
    return fits


def _pooled(batch: pd.DataFrame) -> pd.DataFrame:
    """Adjacent violators of rows (low, high, n, tp) pooled into blocks of rising rates."""
    blocks: list[list[float]] = []
    for low, high, n, tp in batch.sort_values("low")[["low", "high", "n", "tp"]].itertuples(index=False):
        block = [low, high, n, tp]
        while blocks and blocks[-1][3] * block[2] >= block[3] * blocks[-1][2]:
            last = blocks.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        blocks.append(block)
    out = pd.DataFrame(blocks, columns=["low", "high", "n", "tp"])
    return out.astype({"n": "int64", "tp": "int64"})


def isotonic_blocks(counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """(low, high, n, tp): blocks of scores with rising rates, of a stored table (score, n, tp).

    Violators are pooled inside score ranges first; then the blocks that are left of ``MERGED`` neighbouring ranges
    at a time, until one range holds them all.
    """
    blocks = with_ranges(counts, "score", ranges).select(
        "__range", F.col("score").alias("low"), F.col("score").alias("high"), "n", "tp"
    )
    left = blocks.agg(F.max("__range")).first()[0]
    while True:
        pooled = blocks.groupBy("__range").applyInPandas(
            lambda key, batch: _pooled(batch).assign(__range=key[0]), "low double, high double, n long, tp long, __range double"
        )
        if not left:
            return pooled.drop("__range")
        blocks = cut_lineage(pooled).withColumn("__range", F.floor(F.greatest("__range", F.lit(0.0)) / MERGED).cast("double"))
        left = left // MERGED


class Calibrator:
    """Platt or isotonic map from raw to calibrated probability.

    Fitted on counts per distinct score, so the fit does not grow with ties.
    """

    def __init__(self, method: str = "isotonic"):
        if method not in ("isotonic", "platt"):
            raise ValueError("method must be isotonic or platt")
        self.method = method
        self.slope = self.intercept = None
        self.scores, self.rates = np.zeros(0), np.zeros(0)

    def fit(self, scored: DataFrame, y: str = "y", p: str = "p") -> "Calibrator":
        """Eager."""
        return self.fit_counts(cut_lineage(score_counts(scored, y, p)))

    def fit_counts(self, counts: DataFrame) -> "Calibrator":
        """Eager: ``counts`` (score, n, tp) is a stored table.  Only sums or the final blocks come to the driver."""
        if self.method == "isotonic":
            blocks = isotonic_blocks(counts).orderBy("low").collect()
            ends = [(x, r["tp"] / r["n"]) for r in blocks for x in sorted({r["low"], r["high"]})]
            self.scores, self.rates = (np.array(c, dtype=float) for c in zip(*ends)) if ends else (np.zeros(0), np.zeros(0))
            return self
        # unit-strength ridge on the slope
        z = logit(F.col("score"), PLATT_CLIP).alias("z")
        (fitted,) = fit_logits(counts.select(z, "n", "tp"), [LogitFit(True, 1.0)])
        self.slope, self.intercept = fitted.slope, fitted.intercept
        return self

    def transform(self, scored: DataFrame, p: str = "p", out: str = "p_cal") -> DataFrame:
        """Isotonic rates are interpolated between scores, and constant beyond the first and the last."""
        if self.method == "platt":
            z = logit(F.col(p), PLATT_CLIP)
            return scored.withColumn(out, sigmoid(F.lit(self.slope) * z + F.lit(self.intercept)))
        scores, rates = self.scores, self.rates
        if not len(scores):
            return scored.withColumn(out, F.lit(None).cast("double"))

        @F.pandas_udf("double")
        def interpolated(x: pd.Series) -> pd.Series:
            return pd.Series(np.interp(x.astype(float), scores, rates))

        return scored.withColumn(out, F.when(F.col(p).isNotNull(), interpolated(F.col(p).cast("double"))))


def calibration_report(
    scored: DataFrame, y: str = "y", raw: str = "p", calibrated: str = "p_cal"
) -> DataFrame:
    """One row: Brier score and log loss before and after calibration."""
    label = F.col(y).cast("double")
    squared = lambda c: F.avg(F.pow(F.col(c) - label, F.lit(2)))
    return scored.agg(
        squared(raw).alias("raw_brier"),
        squared(calibrated).alias("calibrated_brier"),
        F.avg(log_loss_terms(label, F.col(raw))).alias("raw_log_loss"),
        F.avg(log_loss_terms(label, F.col(calibrated))).alias("calibrated_log_loss"),
    )


def reliability_bins(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Ten equal-width bins, empty ones included."""
    place = F.least(F.floor(F.col(p) * BINS), F.lit(BINS - 1)).cast("int")
    filled = scored.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(p).alias("mean_probability"),
        F.avg(F.col(y).cast("double")).alias("event_rate"),
    )
    frame = scored.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return frame.join(filled, "bin", "left").select(
        "bin",
        (F.col("bin") / BINS).alias("lower"),
        ((F.col("bin") + 1) / BINS).alias("upper"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "mean_probability",
        "event_rate",
    )


def quantile_edges(scored: DataFrame, p: str = "p", bins: int = BINS) -> list[float]:
    """Distinct quantile edges of the scores. Eager: at most ``bins + 1`` numbers."""
    steps = [i / bins for i in range(bins + 1)]
    found = exact_quantiles(scored, p, steps).select("quantile").distinct().collect()
    return sorted(r["quantile"] for r in found)


def quantile_bins(scored: DataFrame, y: str = "y", p: str = "p", bins: int = BINS) -> DataFrame:
    """Quantile bins that never split equal scores; the realised number may be smaller.

    Eager for the edges.  Constant scores give one bin with the status
    ``degenerate_constant_predictions``.
    """
    edges = quantile_edges(scored, p, bins)
    if not edges:
        edges = [0.0]
    constant = len(edges) < 2
    lows, highs = (edges[:1], edges[:1]) if constant else (edges[:-1], edges[1:])
    interior = F.array(*[F.lit(e) for e in edges[1:-1]]).cast("array<double>")
    place = F.size(F.filter(interior, lambda e: e <= F.col(p)))
    filled = scored.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(y).cast("bigint")).alias("positives"),
        F.avg(p).alias("mean_probability"),
        F.avg(F.col(y).cast("double")).alias("event_rate"),
    )
    frame = scored.sparkSession.range(len(lows)).select(F.col("id").cast("int").alias("bin"))
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bin") + 1)
    return frame.join(filled, "bin", "left").select(
        "bin",
        at(lows).alias("lower"),
        at(highs).alias("upper"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("positives", F.lit(0)).alias("positives"),
        "mean_probability",
        "event_rate",
        F.lit("degenerate_constant_predictions" if constant else "ok").alias("status"),
    )


def _logits(counts: DataFrame) -> DataFrame:
    return counts.withColumn("z", logit(F.col("score")))


def _summary(counts: DataFrame):
    """One row of what the fits need to know beforehand, of counts (score, n, tp)."""
    z, n, tp = F.col("z"), F.col("n").cast("double"), F.col("tp").cast("double")
    at = lambda a: F.sum(tp - n * sigmoid(z + F.lit(a)))
    neg = F.col("n") > F.col("tp")
    return _logits(counts).agg(
        F.sum("n").alias("n"),
        F.sum("tp").alias("tp"),
        F.min("score").alias("p_lo"),
        F.max("score").alias("p_hi"),
        F.min(F.when(neg, z)).alias("lo0"),
        F.max(F.when(neg, z)).alias("hi0"),
        F.min(F.when(F.col("tp") > 0, z)).alias("lo1"),
        F.max(F.when(F.col("tp") > 0, z)).alias("hi1"),
        at(-OFFSET_REACH).alias("at_low"),
        at(OFFSET_REACH).alias("at_high"),
        F.sum("bad_y").alias("bad_y"),
        F.count_if(~F.coalesce(F.col("score").between(0, 1) & ~F.isnan("score"), F.lit(False))).alias("bad_p"),
    ).head()


def _has_offset(s) -> bool:
    return s["at_low"] is not None and s["at_low"] >= 0 >= s["at_high"]


def calibration_offset(scored: DataFrame, y: str = "y", p: str = "p") -> float | None:
    """Offset a with sum(y - sigmoid(logit(p) + a)) = 0 in [-40, 40], or None without a root. Eager."""
    counts = cut_lineage(_checked_counts(scored, y, p))
    if not _has_offset(_summary(counts)):
        return None
    return fit_logits(_logits(counts), [LogitFit(False)])[0].intercept


def calibration_diagnostics(scored: DataFrame, y: str = "y", p: str = "p") -> dict:
    """Offset, joint intercept/slope and their availability on labelled test scores.

    Eager: only scalars come back.  The joint fit needs overlapping classes; complete
    or quasi separation on the logit, constant scores, a single class, or a fit that
    misses its score equations are reported as statuses instead of numbers.
    """
    counts = cut_lineage(_checked_counts(scored, y, p))
    curve = running_totals(counts.select("score", "n", "tp"), "score", ["n", "tp"], descending=True)
    return _diagnostics(counts, ranking_of(curve).head()["pr_auc"])


def _checked_counts(scored: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """``score_counts`` with the number of rows whose label is not 0 or 1."""
    return scored.groupBy(*(by or []), F.col(p).alias("score")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(y).cast("bigint")).alias("tp"),
        F.count_if(~F.coalesce(F.col(y).isin(0, 1), F.lit(False))).alias("bad_y"),
    )


def _diagnostics(counts: DataFrame, ap: float | None) -> dict:
    """``calibration_diagnostics`` of a stored table of checked counts with the average precision ``ap``."""
    s = _summary(counts)
    if not s["n"] or s["bad_y"] or s["bad_p"]:
        return {"status": "unavailable_invalid_inputs"}
    report: dict = {"rows": s["n"], "prevalence": s["tp"] / s["n"]}
    if s["tp"] in (0, s["n"]):
        return report | {"status": "unavailable_single_class_test"}
    report |= {
        "average_precision": ap,
        "average_precision_over_prevalence": ap / report["prevalence"],
    }
    bracketed, constant = _has_offset(s), s["p_lo"] == s["p_hi"]
    joint = "unavailable_constant_predictions" if constant else _joint_status(s)
    offset_fit, joint_fit = LogitFit(False), LogitFit(True)
    fit_logits(_logits(counts), [offset_fit] * bracketed + [joint_fit] * (joint == "ok"))
    report["calibration_in_the_large"] = offset_fit.intercept if bracketed else None
    report["calibration_in_the_large_status"] = "ok" if bracketed else "unavailable_no_bracketed_root"
    if constant:
        return report | {"status": joint}
    if joint == "ok":
        worst = max(map(abs, joint_fit.score)) / s["n"]
        if worst <= MEAN_SCORE_TOLERANCE:
            report |= {"intercept": joint_fit.intercept, "slope": joint_fit.slope, "max_abs_mean_score": worst}
        else:
            joint = "unavailable_score_equations"
    report["joint_status"] = joint
    done = joint == "ok" and bracketed
    return report | {"status": "ok" if done else "partial"}


def _joint_status(s) -> str:
    if min(s["lo0"], s["lo1"]) == max(s["hi0"], s["hi1"]):
        return "unavailable_constant_logit_after_clipping"
    if s["hi0"] < s["lo1"] or s["hi1"] < s["lo0"]:
        return "unavailable_complete_separation"
    if s["hi0"] == s["lo1"] or s["hi1"] == s["lo0"]:
        return "unavailable_quasi_separation"
    return "ok"


#: The two probabilities of a test row, as sections name them.
KINDS = ("raw", "calibrated")


def probability_evidence(
    scored: DataFrame, method: str = "platt", y: str = "y", p: str = "p", split: str = "split"
) -> DataFrame:
    """Calibrate on validation, evaluate on test: long rows (section, metric, value).

    The rows are read once, into a stored table of counts per split and score; all sections come
    from it.  Eager: fits, bin edges and the scalars of the diagnostics.  Test labels only enter
    the evaluation.
    """
    used = scored.filter(F.col(split).isin("validation", "test"))
    counts = cut_lineage(_checked_counts(used, y, p, [split]))
    validation = counts.filter(F.col(split) == "validation").select("score", "n", "tp")
    base = validation.agg(F.sum("n").alias("n"), F.sum("tp").alias("tp")).head()
    if not base["tp"] or base["tp"] == base["n"]:
        raise ValueError("validation: calibration requires both outcome classes")
    constant = base["tp"] / base["n"]
    test = Calibrator(method).fit_counts(validation).transform(
        counts.filter(F.col(split) == "test"), "score", "p_cal"
    )
    test = cut_lineage(test.select(F.col("score").alias("raw"), F.col("p_cal").alias("calibrated"), "n", "tp", "bad_y"))
    both = test.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in KINDS])).alias("k"), "n", "tp", "bad_y"
    ).groupBy("k.kind", "k.score").agg(*[F.sum(c).alias(c) for c in ("n", "tp", "bad_y")])
    curve = cut_lineage(running_totals(both, "score", ["n", "tp", "bad_y"], ["kind"], descending=True))

    rising = curve.withColumn("n__cum", F.col("n__total") - F.col("n__cum") + F.col("n"))
    steps = [i / BINS for i in range(BINS + 1)]
    edges: dict[str, list[float]] = {k: [] for k in KINDS}
    for row in quantiles_of(rising, "score", steps, ["kind"]).select("kind", "quantile").distinct().collect():
        edges[row["kind"]].append(row["quantile"])  # at most BINS + 1 numbers each
    places = F.lit(0)
    for kind in KINDS:
        inner = F.array(*[F.lit(e) for e in sorted(edges[kind])[1:-1]]).cast("array<double>")
        places = F.when(F.col("kind") == kind, F.size(F.filter(inner, lambda e: e <= F.col("score")))).otherwise(places)
    number = {
        "reliability_": (F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int"), dict.fromkeys(KINDS, BINS)),
        "quantile_reliability_": (places, {k: max(len(edges[k]) - 1, 1) for k in KINDS}),
    }
    binned = curve.select(
        F.explode(F.array(*[
            F.struct(F.concat(F.lit(name), "kind").alias("section"), place.alias("bin")) for name, (place, _) in number.items()
        ])).alias("b"), "n", "tp",
    ).groupBy("b.section", "b.bin").agg((F.sum("tp") / F.sum("n")).alias("value"))
    session = scored.sparkSession
    frame = session.createDataFrame(
        [(f"{name}{k}", b) for name, (_, sizes) in number.items() for k in KINDS for b in range(sizes[k])],
        "section string, bin int",
    )
    bins = frame.join(F.broadcast(binned), ["section", "bin"], "left").select(  # at most BINS rows a section
        "section", F.concat(F.lit("bin_"), F.col("bin").cast("string")).alias("metric"), "value"
    )

    ranking = {r["kind"]: r.asDict() for r in ranking_of(curve, ["kind"]).collect()}  # two rows

    neg = F.col("n") - F.col("tp")
    total = F.sum("n")
    mean = lambda one, zero: F.sum(F.col("tp") * one + neg * zero) / total
    losses = {}
    for name, c in {"raw": F.col("raw"), "calibrated": F.col("calibrated"), "base_rate": F.lit(constant)}.items():
        losses[f"{name}_brier"] = mean(F.pow(1 - c, F.lit(2)), F.pow(c, F.lit(2)))
        losses[f"{name}_log_loss"] = mean(log_loss_terms(F.lit(1.0), c), log_loss_terms(F.lit(0.0), c))
    rate = F.sum("tp") / total
    losses["oracle_test_base_rate_brier"] = rate * (1 - rate)
    quality = test.agg(*[v.alias(k) for k, v in losses.items()]).unpivot(
        [], list(losses), "metric", "value"
    ).select(F.lit("probability_quality").alias("section"), "metric", "value")

    calibrated = curve.filter("kind = 'calibrated'").select("score", "n", "tp", "bad_y")
    diagnostics = _diagnostics(calibrated, ranking.get("calibrated", {}).get("pr_auc"))
    scalars = [
        ("population", "validation_rows", float(base["n"])),
        ("population", "validation_positives", float(base["tp"])),
        ("population", "baseline_probability", constant),
    ] + [("diagnostics", k, float(v)) for k, v in diagnostics.items() if isinstance(v, (int, float))]
    scalars += [
        (f"ranking_{kind}", k, None if v is None else float(v))
        for kind, row in ranking.items() for k, v in row.items() if k != "kind"
    ]
    out = session.createDataFrame(scalars, "section string, metric string, value double")
    for part in (quality, bins):
        out = out.unionByName(part)
    return out


def probabilities(vector: str = "probability") -> Column:
    """Probability of class 1 from a Spark ML probability vector."""
    return vector_to_array(F.col(vector))[1]
