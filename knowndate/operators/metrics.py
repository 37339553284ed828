"""Ranking metrics of rare-event scores.

Scores are first counted per distinct value; running totals over the distinct
values (see ``ordered.running_totals``) give every ranking metric without a global
sort in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowndate.operators.ordered import exact_quantiles, running_totals
from knowndate.session import cut_lineage

# --- fixed values -----------------------------------------------------------
ALERT_RATES = [0.001, 0.005, 0.01, 0.025, 0.05]
# ----------------------------------------------------------------------------


def score_counts(scored: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None):
    """One row per (by, distinct score): rows ``n`` and positives ``tp``."""
    return scored.groupBy(*(by or []), F.col(p).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("tp")
    )


def score_curve(scored: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None):
    """Distinct scores from high to low with cumulative rows and positives."""
    return running_totals(score_counts(scored, y, p, by), "score", ["n", "tp"], by, descending=True)


def ranking_metrics(
    scored: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None
) -> DataFrame:
    """Rows, positives, prevalence, step-wise average precision, ROC-AUC, Brier score.

    One row, or one per ``by`` group (a small fixed set such as splits or models).
    """
    return ranking_of(score_curve(scored, y, p, by), by)


def ranking_of(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``ranking_metrics`` from a score curve."""
    neg = F.col("n") - F.col("tp")
    neg_cum = F.col("n__cum") - F.col("tp__cum")
    neg_total = F.max("n__total") - F.max("tp__total")
    below = (F.col("n__total") - F.col("tp__total")) - neg_cum
    precision = F.col("tp__cum") / F.col("n__cum")
    squared = F.col("tp") * F.pow(F.col("score") - 1, F.lit(2)) + neg * F.pow("score", F.lit(2))
    return curve.groupBy(*(by or [])).agg(
        F.max("n__total").alias("rows"),
        F.max("tp__total").alias("positives"),
        (F.max("tp__total") / F.max("n__total")).alias("prevalence"),
        F.try_divide(F.sum(F.col("tp") * precision), F.max("tp__total")).alias("pr_auc"),
        F.try_divide(
            F.sum(F.col("tp") * (below + neg / 2.0)), F.max("tp__total") * neg_total
        ).alias("roc_auc"),
        (F.sum(squared) / F.max("n__total")).alias("brier"),
    )


def best_f1(scored: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None):
    """Threshold with the largest F1; the lowest threshold among equals."""
    curve = score_curve(scored, y, p, by)
    precision = F.col("tp__cum") / F.col("n__cum")
    recall = F.coalesce(F.try_divide(F.col("tp__cum"), F.col("tp__total")), F.lit(0.0))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    rows = curve.select(
        *(by or []),
        F.struct(
            f1.alias("f1"),
            (-F.col("score")).alias("neg"),
            precision.alias("precision"),
            recall.alias("recall"),
            F.col("score").alias("threshold"),
        ).alias("m"),
    )
    best = rows.groupBy(*(by or [])).agg(F.max("m").alias("m"))
    return best.select(*(by or []), "m.f1", "m.precision", "m.recall", "m.threshold")


def alert_metrics(
    scored: DataFrame,
    tie: str,
    rates: list[float] = ALERT_RATES,
    y: str = "y",
    p: str = "p",
) -> DataFrame:
    """Precision, recall and lift of the top ``ceil(n * rate)`` rows per alert rate.

    Whole scores above the budget are taken from the running totals; only the rows
    that share the boundary score are ordered, by the numeric column ``tie``.
    """
    curve = score_curve(scored, y, p)
    k = [
        F.struct(
            F.lit(r).alias("rate"),
            F.greatest(F.ceil(F.col("n__total") * F.lit(r)), F.lit(1)).cast("bigint").alias("k"),
        )
        for r in rates
    ]
    before = F.col("n__cum") - F.col("n")
    hits = F.filter(F.array(*k), lambda a: (a["k"] > before) & (a["k"] <= F.col("n__cum")))
    edges = curve.select(
        "score",
        F.explode(hits).alias("a"),
        before.alias("n_before"),
        (F.col("tp__cum") - F.col("tp")).alias("tp_before"),
        F.col("n__total").alias("n_all"),
        F.col("tp__total").alias("tp_all"),
    ).select("score", "a.rate", "a.k", "n_before", "tp_before", "n_all", "tp_all")
    edges = cut_lineage(edges)
    # at most one edge per rate: safe to broadcast
    tied = scored.select(
        F.col(p).alias("score"), F.col(y).cast("bigint").alias("hit"), F.col(tie).alias("__tie")
    ).join(F.broadcast(edges.select("score", "rate")), "score")
    per_tie = tied.groupBy("rate", "__tie").agg(
        F.count(F.lit(1)).alias("m"), F.sum("hit").alias("hit")
    )
    ordered = running_totals(per_tie, "__tie", ["m", "hit"], ["rate"])
    taken = (
        ordered.join(F.broadcast(edges), "rate")
        .filter(F.col("m__cum") <= F.col("k") - F.col("n_before"))
        .groupBy("rate")
        .agg(F.max("hit__cum").alias("tp_edge"))
    )
    tp = F.col("tp_before") + F.coalesce(F.col("tp_edge"), F.lit(0))
    prevalence = F.greatest(F.col("tp_all") / F.col("n_all"), F.lit(1e-12))
    return edges.join(taken, "rate", "left").select(
        "rate",
        "k",
        tp.alias("true_positives"),
        (tp / F.col("k")).alias("precision"),
        (tp / F.greatest(F.col("tp_all"), F.lit(1))).alias("recall"),
        (tp / F.col("k") / prevalence).alias("lift"),
    )


def run_spread(runs: DataFrame, metrics: list[str], population: str = "population") -> DataFrame:
    """Median, quartiles and range per metric over runs.

    ``passed`` is false when a run failed or the runs scored different populations;
    columns of ``runs``: ``status``, the population digest and the metrics.
    """
    long = runs.unpivot([], [F.col(c).cast("double").alias(c) for c in metrics], "metric", "value")
    q = exact_quantiles(long, "value", [0.0, 0.25, 0.5, 0.75, 1.0], ["metric"])
    pick = lambda v: F.max(F.when(F.col("probability") == v, F.col("quantile")))
    spread = q.groupBy("metric").agg(
        pick(0.5).alias("median"),
        pick(0.0).alias("min"),
        pick(1.0).alias("max"),
        pick(0.25).alias("q1"),
        pick(0.75).alias("q3"),
    )
    health = (
        runs.groupBy(population)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "ok").alias("failed"))
        .agg(
            F.sum("n").alias("runs"),
            ((F.count(F.lit(1)) == 1) & (F.sum("failed") == 0)).alias("passed"),
        )
    )
    return (
        spread.withColumn("__k", F.lit(1))
        .join(F.broadcast(health.withColumn("__k", F.lit(1))), "__k")
        .drop("__k")
    )


def log_loss_terms(y, p):
    """Summed log loss expression with probabilities clipped at machine precision."""
    eps = math.ulp(1.0)
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))
