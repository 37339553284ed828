"""Forward event labels with right-censoring, and the modelling population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowndate.functions.keys import cik_label_key
from knowndate.operators.asof import next_date_after
from knowndate.operators.checks import need_columns

LABEL = "distress_12m"


def normalize_events(events: DataFrame) -> DataFrame:
    """Distinct (cik key, event_date, event_type) without unusable rows."""
    need_columns(events, ["cik", "event_date", "event_type"])
    day = F.col("event_date")
    if dict(events.dtypes)["event_date"] == "string":
        day = F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd")
    return (
        events.withColumns({"cik": cik_label_key(F.col("cik")), "event_date": F.to_date(day)})
        .filter(F.col("event_date").isNotNull() & F.col("event_type").isNotNull())
        .filter(F.col("cik") != "")
        .dropDuplicates(["cik", "event_date", "event_type"])
    )


def label_forward(
    observations: DataFrame,
    events: DataFrame,
    horizon_days: int = 365,
    embargo_days: int = 0,
    observed_through: str | None = None,
) -> DataFrame:
    """Label each filing by the first event strictly after it.

    The label is NULL while the outcome window is open and no event decides it.  A
    positive inside an open window is known (``label_mature``) but not part of the
    modelling population (``label_window_complete``).  Only the first later event
    counts, so an embargo can hide a second one.
    """
    keyed = observations.withColumn("__cik", cik_label_key(F.col("cik")))
    dates = normalize_events(events).select(F.col("cik").alias("__cik"), "event_date")
    matched = next_date_after(keyed, dates, "filed", "event_date", ["__cik"], "next_distress_date")
    cutoff = F.lit(observed_through).cast("date")
    delta = F.datediff("next_distress_date", F.to_date("filed"))
    hit = F.coalesce((delta > embargo_days) & (delta <= horizon_days), F.lit(False))
    window_end = F.date_add(F.to_date("filed"), horizon_days)
    complete = (
        F.lit(True)
        if observed_through is None
        else F.coalesce(window_end <= cutoff, F.lit(False))
    )
    return matched.select(
        *observations.columns,
        F.when(complete | hit, hit.cast("int")).alias(LABEL),
        (complete | hit).alias("label_mature"),
        complete.alias("label_window_complete"),
        cutoff.alias("label_observed_through"),
        delta.cast("double").alias("days_to_distress"),
        "next_distress_date",
        F.lit(horizon_days).alias("label_horizon_days"),
        window_end.alias("label_window_end"),
    )


def modelling_population(cohort: DataFrame) -> DataFrame:
    """Rows with a complete outcome window and a label, as a plain bigint label."""
    need_columns(cohort, [LABEL])
    out = cohort
    if "label_window_complete" in cohort.columns:
        out = out.filter(F.coalesce(F.col("label_window_complete"), F.lit(False)))
    return out.filter(F.col(LABEL).isNotNull()).withColumn(LABEL, F.col(LABEL).cast("bigint"))


def split_name(filed: Column, train_end: str, validation_end: str) -> Column:
    """Chronological part of a date: train, validation or test."""
    return (
        F.when(filed <= F.lit(train_end).cast("date"), "train")
        .when(filed <= F.lit(validation_end).cast("date"), "validation")
        .when(filed.isNotNull(), "test")
    )


def temporal_split(
    frame: DataFrame, train_end: str = "2020-12-31", validation_end: str = "2022-12-31"
) -> DataFrame:
    """Add the column ``split``; use :func:`split_check` to demand non-empty parts."""
    return frame.withColumn("split", split_name(F.to_date("filed"), train_end, validation_end))


def split_check(frame: DataFrame) -> DataFrame:
    """One row: rows per part and whether all three parts hold rows."""
    part = lambda s: F.count_if(F.col("split") == s)
    counts = frame.agg(*[part(s).alias(f"{s}_rows") for s in ("train", "validation", "test")])
    return counts.withColumn(
        "passed",
        F.least("train_rows", "validation_rows", "test_rows") > 0,
    )


def censoring_inventory(frame: DataFrame) -> DataFrame:
    """What censoring removes: one row per split plus the total (``split = 'all'``).

    Needs the ``split`` column of :func:`temporal_split`.
    """
    complete = F.coalesce(F.col("label_window_complete"), F.lit(False))
    known = F.col(LABEL).isNotNull()
    kept = complete & known
    rolled = frame.rollup("split").agg(
        F.grouping("split").alias("__total"),
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(complete).alias("rows_window_complete"),
        F.count_if(~complete).alias("rows_censored"),
        F.count_if(~complete & known).alias("censored_with_knowable_label"),
        F.count_if(~complete & (F.col(LABEL) == 1)).alias("censored_knowable_positives"),
        F.count_if(kept).alias("rows_after"),
        F.count_if(~kept).alias("rows_dropped"),
        F.count_if(kept & (F.col(LABEL) == 1)).alias("positives_after"),
        F.avg(F.when(kept, F.col(LABEL))).alias("prevalence_after"),
        F.min(F.when(~complete, F.to_date("filed"))).alias("censored_first_filed"),
        F.max(F.when(~complete, F.to_date("filed"))).alias("censored_last_filed"),
    )
    return rolled.withColumn(
        "split", F.when(F.col("__total") == 1, "all").otherwise(F.coalesce("split", F.lit("undated")))
    ).drop("__total")


def censoring_confined_to_test(inventory: DataFrame) -> DataFrame:
    """One row: no train or validation row was dropped."""
    early = F.col("split").isin("train", "validation")
    return inventory.agg(
        (F.coalesce(F.sum(F.when(early, F.col("rows_dropped"))), F.lit(0)) == 0).alias(
            "censoring_confined_to_test"
        )
    )
