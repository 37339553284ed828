"""Macro series: panel, transforms, as-of context, profile.

A macro panel has one row per calendar date, so the windows without a partition
key here are bounded by the calendar, whatever the size of the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowndate.operators.asof import asof_backward

# --- fixed values -----------------------------------------------------------
SERIES = {
    "treasury_3m": "DGS3MO",
    "treasury_10y": "DGS10",
    "unemployment": "UNRATE",
    "cpi": "CPIAUCSL",
    "industrial_production": "INDPRO",
    "credit_spread": "BAA10Y",
}
MACRO_FEATURES = [
    "treasury_3m", "treasury_10y", "yield_curve_10y_3m", "unemployment", "cpi_yoy",
    "industrial_production_yoy", "credit_spread",
]
# ----------------------------------------------------------------------------


def macro_panel(series: DataFrame, names: list[str]) -> DataFrame:
    """Long (series, date, value) → union of dates, one forward-filled column per series."""
    wide = (
        series.filter(F.col("value").isNotNull())
        .groupBy("date")
        .pivot("series", names)
        .agg(F.max("value"))
    )
    past = W.partitionBy().orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return wide.select("date", *[F.last(n, ignorenulls=True).over(past).alias(n) for n in names])


def macro_features(macro: DataFrame, lag_rows: int = 12) -> DataFrame:
    """Yield-curve slope and ``lag_rows``-row changes of price and production indexes.

    The change counts rows, as defined; on a daily panel that is not a year.
    """
    order = W.partitionBy().orderBy("date")
    out = macro
    if {"treasury_10y", "treasury_3m"} <= set(macro.columns):
        out = out.withColumn("yield_curve_10y_3m", F.col("treasury_10y") - F.col("treasury_3m"))
    for source, name in (
        ("cpi", "cpi_yoy"),
        ("industrial_production", "industrial_production_yoy"),
    ):
        if source in macro.columns:
            base = F.lag(source, lag_rows).over(order)
            out = out.withColumn(name, F.try_divide(F.col(source), base) - 1)
    return out


def attach_macro(frame: DataFrame, macro: DataFrame, matched_date: str = "date_macro") -> DataFrame:
    """Macro features as of each filing date."""
    have = [c for c in MACRO_FEATURES if c in macro.columns]
    return asof_backward(frame, macro, "filed", "date", None, have, matched_date)


def macro_profile(macro: DataFrame) -> DataFrame:
    """Availability and range per series; duplicate dates make ``passed`` false."""
    names = [c for c in macro.columns if c != "date"]
    long = macro.unpivot(["date"], names, "feature", "value")
    per_date = long.groupBy("feature", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("have"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )
    day = F.when(F.col("have") > 0, F.col("date"))
    return per_date.groupBy("feature").agg(
        F.sum("n").alias("rows"),
        F.sum("have").alias("non_null"),
        F.try_divide(F.sum("have"), F.sum("n")).alias("coverage"),
        F.min(day).cast("string").alias("first_available"),
        F.max(day).cast("string").alias("last_available"),
        F.min("lo").alias("min"),
        F.max("hi").alias("max"),
        F.sum(F.col("n") - 1).alias("duplicate_dates"),
        (F.sum(F.col("n") - 1) == 0).alias("passed"),
    )


def point_in_time_context(filings: DataFrame, prices: DataFrame, macro: DataFrame) -> DataFrame:
    """Issuer market features and macro features of each filing date in one frame."""
    from knowndate.operators.market import attach_issuer_market, issuer_market_features

    with_market = attach_issuer_market(filings, issuer_market_features(prices))
    return attach_macro(with_market, macro_features(macro))


def widen(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
