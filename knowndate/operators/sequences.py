"""Per-issuer change features and trailing sequences, safe for a dominant issuer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowndate.operators.ordered import exact_quantiles, lookback_chunks

CHUNK_ROWS = 200_000


def add_changes(
    frame: DataFrame, features: list[str], cik: str = "cik", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Change against the previous and the fourth-previous filing (``__qoq``/``__yoy``).

    Filings are ordered by (filed, adsh).  A zero base gives NULL.
    """
    present = [c for c in features if c in frame.columns]
    spread, parts, pos = lookback_chunks(frame, [cik], "filed", "adsh", 4, chunk_rows)
    w = W.partitionBy(*parts).orderBy(pos)
    change = lambda c, k: F.try_divide(F.col(c), F.lag(c, k).over(w)) - 1
    out = spread.withColumns(
        {
            **{f"{c}__qoq": change(c, 1) for c in present},
            **{f"{c}__yoy": change(c, 4) for c in present},
        }
    )
    return out.filter(~F.col("__halo")).drop("__halo", "__chunk", pos)


def train_statistics(frame: DataFrame, features: list[str]) -> dict[str, tuple[float, float, float]]:
    """Median, mean and population deviation of each feature on the training rows.

    Mean and deviation are taken after the median filled the gaps.  Features without
    any training value are left out.  Eager: brings back three numbers per feature.
    """
    train = frame.filter(F.col("split") == "train")
    long = train.unpivot([], [F.col(c).cast("double").alias(c) for c in features], "feature", "v")
    medians = {
        r["feature"]: r["quantile"] for r in exact_quantiles(long, "v", [0.5], ["feature"]).collect()
    }
    known = [c for c in features if c in medians]
    filled = train.select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in known]
    )
    row = filled.agg(
        *[F.avg(c).alias(f"m_{c}") for c in known], *[F.stddev_pop(c).alias(f"s_{c}") for c in known]
    ).head()
    return {c: (medians[c], row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in known}


def standardized(frame: DataFrame, stats: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Fill with the training median, centre and scale with the training moments."""
    return frame.withColumns(
        {
            c: (F.coalesce(F.col(c).cast("double"), F.lit(med)) - F.lit(mean)) / F.lit(dev)
            for c, (med, mean, dev) in stats.items()
        }
    )


def build_sequences(
    frame: DataFrame,
    features: list[str],
    lookback: int = 8,
    min_history: int = 2,
    cik: str = "cik",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Trailing sequence of feature vectors ending at each filing, left-padded with zeros.

    One output row per filing with enough history: its own columns, ``length`` and
    ``sequence`` (array of ``lookback`` arrays).  Later filings never change it.
    """
    vectors = frame.withColumn("__vector", F.array(*[F.col(c).cast("double") for c in features]))
    spread, parts, pos = lookback_chunks(vectors, [cik], "filed", "adsh", lookback - 1, chunk_rows)
    trail = W.partitionBy(*parts).orderBy(pos).rowsBetween(-(lookback - 1), W.currentRow)
    zeros = F.array(*[F.lit(0.0) for _ in features])
    out = spread.withColumn("__past", F.collect_list("__vector").over(trail)).filter(
        ~F.col("__halo") & (F.size("__past") >= min_history)
    )
    return out.select(
        *frame.columns,
        F.size("__past").alias("length"),
        F.concat(F.array_repeat(zeros, F.lit(lookback) - F.size("__past")), "__past").alias(
            "sequence"
        ),
    )
