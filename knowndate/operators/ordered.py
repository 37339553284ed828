"""Ordered computations that stay distributed when one group holds most rows.

A plain window puts a whole group into one task.  The helpers here first reduce
to distinct order values (a map-side combined aggregation) and then cut the order
into ranges, so that no task sees more than one range of one group.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowndate.session import cut_lineage

#: Rows of distinct order values that one task sorts, and the most ranges they are cut into.
ROWS_PER_RANGE = 1 << 17
MOST_RANGES = 4096


def with_ranges(df: DataFrame, order_col: str, ranges: int | None = None, out: str = "__range") -> DataFrame:
    """Add an order-preserving range number; ranges hold about equal numbers of rows.

    Eager: ``df`` should be a stored table, it is read for its size and, with two ranges
    or more, for ``ranges - 1`` cut points.  The cuts are those of all groups together,
    so no group has more rows in a range than the range has.  They only steer the work
    split; results never depend on them.
    """
    if ranges is None:
        ranges = min(-(-df.count() // ROWS_PER_RANGE), MOST_RANGES)
    value = F.col(order_col).cast("double")
    steps = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(value, steps, 10000)).first()[0] if steps else None
    cuts = sorted({c for c in cuts or [] if math.isfinite(c)})
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    inf = float("inf")
    finder = Bucketizer(splits=[-inf, *cuts, inf], inputCol="__value", outputCol=out, handleInvalid="keep")
    # NULL comes first in ascending order; what is no number has a range of its own at the end
    return (
        finder.transform(df.withColumn("__value", value))
        .withColumn(out, F.coalesce(out, F.lit(-1.0)))
        .drop("__value")
    )


def running_totals(
    df: DataFrame,
    order_col: str,
    sums: list[str],
    by: list[str] | None = None,
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``<c>__cum`` and group totals ``<c>__total``.

    ``df`` holds one row per (by, order_col) with a numeric ``order_col``.  Eager: it is
    evaluated once and stored.  Each range is summed on its own; the range totals (one row
    per group and range) give the offsets.
    """
    by = by or []
    ranged = with_ranges(cut_lineage(df), order_col, ranges)
    arrow = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    groups = W.partitionBy(*by) if by else W.partitionBy()
    before = groups.orderBy(arrow("__range")).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by, "__range")
        .agg(*[F.sum(c).alias(f"__{c}") for c in sums])
        .select(
            *[F.col(c).alias(f"__of_{c}") for c in by],
            F.col("__range").alias("__of_range"),
            *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}_off") for c in sums],
            *[F.sum(f"__{c}").over(groups).alias(f"{c}__total") for c in sums],
        )
    )
    inside = (
        W.partitionBy(*by, "__range")
        .orderBy(arrow(order_col))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    same = F.col("__range") == F.col("__of_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    out = ranged.join(offsets, same)
    cums = {f"{c}__cum": F.col(f"__{c}_off") + F.sum(c).over(inside) for c in sums}
    drop = ["__range", "__of_range", *[f"__of_{c}" for c in by], *[f"__{c}_off" for c in sums]]
    return out.withColumns(cums).drop(*drop)


def exact_quantiles(
    df: DataFrame, value_col: str, probabilities: list[float], by: list[str] | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles as rows (by, probability, quantile).

    Works on counts of distinct values with distributed running totals, so no task
    holds the whole distribution (the built-in exact percentile does).
    """
    by = by or []
    counts = (
        df.withColumn("__v", F.col(value_col).cast("double"))
        .filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
        .groupBy(*by, "__v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return quantiles_of(running_totals(counts, "__v", ["n"], by), "__v", probabilities, by)


def quantiles_of(
    ranked: DataFrame, value_col: str, probabilities: list[float], by: list[str] | None = None
) -> DataFrame:
    """``exact_quantiles`` from distinct values with their counts ``n`` and ascending running totals ``n__cum``."""
    by = by or []
    ranked = ranked.withColumn("__v", F.col(value_col))
    first, last = F.col("n__cum") - F.col("n"), F.col("n__cum") - 1
    spots = [
        F.struct(
            F.lit(p).alias("probability"),
            (F.lit(p) * (F.col("n__total") - 1)).alias("spot"),
        )
        for p in probabilities
    ]
    touched = F.filter(
        F.array(*spots), lambda s: (F.ceil(s["spot"]) >= first) & (F.floor(s["spot"]) <= last)
    )
    picked = ranked.select(
        *by, "__v", first.alias("__first"), last.alias("__last"), F.explode(touched).alias("s")
    )
    low, high = F.floor("s.spot"), F.ceil("s.spot")
    inside = lambda at: (at >= F.col("__first")) & (at <= F.col("__last"))
    ends = picked.groupBy(*by, F.col("s.probability").alias("probability")).agg(
        F.max(F.when(inside(low), F.col("__v"))).alias("__lo"),
        F.max(F.when(inside(high), F.col("__v"))).alias("__hi"),
        F.max(F.col("s.spot") - low).alias("__t"),
    )
    return ends.select(
        *by,
        "probability",
        (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__t")).alias("quantile"),
    )


def dense_index(df: DataFrame, key: str, out: str, buckets: int = 1024) -> DataFrame:
    """Number distinct keys 0..n-1 without a global sort; also adds ``<out>__n``.

    Keys are numbered inside buckets of their CRC-32 and shifted by the bucket offsets
    (``buckets`` rows, broadcast).
    """
    hashed = df.withColumn("__b", F.crc32(F.col(key).cast("string")) % buckets)
    offsets = (
        hashed.groupBy("__b")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            "__b",
            (F.sum("__n").over(W.orderBy("__b")) - F.col("__n")).alias("__off"),
            F.sum("__n").over(W.partitionBy()).alias(f"{out}__n"),
        )
    )
    place = F.row_number().over(W.partitionBy("__b").orderBy(key)) - 1
    return (
        hashed.join(F.broadcast(offsets), "__b")
        .withColumn(out, F.col("__off") + place)
        .drop("__b", "__off")
    )


def day_positions(df: DataFrame, by: list[str], day: str, tie: str, out: str = "pos") -> DataFrame:
    """Zero-based position of every row in (by, day, tie) order, and ``<out>__n`` per group.

    Rows per (group, day) are counted first; the running sum over days therefore
    handles at most one row per calendar day and group.  Only the rows of one group
    on one day are ordered together.
    """
    days = df.groupBy(*by, day).agg(F.count(F.lit(1)).alias("__n"))
    group = W.partitionBy(*by) if by else W.partitionBy()
    before = group.orderBy(day).rowsBetween(W.unboundedPreceding, W.currentRow)
    days = days.select(
        *by,
        day,
        (F.sum("__n").over(before) - F.col("__n")).alias("__before"),
        F.sum("__n").over(group).alias(f"{out}__n"),
    )
    within = W.partitionBy(*by, day).orderBy(tie)
    return (
        df.join(days, [*by, day])
        .withColumn(out, F.col("__before") + F.row_number().over(within) - 1)
        .drop("__before")
    )


def lookback_chunks(
    df: DataFrame, by: list[str], day: str, tie: str, rows_back: int, chunk_rows: int
) -> tuple[DataFrame, list[str], str]:
    """Prepare a window that looks ``rows_back`` rows back, split into chunks.

    Each row goes to chunk ``pos div chunk_rows``; the last ``rows_back`` rows of a
    chunk are also copied into the next one, marked ``__halo``.  Windows over the
    returned partition columns then give the same values as windows over the whole
    group; drop the halo rows afterwards.
    """
    if chunk_rows < rows_back:
        raise ValueError("chunk_rows must be at least rows_back")
    placed = day_positions(df, by, day, tie, "__pos").drop("__pos__n")
    chunk = F.floor(F.col("__pos") / chunk_rows).cast("bigint")
    tail = F.col("__pos") % chunk_rows >= chunk_rows - rows_back
    own = F.struct(chunk.alias("chunk"), F.lit(False).alias("halo"))
    copy = F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("halo"))
    spread = placed.withColumn(
        "__c", F.explode(F.when(tail, F.array(own, copy)).otherwise(F.array(own)))
    )
    spread = spread.select(
        *placed.columns, F.col("__c.chunk").alias("__chunk"), F.col("__c.halo").alias("__halo")
    )
    return spread, [*by, "__chunk"], "__pos"
