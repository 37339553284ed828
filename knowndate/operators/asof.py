"""As-of joins: attach what was known on a date.

Both sides are first reduced to one row per (key, day).  A key therefore has at
most one row per calendar day and side in the ordered step, however many rows it
has in the input, and the result is joined back on (key, day), which spreads even
a dominant key over its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowndate.session import spread


def _day_grain(right: DataFrame, by: list[str], day: str, payload: list[str], tie: str | None):
    """One payload struct per (by, day): the last row by ``tie``, equal ones by the largest payload."""
    rows = right.filter(F.col(day).isNotNull()).select(
        *by,
        F.to_date(day).alias("__day"),
        F.struct(*payload).alias("__payload"),
        (F.col(tie) if tie else F.lit(0)).alias("__tie"),
    )
    for name in by:
        rows = rows.filter(F.col(name).isNotNull())
    last = F.max(F.struct("__tie", "__payload"))["__payload"]
    return rows.groupBy(*by, "__day").agg(last.alias("__payload"))


def _matched_days(left_days: DataFrame, history: DataFrame, by: list[str]) -> DataFrame:
    """(by, day) of the left side with the latest payload dated on or before it."""
    kind = dict(history.dtypes)["__payload"]
    stacked = left_days.select(
        *by,
        "__day",
        F.lit(1).alias("__side"),
        F.lit(None).cast(f"struct<day:date,payload:{kind}>").alias("__hit"),
    ).unionByName(
        history.select(
            *by,
            "__day",
            F.lit(0).alias("__side"),
            F.struct(F.col("__day").alias("day"), F.col("__payload").alias("payload")).alias("__hit"),
        )
    )
    seen = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("__day", "__side")
    seen = seen.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        stacked.withColumn("__hit", F.last("__hit", ignorenulls=True).over(seen))
        .filter(F.col("__side") == 1)
        .select(*by, "__day", "__hit")
    )


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: list[str] | None,
    payload: list[str],
    matched_date: str = "date",
    tie: str | None = None,
) -> DataFrame:
    """Latest right row dated on or before each left row; every left row is kept.

    ``payload`` columns and the matched date are appended.  Left rows with a NULL
    key or date stay, without a match.  The payload travels as one struct, so NULL
    features inside a matched row stay NULL.  ``tie`` orders several right rows of
    one key and day; without it the right side must be unique per key and day.
    """
    by = by or []
    keyed = left.withColumn("__day", F.to_date(left_on))
    usable = keyed.filter(F.col("__day").isNotNull())
    for name in by:
        usable = usable.filter(F.col(name).isNotNull())
    days = usable.select(*by, "__day").distinct()
    hits = _matched_days(days, _day_grain(right, by, right_on, payload, tie), by)
    return keyed.join(hits, [*by, "__day"], "left").select(
        *left.columns,
        F.col("__hit.day").alias(matched_date),
        *[F.col(f"__hit.payload.{c}").alias(c) for c in payload],
    )


def next_date_after(
    left: DataFrame, events: DataFrame, left_on: str, event_on: str, by: list[str], out: str
) -> DataFrame:
    """First event strictly later than each left row's date, per key."""
    keyed = left.withColumn("__day", F.to_date(left_on))
    days = keyed.filter(F.col("__day").isNotNull()).select(*by, "__day").distinct()
    dates = events.select(*by, F.to_date(event_on).alias("__day")).distinct()
    stacked = days.select(
        *by, "__day", F.lit(0).alias("__side"), F.lit(None).cast("date").alias("__next")
    ).unionByName(
        dates.select(*by, "__day", F.lit(1).alias("__side"), F.col("__day").alias("__next"))
    )
    # Backwards in time; on equal days the observation comes first and so misses the event.
    later = (
        W.partitionBy(*by)
        .orderBy(F.col("__day").desc(), "__side")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    hits = (
        stacked.withColumn(out, F.min("__next").over(later))
        .filter((F.col("__side") == 0) & F.col(out).isNotNull())
        .select(*by, "__day", out)
    )
    return keyed.join(hits, [*by, "__day"], "left").select(*left.columns, out)


def attach_security(filings: DataFrame, links: DataFrame) -> DataFrame:
    """Security whose accepted validity interval covers each filing date.

    Exactly one active accepted link gives its security, several give
    ``ambiguous``, none ``unresolved``.  Link rows are counted, so the same security
    twice is ambiguous.  Intervals become +1/-1 steps that are summed per (cik, day);
    the running sum of link hashes names the link when exactly one is active.  No
    filing × link pairs are formed.  Every step is dealt out to enough tasks that its
    state stays small.
    """
    usable = links.filter(
        (F.col("decision") == "accepted_identifier") & (F.col("valid_from") <= F.col("valid_to"))
    ).select("cik", "security_id", "valid_from", "valid_to")
    code = F.xxhash64("security_id", "valid_from", "valid_to").cast("decimal(38,0)")
    coded = usable.withColumn("__code", code)
    steps = coded.select(
        "cik",
        F.explode(
            F.array(
                F.struct(F.to_date("valid_from").alias("day"), F.lit(1).alias("sign")),
                F.struct(F.date_add(F.to_date("valid_to"), 1).alias("day"), F.lit(-1).alias("sign")),
            )
        ).alias("s"),
        "__code",
    ).select(
        "cik",
        F.col("s.day").alias("__day"),
        F.col("s.sign").cast("bigint").alias("__n"),
        (F.col("__code") * F.col("s.sign")).cast("decimal(38,0)").alias("__h"),
    )
    keyed = spread(filings.withColumn("__day", F.to_date("filed")), "cik", "__day")
    days = keyed.select("cik", "__day").distinct()
    marks = days.select(
        "cik",
        "__day",
        F.lit(0).cast("bigint").alias("__n"),
        F.lit(0).cast("decimal(38,0)").alias("__h"),
        F.lit(True).alias("__asked"),
    )
    stacked = steps.withColumn("__asked", F.lit(False)).unionByName(marks)
    grain = (
        spread(stacked, "cik", "__day")
        .groupBy("cik", "__day")
        .agg(
            F.sum("__n").alias("__n"),
            F.sum("__h").cast("decimal(38,0)").alias("__h"),
            F.max("__asked").alias("__asked"),
        )
    )
    until = W.partitionBy("cik").orderBy("__day").rowsBetween(W.unboundedPreceding, W.currentRow)
    active = (
        spread(grain, "cik").withColumns(
            {
                "__active": F.sum("__n").over(until),
                "__code": F.sum("__h").over(until).cast("decimal(38,0)"),
            }
        )
        .filter("__asked")
        .select("cik", "__day", "__active", "__code")
    )
    named = spread(coded.select("cik", "__code", "security_id"), "cik", "__code").dropDuplicates(["cik", "__code"])
    resolved = spread(active, "cik", "__code").join(
        named.withColumn("__active", F.lit(1).cast("bigint")), ["cik", "__code", "__active"], "left"
    ).select("cik", "__day", "__active", "security_id")
    return keyed.join(spread(resolved, "cik", "__day"), ["cik", "__day"], "left").select(
        *filings.columns,
        "security_id",
        F.when(F.col("__active") == 1, "accepted")
        .when(F.col("__active") > 1, "ambiguous")
        .otherwise("unresolved")
        .alias("security_resolution"),
    )
