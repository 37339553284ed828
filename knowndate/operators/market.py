"""Trailing price features, price and validity audits, delistings, missingness.

Price histories are unique per (security, date) — ``checks.price_plausibility``
tells — so a security's window holds at most one row per calendar day.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowndate.operators.asof import asof_backward
from knowndate.operators.checks import DELISTING_COLUMNS, MASTER_COLUMNS, PRICE_COLUMNS, need_columns

# --- fixed values -----------------------------------------------------------
ISSUER_MARKET_FEATURES = [
    "ret_21d", "ret_63d", "ret_252d", "vol_63d", "drawdown_252d", "distance_52w_high",
    "volume_z_63d",
]
SECURITY_MARKET_FEATURES = [
    "ret_5d", "ret_21d", "ret_63d", "ret_126d", "ret_252d", "vol_21d", "vol_63d",
    "drawdown_63d", "drawdown_252d", "distance_52w_high", "volume_z_21d", "volume_z_63d",
    "downside_vol_63d", "max_loss_63d",
]
TRADING_DAYS = 252
# ----------------------------------------------------------------------------


class _Trailing:
    """Trailing figures of consecutive rows, several histories one after the other, as (values, known) arrays.

    Rows of a frame are taken in order, one step for all rows at once, by the updates that Spark's own mean and deviation
    use: values are those of sliding frames, and no error outlives its frame.
    """

    def __init__(self, codes: np.ndarray):
        rows = np.arange(len(codes))
        first = np.ones(len(codes), dtype=bool)
        first[1:] = codes[1:] != codes[:-1]
        self.position = rows - np.maximum.accumulate(np.where(first, rows, 0))

    def lag(self, column, rows: int):
        """Value and knowledge of so many rows before, unknown before a history begins."""
        values, known = (np.zeros_like(x) for x in column)
        if rows < len(values):
            values[rows:], known[rows:] = (x[: len(x) - rows] for x in column)
        return values, known & (self.position >= rows)

    @staticmethod
    def ratio(top, bottom):
        """top / bottom; unknown for a zero divisor."""
        known = top[1] & bottom[1] & (bottom[0] != 0)
        return np.where(known, top[0], 0.0) / np.where(known, bottom[0], 1.0), known

    def change(self, column, rows: int):
        """x / x[-rows] - 1; unknown for a zero base."""
        values, known = self.ratio(column, self.lag(column, rows))
        return values - 1, known

    def moments(self, column, rows: int, least: int):
        """Mean and sample deviation of known values, unknown below ``least`` of them."""
        n, total, mean, squares = (np.zeros(len(column[0])) for _ in range(4))
        for back in range(rows - 1, -1, -1):
            x, known = self.lag(column, back)
            n += known
            total += np.where(known, x, 0.0)
            delta = np.where(known, x - mean, 0.0)
            step = delta / np.maximum(n, 1.0)
            mean += step
            squares += delta * (delta - step)
        enough = n >= least
        return (total / np.maximum(n, 1.0), enough), (np.sqrt(squares / np.maximum(n - 1, 1.0)), enough)

    def deviation(self, column, rows: int, least: int):
        return self.moments(column, rows, least)[1]

    def zscore(self, column, rows: int, least: int):
        mean, spread = self.moments(column, rows, least)
        return self.ratio((column[0] - mean[0], column[1] & mean[1]), spread)

    def extreme(self, better, column, rows: int, least: int):
        """Highest (np.fmax) or lowest (np.fmin) known value of the last rows, from frames of doubled length."""
        worst = -np.inf if better is np.fmax else np.inf
        best, count, have = np.where(column[1], column[0], worst), column[1].astype(np.int64), 1
        while have < rows:
            back = min(have, rows - have)
            earlier, inside = self.lag((best, np.ones(len(best), dtype=bool)), back)
            best, have = better(best, np.where(inside, earlier, worst)), have + back
        held = np.cumsum(count)
        before, _ = self.lag((held, column[1]), rows)
        began = held - count
        count = held - np.where(self.position >= rows, before, began[np.arange(len(held)) - self.position])
        return best, count >= least

    def below_high(self, close, rows: int, least: int):
        """Distance from the highest close of the last rows."""
        high, enough = self.extreme(np.fmax, close, rows, least)
        values, known = self.ratio(close, (high, enough))
        return values - 1, known


def _issuer(h: _Trailing, close, volume) -> dict:
    daily, low = h.change(close, 1), h.below_high(close, TRADING_DAYS, 20)
    spread = h.deviation(daily, 63, 20)
    return {
        **{f"ret_{n}d": h.change(close, n) for n in (21, 63, 252)},
        "vol_63d": (spread[0] * math.sqrt(TRADING_DAYS), spread[1]),
        "drawdown_252d": low,
        "volume_z_63d": h.zscore(volume, 63, 20),
        "distance_52w_high": low,
    }


def _security(h: _Trailing, close, volume) -> dict:
    daily, low = h.change(close, 1), h.below_high(close, TRADING_DAYS, 20)
    loss = (daily[0], daily[1] & (daily[0] < 0))
    least = {21: max(10, 21 // 3), 63: max(10, 63 // 3)}
    spreads = {f"vol_{n}d": h.deviation(daily, n, m) for n, m in least.items()}
    spreads["downside_vol_63d"] = h.deviation(loss, 63, 20)
    yearly = {name: (x * math.sqrt(TRADING_DAYS), known) for name, (x, known) in spreads.items()}
    return {
        **{f"ret_{n}d": h.change(close, n) for n in (5, 21, 63, 126, 252)},
        **{name: yearly[name] for name in ("vol_21d", "vol_63d")},
        **{f"volume_z_{n}d": h.zscore(volume, n, m) for n, m in least.items()},
        "drawdown_63d": h.below_high(close, 63, 20),
        "drawdown_252d": low,
        "downside_vol_63d": yearly["downside_vol_63d"],
        "max_loss_63d": h.extreme(np.fmin, daily, 63, 20),
        "distance_52w_high": low,
    }


def _known(prices: DataFrame) -> DataFrame:
    """NaN is a missing price or volume."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    return prices.withColumns({c: known(c) for c in ("close", "volume")})


def _with_trailing(prices: DataFrame, key: str, features) -> DataFrame:
    """Add ``features`` of each history in order of date.

    Spark deals histories out and sorts them; a task reads its rows once, in Arrow batches, and keeps the last year of
    rows from one batch to the next, so a history of any length takes the memory of one batch.
    """
    p = _known(prices)
    kept = p.columns
    none = np.zeros(0), np.zeros(0, dtype=bool)
    names = list(features(_Trailing(np.zeros(0)), none, none))
    work = p.withColumns({f"__{c}": F.col(c).cast("double") for c in ("close", "volume")})

    def column(rows: pa.Table, name: str):
        x = rows[name].combine_chunks()
        return x.fill_null(0.0).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False)

    def add(batches):
        past = None
        for batch in batches:
            new = pa.table({c: batch.column(c) for c in (key, "__close", "__volume")})
            rows = pa.concat_tables([past, new]).combine_chunks() if past else new
            codes = rows[key].combine_chunks().dictionary_encode(null_encoding="encode").indices
            with np.errstate(all="ignore"):
                made = features(_Trailing(codes.to_numpy()), column(rows, "__close"), column(rows, "__volume"))
            old = len(rows) - len(new)
            arrays = [pa.array(made[n][0][old:], mask=~made[n][1][old:]) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + arrays, [*kept, *names])
            past = rows.slice(max(len(rows) - TRADING_DAYS, 0))

    schema = T.StructType([*p.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return work.repartition(key).sortWithinPartitions(key, "date").mapInArrow(add, schema)


def issuer_market_features(prices: DataFrame, key: str = "cik") -> DataFrame:
    """Returns, volatility, distance from the high and volume score per issuer."""
    return _with_trailing(prices, key, _issuer)


def security_market_features(prices: DataFrame, key: str = "security_id") -> DataFrame:
    """The fourteen trailing features per security."""
    return _with_trailing(prices, key, _security)


def attach_issuer_market(filings: DataFrame, features: DataFrame) -> DataFrame:
    """Market features of the issuer as of each filing date; all filings are kept."""
    have = [c for c in ISSUER_MARKET_FEATURES if c in features.columns]
    return asof_backward(filings, features, "filed", "date", ["cik"], have)


def attach_security_market(filings: DataFrame, features: DataFrame) -> DataFrame:
    """Market features of the resolved security as of each filing date."""
    have = [c for c in SECURITY_MARKET_FEATURES if c in features.columns]
    return asof_backward(filings, features, "filed", "date", ["security_id"], have)


def market_missingness(frame: DataFrame, features: list[str]) -> DataFrame:
    """Availability flag and one 0/1 byte per feature; no row is dropped."""
    present = [c for c in features if c in frame.columns]
    if not present:
        return frame.withColumn("market_data_available", F.lit(False))
    return frame.withColumns(
        {
            "market_data_available": F.coalesce(*[F.col(c) for c in present]).isNotNull(),
            **{f"{c}__missing": F.col(c).isNull().cast("byte") for c in present},
        }
    )


def price_gaps(prices: DataFrame, max_gap_days: int = 14) -> DataFrame:
    """Largest calendar gap and number of long gaps per security."""
    need_columns(prices, PRICE_COLUMNS)
    w = W.partitionBy("security_id").orderBy("date")
    gaps = prices.select(
        "security_id", F.datediff("date", F.lag("date").over(w)).alias("gap")
    )
    return gaps.groupBy("security_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("max_calendar_gap_days"),
        F.count_if(F.col("gap") > max_gap_days).alias("gaps_over_threshold"),
    )


def security_master_audit(master: DataFrame) -> DataFrame:
    """One row: sizes, reversed intervals, duplicates, overlaps with earlier intervals.

    Intervals that start on one day are reduced to a count and the latest end, so
    the running maximum handles one row per day.  All but one of several intervals
    starting together overlap by definition.
    """
    need_columns(master, MASTER_COLUMNS)
    per_evidence = master.groupBy("security_id", "valid_from", "valid_to", "source_identifier").agg(
        F.count(F.lit(1)).alias("n"),
    )
    per_day = per_evidence.groupBy("security_id", "valid_from").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") - 1).alias("dup"),
        F.max("valid_to").alias("until"),
        F.sum(F.when(F.col("valid_to") < F.col("valid_from"), F.col("n")).otherwise(0)).alias("rev"),
    )
    earlier = W.partitionBy("security_id").orderBy("valid_from").rowsBetween(
        W.unboundedPreceding, -1
    )
    marked = per_day.withColumn("reach", F.max("until").over(earlier))
    per_security = marked.groupBy("security_id").agg(
        F.sum("n").alias("rows"),
        F.sum("dup").alias("dup"),
        F.sum("rev").alias("rev"),
        F.sum(
            F.when(F.col("valid_from").isNotNull(), F.col("n") - 1).otherwise(0)
            + F.coalesce((F.col("valid_from") <= F.col("reach")).cast("int"), F.lit(0))
        ).alias("over"),
    )
    issuers = master.select("issuer_id").distinct().agg(F.count("issuer_id").alias("issuers"))
    out = per_security.agg(
        F.sum("rows").alias("rows"),
        F.count("security_id").alias("securities"),
        F.sum("rev").alias("reversed_intervals"),
        F.sum("dup").alias("duplicate_evidence"),
        F.sum("over").alias("overlapping_intervals"),
    )
    out = out.withColumn("__k", F.lit(1)).join(issuers.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return out.withColumn(
        "passed", (F.col("reversed_intervals") == 0) & (F.col("duplicate_evidence") == 0)
    )


def delisting_observations(delistings: DataFrame) -> DataFrame:
    """Explicit delisting returns only; a missing return is never filled in."""
    need_columns(delistings, DELISTING_COLUMNS)
    return delistings.filter(
        F.col("delist_return").isNotNull() & ~F.isnan(F.col("delist_return").cast("double"))
    ).select(
        "security_id",
        F.to_date("delist_date").alias("date"),
        F.col("delist_return").cast("double").alias("delist_return"),
        F.lit(True).alias("is_delisting_observation"),
        "source",
        "source_identifier",
    )
