"""Issuer keys, observation ids and quarter arithmetic as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNAVAILABLE = "unavailable"

_DECIMAL_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _text(value: Column) -> Column:
    return F.trim(value.cast("string"))


def cik_label_key(value: Column) -> Column:
    """Digits without leading zeros; numeric text is truncated, other text keeps its digits.

    Missing or digit-free input gives the empty string.
    """
    text = _text(value)
    number = F.when(text.rlike(_DECIMAL_TEXT), text.try_cast("double").try_cast("bigint"))
    digits = F.regexp_replace(text, "[^0-9]", "")
    stripped = F.ltrim(digits, F.lit("0"))
    salvaged = F.when(stripped != "", stripped).when(digits != "", F.lit("0")).otherwise(F.lit(""))
    return F.coalesce(number.cast("string"), salvaged, F.lit(""))


def cik_filing_key(value: Column) -> Column:
    """Ten zero-padded digits; ``.0`` is dropped and anything else gives NULL.

    Use :func:`knowndate.operators.checks.require_no_invalid` on the key where a
    bad value has to stop the job.
    """
    text = F.regexp_replace(_text(value), r"[.]0$", "")
    return F.when(text.rlike("^[0-9]+$"), zero_pad(text))


def cik_coverage_key(value: Column) -> Column:
    """Drop a trailing ``.0`` and zero-pad; no other check."""
    return zero_pad(F.regexp_replace(value.cast("string"), r"[.]0$", ""))


def cik_observation_key(value: Column, dtype: str = "string") -> Column:
    """Ten digits for 1..9999999999, else ``unavailable``; never repairs text.

    ``dtype`` is the Spark type name of ``value``: integral floats are accepted
    only when the column really is a floating-point one.
    """
    if dtype in ("double", "float"):
        whole = value.try_cast("bigint")
        text = F.when(whole.cast("double") == value, whole.cast("string"))
    elif dtype == "boolean":
        text = F.lit(None).cast("string")
    else:
        text = _text(value)
    number = F.when(text.rlike("^[0-9]{1,10}$"), text.try_cast("bigint"))
    return F.when(number > 0, zero_pad(number.cast("string"))).otherwise(F.lit(UNAVAILABLE))


def zero_pad(text: Column, width: int = 10) -> Column:
    """Left-pad with zeros without cutting longer text."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def text_or_unavailable(value: Column) -> Column:
    text = _text(value)
    return F.when(text != "", text).otherwise(F.lit(UNAVAILABLE))


def event_id(cik: Column, next_date: Column) -> Column:
    """``cik:yyyy-MM-dd`` for a usable key and date, else ``unavailable``."""
    usable = (cik != UNAVAILABLE) & next_date.isNotNull()
    return F.when(
        usable, F.concat_ws(":", cik, F.date_format(next_date, "yyyy-MM-dd"))
    ).otherwise(F.lit(UNAVAILABLE))


def valid_event_id(cik: Column, event: Column) -> Column:
    """The id starts with its own key and ends in a real calendar date."""
    day = F.substring(event, 12, 10)
    return F.coalesce(
        cik.rlike("^[0-9]{10}$")
        & event.rlike("^[0-9]{10}:[0-9]{4}-[0-9]{2}-[0-9]{2}$")
        & (F.substring(event, 1, 10) == cik)
        & F.try_to_date(day, "yyyy-MM-dd").isNotNull(),
        F.lit(False),
    )


def observation_id(cik: Column, adsh: Column, filed: Column) -> Column:
    """``cik:adsh``, falling back to ``cik:filed``; inputs use the placeholder text."""
    tail = F.when(adsh != UNAVAILABLE, adsh).when(filed != UNAVAILABLE, filed)
    return F.when((cik != UNAVAILABLE) & tail.isNotNull(), F.concat_ws(":", cik, tail)).otherwise(
        F.lit(UNAVAILABLE)
    )


def with_observation_ids(df, cik="cik", adsh="adsh", filed="filed", next_date="next_distress_date"):
    """Replace/add the five identity columns cik, adsh, filed, observation_id, event_id."""
    dtypes = dict(df.dtypes)
    key = cik_observation_key(F.col(cik), dtypes[cik])
    accession = text_or_unavailable(F.col(adsh))
    day = F.coalesce(F.date_format(F.col(filed), "yyyy-MM-dd"), F.lit(UNAVAILABLE))
    return df.select(
        *[c for c in df.columns if c not in (cik, adsh, filed)],
        key.alias("cik"),
        accession.alias("adsh"),
        day.alias("filed"),
        observation_id(key, accession, day).alias("observation_id"),
        event_id(key, F.col(next_date)).alias("event_id"),
    )


def quarter_index(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day) - 1


def quarter_label(index: Column) -> Column:
    """``YYYYQn`` of a quarter index."""
    year = F.floor(index / 4).cast("int")
    return F.concat(year.cast("string"), F.lit("Q"), (F.pmod(index, F.lit(4)) + 1).cast("string"))


def parse_quarter_label(label: Column) -> Column:
    """Quarter index of ``YYYYQn``."""
    return F.substring(label, 1, 4).cast("int") * 4 + F.substring(label, 6, 1).cast("int") - 1


def observation_quarters(last_filing: Column) -> Column:
    """Quarter indexes 0, 4, 8 and 12 quarters before the last filing."""
    base = quarter_index(last_filing)
    return F.array(*[base - F.lit(back) for back in (0, 4, 8, 12)])


def yyyymmdd(value: Column) -> Column:
    """yyyymmdd held as text, int or float → date; NULL when it is not a date."""
    whole = value.try_cast("double").try_cast("bigint").cast("string")
    return F.when(F.length(whole) == 8, F.try_to_date(whole, "yyyyMMdd"))
