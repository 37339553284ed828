"""Entity-name keys and similarity scores."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
LEGAL_SUFFIXES = [
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY",
    "LTD", "LIMITED", "LLC", "PLC", "LP", "L P",
]
LIST_ABBREVIATIONS = {
    "HOLDINGS": "HLDGS",
    "HOLDING": "HLDG",
    "INTERNATIONAL": "INTL",
    "LIMITED": "LTD",
    "ASSURANCE": "ASSUR",
    "GENERATION": "GENERAT",
    "CORPORATION": "CORP",
    "COMPANY": "CO",
    "INCORPORATED": "INC",
}
LIST_NAME_WIDTH = 28
# ----------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _compatibility_upper(names: pd.Series) -> pd.Series:
    return names.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).upper())


def entity_name_key(name: Column) -> Column:
    """Upper-case key of a company name without legal suffixes.

    ASCII names stay inside the JVM.  Only names with other characters carry a
    value into the one Python step, compatibility decomposition, which Spark has
    no function for.
    """
    foreign = name.rlike(r"[^\x00-\x7F]")
    upper = F.when(foreign, _compatibility_upper(F.when(foreign, name))).otherwise(F.upper(name))
    spaced = F.regexp_replace(upper, "[^A-Z0-9 ]+", " ")
    tokens = F.filter(F.split(spaced, " +"), lambda t: (t != "") & ~t.isin(LEGAL_SUFFIXES))
    return F.array_join(tokens, " ")


def key_tokens(key: Column) -> Column:
    """Distinct tokens of a name key (empty for an empty key)."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: t != ""))


def token_jaccard(left_key: Column, right_key: Column) -> Column:
    left, right = key_tokens(left_key), key_tokens(right_key)
    both = F.size(F.array_intersect(left, right))
    return F.coalesce(
        F.when(
            (F.size(left) > 0) & (F.size(right) > 0),
            both / (F.size(left) + F.size(right) - both),
        ),
        F.lit(0.0),
    )


def exact_or_jaccard(left_key: Column, right_key: Column) -> Column:
    """1 for equal non-empty keys, token Jaccard otherwise."""
    return F.when((left_key != "") & (left_key == right_key), F.lit(1.0)).otherwise(
        token_jaccard(left_key, right_key)
    )


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff–Obershelp ratio per row; the first argument is the alias (order matters)."""
    pairs = zip(left, right)
    ratio = [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]
    return pd.Series(ratio, dtype="float64")


def list_name_key(key: Column, width: int = LIST_NAME_WIDTH) -> Column:
    """List-style key from an entity-name key: abbreviations, cut to the list's width."""
    table = F.create_map(*[F.lit(x) for pair in LIST_ABBREVIATIONS.items() for x in pair])
    tokens = F.transform(F.split(key, " "), lambda t: F.coalesce(F.try_element_at(table, t), t))
    return F.rtrim(F.substring(F.array_join(tokens, " "), 1, width))
