"""Security identifiers: check digits, extraction from text, comparison, context."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Character values of an identifier are positions in this alphabet.
IDENTIFIER_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"
CUSIP_LABEL = r"(?i)\bCUSIP(?:\s+(?:NO\.?|NUMBER))?\s*[:#-]?\s*([0-9A-Z*@#]{9})\b"
ISIN_LABEL = r"(?i)\bISIN(?:\s+(?:NO\.?|NUMBER))?\s*[:#-]?\s*([A-Z]{2}[A-Z0-9]{9}[0-9])\b"
CUSIP_SHAPE = "^[0-9A-Z*@#]{8}[0-9]$"
ISIN_SHAPE = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
ISIN_COUNTRIES = [
    "US", "CA", "GB", "DE", "FR", "NL", "IE", "LU", "CH", "JP", "AU", "NZ", "SE", "NO", "DK",
    "FI", "BE", "AT", "ES", "IT", "PT", "GR", "PL", "CZ", "HU", "RO", "BG", "HR", "SI", "SK",
    "EE", "LV", "LT", "IS", "LI", "MX", "BR", "AR", "CL", "CO", "PE", "UY", "ZA", "IL", "SA",
    "AE", "QA", "KW", "BH", "IN", "CN", "HK", "SG", "KR", "TW", "TH", "MY", "ID", "PH", "VN",
    "TR",
]
EQUITY_TERMS = [
    "common stock", "common shares", "ordinary shares", "class a", "class b", "equity security",
]
DEBT_TERMS = [
    "note", "notes", "debenture", "bond", "senior secured", "senior unsecured", "convertible note",
]
PREFERRED_TERMS = ["preferred stock", "preferred shares", "preference shares"]
CORE_FORMS = ["10-K", "10-K/A", "10-Q", "10-Q/A", "8-K", "8-K/A"]
PRIORITY_EXHIBIT_SHAPE = "^EX-0*[24]([.].*)?$"
CONTEXT_RADIUS = 220
# ----------------------------------------------------------------------------

_LOWER = "abcdefghijklmnopqrstuvwxyz"


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    An expression that mentions its input many times is otherwise copied with all of
    its input when Catalyst pushes a filter below a projection.
    """
    return F.transform(F.array(value), use)[0]


def clean(value: Column) -> Column:
    return F.upper(F.trim(value))


def _char_value(char: Column) -> Column:
    return F.call_function("instr", F.lit(IDENTIFIER_ALPHABET), char) - 1


def cusip_check_digit(body: Column) -> Column:
    """Check digit of an eight-character body, as an int; the body must be well formed."""
    parts = []
    for position in range(1, 9):
        value = _char_value(F.substring(body, position, 1)) * (2 if position % 2 == 0 else 1)
        parts.append(F.floor(value / 10) + value % 10)
    return ((10 - reduce(add, parts) % 10) % 10).cast("int")


def valid_cusip(value: Column) -> Column:
    def check(text):
        digit = F.substring(text, 9, 1).try_cast("int")
        return F.coalesce(
            text.rlike(CUSIP_SHAPE) & (cusip_check_digit(text) == digit), F.lit(False)
        )

    return bind(clean(value), check)


def luhn_total(text: Column) -> Column:
    """Luhn sum of an upper-case identifier whose letters expand to two digits each."""
    digits = F.array_join(
        F.transform(F.split(text, ""), lambda c: _char_value(c).cast("string")), ""
    )

    def term(char, index):
        n = char.cast("int") * F.when(index % 2 == 1, 2).otherwise(1)
        return F.floor(n / 10) + n % 10

    terms = F.transform(F.split(F.reverse(digits), ""), term)
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, x: a + x)


def valid_isin(value: Column) -> Column:
    def check(text):
        shaped = text.rlike(ISIN_SHAPE) & F.substring(text, 1, 2).isin(ISIN_COUNTRIES)
        total = luhn_total(F.when(shaped, text))
        return F.coalesce(shaped & (total % 10 == 0), F.lit(False))

    return bind(clean(value), check)


def extract_cusips(text: Column) -> Column:
    """Labelled, check-digit-valid CUSIPs of a text: upper case, distinct, sorted."""
    found = F.regexp_extract_all(text, F.lit(CUSIP_LABEL), 1)
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, valid_cusip), F.upper)))


def extract_isins(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(ISIN_LABEL), 1)
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, valid_isin), F.upper)))


def cusip_from_us_isin(isin: Column) -> Column:
    """Characters 3–11 of a US ISIN, by shape only (no check digit)."""
    text = clean(isin)
    return F.when(text.rlike("^US[A-Z0-9]{9}[0-9]$"), F.substring(text, 3, 9))


def corroboration(isin: Column, evidence_isins: Column, evidence_cusips: Column) -> Column:
    """Struct of exact-ISIN match, embedded-CUSIP match (US/CA) and their OR."""
    candidate = clean(F.coalesce(isin, F.lit("")))
    good = valid_isin(candidate)
    known_isins = F.transform(F.filter(evidence_isins, valid_isin), F.upper)
    known_cusips = F.transform(F.filter(evidence_cusips, valid_cusip), F.upper)
    exact = good & F.array_contains(known_isins, candidate)
    embedded = F.substring(candidate, 3, 9)
    inside = (
        good
        & F.substring(candidate, 1, 2).isin("US", "CA")
        & valid_cusip(embedded)
        & F.array_contains(known_cusips, embedded)
    )
    exact, inside = F.coalesce(exact, F.lit(False)), F.coalesce(inside, F.lit(False))
    return F.struct(
        exact.alias("exact_isin_match"),
        inside.alias("isin_embedded_cusip_match"),
        (exact | inside).alias("identifier_corroborated"),
    )


def identifier_relationship(observed: Column, candidate: Column) -> Column:
    a = clean(F.coalesce(observed, F.lit("")))
    b = clean(F.coalesce(candidate, F.lit("")))
    return (
        F.when((F.length(a) != 9) | (F.length(b) != 9), F.lit("unusable"))
        .when(a == b, F.lit("exact"))
        .when(
            F.substring(a, 1, 8) == F.substring(b, 1, 8),
            F.lit("same_security_body_check_digit_difference"),
        )
        .when(
            F.substring(a, 1, 6) == F.substring(b, 1, 6), F.lit("same_issuer_root_different_issue")
        )
        .otherwise(F.lit("different_issuer_root"))
    )


def ascii_upper(text: Column) -> Column:
    """Upper case of ASCII letters only, so that positions keep counting characters."""
    return F.translate(text, _LOWER, _LOWER.upper())


def match_start(folded: Column, identifier: Column) -> Column:
    """Zero-based start of the first match in a text in ``ascii_upper``, NULL if there is none."""
    at = F.call_function("instr", folded, F.upper(identifier))
    return F.when(at > 0, at - 1)


def context_window(
    text: Column, identifier: Column, start: Column, radius: int = CONTEXT_RADIUS
) -> Column:
    """Text around a match that begins at ``start``; empty without a match."""
    left = F.greatest(start - radius, F.lit(0))
    stop = start + F.length(identifier) + radius
    return F.coalesce(F.substring(text, left + 1, stop - left), F.lit(""))


def security_context(window: Column) -> Column:
    """Security type suggested by the words around an identifier.

    Terms are plain substrings, and debt is looked at before preferred stock.
    """
    lowered = F.lower(F.coalesce(window, F.lit("")))

    def mentions(terms):
        return reduce(lambda a, b: a | b, [lowered.contains(t) for t in terms])

    equity, debt, preferred = (mentions(t) for t in (EQUITY_TERMS, DEBT_TERMS, PREFERRED_TERMS))
    return (
        F.when(equity & ~debt & ~preferred, F.lit("common_equity"))
        .when(debt & ~equity, F.lit("debt"))
        .when(preferred, F.lit("preferred"))
        .when(equity | debt, F.lit("ambiguous_security_type"))
        .otherwise(F.lit("unknown"))
    )


def is_priority_document(document_type: Column) -> Column:
    kind = clean(F.coalesce(document_type, F.lit("")))
    return kind.isin(CORE_FORMS) | kind.rlike(PRIORITY_EXHIBIT_SHAPE)
