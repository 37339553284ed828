"""SQL fragments of identifier arithmetic for the DuckDB twins."""

from __future__ import annotations

from knowndate.functions.identifiers import (
    CUSIP_SHAPE,
    DEBT_TERMS,
    EQUITY_TERMS,
    IDENTIFIER_ALPHABET,
    ISIN_COUNTRIES,
    ISIN_SHAPE,
    PREFERRED_TERMS,
)


def check_digit(body: str) -> str:
    """Check digit of an eight-character body."""
    terms = []
    for i in range(1, 9):
        v = f"((strpos('{IDENTIFIER_ALPHABET}', substr({body}, {i}, 1)) - 1) * {2 if i % 2 == 0 else 1})"
        terms.append(f"({v} // 10 + {v} % 10)")
    return f"((10 - ({' + '.join(terms)}) % 10) % 10)"


def valid_cusip(x: str) -> str:
    return (
        f"(regexp_matches({x}, '{CUSIP_SHAPE}') AND "
        f"CAST({check_digit(x)} AS VARCHAR) = substr({x}, 9, 1))"
    )


def luhn_total(text: str) -> str:
    """Luhn total of an identifier whose letters expand to two digits."""
    digits = (
        f"reverse(array_to_string(list_transform(string_split({text}, ''), "
        f"lambda c: CAST(strpos('{IDENTIFIER_ALPHABET}', c) - 1 AS VARCHAR)), ''))"
    )
    return (
        f"list_sum(list_transform(string_split({digits}, ''), lambda d, i: "
        f"(CAST(d AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) // 10 + "
        f"(CAST(d AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) % 10))"
    )


def valid_isin(x: str) -> str:
    countries = ", ".join(f"'{c}'" for c in ISIN_COUNTRIES)
    return (
        f"(CASE WHEN regexp_matches({x}, '{ISIN_SHAPE}') AND substr({x}, 1, 2) IN ({countries}) "
        f"THEN {luhn_total(x)} % 10 = 0 ELSE FALSE END)"
    )


def _any(terms: list[str], text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def security_context(text: str) -> str:
    e, d, p = (_any(t, text) for t in (EQUITY_TERMS, DEBT_TERMS, PREFERRED_TERMS))
    return (
        f"CASE WHEN {e} AND NOT {d} AND NOT {p} THEN 'common_equity' WHEN {d} AND NOT {e} THEN 'debt' "
        f"WHEN {p} THEN 'preferred' WHEN {e} OR {d} THEN 'ambiguous_security_type' ELSE 'unknown' END"
    )


def name_key(x: str) -> str:
    """Entity-name key of ASCII text."""
    from knowndate.functions.names import LEGAL_SUFFIXES

    drop = ", ".join(f"'{s}'" for s in LEGAL_SUFFIXES)
    return (
        f"array_to_string(list_filter(string_split(regexp_replace(upper({x}), '[^A-Z0-9 ]+', ' ', 'g'), ' '), "
        f"lambda t: t <> '' AND t NOT IN ({drop})), ' ')"
    )


def list_key(x: str) -> str:
    from knowndate.functions.names import LIST_ABBREVIATIONS, LIST_NAME_WIDTH

    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LIST_ABBREVIATIONS.items())
    return (
        f"rtrim(substr(array_to_string(list_transform(string_split({name_key(x)}, ' '), "
        f"lambda t: CASE t {cases} ELSE t END), ' '), 1, {LIST_NAME_WIDTH}))"
    )


def padded(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 10, '0')"


_BEST_BLOCK = """list_max(flatten(list_transform(range(1, len(x.a) + 1), lambda i: list_transform(
  list_filter(range(1, len(x.b) + 1), lambda j: substr(x.b, j, 1) = substr(x.a, i, 1)), lambda j: struct_pack(
    k := list_max(list_filter(range(1, least(len(x.a) - i, len(x.b) - j) + 2), lambda k: substr(x.a, i, k) = substr(x.b, j, k))),
    i := -i, j := -j)))))"""


def name_scores(pairs: str) -> str:
    """CTEs ``ratios`` and ``scores`` (a, n, score) over distinct key pairs; needs WITH RECURSIVE.

    Each step takes the longest common block of two strings (the first in a, then in n) and goes on with what lies
    before and behind it; the ratio is twice the blocks' length over both lengths.
    """
    words = "list_distinct(string_split({}, ' '))"
    a, n = words.format("a"), words.format("n")
    return f"""blocks AS (
  SELECT s.a AS pa, s.n AS pn, x.a, x.b, {_BEST_BLOCK} AS m FROM {pairs} s, LATERAL (SELECT s.a AS a, s.n AS b) x
  UNION ALL
  SELECT pa, pn, x.a, x.b, {_BEST_BLOCK} AS m FROM (
    SELECT pa, pn, unnest([struct_pack(a := substr(a, 1, -m.i - 1), b := substr(b, 1, -m.j - 1)),
       struct_pack(a := substr(a, m.k - m.i), b := substr(b, m.k - m.j))]) AS x FROM blocks WHERE m IS NOT NULL) u
  WHERE x.a <> '' AND x.b <> ''),
ratios AS (SELECT pa AS a, pn AS n, 2.0 * coalesce(sum(m.k), 0) / (len(pa) + len(pn)) AS ratio FROM blocks GROUP BY pa, pn),
scores AS (SELECT a, n, greatest(ratio, len(list_intersect({a}, {n})) / len(list_distinct(list_concat({a}, {n})))) AS score
  FROM ratios)"""


def crc32(x: str) -> str:
    """CRC-32 of ASCII text: eight shift steps a character."""
    step = "lambda c, i: xor(c >> 1, 3988292384 * (c & 1))"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({x}, ''), lambda t: CAST(ascii(t) AS BIGINT))), "
        f"lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {step})))"
    )


def newton(name: str, counts: str, start: str, ridge: float = 0.0, free_slope: bool = True, steps: int = 40) -> str:
    """Recursive CTE (i, a, b) of Newton steps for sigmoid(a + b * z) on (z, n, tp); ``start`` selects a and b."""
    det = "(s.aa * s.bb - s.ab * s.ab)"
    to = (
        f"a + (s.bb * s.f - s.ab * s.g) / {det}, b + (s.aa * s.g - s.ab * s.f) / {det}" if free_slope else "a + s.f / s.aa, b"
    )
    return f"""{name}(i, a, b) AS ({start.replace('SELECT', 'SELECT 0,', 1)} UNION ALL
   SELECT i + 1, {to} FROM (SELECT r.i, r.a, r.b, (SELECT struct_pack(f := sum(tp - n * m), g := sum((tp - n * m) * z) - {ridge} * r.b,
       aa := sum(n * m * (1 - m)), ab := sum(n * m * (1 - m) * z), bb := sum(n * m * (1 - m) * z * z) + {ridge})
     FROM (SELECT n, tp, z, 1 / (1 + exp(-(r.a + r.b * z))) AS m FROM {counts})) AS s FROM {name} r WHERE r.i < {steps}))"""
