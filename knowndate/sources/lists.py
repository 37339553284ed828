"""Official security lists: fixed-width, legacy, flattened-PDF and positioned-word forms.

Parsers take a DataFrame with one line per row (``value``), as ``spark.read.text``
gives it, and any key columns such as the list's vintage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowndate.functions.identifiers import valid_cusip
from knowndate.functions.keys import parse_quarter_label, quarter_label
from knowndate.functions.names import entity_name_key
from knowndate.session import computed_once

# --- fixed values -----------------------------------------------------------
LINE_WIDTH = 80
# field: (first character counted from 1, length)
FIXED_FIELDS = {
    "cusip": (1, 9),
    "marker": (10, 1),
    "issuer_name": (11, 28),
    "issuer_description": (41, 16),
    "status": (68, 3),
    "type_code": (80, 1),
}
LEGACY_MIN_WIDTH = 40
OPTION_DESCRIPTIONS = ["CALL", "PUT"]
STATUS_ADDED = "*A*"
STATUS_DELETED = "*D*"
PDF_ROW = r"^\s*([0-9A-Z*@#]{6})\s+([0-9A-Z*@#]{2})\s+([0-9])\s+(.+?)\s*$"
LIST_HREF = r'(?i)href="([^"]*?/13flist\d{4}q[1-4](?:-txt)?\.(?:pdf|txt))"'
LIST_HREF_PARTS = r"(?i)/13flist(\d{4})q([1-4])(?:-txt)?\.(pdf|txt)$"
SITE_ORIGIN = "https://www.sec.gov"
FORMAT_PREFERENCE = ["txt", "pdf"]
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnBounds:
    """Left edges of the columns of a positioned page, in points."""

    cusip_left: float = 70.0
    issuer_left: float = 148.0
    description_left: float = 348.0
    status_left: float = 462.0


def _field(name: str) -> Column:
    start, length = FIXED_FIELDS[name]
    return F.trim(F.substring("value", start, length))


def _usable_issuer(name: Column) -> Column:
    return entity_name_key(name) != ""


def parse_fixed_width(lines: DataFrame) -> DataFrame:
    """80-column lines → list rows; options, bad CUSIPs and empty issuers are dropped."""
    keys = [c for c in lines.columns if c != "value"]
    status = _field("status")
    rows = lines.filter(F.length("value") == LINE_WIDTH).select(
        *keys,
        F.upper(_field("cusip")).alias("cusip"),
        *[_field(f).alias(f) for f in ("issuer_name", "issuer_description", "status", "marker", "type_code")],
        (status == STATUS_ADDED).alias("added_to_13f_list"),
        (status == STATUS_DELETED).alias("deleted_from_13f_list"),
    )
    return rows.filter(
        valid_cusip(F.col("cusip"))
        & ~F.upper("issuer_description").isin(OPTION_DESCRIPTIONS)
        & _usable_issuer(F.col("issuer_name"))
    ).distinct()


def parse_legacy_text(lines: DataFrame) -> DataFrame:
    """Older text lists of at least 40 characters with their own offsets."""
    keys = [c for c in lines.columns if c != "value"]
    part = lambda start, length: F.trim(F.substring("value", start, length))
    rows = lines.filter(F.length("value") >= LEGACY_MIN_WIDTH).select(
        *keys,
        F.upper(part(1, 9)).alias("cusip"),
        part(11, 30).alias("issuer_name"),
        F.when(F.length("value") >= 67, part(41, 27)).otherwise("").alias("issuer_description"),
        F.when(F.length("value") >= 70, part(68, 3)).otherwise("").alias("status"),
    )
    return rows.filter(valid_cusip(F.col("cusip")) & _usable_issuer(F.col("issuer_name"))).distinct()


def parse_pdf_text(lines: DataFrame) -> DataFrame:
    """Flattened PDF rows: CUSIP in three pieces, issuer = first 30 characters of the tail."""
    keys = [c for c in lines.columns if c != "value"]
    part = lambda i: F.regexp_extract("value", PDF_ROW, i)
    tail = F.trim(part(4))
    pieces = {
        "cusip": F.concat(part(1), part(2), part(3)),
        "issuer_name": F.trim(F.substring(tail, 1, 30)),
        "row_text": tail,
    }
    rows = computed_once(lines.filter(F.col("value").rlike(PDF_ROW)), pieces).select(*keys, *pieces)
    return rows.filter(valid_cusip(F.col("cusip")) & _usable_issuer(F.col("issuer_name"))).distinct()


def list_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("cusip").alias("unique_cusips"),
        F.count_distinct("issuer_name").alias("unique_issuer_names"),
    )


def line_fidelity(lines: DataFrame, by: list[str]) -> DataFrame:
    """Counts per list before any row is dropped; options are set apart first."""
    conforming = F.length("value") == LINE_WIDTH
    candidate = conforming & (F.trim(F.substring("value", 1, 9)) != "")
    option = F.upper(_field("issuer_description")).isin(OPTION_DESCRIPTIONS)
    good = valid_cusip(F.substring("value", 1, 9))
    width = F.when(F.trim("value") != "", F.length("value"))
    out = lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"),
        F.min(width).alias("min_width"),
        F.max(width).alias("max_width"),
        F.count_if(conforming).alias("conforming_lines"),
        F.count_if(candidate).alias("candidate_rows"),
        F.count_if(candidate & option).alias("option_rows"),
        F.count_if(candidate & option & good).alias("option_cusip_valid_rows"),
        F.count_if(candidate & ~option).alias("security_rows"),
        F.count_if(candidate & ~option & good).alias("cusip_valid_rows"),
    )
    return out.withColumn(
        "cusip_valid_rate",
        F.coalesce(F.try_divide(F.col("cusip_valid_rows"), F.col("security_rows")), F.lit(0.0)),
    )


def line_fidelity_gate(fidelity: DataFrame, min_rows: int = 1000) -> DataFrame:
    """Per list: one line width, enough security rows, every one check-digit valid."""
    width_ok = F.coalesce(
        (F.col("min_width") == LINE_WIDTH) & (F.col("max_width") == LINE_WIDTH), F.lit(True)
    )
    return fidelity.withColumn(
        "passed",
        width_ok
        & (F.col("security_rows") >= min_rows)
        & (F.col("cusip_valid_rows") == F.col("security_rows")),
    )


def membership_events(rows: DataFrame) -> DataFrame:
    """Dated list changes (needs ``vintage``); a deletion names the event if both are set."""
    added, deleted = F.col("added_to_13f_list"), F.col("deleted_from_13f_list")
    return rows.filter(added | deleted).select(
        "cusip",
        "issuer_name",
        "issuer_description",
        F.when(deleted, "deleted_from_13f_list").otherwise("added_to_13f_list").alias("event"),
        F.when(added, F.col("vintage")).alias("added_to_13f_list_quarter"),
        F.when(deleted, F.col("vintage")).alias("deleted_from_13f_list_quarter"),
    )


# --- positioned words --------------------------------------------------------


def word_lines(words: DataFrame, y_tolerance: float = 2.5) -> DataFrame:
    """Add ``line``: the height of the first word of the word's text line.

    Columns: doc, page, text, x0, top.  A gap above the tolerance always starts a
    line, so each page is cut into runs at such gaps.  Only inside a run, over its
    distinct heights, are words compared with the first word of their line.
    """
    heights = words.select("doc", "page", "top").distinct()
    down = W.partitionBy("doc", "page").orderBy("top")
    starts = (F.col("top") - F.lag("top").over(down) > y_tolerance).cast("int")
    runs = heights.withColumn("__start", F.coalesce(starts, F.lit(0)))
    runs = runs.withColumn("__run", F.sum("__start").over(down))
    empty = F.array().cast("array<struct<top:double,line:double>>")

    def place(done, top):
        last = F.try_element_at(done, F.lit(-1))["line"]
        line = F.when(last.isNull() | (top - last > y_tolerance), top).otherwise(last)
        return F.concat(done, F.array(F.struct(top.alias("top"), line.alias("line"))))

    ordered = F.array_sort(F.collect_list(F.col("top").cast("double")))
    placed = (
        runs.groupBy("doc", "page", "__run")
        .agg(F.aggregate(ordered, empty, place).alias("t"))
        .select("doc", "page", F.inline("t"))
    )
    return words.withColumn("top", F.col("top").cast("double")).join(placed, ["doc", "page", "top"])


def line_columns(words: DataFrame, bounds: ColumnBounds, y_tolerance: float = 2.5) -> DataFrame:
    """One row per text line with the words of each column joined from left to right."""
    x = F.col("x0").cast("double")
    bucket = (
        F.when((x >= bounds.cusip_left) & (x < bounds.issuer_left), "cusip")
        .when((x >= bounds.issuer_left) & (x < bounds.description_left), "issuer")
        .when((x >= bounds.description_left) & (x < bounds.status_left), "description")
        .when(x >= bounds.status_left, "status")
    )
    lined = word_lines(words, y_tolerance).withColumn("__b", bucket)

    def joined(name):
        mine = F.collect_list(F.when(F.col("__b") == name, F.struct(x.alias("x"), "top", "text")))
        return F.trim(F.array_join(F.transform(F.array_sort(mine), lambda w: w["text"]), " "))

    return lined.groupBy("doc", "page", "line").agg(
        F.replace(joined("cusip"), F.lit(" "), F.lit("")).alias("cusip"),
        joined("issuer").alias("issuer_text"),
        joined("description").alias("issuer_description"),
        joined("status").alias("status"),
    )


def parse_words(
    words: DataFrame, bounds: ColumnBounds | None = None, y_tolerance: float = 2.5
) -> DataFrame:
    """Positioned words → list rows per page; options and invalid CUSIPs are dropped."""
    lines = line_columns(words, bounds or ColumnBounds(), y_tolerance)
    added = F.startswith("issuer_text", F.lit("*"))
    issuer = F.when(added, F.trim(F.substring("issuer_text", 2, 1 << 30))).otherwise(
        F.col("issuer_text")
    )
    rows = lines.select(
        "doc",
        "page",
        "cusip",
        issuer.alias("issuer_name"),
        "issuer_description",
        "status",
        added.alias("added_marker"),
    )
    return rows.filter(
        valid_cusip(F.col("cusip"))
        & ~F.upper("issuer_description").isin(OPTION_DESCRIPTIONS)
        & (F.col("issuer_name") != "")
    ).distinct()


def page_fidelity(
    words: DataFrame, bounds: ColumnBounds | None = None, y_tolerance: float = 2.5
) -> DataFrame:
    """Candidate, option and equity line counts per page before any line is dropped."""
    lines = line_columns(words, bounds or ColumnBounds(), y_tolerance)
    candidate = F.length("cusip") == 9
    option = F.upper("issuer_description").isin(OPTION_DESCRIPTIONS)
    good = valid_cusip(F.col("cusip"))
    return lines.groupBy("doc", "page").agg(
        F.count_if(candidate).alias("candidate_rows"),
        F.count_if(candidate & option).alias("option_rows"),
        F.count_if(candidate & ~option).alias("equity_rows"),
        F.count_if(candidate & ~option & good).alias("equity_cusip_valid"),
    )


def list_fidelity(pages: DataFrame, rows: DataFrame, min_rows=1000, min_cusips=1000, min_pages=50):
    """Page counts rolled up per list with the floors a usable list must reach."""
    totals = pages.groupBy("doc").agg(
        F.count(F.lit(1)).alias("pages"),
        *[
            F.sum(c).alias(c)
            for c in ("candidate_rows", "option_rows", "equity_rows", "equity_cusip_valid")
        ],
    )
    parsed = rows.groupBy("doc").agg(
        F.count(F.lit(1)).alias("page_rows"),
        F.count_distinct("cusip").alias("unique_cusips"),
        F.count_distinct("issuer_name").alias("unique_issuers"),
        F.count_distinct("page").alias("nonempty_pages"),
    )
    distinct = rows.drop("page").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("parsed_rows"))
    out = totals.join(parsed, "doc", "left").join(distinct, "doc", "left")
    out = out.fillna(0).withColumn(
        "equity_valid_rate",
        F.coalesce(F.try_divide(F.col("equity_cusip_valid"), F.col("equity_rows")), F.lit(0.0)),
    )
    return out.withColumn(
        "passed",
        (F.col("equity_rows") > 0)
        & (F.col("equity_cusip_valid") == F.col("equity_rows"))
        & (F.col("parsed_rows") >= min_rows)
        & (F.col("unique_cusips") >= min_cusips)
        & (F.col("nonempty_pages") >= min_pages),
    )


def page_row_floor(rows: DataFrame, pages: DataFrame, min_rows: int) -> DataFrame:
    """Rows per page and whether the page reaches the floor (pages without rows included)."""
    counts = rows.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("rows"))
    return (
        pages.select("doc", "page").distinct().join(counts, ["doc", "page"], "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0)))
        .withColumn("passed", F.col("rows") >= min_rows)
    )


# --- where each list is published ----------------------------------------------


def source_index(pages: DataFrame, html: str = "html", order: str = "page_id") -> DataFrame:
    """List links of index pages: one row per (vintage, format), the first link wins."""
    links = pages.select(
        F.col(order).alias("__page"),
        F.posexplode(F.regexp_extract_all(html, F.lit(LIST_HREF), 1)).alias("__pos", "path"),
    )
    part = lambda i: F.regexp_extract("path", LIST_HREF_PARTS, i)
    named = links.select(
        "__page",
        "__pos",
        "path",
        F.concat(part(1), F.lit("Q"), part(2)).alias("vintage"),
        F.lower(part(3)).alias("format"),
    )
    url = F.when(F.startswith("path", F.lit("http")), F.col("path")).otherwise(
        F.concat(
            F.lit(SITE_ORIGIN),
            F.when(F.startswith("path", F.lit("/")), F.lit("")).otherwise(F.lit("/")),
            F.col("path"),
        )
    )
    first = F.min_by("path", F.struct("__page", "__pos"))
    return named.groupBy("vintage", "format").agg(first.alias("path")).select(
        "vintage", "format", url.alias("url")
    )


def list_manifest(index: DataFrame) -> DataFrame:
    """One row per vintage: the preferred format, its URL and all available formats."""
    rank = F.array_position(F.array(*[F.lit(f) for f in FORMAT_PREFERENCE]), F.col("format"))
    usable = index.filter(F.coalesce("url", F.lit("")) != "").withColumn("__rank", rank)
    return usable.groupBy("vintage").agg(
        F.min_by("format", "__rank").alias("format"),
        F.min_by("url", "__rank").alias("url"),
        F.array_join(F.array_sort(F.collect_set("format")), ",").alias("available_formats"),
    )


def manifest_summary(manifest: DataFrame, floor: int = 100) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("vintage_count"),
        F.count_if(F.col("format") == "txt").alias("txt"),
        F.count_if(F.col("format") == "pdf").alias("pdf"),
        F.min("vintage").alias("first_vintage"),
        F.max("vintage").alias("last_vintage"),
    ).withColumn("passed", F.col("vintage_count") >= floor)


def quarter_span(spark, first: str, last: str) -> DataFrame:
    """All quarter labels between two labels."""
    ends = spark.range(1).select(
        F.sequence(parse_quarter_label(F.lit(first)), parse_quarter_label(F.lit(last))).alias("q")
    )
    return ends.select(F.explode("q").alias("q")).select(quarter_label(F.col("q")).alias("vintage"))


def missing_quarters(manifest: DataFrame, first: str, last: str) -> DataFrame:
    """Quarters of the span that were never published."""
    wanted = quarter_span(manifest.sparkSession, first, last)
    return wanted.join(manifest.select("vintage"), "vintage", "left_anti")


def preflight(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested vintages with their source, case-insensitively; ``resolved`` tells."""
    have = manifest.select(
        F.upper("vintage").alias("__v"), F.col("format"), F.col("url"), F.lit(True).alias("__have")
    )
    asked = wanted.select("vintage").distinct().withColumn("__v", F.upper("vintage"))
    return asked.join(have, "__v", "left").select(
        "vintage", "format", "url", F.coalesce("__have", F.lit(False)).alias("resolved")
    )


def preflight_check(report: DataFrame) -> DataFrame:
    out = report.agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(~F.col("resolved")).alias("unavailable")
    )
    return out.withColumn("passed", F.col("unavailable") == 0)


def evenly_spaced_cases(cases: DataFrame, n: int = 5) -> DataFrame:
    """``n`` cases spread evenly over (last_filing, cik); half positions round to even.

    Positions come from counts per day, so only the picked days are ever ordered by cik.
    """
    from knowndate.operators.ordered import day_positions

    placed = day_positions(cases, [], "last_filing", "cik")
    last = F.col("pos__n") - 1
    picks = F.array(*[F.bround(F.lit(i) * last / (n - 1)).cast("bigint") for i in range(n)])
    return placed.filter(F.array_contains(picks, F.col("pos").cast("bigint"))).drop("pos", "pos__n")

