"""Identifier evidence: from filing documents to corroborated identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowndate.functions.identifiers import (
    ascii_upper,
    bind,
    context_window,
    extract_cusips,
    extract_isins,
    is_priority_document,
    match_start,
    security_context,
    valid_cusip,
)

# --- fixed values -----------------------------------------------------------
TEXT_SUFFIXES = [".htm", ".html", ".txt"]
EXHIBIT_NAME = r"(?i)(?:^|[-_])ex(?:hibit)?[-_]?(2|4)(?:[._-]|$)"
INDEX_NAME = r"(?i)(?:^|[-_])(index|header)(?:[._-]|$)"
MAX_DOCUMENTS = 8
ARCHIVE_ROOT = "https://www.sec.gov/Archives/edgar/data"
# ----------------------------------------------------------------------------


def accession_base_url(cik: Column, accession: Column) -> Column:
    number = F.replace(cik.cast("string"), F.lit(".0"), F.lit("")).try_cast("bigint")
    return F.concat_ws(
        "/", F.lit(ARCHIVE_ROOT), number.cast("string"), F.replace(accession, F.lit("-"), F.lit(""))
    )


def select_documents(documents: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """Documents worth reading per accession, at most ``max_documents``.

    Columns: cik, accession, name, position, primary_document.  The primary document
    comes first, then exhibits 2 and 4 by file name; without a primary document other
    textual files follow, except indexes.  A repeated name counts once.
    """
    suffix = F.lower(F.regexp_extract("name", r"(\.[^./]*)$", 1))
    textual = suffix.isin(TEXT_SUFFIXES)
    primary = F.coalesce(F.col("name") == F.col("primary_document"), F.lit(False))
    has_primary = F.coalesce(F.col("primary_document"), F.lit("")) != ""
    exhibit = textual & F.col("name").rlike(EXHIBIT_NAME)
    fallback = ~has_primary & textual & ~F.col("name").rlike(INDEX_NAME)
    order = F.when(primary, 0).when(exhibit, 1).when(fallback, 2)
    reason = F.when(primary, "primary_filing").when(exhibit, "priority_exhibit_filename").otherwise(
        "textual_accession_fallback"
    )
    ranked = documents.withColumns({"__order": order, "selection_reason": reason}).filter(
        F.col("__order").isNotNull()
    )
    unique = ranked.groupBy("cik", "accession", "name").agg(
        F.min_by(
            F.struct(*[c for c in ranked.columns if c not in ("cik", "accession", "name")]),
            F.struct("__order", "position"),
        ).alias("d")
    ).select("cik", "accession", "name", "d.*")
    w = W.partitionBy("cik", "accession").orderBy("__order", "position")
    return (
        unique.withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= max_documents)
        .drop("__rn", "__order")
    )


def identifier_evidence(documents: DataFrame) -> DataFrame:
    """Valid labelled identifiers per priority document; documents without any are left out.

    Columns: cik, accession, filing_date, document_type, source, text.
    """
    lists = F.struct(
        extract_cusips(F.col("text")).alias("cusips"), extract_isins(F.col("text")).alias("isins")
    )
    keep = ["cik", "accession", "filing_date", "document_type", "source"]
    # generated columns: a filter on plain ones would move below and run the patterns again
    found = documents.filter(is_priority_document(F.col("document_type"))).select(
        *keep, F.inline(F.array(lists))
    )
    return found.filter((F.size("cusips") > 0) | (F.size("isins") > 0)).select(
        "cik",
        "accession",
        "filing_date",
        "document_type",
        "source",
        "cusips",
        "isins",
        F.lit("unreviewed").alias("review_status"),
    )


def _tagged(cusips: Column, isins: Column) -> Column:
    tag = lambda kind: lambda v: F.struct(
        F.lit(kind).alias("identifier_type"), v.alias("identifier")
    )
    return F.concat(F.transform(cusips, tag("CUSIP")), F.transform(isins, tag("ISIN")))


def explode_identifiers(evidence: DataFrame) -> DataFrame:
    """One row per document and identifier."""
    keep = [c for c in evidence.columns if c not in ("cusips", "isins")]
    return evidence.select(*keep, F.inline(_tagged(F.col("cusips"), F.col("isins"))))


def contextual_evidence(documents: DataFrame) -> DataFrame:
    """One row per document and identifier with its surroundings and security type.

    Columns used: text; all other columns are carried along except the text itself.
    """
    keep = [c for c in documents.columns if c != "text"]
    text = F.col("text")
    tagged = _tagged(extract_cusips(text), extract_isins(text))

    def placed(found: Column) -> Column:
        """The identifiers with place and surroundings, built inside the array: no row carries the text further."""
        around = lambda t: lambda start: F.struct(
            t["identifier_type"].alias("identifier_type"),
            t["identifier"].alias("identifier"),
            start.alias("identifier_match_start"),
            context_window(text, t["identifier"], start).alias("identifier_context"),
        )
        within = lambda folded: F.transform(
            found, lambda t: bind(match_start(folded, t["identifier"]), around(t))
        )
        return F.when(F.size(found) > 0, bind(ascii_upper(text), within))

    rows = documents.select(*keep, F.inline(bind(tagged, placed)))
    kind = security_context(F.col("identifier_context"))
    return rows.select(
        *keep,
        "identifier_type",
        "identifier",
        "identifier_match_start",
        (F.col("identifier_match_start") + F.length("identifier")).alias("identifier_match_end"),
        "identifier_context",
        kind.alias("security_context"),
        (kind == "common_equity").alias("common_equity_context"),
        F.lit("unreviewed").alias("review_status"),
    )


def pilot_evidence(plan: DataFrame, documents: DataFrame) -> DataFrame:
    """Contextual evidence of the documents that belong to a pilot plan."""
    wanted = plan.select("cik", "accession", "candidate_security_id", "filing_date", "form")
    return contextual_evidence(documents).join(wanted, ["cik", "accession"])  # identifiers are shuffled, texts are not


_EVIDENCE_KEY = ["cik", "identifier_type", "identifier"]


def evidence_by_target(evidence: DataFrame) -> DataFrame:
    """Evidence rows, distinct identifiers and documents per target.

    Rows are combined per (target, identifier, document) before anything is counted
    distinct.
    """
    small = evidence.groupBy("cik", "identifier", "document_sha256").agg(
        F.count("identifier").alias("n"),
        F.count(F.lit(1)).alias("r"),
        F.count_if("common_equity_context").alias("e"),
    )
    return small.groupBy("cik").agg(
        F.sum("r").alias("evidence_rows"),
        F.count_distinct("identifier").alias("unique_identifiers"),
        F.sum("e").alias("common_equity_rows"),
        F.count_distinct("document_sha256").alias("documents"),
    )


def evidence_quality(evidence: DataFrame) -> DataFrame:
    """One row: size, duplicate rate over (target, type, identifier), equity coverage."""
    per_key = evidence.groupBy(*_EVIDENCE_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("common_equity_context").alias("e")
    )
    per_target = per_key.groupBy("cik").agg(
        F.sum("n").alias("n"),
        F.sum("e").alias("e"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("d"),
    )
    return per_target.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("targets"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("common_equity_rows"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("unique_identifiers"),
        F.count_if(F.col("e") > 0).alias("targets_with_common_equity"),
        F.try_divide(F.sum("d"), F.sum("n")).alias("duplicate_rate"),
    )


def corroboration(evidence: DataFrame) -> DataFrame:
    """Common-equity identifiers per target and security with independent sources."""
    equity = evidence.filter(F.coalesce("common_equity_context", F.lit(False)))
    key = [*_EVIDENCE_KEY, "candidate_security_id"]
    small = equity.groupBy(*key, "document_sha256", "accession").agg(
        F.count(F.lit(1)).alias("n"), F.min("filing_date").alias("lo"), F.max("filing_date").alias("hi")
    )
    out = small.groupBy(*key).agg(
        F.sum("n").alias("evidence_rows"),
        F.count_distinct("document_sha256").alias("independent_documents"),
        F.count_distinct("accession").alias("independent_accessions"),
        F.min("lo").alias("first_filing_date"),
        F.max("hi").alias("last_filing_date"),
    )
    return out.withColumns(
        {
            "corroboration_status": F.when(F.col("independent_accessions") >= 2, "multi_accession")
            .when(F.col("independent_documents") >= 2, "multi_document")
            .otherwise("single_document"),
            "acceptance_status": F.lit("unreviewed"),
        }
    )


def corroboration_report(candidates: DataFrame) -> DataFrame:
    per = candidates.groupBy("cik").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("independent_documents") >= 2).alias("d"),
        F.count_if(F.col("independent_accessions") >= 2).alias("a"),
        F.count_if(F.col("independent_documents") == 1).alias("s"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(
        F.count(F.lit(1)).alias("targets"),
        total("n").alias("candidate_identifiers"),
        total("d").alias("multi_document"),
        total("a").alias("multi_accession"),
        total("s").alias("single_document"),
    )


def cusip_validity(evidence: DataFrame) -> DataFrame:
    """One row: CUSIP rows and distinct CUSIPs, all and common equity, valid or not."""
    per = (
        evidence.filter(F.col("identifier_type") == "CUSIP")
        .groupBy("identifier")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("common_equity_context").alias("e"))
        .withColumn("ok", valid_cusip(F.col("identifier")))
    )
    ok, common = F.col("ok"), F.col("e") > 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(
        total("n").alias("cusip_rows"),
        F.count(F.lit(1)).alias("cusip_unique"),
        total(F.when(ok, F.col("n"))).alias("valid_rows"),
        F.count_if(ok).alias("valid_unique"),
        total("e").alias("common_equity_rows"),
        total(F.when(ok, F.col("e"))).alias("common_equity_valid_rows"),
        F.count_if(common).alias("common_equity_unique"),
        F.count_if(common & ok).alias("common_equity_valid_unique"),
    )


def identifier_coverage(ids: DataFrame) -> DataFrame:
    """One row: usable issuer keys, observation ids and linked events of scored rows.

    ``ids`` carries the five identity columns of ``keys.with_observation_ids``.
    """
    from knowndate.functions.keys import UNAVAILABLE, valid_event_id

    valid = F.col("cik").rlike("^[0-9]{10}$") & (F.col("cik") != "0000000000")
    missing = F.coalesce(F.trim("cik"), F.lit("")).isin("", UNAVAILABLE)
    linked = valid_event_id(F.col("cik"), F.col("event_id"))
    marked = ids.select(
        "cik",
        "event_id",
        F.coalesce(valid, F.lit(False)).alias("valid"),
        missing.alias("missing"),
        linked.alias("linked"),
        (
            F.coalesce(valid, F.lit(False))
            & ~F.coalesce(F.trim("observation_id"), F.lit("")).isin("", UNAVAILABLE)
        ).alias("observed"),
        "observation_id",
    )
    small = marked.groupBy("cik", "event_id", "observation_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.first("valid").alias("valid"),
        F.first("missing").alias("missing"),
        F.first("linked").alias("linked"),
        F.first("observed").alias("observed"),
    )
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return small.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_distinct(F.when(F.col("valid"), F.col("cik"))).alias("unique_ciks"),
        total(F.col("missing")).alias("ciks_unavailable"),
        total(~F.col("valid") & ~F.col("missing")).alias("ciks_invalid"),
        total(F.col("valid")).alias("rows_with_valid_cik"),
        F.count_distinct(F.when(F.col("observed"), F.col("observation_id"))).alias(
            "unique_observation_ids"
        ),
        total(F.col("linked")).alias("rows_with_linked_event"),
        F.count_distinct(F.when(F.col("linked"), F.col("event_id"))).alias("unique_linked_events"),
    )


def bootstrap_readiness(coverage: DataFrame) -> DataFrame:
    """One row: what blocks a cluster bootstrap over issuer keys."""
    from knowndate.operators.checks import reasons

    why = reasons(
        (F.col("rows") == 0, "empty_test_population"),
        (F.col("ciks_unavailable") > 0, "test_ciks_unavailable"),
        (F.col("ciks_invalid") > 0, "test_ciks_invalid"),
        (F.col("unique_ciks") < 2, "fewer_than_two_distinct_test_ciks"),
    )
    return coverage.withColumn("blockers", why).withColumn(
        "supports_cluster_bootstrap", F.size("blockers") == 0
    )
