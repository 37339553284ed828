"""Readers of landed files and parsers of their contents.

A reader loads files; a parser works on any DataFrame with the raw text in ``value``,
so it can be used on tables as well.  Schemas are always given, never inferred.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowndate.functions.keys import cik_filing_key, yyyymmdd, zero_pad
from knowndate.operators.checks import need_columns
from knowndate.operators.cohort import FACT_COLUMNS, SUBMISSION_COLUMNS
from knowndate.sources.streams import ZipTables, member_of, streamed_uri, tsv_batches

# --- fixed values -----------------------------------------------------------
NAME_SOURCE_REQUIRED = ["adsh", "cik", "name", "filed"]
NAME_SOURCE_COLUMNS = ["adsh", "cik", "name", "filed", "form", "period"]
FIRST_DATASET_YEAR = 2009
BANKRUPTCY_ITEM = "1.03"
BANKRUPTCY_EVENT = "sec_8k_item_1_03"
REPORT_FORMS = ["10-K", "10-Q", "10-K/A", "10-Q/A"]
CONCEPT_TAGS = {
    "assets": ["Assets"],
    "liabilities": ["Liabilities"],
    "equity": [
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "cash": [
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
    ],
    "revenue": [
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "Revenues",
        "SalesRevenueNet",
    ],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "operating_income": ["OperatingIncomeLoss"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
}
PROVIDER = "EODHD"
MAX_DOCUMENT_BYTES = 8_000_000
# ----------------------------------------------------------------------------

_QUARTER = r"(\d{4}q[1-4])"


# --- quarterly datasets ---------------------------------------------------------


def quarter_plan(spark: SparkSession, start_year: int, end_year: int, end_quarter: int) -> DataFrame:
    """Quarters from the first of ``start_year`` to ``end_quarter`` of ``end_year``."""
    if start_year < FIRST_DATASET_YEAR or end_quarter not in (1, 2, 3, 4):
        raise ValueError("datasets start in 2009 and quarters run from 1 to 4")
    index = F.explode(F.sequence(F.lit(start_year * 4), F.lit(end_year * 4 + end_quarter - 1)))
    year, quarter = F.floor(F.col("i") / 4).cast("int"), (F.col("i") % 4 + 1).cast("int")
    return spark.range(1).select(index.alias("i")).select(
        year.alias("year"),
        quarter.alias("quarter"),
        F.concat(year.cast("string"), F.lit("q"), quarter.cast("string")).alias("source_quarter"),
    )


def read_zip_tables(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """TSV member ``<table>.txt`` of zip archives → text columns and ``source_quarter``.

    One archive per task, which streams the member from the file system in batches, so neither the
    archive nor the member has to fit in memory.  Where only Spark reaches the store, an archive is one
    binary value of at most two gigabytes.  Columns an archive lacks come back as NULL.  Land archives as parquet
    once (``write_partitioned``) and read that from then on.
    """
    wanted = list(columns)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    paths = sorted(r["path"] for r in files.select("path").collect())  # one name per archive
    if all(streamed_uri(p) for p in paths):
        spark.dataSource.register(ZipTables)
        options = {"paths": "\n".join(paths), "table": table, "columns": "\n".join(wanted)}
        rows = spark.read.format(ZipTables.name()).options(**options).load()
    else:
        schema = "path string, " + ", ".join(f"`{c}` string" for c in wanted)

        def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, content in zip(batch["path"], batch["content"]):
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        with archive.open(member_of(archive.namelist(), table)) as raw:
                            for chunk in tsv_batches(raw, wanted):
                                chunk.insert(0, "path", name)
                                yield chunk

        rows = files.select("path", "content").mapInPandas(members, schema)
    return rows.select(
        *wanted, F.regexp_extract("path", _QUARTER, 1).alias("source_quarter")
    )


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Landed TSV files (``…/2024q1/sub.txt`` or partitioned by ``source_quarter``)."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, quote="")
    if "source_quarter" in rows.columns:
        return rows
    return rows.withColumn(
        "source_quarter", F.regexp_extract(F.col("_metadata.file_path"), _QUARTER, 1)
    )


def submissions_of(raw: DataFrame) -> DataFrame:
    """Raw submission text columns → the columns the cohort needs."""
    need_columns(raw, ["adsh", "cik", "form", "filed", "period"])
    return raw.select(*[c for c in (*SUBMISSION_COLUMNS, "source_quarter") if c in raw.columns])


def facts_from(raw: DataFrame) -> DataFrame:
    """Raw fact text columns → typed facts."""
    need_columns(raw, ["adsh", "tag", "ddate", "qtrs", "uom", "value"])
    kept = raw.select(*[c for c in (*FACT_COLUMNS, "source_quarter") if c in raw.columns])
    value = F.col("value").try_cast("double")
    return kept.withColumns(
        {
            "value": F.when(~F.isnan(value), value),
            "qtrs": F.col("qtrs").try_cast("double").try_cast("int"),
        }
    )


def filing_name_source(raw: DataFrame) -> DataFrame:
    """Submissions reduced to names, with strict keys; missing columns raise."""
    need_columns(raw, NAME_SOURCE_REQUIRED)
    keep = [c for c in (*NAME_SOURCE_COLUMNS, "source_quarter") if c in raw.columns]
    return raw.select(*keep).withColumns(
        {"cik": cik_filing_key(F.col("cik")), "filed": yyyymmdd(F.col("filed"))}
    )


def filing_names(source: DataFrame, ciks: DataFrame) -> DataFrame:
    """Distinct filing names of the wanted issuers (semi join)."""
    wanted = ciks.select(cik_filing_key(F.col("cik")).alias("cik")).distinct()
    columns = [c for c in NAME_SOURCE_COLUMNS if c in source.columns]
    return source.select(*columns).join(wanted, "cik", "left_semi").distinct()


def source_status(plan: DataFrame, source: DataFrame, ciks: DataFrame) -> DataFrame:
    """Planned quarters with row and matched counts; missing ones are ``source_not_published``."""
    wanted = ciks.select(cik_filing_key(F.col("cik")).alias("cik")).distinct()
    per = source.groupBy("source_quarter", "cik").agg(F.count(F.lit(1)).alias("n"))
    hit = wanted.withColumn("__hit", F.lit(True))
    counts = per.join(hit, "cik", "left").groupBy("source_quarter").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("__hit"), F.col("n")).otherwise(0)).alias("matched_rows"),
    )
    return plan.select("source_quarter").join(counts, "source_quarter", "left").select(
        "source_quarter",
        F.when(F.col("rows").isNull(), "source_not_published").otherwise("retrieved").alias("status"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("matched_rows", F.lit(0)).alias("matched_rows"),
    )


# --- JSON documents ----------------------------------------------------------------

_FACT = "array<struct<val:double,filed:string,end:string,form:string>>"
_COMPANY_FACTS = (
    "cik string, entityName string, facts struct<`us-gaap`:"
    f"map<string,struct<units:map<string,{_FACT}>>>>"
)
_SUBMISSION = (
    "cik string, name string, formerNames array<struct<name:string,`from`:string,`to`:string>>, "
    "filings struct<recent:struct<form:array<string>,filingDate:array<string>,"
    "items:array<string>,accessionNumber:array<string>>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: ``value`` and the file ``path``."""
    text = spark.read.text(path, wholetext=True)
    return text.select("value", F.col("_metadata.file_path").alias("path"))


def _tagged_facts(gaap: Column, tags: list[str]) -> Column:
    """USD facts of the first listed tag that has a USD unit at all."""
    usd = [F.try_element_at(F.try_element_at(gaap, F.lit(t))["units"], F.lit("USD")) for t in tags]
    return F.coalesce(*usd)


def company_fact_record(documents: DataFrame, as_of: str) -> DataFrame:
    """Company-facts JSON → the record known on ``as_of``: latest value per concept.

    Latest means last by (filed, end, position) among annual and quarterly reports.
    """
    doc = F.from_json("value", _COMPANY_FACTS)
    rows = documents.withColumn("__d", doc)
    gaap = F.col("__d.facts.us-gaap")

    def latest(tags):
        indexed = F.transform(
            _tagged_facts(gaap, tags),
            lambda r, i: F.struct(
                r["filed"].alias("filed"),
                F.coalesce(r["end"], F.lit("")).alias("end"),
                i.alias("i"),
                r["val"].alias("val"),
                r["form"].alias("form"),
            ),
        )
        known = F.filter(
            indexed,
            lambda r: (F.coalesce(r["filed"], F.lit("")) != "")
            & (F.try_to_date(r["filed"], "yyyy-MM-dd") <= F.lit(as_of).cast("date"))
            & r["form"].isin(REPORT_FORMS),
        )
        return F.array_max(known)["val"]

    return rows.select(
        F.col("__d.cik").alias("cik"),
        F.col("__d.entityName").alias("entity"),
        F.lit(as_of).alias("as_of"),
        *[latest(tags).alias(name) for name, tags in CONCEPT_TAGS.items()],
    )


def bankruptcy_events(documents: DataFrame) -> DataFrame:
    """Submission JSON → one event per 8-K whose item list holds exactly 1.03."""
    recent = F.col("__d.filings.recent")
    rows = documents.select(F.from_json("value", _SUBMISSION).alias("__d"))
    zipped = F.arrays_zip(
        recent["form"].alias("form"),
        recent["filingDate"].alias("day"),
        recent["items"].alias("items"),
        recent["accessionNumber"].alias("accession"),
    )
    filings = rows.select(F.coalesce("__d.cik", F.lit("")).alias("cik"), F.inline(zipped))
    items = F.transform(F.split(F.coalesce("items", F.lit("")), ","), lambda x: F.trim(x))
    return filings.filter(
        F.startswith("form", F.lit("8-K")) & F.array_contains(items, BANKRUPTCY_ITEM)
        & F.col("day").isNotNull()
    ).select(
        "cik",
        F.col("day").alias("event_date"),
        F.lit(BANKRUPTCY_EVENT).alias("event_type"),
        F.col("accession").alias("event_accession"),
    )


def ticker_map(documents: DataFrame) -> DataFrame:
    """Object-of-objects ticker JSON → distinct (cik, ticker) with one title."""
    entry = "map<string,struct<cik_str:string,ticker:string,title:string>>"
    rows = documents.select(F.explode(F.map_values(F.from_json("value", entry))).alias("t"))
    keyed = rows.select(
        zero_pad(F.col("t.cik_str")).alias("cik"),
        F.upper("t.ticker").alias("ticker"),
        F.col("t.title").alias("title"),
    )
    return keyed.groupBy("cik", "ticker").agg(F.min("title").alias("title"))


def cik_names(lines: DataFrame) -> DataFrame:
    """``NAME:CIK:`` lines → distinct (cik, historical_name); names may hold colons."""
    text = F.regexp_replace(F.rtrim("value"), ":$", "")
    shape = r"^(.*):\s*([0-9]+)\s*$"
    return lines.filter(text.rlike(shape)).select(
        zero_pad(F.regexp_extract(text, shape, 2)).alias("cik"),
        F.trim(F.regexp_extract(text, shape, 1)).alias("historical_name"),
    ).distinct()


def dated_aliases(documents: DataFrame, source: Column | None = None) -> DataFrame:
    """Submission JSON → current name and former names with their dates."""
    origin = source if source is not None else F.lit(None).cast("string")
    rows = documents.select(F.from_json("value", _SUBMISSION).alias("__d"), origin.alias("source"))
    current = F.struct(
        F.col("__d.name").alias("name"),
        F.lit(None).cast("string").alias("from_date"),
        F.lit(None).cast("string").alias("to_date"),
        F.lit("current").alias("name_type"),
    )
    former = F.transform(
        F.coalesce("__d.formerNames", F.array().cast("array<struct<name:string,from:string,to:string>>")),
        lambda x: F.struct(
            x["name"].alias("name"),
            x["from"].alias("from_date"),
            x["to"].alias("to_date"),
            F.lit("former").alias("name_type"),
        ),
    )
    names = F.filter(
        F.concat(F.array(current), former),
        lambda n: (n["name_type"] == "former") | (F.coalesce(n["name"], F.lit("")) != ""),
    )
    return rows.select(
        zero_pad(F.col("__d.cik")).alias("cik"), "source", F.inline(names)
    ).select("cik", "name", "from_date", "to_date", "name_type", "source").distinct()


def macro_observations(lines: DataFrame) -> DataFrame:
    """``date,value`` CSV lines with their ``series``; headers and non-numbers are dropped."""
    parts = F.split("value", ",")
    number = F.trim(parts[1]).try_cast("double")
    return lines.select(
        "series", F.try_to_date(parts[0], "yyyy-MM-dd").alias("date"), number.alias("value")
    ).filter(F.col("date").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def security_master(documents: DataFrame) -> DataFrame:
    """Provider symbol JSON objects with ``is_delisted`` → security master rows."""
    entry = F.from_json("value", "Code string, Isin string, Name string")
    rows = documents.select(entry.alias("e"), F.col("is_delisted").cast("boolean").alias("is_delisted"))
    code = F.coalesce("e.Code", F.lit(""))
    ident = F.concat(code, F.lit(".US"))
    return rows.select(
        ident.alias("security_id"),
        F.coalesce(F.nullif(F.col("e.Isin"), F.lit("")), code).alias("issuer_id"),
        F.col("e.Name").alias("security_name"),
        F.lit(None).cast("date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        F.lit(PROVIDER).alias("source"),
        ident.alias("source_identifier"),
        code.alias("ticker"),
        F.col("e.Isin").alias("isin"),
        "is_delisted",
    )


def price_rows(documents: DataFrame, retrieved_at: str) -> DataFrame:
    """Provider price JSON objects with ``security_id`` → normalised price rows.

    The adjusted close counts whenever the key is there, even when its value is null.
    """
    entry = F.from_json("value", "date string, close double, adjusted_close double, volume double")
    keys = F.json_object_keys("value")
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    rows = documents.select("security_id", entry.alias("e"), has("adjusted_close").alias("a"), has("volume").alias("v"))
    return rows.select(
        "security_id",
        F.try_to_date("e.date", "yyyy-MM-dd").alias("date"),
        F.when(F.col("a"), F.col("e.adjusted_close")).otherwise(F.col("e.close")).alias("close"),
        F.when(F.col("v"), F.col("e.volume")).otherwise(F.lit(0.0)).alias("volume"),
        F.lit(PROVIDER).alias("source"),
        F.lit(retrieved_at).alias("retrieved_at"),
    )


def accession_documents(documents: DataFrame) -> DataFrame:
    """Folder-index JSON with ``cik``, ``accession`` → listed documents and their URLs."""
    from knowndate.operators.evidence import accession_base_url

    shape = "directory struct<item:array<struct<name:string,size:string>>>"
    rows = documents.select("cik", "accession", F.from_json("value", shape).alias("d"))
    items = rows.select(
        "cik", "accession", F.posexplode("d.directory.item").alias("position", "i")
    )
    base = accession_base_url(F.col("cik"), F.col("accession"))
    name = F.coalesce("i.name", F.lit(""))
    return items.filter((name != "") & ~F.endswith(name, F.lit("/"))).select(
        "cik",
        "accession",
        "position",
        F.col("i.name").alias("name"),
        F.col("i.size").alias("size"),
        base.alias("base_url"),
        F.concat_ws("/", base, "i.name").alias("url"),
    )


def document_text(documents: DataFrame, raw: str = "html", url: str = "url") -> DataFrame:
    """Readable text of fetched documents, with digest and sizes.

    Tags of ``.htm``/``.html`` documents become spaces. ``oversize`` marks documents
    above the ceiling of the fetch; their text is returned all the same.
    """
    size = F.octet_length(raw)
    markup = F.lower(url).rlike(r"[.]html?$")
    stripped = F.trim(
        F.regexp_replace(F.regexp_replace(raw, "<[^>]+>", " "), r"\s+", " ")
    )
    text = F.when(markup, stripped).otherwise(F.col(raw))
    kept = [c for c in documents.columns if c != raw]
    out = documents.select(
        *kept,
        size.alias("bytes"),
        F.sha2(raw, 256).alias("sha256"),
        (size > MAX_DOCUMENT_BYTES).alias("oversize"),
        text.alias("text"),
    )
    return out.withColumn("text_chars", F.length("text"))
