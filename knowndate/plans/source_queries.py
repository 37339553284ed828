"""Queries for list parsers, JSON and text parsers, file audits and contracts.

The raw lines and documents are derived row by row from the provided tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from knowndate.operators import checks, evidence, labels, market
from knowndate.plans import bindings as b
from knowndate.plans.cohort_queries import _DELIST, delisting_table
from knowndate.plans.registry import query
from knowndate.session import computed_once, spread
from knowndate.sources import files, lists, readers


def _day(name):
    return F.col(name).cast("string").alias(name)


# --- list lines -------------------------------------------------------------------------


def _parts(spark, sf_dir):
    """List rows of the parts; the table is small in bytes, so it is dealt out to all cores before its rows are made."""
    k = F.col("p_partkey")
    p = spread(b.table(spark, sf_dir, "part"), "p_partkey", least=spark.sparkContext.defaultParallelism)
    p = computed_once(p, {"good": b.cusip_of(k)})
    good = F.col("good")
    bad = F.concat(F.substring(good, 1, 8), ((F.substring(good, 9, 1).cast("int") + 1) % 10).cast("string"))
    desc = F.when(k % 9 == 0, "CALL").when(k % 9 == 1, "PUT").otherwise("COM")
    status = F.when(k % 6 == 0, "*A*").when(k % 6 == 1, "*D*").otherwise("")
    issuer = F.when(k % 29 == 0, "INC").otherwise(F.upper(F.concat("p_name", F.lit(" "), "p_brand")))
    vintage = F.concat(
        (F.lit(1996) + F.col("p_size") % 20).cast("string"), F.lit("Q"), (k % 4 + 1).cast("string")
    )
    return p.select(
        "p_partkey",
        vintage.alias("vintage"),
        F.when(k % 17 == 0, bad).otherwise(good).alias("cusip"),
        issuer.alias("issuer"),
        desc.alias("descr"),
        status.alias("status"),
        F.when(k % 5 == 0, "*").otherwise(" ").alias("marker"),
    )


_PARTS = f"""pt AS (SELECT p_partkey, (1996 + p_size % 20) || 'Q' || (p_partkey % 4 + 1) AS vintage,
   {b.cusip_of_sql('p_partkey')} AS good, CASE WHEN p_partkey % 29 = 0 THEN 'INC' ELSE upper(p_name || ' ' || p_brand) END AS issuer,
   CASE p_partkey % 9 WHEN 0 THEN 'CALL' WHEN 1 THEN 'PUT' ELSE 'COM' END AS descr,
   CASE p_partkey % 6 WHEN 0 THEN '*A*' WHEN 1 THEN '*D*' ELSE '' END AS status,
   CASE WHEN p_partkey % 5 = 0 THEN '*' ELSE '' END AS marker, p_partkey % 17 = 0 AS bad FROM part)"""


def _fixed_lines(spark, sf_dir):
    line = F.concat(
        "cusip", "marker", F.rpad("issuer", 28, " "), F.lit("  "), F.rpad("descr", 16, " "),
        F.lit(" " * 11), F.rpad("status", 3, " "), F.lit(" " * 9), F.lit("E"),
    )
    short = F.col("p_partkey") % 31 == 0
    return _parts(spark, sf_dir).select(
        "vintage", F.when(short, F.substring(line, 1, 79)).otherwise(line).alias("value")
    )


_FIXED = "p_partkey % 31 <> 0 AND NOT bad AND descr = 'COM' AND issuer <> 'INC'"


@query(
    "s15_fixed_width_list",
    f"""WITH {_PARTS} SELECT DISTINCT vintage, good AS cusip, rtrim(substr(issuer, 1, 28)) AS issuer_name, descr AS issuer_description,
     status, marker, 'E' AS type_code, status = '*A*' AS added_to_13f_list, status = '*D*' AS deleted_from_13f_list
    FROM pt WHERE {_FIXED}""",
)
def fixed_width(spark, sf_dir):
    return lists.parse_fixed_width(_fixed_lines(spark, sf_dir))


@query(
    "f17_membership_events",
    f"""WITH {_PARTS} SELECT DISTINCT good AS cusip, rtrim(substr(issuer, 1, 28)) AS issuer_name, descr AS issuer_description,
      CASE status WHEN '*D*' THEN 'deleted_from_13f_list' ELSE 'added_to_13f_list' END AS event,
      CASE WHEN status = '*A*' THEN vintage END AS added_to_13f_list_quarter,
      CASE WHEN status = '*D*' THEN vintage END AS deleted_from_13f_list_quarter
    FROM pt WHERE {_FIXED} AND status <> ''""",
)
def membership(spark, sf_dir):
    return lists.membership_events(lists.parse_fixed_width(_fixed_lines(spark, sf_dir)))


_FID = f"""{_PARTS}, fid AS (SELECT vintage, count(*) AS lines, min(CASE WHEN p_partkey % 31 = 0 THEN 79 ELSE 80 END) AS min_width,
   max(CASE WHEN p_partkey % 31 = 0 THEN 79 ELSE 80 END) AS max_width, count(*) FILTER (WHERE p_partkey % 31 <> 0) AS conforming_lines,
   count(*) FILTER (WHERE p_partkey % 31 <> 0) AS candidate_rows,
   count(*) FILTER (WHERE p_partkey % 31 <> 0 AND descr <> 'COM') AS option_rows,
   count(*) FILTER (WHERE p_partkey % 31 <> 0 AND descr <> 'COM' AND NOT bad) AS option_cusip_valid_rows,
   count(*) FILTER (WHERE p_partkey % 31 <> 0 AND descr = 'COM') AS security_rows,
   count(*) FILTER (WHERE p_partkey % 31 <> 0 AND descr = 'COM' AND NOT bad) AS cusip_valid_rows FROM pt GROUP BY 1)"""


@query(
    "a16_line_fidelity",
    f"WITH {_FID} SELECT *, round(COALESCE(cusip_valid_rows / NULLIF(security_rows, 0), 0), 8) AS cusip_valid_rate FROM fid",
)
def line_fidelity(spark, sf_dir):
    out = lists.line_fidelity(_fixed_lines(spark, sf_dir), ["vintage"])
    return out.withColumn("cusip_valid_rate", F.round("cusip_valid_rate", 8))


@query(
    "g11_line_fidelity_gate",
    f"""WITH {_FID} SELECT vintage, min_width = 80 AND max_width = 80 AND security_rows >= 5
      AND cusip_valid_rows = security_rows AS passed FROM fid""",
)
def line_gate(spark, sf_dir):
    fid = lists.line_fidelity(_fixed_lines(spark, sf_dir), ["vintage"])
    return lists.line_fidelity_gate(fid, 5).select("vintage", "passed")


@query(
    "g11_line_fidelity_gate_default",
    f"""WITH {_FID} SELECT vintage, min_width = 80 AND max_width = 80 AND security_rows >= 1000
      AND cusip_valid_rows = security_rows AS passed FROM fid""",
)
def line_gate_default(spark, sf_dir):
    fid = lists.line_fidelity(_fixed_lines(spark, sf_dir), ["vintage"])
    return lists.line_fidelity_gate(fid).select("vintage", "passed")


@query(
    "s16_legacy_text_list",
    f"""WITH {_PARTS} SELECT DISTINCT good AS cusip, rtrim(substr(issuer, 1, 30)) AS issuer_name,
      CASE WHEN p_partkey % 2 = 0 THEN descr ELSE '' END AS issuer_description,
      CASE WHEN p_partkey % 2 = 0 THEN 'ADD' ELSE '' END AS status FROM pt WHERE NOT bad AND issuer <> 'INC' AND p_partkey % 31 <> 0""",
)
def legacy(spark, sf_dir):
    head = F.concat("cusip", F.lit(" "), F.rpad("issuer", 30, " "))
    full = F.concat(head, F.rpad("descr", 27, " "), F.lit("ADD"))
    k = F.col("p_partkey")
    line = F.when(k % 31 == 0, F.substring(full, 1, 39)).when(k % 2 == 0, full).otherwise(head)
    return lists.parse_legacy_text(_parts(spark, sf_dir).select(line.alias("value")))


_PDF = f"""{_PARTS}, pdf AS (SELECT DISTINCT good AS cusip, trim(substr(issuer || ' ' || descr || ' ADDED', 1, 30)) AS issuer_name,
   issuer || ' ' || descr || ' ADDED' AS row_text FROM pt WHERE NOT bad AND p_partkey % 31 <> 0)"""


def _pdf(spark, sf_dir):
    body = F.concat_ws(" ", "issuer", "descr", F.lit("ADDED"))
    line = F.concat(
        F.lit("  "), F.substring("cusip", 1, 6), F.lit("  "), F.substring("cusip", 7, 2), F.lit(" "),
        F.substring("cusip", 9, 1), F.lit("   "), body, F.lit("  "),
    )
    broken = F.col("p_partkey") % 31 == 0
    rows = _parts(spark, sf_dir).select(F.when(broken, body).otherwise(line).alias("value"))
    return lists.parse_pdf_text(rows)


@query("s17_pdf_text_list", f"WITH {_PDF} SELECT * FROM pdf")
def pdf_text(spark, sf_dir):
    return _pdf(spark, sf_dir)


@query(
    "s17_pdf_list_summary",
    f"""WITH {_PDF} SELECT count(*) AS rows, count(DISTINCT cusip) AS unique_cusips,
    count(DISTINCT issuer_name) AS unique_issuer_names FROM pdf""",
)
def pdf_summary(spark, sf_dir):
    return lists.list_summary(_pdf(spark, sf_dir))


def _words(spark, sf_dir):
    """Words of list pages: forty lines per page, the words of a line up to 2 points apart."""
    p = _parts(spark, sf_dir)
    k = F.col("p_partkey")
    top = F.lit(100.0) + (k % 40) * 12

    def word(x, text, drop=0.0):
        return F.struct(F.lit(x).alias("x0"), (top + drop).alias("top"), text.alias("text"))

    tokens = F.split("issuer", " ")
    issuer = [
        F.struct(F.lit(167.4 + 40 * i).alias("x0"), (top + 0.5).alias("top"), F.try_element_at(tokens, F.lit(i + 1)).alias("text"))
        for i in range(4)
    ]
    words = F.array(
        word(72.8, F.substring("cusip", 1, 6)),
        word(115.7, F.substring("cusip", 7, 2), 1.0),
        word(135.1, F.substring("cusip", 9, 1), 2.0),
        word(150.1, F.col("marker")),
        *issuer,
        word(350.5, F.col("descr"), 2.0),
        word(468.2, F.col("status"), 1.0),
    )
    spread = p.select(
        "vintage", F.floor(k / 40).alias("page"), F.inline(words)
    )
    return spread.withColumnRenamed("vintage", "doc").filter("text IS NOT NULL AND trim(text) <> ''")


_WORDS = f"""{_PARTS}, wr AS (SELECT *, vintage AS doc, p_partkey // 40 AS page FROM pt)"""


@query(
    "s18_positioned_words",
    f"""WITH {_WORDS} SELECT DISTINCT doc, page, good AS cusip, issuer AS issuer_name, descr AS issuer_description, status,
      marker = '*' AS added_marker FROM wr WHERE NOT bad AND descr = 'COM'""",
)
def positioned(spark, sf_dir):
    return lists.parse_words(_words(spark, sf_dir))


_PAGE = """count(*) AS candidate_rows, count(*) FILTER (WHERE descr <> 'COM') AS option_rows,
   count(*) FILTER (WHERE descr = 'COM') AS equity_rows, count(*) FILTER (WHERE descr = 'COM' AND NOT bad) AS equity_cusip_valid"""


@query("a17_page_fidelity", f"WITH {_WORDS} SELECT doc, page, {_PAGE} FROM wr GROUP BY 1, 2")
def page_fidelity(spark, sf_dir):
    return lists.page_fidelity(_words(spark, sf_dir))


@query(
    "a23_list_fidelity",
    f"""WITH {_WORDS}, t AS (SELECT doc, count(DISTINCT page) AS pages, {_PAGE} FROM wr GROUP BY 1),
     g AS (SELECT doc, count(*) AS parsed_rows, count(DISTINCT good) AS unique_cusips, count(DISTINCT page) AS nonempty_pages FROM wr
        WHERE NOT bad AND descr = 'COM' GROUP BY 1)
    SELECT doc, pages, candidate_rows, option_rows, equity_rows, equity_cusip_valid, COALESCE(parsed_rows, 0) AS parsed_rows,
      COALESCE(unique_cusips, 0) AS unique_cusips, COALESCE(nonempty_pages, 0) AS nonempty_pages,
      equity_rows > 0 AND equity_cusip_valid = equity_rows AND COALESCE(parsed_rows, 0) >= 5 AND COALESCE(unique_cusips, 0) >= 5
        AND COALESCE(nonempty_pages, 0) >= 2 AS passed FROM t LEFT JOIN g USING (doc)""",
)
def list_fidelity(spark, sf_dir):
    w = _words(spark, sf_dir)
    out = lists.list_fidelity(lists.page_fidelity(w), lists.parse_words(w), 5, 5, 2)
    return out.drop("page_rows", "unique_issuers", "equity_valid_rate")


def _index_pages(spark, sf_dir):
    k = F.col("page_id")
    ext = F.when(k % 3 == 0, "pdf").when(k % 3 == 1, "txt").otherwise("TXT")
    link = F.concat(
        F.lit('<a HREF="'),
        F.when(k % 2 == 0, F.lit("/files/investment")).otherwise("https://www.sec.gov/divisions"),
        F.lit("/13flist"), (F.lit(1996) + k % 60).cast("string"), F.lit("q"), (k % 4 + 1).cast("string"),
        F.when(k % 5 == 0, "-txt").otherwise(""), F.lit("."), ext, F.lit('">list</a>'),
    )
    return b.table(spark, sf_dir, "pages").select("page_id", F.concat("html", link).alias("html"))


_INDEX = """links AS (SELECT page_id, (1996 + page_id % 60) || 'Q' || (page_id % 4 + 1) AS vintage,
   CASE page_id % 3 WHEN 0 THEN 'pdf' ELSE 'txt' END AS format,
   'https://www.sec.gov' || CASE WHEN page_id % 2 = 0 THEN '/files/investment' ELSE '/divisions' END || '/13flist' || (1996 + page_id % 60)
     || 'q' || (page_id % 4 + 1) || CASE WHEN page_id % 5 = 0 THEN '-txt' ELSE '' END || '.'
     || CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' ELSE 'TXT' END AS url FROM pages),
 idx AS (SELECT vintage, format, arg_min(url, page_id) AS url FROM links GROUP BY 1, 2),
 man AS (SELECT vintage, max(format) AS format, arg_max(url, format) AS url, string_agg(format, ',' ORDER BY format) AS available_formats FROM idx GROUP BY 1)"""


@query("s19_list_source_index", f"WITH {_INDEX} SELECT * FROM man")
def source_index(spark, sf_dir):
    return lists.list_manifest(lists.source_index(_index_pages(spark, sf_dir)))


def _manifest(spark, sf_dir):
    return lists.list_manifest(lists.source_index(_index_pages(spark, sf_dir)))


@query(
    "a26_manifest_summary",
    f"""WITH {_INDEX} SELECT count(*) AS vintage_count, count(*) FILTER (WHERE format = 'txt') AS txt,
    count(*) FILTER (WHERE format = 'pdf') AS pdf, min(vintage) AS first_vintage, max(vintage) AS last_vintage, count(*) >= 100 AS passed FROM man""",
)
def manifest_summary(spark, sf_dir):
    return lists.manifest_summary(_manifest(spark, sf_dir))


@query(
    "j17_missing_quarters",
    f"""WITH {_INDEX} SELECT (i // 4) || 'Q' || (i % 4 + 1) AS vintage FROM range(1996 * 4 + 2, 2030 * 4 + 1) t(i)
    WHERE (i // 4) || 'Q' || (i % 4 + 1) NOT IN (SELECT vintage FROM man)""",
)
def missing(spark, sf_dir):
    return lists.missing_quarters(_manifest(spark, sf_dir), "1996Q3", "2030Q1")


@query(
    "j17_preflight",
    f"""WITH {_INDEX}, w AS (SELECT DISTINCT lower((1997 + p_size % 5) || 'Q' || (p_partkey % 4 + 1)) AS vintage FROM part)
    SELECT w.vintage, man.format, man.url, man.vintage IS NOT NULL AS resolved FROM w LEFT JOIN man ON upper(w.vintage) = man.vintage""",
)
def preflight(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    vintage = F.concat(
        (F.lit(1997) + F.col("p_size") % 5).cast("string"), F.lit("q"), (F.col("p_partkey") % 4 + 1).cast("string")
    )
    return lists.preflight(_manifest(spark, sf_dir), p.select(vintage.alias("vintage")))


# --- JSON and text parsers -------------------------------------------------------------------


@query(
    "s07_bankruptcy_events",
    """SELECT CAST(o_custkey AS VARCHAR) AS cik, strftime(o_orderdate, '%Y-%m-%d') AS event_date, 'sec_8k_item_1_03' AS event_type,
      'acc-' || o_orderkey AS event_accession FROM orders WHERE o_orderkey % 5 IN (0, 1)""",
)
def bankruptcy(spark, sf_dir):
    k = F.col("o_orderkey")
    items = F.when(k % 5 == 0, "1.03").when(k % 5 == 1, "9.01, 1.03 ,2.02").when(k % 5 == 2, "1.031").otherwise("")
    recent = F.struct(
        F.array(F.when(k % 3 == 0, "8-K/A").otherwise("8-K"), F.lit("10-K")).alias("form"),
        F.array(*[F.date_format("o_orderdate", "yyyy-MM-dd")] * 2).alias("filingDate"),
        F.array(items, F.lit("1.03")).alias("items"),
        F.array(F.concat(F.lit("acc-"), k.cast("string")), F.lit("x")).alias("accessionNumber"),
    )
    doc = F.struct(
        F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings")
    )
    docs = b.table(spark, sf_dir, "orders").select(F.to_json(doc).alias("value"))
    return readers.bankruptcy_events(docs)


@query(
    "s06_w13_company_fact_record",
    """SELECT CAST(o_orderkey AS VARCHAR) AS cik, CASE WHEN o_orderdate <= TIMESTAMP '1999-06-30' THEN
        CASE WHEN o_orderkey % 2 = 0 AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1999-06-30' THEN o_totalprice * 2 ELSE o_totalprice END END AS assets,
      CASE WHEN o_orderkey % 3 <> 0 AND o_orderdate <= TIMESTAMP '1999-06-30' THEN o_totalprice END AS revenue FROM orders""",
)
def company_facts(spark, sf_dir):
    """Revenues only counts where the preferred revenue tag is absent, even if that one is empty."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    day = lambda n: F.date_format(F.date_add(F.to_date("o_orderdate"), n), "yyyy-MM-dd")

    def fact(value, days, form):
        return F.struct(
            value.alias("val"), day(days).alias("filed"), F.lit("1998-12-31").alias("end"), F.lit(form).alias("form")
        )

    assets = F.when(
        k % 2 == 0, F.array(fact(price, 0, "10-K"), fact(price * 2, 30, "10-Q/A"), fact(price * 3, -1, "8-K"))
    ).otherwise(F.array(fact(price, 0, "10-K")))
    node = lambda arr: F.struct(F.struct(arr.alias("USD")).alias("units"))
    empty = F.array(fact(price * 9, 0, "8-K"))
    gaap = F.struct(
        node(assets).alias("Assets"),
        F.when(k % 3 == 0, node(empty)).alias("RevenueFromContractWithCustomerExcludingAssessedTax"),
        node(F.array(fact(price, 0, "10-K"))).alias("Revenues"),
    )
    doc = F.struct(k.cast("string").alias("cik"), F.struct(gaap.alias("us-gaap")).alias("facts"))
    docs = b.table(spark, sf_dir, "orders").select(F.to_json(doc).alias("value"))
    return readers.company_fact_record(docs, "1999-06-30").select("cik", "assets", "revenue")


@query(
    "s08_ticker_map",
    """SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, upper(substr(c_mktsegment, 1, 3)) || c_custkey AS ticker,
      c_name AS title FROM customer""",
)
def ticker_json(spark, sf_dir):
    entry = F.struct(
        F.col("c_custkey").alias("cik_str"),
        F.lower(F.concat(F.substring("c_mktsegment", 1, 3), F.col("c_custkey").cast("string"))).alias("ticker"),
        F.col("c_name").alias("title"),
    )
    twice = F.struct(entry.alias("0"), entry.alias("1"))
    docs = b.table(spark, sf_dir, "customer").select(F.to_json(twice).alias("value"))
    return readers.ticker_map(docs)


@query(
    "s09_cik_names",
    """SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN c_custkey % 3 = 0 THEN c_name || ': HOLDINGS' ELSE c_name END
      AS historical_name FROM customer WHERE c_custkey % 11 <> 0""",
)
def name_lines(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat("c_name", F.lit(": HOLDINGS"))).otherwise(F.col("c_name"))
    line = F.when(k % 11 == 0, F.concat(name, F.lit(":none:"))).otherwise(
        F.concat(name, F.lit(":"), k.cast("string"), F.lit(": "))
    )
    return readers.cik_names(b.table(spark, sf_dir, "customer").select(line.alias("value")))


@query(
    "s10_dated_aliases",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS name, NULL::VARCHAR AS from_date, NULL::VARCHAR AS to_date,
      'current' AS name_type FROM customer WHERE c_custkey % 7 <> 0
    UNION ALL SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0'), 'Old ' || c_name, '1999-01-01', '2000-01-01', 'former' FROM customer WHERE c_custkey % 2 = 0""",
)
def aliases(spark, sf_dir):
    k = F.col("c_custkey")
    old = F.struct(
        F.concat(F.lit("Old "), "c_name").alias("name"), F.lit("1999-01-01").alias("from"), F.lit("2000-01-01").alias("to")
    )
    doc = F.struct(
        k.cast("string").alias("cik"),
        F.when(k % 7 != 0, F.col("c_name")).alias("name"),
        F.when(k % 2 == 0, F.array(old, old)).alias("formerNames"),
    )
    docs = b.table(spark, sf_dir, "customer").select(F.to_json(doc).alias("value"))
    return readers.dated_aliases(docs).drop("source")


@query(
    "s11_macro_observations",
    """SELECT event_type AS series, strftime(ts, '%Y-%m-%d') AS date, round(value, 4) AS value FROM events WHERE event_id % 9 <> 0""",
)
def observations(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    number = F.when(F.col("event_id") % 9 != 0, F.round("value", 4).cast("string")).otherwise(".")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(","), number)
    out = readers.macro_observations(e.select(F.col("event_type").alias("series"), line.alias("value")))
    return out.select("series", _day("date"), "value")


@query(
    "s13_security_master",
    """SELECT 'P' || p_partkey || '.US' AS security_id, CASE WHEN p_size % 4 <> 0 THEN 'I' || p_partkey ELSE 'P' || p_partkey END AS issuer_id,
      p_name AS security_name, CASE WHEN p_size % 4 <> 0 THEN 'I' || p_partkey END AS isin, p_size % 2 = 1 AS is_delisted FROM part""",
)
def symbol_master(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    doc = F.struct(
        F.concat(F.lit("P"), key).alias("Code"),
        F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("I"), key)).alias("Isin"),
        F.col("p_name").alias("Name"),
    )
    docs = b.table(spark, sf_dir, "part").select(
        F.to_json(doc).alias("value"), (F.col("p_size") % 2).alias("is_delisted")
    )
    return readers.security_master(docs).select(
        "security_id", "issuer_id", "security_name", "isin", "is_delisted"
    )


@query(
    "s14_price_rows",
    """SELECT l_suppkey AS security_id, strftime(l_shipdate, '%Y-%m-%d') AS date, CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice
      WHEN 1 THEN l_extendedprice / 2 END AS close, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END AS volume FROM lineitem""",
)
def price_json(spark, sf_dir):
    n, price = F.col("l_linenumber"), F.col("l_extendedprice")
    base = [F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), price.alias("close")]
    volume = F.when(n % 2 == 0, F.col("l_quantity")).alias("volume")
    adjusted = F.when(n % 3 == 1, price / 2).alias("adjusted_close")
    plain = F.to_json(F.struct(*base, volume))
    full = F.to_json(F.struct(*base, adjusted, volume), {"ignoreNullFields": "false"})
    null_volume = F.regexp_replace(full, ',"volume":null', "")
    value = F.when(n % 3 == 0, plain).otherwise(null_volume)
    line = b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("security_id"), value.alias("value"))
    return readers.price_rows(line, "2002-01-01").select("security_id", _day("date"), "close", "volume")


def _accessions(spark, sf_dir):
    k = F.col("page_id")
    names = ["a-index.htm", "ex21.htm", "logo.jpg", "sub/", "", "ex4-1.htm", "notes.txt", "EX_2.HTML", "main.htm", "ex4-1.htm"]
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("10").alias("size")) for n in names])
    more = F.array(F.struct(F.concat(F.lit("doc"), k.cast("string"), F.lit(".txt")).alias("name"), F.lit("5").alias("size")))
    doc = F.struct(F.struct(F.concat(items, more).alias("item")).alias("directory"))
    return b.table(spark, sf_dir, "pages").select(
        k.alias("cik"), F.concat(F.lit("00-"), k.cast("string")).alias("accession"), F.to_json(doc).alias("value")
    )


_DOCS = """acc AS (SELECT page_id AS cik, '00-' || page_id AS accession, n AS name, pos FROM pages, (VALUES (0, 'a-index.htm'), (1, 'ex21.htm'),
   (2, 'logo.jpg'), (5, 'ex4-1.htm'), (6, 'notes.txt'), (7, 'EX_2.HTML'), (8, 'main.htm'), (9, 'ex4-1.htm')) t(pos, n)
   UNION ALL SELECT page_id, '00-' || page_id, 'doc' || page_id || '.txt', 10 FROM pages)"""


@query(
    "s20_accession_documents",
    f"WITH {_DOCS} SELECT cik, accession, pos AS position, name, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/00' || cik || '/' || name AS url FROM acc",
)
def accession_index(spark, sf_dir):
    out = readers.accession_documents(_accessions(spark, sf_dir))
    return out.select("cik", "accession", "position", "name", "url")


@query(
    "w12_document_selection",
    f"""WITH {_DOCS}, r AS (SELECT *, CASE WHEN name = 'main.htm' AND cik % 2 = 0 THEN 'primary_filing' WHEN name IN ('ex4-1.htm', 'EX_2.HTML') THEN 'priority_exhibit_filename'
       WHEN cik % 2 = 1 AND name NOT IN ('a-index.htm', 'logo.jpg') THEN 'textual_accession_fallback' END AS selection_reason FROM acc WHERE pos <> 9),
     k AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY CASE selection_reason WHEN 'primary_filing' THEN 0 WHEN 'priority_exhibit_filename' THEN 1 ELSE 2 END, pos) AS rn
       FROM r WHERE selection_reason IS NOT NULL)
    SELECT cik, name, selection_reason FROM k WHERE rn <= 8""",
)
def selection(spark, sf_dir):
    docs = readers.accession_documents(_accessions(spark, sf_dir))
    docs = docs.withColumn("primary_document", F.when(F.col("cik") % 2 == 0, "main.htm"))
    return evidence.select_documents(docs).select("cik", "name", "selection_reason")


@query(
    "p18_url_containment",
    f"""WITH {_DOCS} SELECT count(*) AS documents, count(*) FILTER (WHERE cik % 10 = 0) AS escaped,
      count(*) FILTER (WHERE cik % 10 = 0) = 0 AS passed FROM acc""",
)
def containment(spark, sf_dir):
    docs = readers.accession_documents(_accessions(spark, sf_dir))
    base = F.when(F.col("cik") % 10 == 0, "https://example.org/").otherwise(F.col("base_url"))
    return checks.url_escapes(docs.withColumn("base_url", base))


@query(
    "s21_document_text",
    r"""SELECT page_id, octet_length(encode(html)) AS bytes, sha256(html) AS sha256, FALSE AS oversize,
      CASE WHEN page_id % 2 = 0 THEN trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) ELSE html END AS text,
      length(CASE WHEN page_id % 2 = 0 THEN trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) ELSE html END) AS text_chars
    FROM pages""",
)
def document_text(spark, sf_dir):
    p = b.table(spark, sf_dir, "pages")
    suffix = F.when(F.col("page_id") % 2 == 0, ".HTM").otherwise(".txt")
    p = p.withColumn("url", F.concat(F.lit("https://x/"), F.col("page_id").cast("string"), suffix))
    return readers.document_text(p).drop("url")


# --- quarters and files --------------------------------------------------------------------------


@query(
    "s02_s05_source_status",
    f"""WITH s AS (SELECT (year(o_orderdate) + 14) || 'q' || quarter(o_orderdate) AS source_quarter, count(*) AS rows,
        count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AS matched_rows FROM orders GROUP BY 1),
      p AS (SELECT (i // 4) || 'q' || (i % 4 + 1) AS source_quarter FROM range(2009 * 4, 2016 * 4 + 2) t(i))
    SELECT source_quarter, CASE WHEN rows IS NULL THEN 'source_not_published' ELSE 'retrieved' END AS status, COALESCE(rows, 0) AS rows,
      COALESCE(matched_rows, 0) AS matched_rows FROM p LEFT JOIN s USING (source_quarter)""",
)
def status(spark, sf_dir):
    plan = readers.quarter_plan(spark, 2009, 2016, 2)
    return readers.source_status(plan, _names_source(spark, sf_dir), _building(spark, sf_dir))


def _building(spark, sf_dir):
    return b.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("cik"))


def _names_source(spark, sf_dir):
    day = F.to_date("o_orderdate")
    raw = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("adsh"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("cik"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("name"),
        F.date_format(day, "yyyyMMdd").alias("filed"),
        F.col("o_orderpriority").alias("form"),
        F.concat((F.year(day) + 14).cast("string"), F.lit("q"), F.quarter(day).cast("string")).alias("source_quarter"),
    )
    return readers.filing_name_source(raw)


@query(
    "s05_filing_names",
    """SELECT o_orderkey AS adsh, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'Customer ' || o_custkey AS name,
      CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed, o_orderpriority AS form FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def filing_names(spark, sf_dir):
    out = readers.filing_names(_names_source(spark, sf_dir), _building(spark, sf_dir))
    return out.select("adsh", "cik", "name", _day("filed"), "form")


@query(
    "s04_quarter_plan_pruning",
    """WITH p AS (SELECT (i // 4) || 'q' || (i % 4 + 1) AS source_quarter FROM range(2011 * 4, 2013 * 4 + 3) t(i))
    SELECT (year(o_orderdate) + 14) || 'q' || quarter(o_orderdate) AS source_quarter, count(*) AS n FROM orders
    WHERE (year(o_orderdate) + 14) || 'q' || quarter(o_orderdate) IN (SELECT source_quarter FROM p) GROUP BY 1""",
)
def plan_pruning(spark, sf_dir):
    plan = readers.quarter_plan(spark, 2011, 2013, 3)
    kept = _names_source(spark, sf_dir).join(plan.select("source_quarter"), "source_quarter", "left_semi")
    return kept.groupBy("source_quarter").agg(F.count(F.lit(1)).alias("n"))


@query("s24_file_manifest")
def manifest(spark, sf_dir):
    return files.file_manifest(spark, sf_dir, "*.parquet").select("name", "bytes", "sha256")


_SHELF = f"""{b.FILINGS}, per AS (SELECT year(filed) || 'q' || quarter(filed) AS source_quarter, count(*) AS n FROM filings GROUP BY 1),
  shelf AS (SELECT source_quarter, source_quarter || '.zip' AS name, CAST(n * CAST(source_quarter[1:4] AS BIGINT) AS BIGINT) AS bytes,
    sha256(source_quarter) AS sha256 FROM per WHERE source_quarter[6:6] <> '3')"""


def _shelf(spark, sf_dir):
    """Archives of the filings' quarters, all of which the plan names; those of third quarters are absent."""
    quarter = F.concat(F.year("filed"), F.lit("q"), F.quarter("filed"))
    per = b.filings(spark, sf_dir).groupBy(quarter.alias("source_quarter")).agg(F.count("*").alias("n"))
    q = F.col("source_quarter")
    shelf = per.filter(F.substring(q, 6, 1) != "3").select(
        F.concat(q, F.lit(".zip")).alias("name"),
        (F.col("n") * F.substring(q, 1, 4).cast("bigint")).alias("bytes"),
        F.sha2(q, 256).alias("sha256"),
    )
    return per, shelf


@query(
    "s25_cache_audit",
    f"""WITH {_SHELF} SELECT source_quarter, name IS NOT NULL AS cached, COALESCE(bytes, 0) AS bytes, sha256
    FROM per LEFT JOIN shelf USING (source_quarter)""",
)
def cache_audit(spark, sf_dir):
    plan, shelf = _shelf(spark, sf_dir)
    return files.cache_audit(plan, shelf)


@query(
    "s26_snapshot_check",
    f"""WITH {_SHELF} SELECT name, bytes, bytes % 5 NOT IN (0, 1, 2) AS matches,
      CASE WHEN bytes % 5 NOT IN (2, 3) THEN CAST(source_quarter[1:4] || '-06-30' AS DATE) END AS observed_through,
      bytes % 5 = 4 AS passed FROM shelf""",
)
def snapshot_check(spark, sf_dir):
    """Sidecars with another digest, another size, none at all, and without a usable time."""
    _, shelf = _shelf(spark, sf_dir)
    k, bytes_ = F.col("bytes") % 5, F.col("bytes")
    said = F.to_json(F.struct(
        F.when(k == 0, "other").otherwise(F.col("sha256")).alias("sha256"),
        F.when(k == 1, bytes_ + 1).otherwise(bytes_).alias("bytes"),
        F.when(k == 3, "unknown").otherwise(F.concat(F.substring("name", 1, 4), F.lit("-06-30T23:00:00Z"))).alias("acquired_utc"),
    ))
    sidecars = shelf.filter(k != 2).select("name", said.alias("value"))
    return files.snapshot_check(shelf, sidecars).withColumn("passed", F.coalesce("passed", F.lit(False)))


@query(
    "s23_report_json",
    """SELECT '{"max_total":' || CAST(CAST(max(o_totalprice) AS BIGINT) AS VARCHAR) || ',"n":' || count(*) || ',"status":"' || o_orderstatus || '"}' AS value
    FROM orders GROUP BY o_orderstatus""",
)
def report(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    rows = o.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice")).cast("bigint").alias("max_total")
    )
    return files.report_json(rows)


# --- contracts ----------------------------------------------------------------------------------


@query(
    "g01_table_contract",
    """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM lineitem) AS rows, 0.0::DOUBLE AS null_rate_l_orderkey,
      (SELECT round(avg((l_returnflag = 'R')::INT), 8) FROM lineitem) AS null_rate_flag, CAST(sum(n - 1) AS BIGINT) AS duplicate_key_rows,
      sum(n - 1) = 0 AS passed FROM k""",
)
def table_contract(spark, sf_dir):
    line = b.table(spark, sf_dir, "lineitem").withColumn(
        "flag", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))
    )
    out = checks.contract(line, ["l_orderkey", "flag"], ["l_orderkey", "l_linenumber"])
    return out.withColumn("null_rate_flag", F.round("null_rate_flag", 8))


@query(
    "g02_price_contract",
    f"""WITH {b.PRICES} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS duplicate_key_rows, TRUE AS passed FROM prices""",
)
def price_contract(spark, sf_dir):
    return checks.price_contract(b.prices(spark, sf_dir)).select("rows", "duplicate_key_rows", "passed")


@query(
    "g02_price_contract_duplicates",
    f"""WITH {b.PRICES}, twice AS (FROM prices UNION ALL (FROM prices WHERE close > 200000))
    SELECT count(*) AS rows, count(*) - count(DISTINCT (security_id, date)) AS duplicate_key_rows,
      count(*) = count(DISTINCT (security_id, date)) AS passed FROM twice""",
)
def price_contract_duplicates(spark, sf_dir):
    """Rows of high prices come twice."""
    prices = b.prices(spark, sf_dir)
    out = checks.price_contract(prices.unionByName(prices.filter("close > 200000")))
    return out.select("rows", "duplicate_key_rows", "passed")


@query(
    "g03_delisting_contract_duplicates",
    f"""WITH {_DELIST}, twice AS (FROM d UNION ALL (FROM d WHERE delist_return IS NULL))
    SELECT count(*) AS rows, round(avg((delist_return IS NULL)::INT), 8) AS null_rate_delist_return,
      count(*) - count(DISTINCT (security_id, delist_date)) AS duplicate_key_rows,
      count(*) = count(DISTINCT (security_id, delist_date)) AS passed FROM twice""",
)
def delisting_contract_duplicates(spark, sf_dir):
    """Delistings without a return come twice."""
    d = delisting_table(spark, sf_dir)
    out = checks.delisting_contract(d.unionByName(d.filter("delist_return IS NULL")))
    return out.select(
        "rows", F.round("null_rate_delist_return", 8).alias("null_rate_delist_return"), "duplicate_key_rows", "passed"
    )


@query(
    "g03_delisting_contract",
    f"""WITH {_DELIST} SELECT count(*) AS rows, round(avg((delist_return IS NULL)::INT), 8) AS null_rate_delist_return,
      CAST(0 AS BIGINT) AS duplicate_key_rows, TRUE AS passed FROM d""",
)
def delisting_contract(spark, sf_dir):
    out = checks.delisting_contract(delisting_table(spark, sf_dir))
    return out.select(
        "rows", F.round("null_rate_delist_return", 8).alias("null_rate_delist_return"), "duplicate_key_rows", "passed"
    )


@query(
    "g04_price_plausibility",
    f"""WITH {b.PRICES} SELECT count(*) AS rows, count(*) FILTER (WHERE close <= 5000) AS non_positive_close,
      count(*) FILTER (WHERE volume < 3) AS negative_volume, CAST(0 AS BIGINT) AS duplicate_key_rows,
      count(*) FILTER (WHERE close <= 5000 OR volume < 3) = 0 AS passed FROM prices""",
)
def plausibility(spark, sf_dir):
    """Prices are shifted down, so that some violate the rules."""
    p = b.prices(spark, sf_dir).withColumns(
        {"close": F.col("close") - 5000, "volume": F.col("volume") - 3}
    )
    return checks.price_plausibility(p)


@query(
    "g05_survivorship_gate",
    f"""WITH {b.cohort_sql()}, m AS (SELECT *, cik % 20 <> 0 AS has FROM cohort)
    SELECT round(1 - avg(has::INT), 8) AS row_drop_rate, round(1 - avg(has::INT) FILTER (WHERE label = 1), 8) AS positive_drop_rate,
      (1 - avg(has::INT)) <= 0.25 AND (1 - avg(has::INT) FILTER (WHERE label = 1)) <= 0.05 AS passed FROM m""",
)
def survivorship(spark, sf_dir):
    c = b.cohort(spark, sf_dir).withColumn("has_market_data", F.col("cik") % 20 != 0)
    out = checks.survivorship_gate(c)
    return out.select(
        F.round("row_drop_rate", 8).alias("row_drop_rate"),
        F.round("positive_drop_rate", 8).alias("positive_drop_rate"),
        "passed",
    )


@query(
    "g06_no_row_drop",
    "SELECT count(*) AS rows_before, count(*) AS rows_after, TRUE AS passed FROM orders",
)
def row_drop(spark, sf_dir):
    f = b.filings(spark, sf_dir).withColumn("security_id", F.col("cik") % 100)
    features = market.security_market_features(b.prices(spark, sf_dir))
    return checks.same_row_count(f, market.attach_security_market(f, features))


@query(
    "g08_identifier_promotion",
    f"""WITH {b.evidence_sql()}, e AS (SELECT source, identifier, security_context, filing_date, CAST(cik AS BIGINT) % 3 <> 0 AS ok,
       CAST(cik AS BIGINT) % 7 <> 0 AS same, CAST(cik AS BIGINT) % 11 = 0 AS amb FROM evid2)
    SELECT source, identifier, CAST((NOT ok)::INT + (security_context <> 'common_equity')::INT + (NOT same)::INT + amb::INT
       + (filing_date < '2000-06-01')::INT + (filing_date > '2002-01-01')::INT AS BIGINT) AS reasons,
      ok AND security_context = 'common_equity' AND same AND NOT amb AND filing_date >= '2000-06-01' AND filing_date <= '2002-01-01'
        AS eligible_for_security_acceptance_review FROM e""",
)
def promotion(spark, sf_dir):
    k = F.col("cik").cast("bigint")
    e = evidence.contextual_evidence(b.documents(spark, sf_dir)).withColumns(
        {
            "identifier_corroborated": k % 3 != 0,
            "cik_matches_filing": k % 7 != 0,
            "ambiguous_identifier": k % 11 == 0,
            "candidate_valid_from": F.lit("2000-06-01"),
            "candidate_valid_to": F.lit("2002-01-01"),
        }
    )
    out = checks.identifier_promotion(e)
    return out.select(
        "source", "identifier", F.size("reasons").cast("bigint").alias("reasons"),
        "eligible_for_security_acceptance_review",
    )


@query(
    "g09_provider_assessment",
    """SELECT s_suppkey, CAST((s_suppkey % 2 = 0)::INT + (s_suppkey % 3 = 0)::INT + (s_suppkey % 5 = 0)::INT + (s_suppkey % 7 = 0)::INT AS BIGINT) AS blockers,
      CAST((s_nationkey % 2 = 0)::INT + (s_nationkey % 3 = 0)::INT AS BIGINT) AS warnings,
      s_suppkey % 2 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS eligible_for_historical_ablation,
      s_acctbal > 0 AND s_suppkey % 4 <> 0 AS public_demo_allowed FROM supplier""",
)
def providers(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    p = b.table(spark, sf_dir, "supplier").withColumns(
        {
            "historical_delisted": k % 2 != 0,
            "identifier_history": k % 3 != 0,
            "provenance": k % 5 != 0,
            "point_in_time_identifiers": k % 7 != 0,
            "delisting_returns": n % 2 != 0,
            "corporate_actions": n % 3 != 0,
            "research_use": F.col("s_acctbal") > 0,
            "public_demo": k % 4 != 0,
            "artifact_redistribution": F.lit(False),
            "derived_feature_redistribution": F.lit(True),
        }
    )
    capable = checks.assess_providers(p).withColumnRenamed("blockers", "b1")
    out = checks.publication_gate(capable)
    return out.select(
        "s_suppkey", F.size("b1").cast("bigint").alias("blockers"), F.size("warnings").cast("bigint").alias("warnings"),
        "eligible_for_historical_ablation", "public_demo_allowed",
    )


@query(
    "g10_model_promotion",
    """SELECT s_suppkey, CAST((s_suppkey % 3 = 0)::INT + (s_suppkey % 4 = 0)::INT + (s_suppkey % 5 = 0)::INT + (s_suppkey % 7 = 0 AND s_suppkey % 2 = 0)::INT AS BIGINT) AS reasons,
      s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 AND NOT (s_suppkey % 7 = 0 AND s_suppkey % 2 = 0) AS passed,
      CAST((s_suppkey % 5 = 0)::INT AS BIGINT) AS missing_fields FROM supplier""",
)
def model_promotion(spark, sf_dir):
    k = F.col("s_suppkey")
    fields = [F.lit("x").alias(c) for c in checks.MODEL_EVIDENCE_FIELDS if c != "code_sha"]
    doc = F.struct(*fields, F.when(k % 5 != 0, "abc").alias("code_sha"))
    e = b.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.to_json(doc).alias("value"),
        F.when(k % 3 == 0, "exploratory").otherwise("candidate").alias("status"),
        (k % 4).alias("data_artifact_count"),
        F.lit(True).alias("tested"),
        F.when(k % 5 != 0, "abc").alias("code_sha"),
        F.lit(True).alias("limitations_declared"),
        (k % 7 == 0).alias("market_model"),
        (k % 2 != 0).alias("survivorship_gate_passed"),
        F.lit(False).alias("current_vintage_macro"),
    )
    gaps = checks.model_evidence_gaps(e).drop("has_test_metrics", "passed")
    out = checks.model_promotion(gaps.withColumnRenamed("tested", "has_test_metrics"))
    return out.select(
        "s_suppkey", F.size("reasons").cast("bigint").alias("reasons"), "passed",
        F.size("missing_fields").cast("bigint").alias("missing_fields"),
    )


@query(
    "g01_duplicate_rows",
    "SELECT count(*) - count(DISTINCT l_orderkey || '/' || l_suppkey) AS duplicate_key_rows FROM lineitem",
)
def duplicates(spark, sf_dir):
    return checks.duplicate_rows(b.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(
    "p09_split_check",
    f"""WITH {b.FILINGS} SELECT count(*) FILTER (WHERE filed <= DATE '{b.TRAIN_END}') AS train_rows,
     count(*) FILTER (WHERE filed > DATE '{b.TRAIN_END}' AND filed <= DATE '{b.VALIDATION_END}') AS validation_rows,
     count(*) FILTER (WHERE filed > DATE '{b.VALIDATION_END}') AS test_rows, TRUE AS passed FROM filings""",
)
def split_check(spark, sf_dir):
    parts = labels.temporal_split(b.filings(spark, sf_dir), b.TRAIN_END, b.VALIDATION_END)
    return labels.split_check(parts)
