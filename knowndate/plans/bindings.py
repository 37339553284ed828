"""Logical inputs of the operators, derived from the provided tables.

Every binding exists twice: as a DataFrame and as the SQL of a common table
expression with the same columns, so that each query has an independent twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowndate.session import spread

# Dates of the bound cohort.
CUTOFF = "2000-12-31"
TRAIN_END = "1997-12-31"
VALIDATION_END = "1998-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- filings, events, labelled cohort ----------------------------------------


def filings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cik"),
        F.col("o_orderkey").alias("adsh"),
        F.to_date("o_orderdate").alias("filed"),
        F.col("o_orderpriority").alias("form"),
        F.col("o_totalprice").alias("assets"),
    )


FILINGS = """filings AS (
  SELECT o_custkey AS cik, o_orderkey AS adsh, CAST(o_orderdate AS DATE) AS filed,
         o_orderpriority AS form, o_totalprice AS assets FROM orders)"""


def distress_events(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .filter(
            (F.col("o_orderstatus") == "F")
            & (F.col("o_orderpriority") == "1-URGENT")
            & (F.col("o_totalprice") > 300000)
        )
        .select(
            F.col("o_custkey").alias("cik"),
            F.to_date("o_orderdate").alias("event_date"),
            F.lit("distress").alias("event_type"),
        )
    )


EVENTS = """ev AS (
  SELECT DISTINCT o_custkey AS cik, CAST(o_orderdate AS DATE) AS event_date FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000)"""


def cohort(spark, sf_dir, **kw) -> DataFrame:
    from knowndate.operators.labels import label_forward

    kw.setdefault("observed_through", CUTOFF)
    return label_forward(filings(spark, sf_dir), distress_events(spark, sf_dir), **kw)


def cohort_sql(horizon=365, embargo=0, cutoff: str | None = CUTOFF) -> str:
    """CTEs ending in ``cohort``; the next event is a correlated minimum."""
    complete = (
        "TRUE" if cutoff is None else f"(filed + INTERVAL {horizon} DAY <= DATE '{cutoff}')"
    )
    hit = (
        f"COALESCE(nxt - filed > {embargo} AND nxt - filed <= {horizon}, FALSE)"
    )
    return f"""{FILINGS}, {EVENTS},
nexts AS (SELECT f.*, (SELECT min(e.event_date) FROM ev e
            WHERE e.cik = f.cik AND e.event_date > f.filed) AS nxt FROM filings f),
cohort AS (SELECT *, {complete} AS complete, {hit} AS hit,
   CASE WHEN {complete} OR {hit} THEN CAST({hit} AS INTEGER) END AS label FROM nexts)"""


SPLIT_SQL = (
    f"CASE WHEN filed <= DATE '{TRAIN_END}' THEN 'train' "
    f"WHEN filed <= DATE '{VALIDATION_END}' THEN 'validation' ELSE 'test' END"
)


# --- raw submissions and facts -------------------------------------------------


def submissions(spark, sf_dir) -> DataFrame:
    """Quarterly submission rows with the raw shapes: numeric dates, some unusable."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    number = lambda d: F.date_format(d, "yyyyMMdd").cast("int")
    form = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "10-K")
        .when(F.col("o_orderpriority") == "2-HIGH", "10-Q")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "10-Q")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "10-K/A")
        .otherwise("8-K")
    )
    return o.select(
        F.col("o_orderkey").alias("adsh"),
        F.col("o_custkey").alias("cik"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("name"),
        form.alias("form"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(20251399).cast("double"))
        .otherwise(number(F.date_sub(day, 30)).cast("double"))
        .alias("period"),
        F.when(F.col("o_orderkey") % 89 != 0, number(day)).alias("filed"),
        F.concat(
            F.year(day).cast("string"), F.lit("q"), F.quarter(day).cast("string")
        ).alias("source_quarter"),
    )


SUBMISSIONS = """sub AS (
  SELECT o_orderkey AS adsh, o_custkey AS cik, 'Customer ' || o_custkey AS name,
    CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q'
      WHEN '3-MEDIUM' THEN '10-Q' WHEN '4-NOT SPECIFIED' THEN '10-K/A' ELSE '8-K' END AS form,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL
      ELSE CAST(o_orderdate AS DATE) - 30 END AS period,
    CASE WHEN o_orderkey % 89 <> 0 THEN CAST(o_orderdate AS DATE) END AS filed,
    year(o_orderdate) || 'q' || quarter(o_orderdate) AS source_quarter
  FROM orders),
elig AS (SELECT * FROM sub WHERE form IN ('10-K','10-Q','10-K/A','10-Q/A')
    AND period IS NOT NULL AND filed IS NOT NULL),
tgt AS (SELECT * FROM elig WHERE form IN ('10-K','10-Q'))"""


def _tags():
    from knowndate.operators.cohort import TAG_FEATURES

    return [*TAG_FEATURES, "Goodwill", "InventoryNet"]


def numeric_facts(spark, sf_dir) -> DataFrame:
    """Long facts of the submissions: mapped and unmapped tags, units, durations."""
    line = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    order = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    period = F.date_sub(F.to_date("o_orderdate"), 30)
    ddate = F.when(F.col("l_partkey") % 4 != 0, period).otherwise(F.to_date("l_shipdate"))
    names = F.array(*[F.lit(t) for t in _tags()])
    return line.join(order, line.l_orderkey == order.o_orderkey).select(
        F.col("l_orderkey").alias("adsh"),
        F.element_at(names, (F.col("l_suppkey") % len(_tags()) + 1).cast("int")).alias("tag"),
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("version"),
        F.date_format(ddate, "yyyyMMdd").alias("ddate"),
        (F.col("l_linenumber") % 5).alias("qtrs"),
        F.when(F.col("l_partkey") % 10 == 0, "EUR").otherwise("USD").alias("uom"),
        F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_partkey") % 7 == 0, "Parent")
        .when(F.col("l_partkey") % 7 == 1, "")
        .alias("coreg"),
    )


def numeric_facts_sql() -> str:
    from knowndate.operators.cohort import TAG_FEATURES

    tags = ", ".join(f"'{t}'" for t in _tags())
    pairs = ", ".join(f"('{t}', '{f}')" for t, f in TAG_FEATURES.items())
    return f"""num AS (
  SELECT l_orderkey AS adsh, list_extract([{tags}], CAST(l_suppkey % {len(_tags())} + 1 AS INTEGER)) AS tag,
    'v' || l_linenumber AS version,
    CASE WHEN l_partkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) - 30
      ELSE CAST(l_shipdate AS DATE) END AS ddate,
    l_linenumber % 5 AS qtrs,
    CASE WHEN l_partkey % 10 = 0 THEN 'EUR' ELSE 'USD' END AS uom, l_extendedprice AS value,
    CASE WHEN l_partkey % 7 = 0 THEN 'Parent' WHEN l_partkey % 7 = 1 THEN '' END AS coreg
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tagmap(tag, feature) AS (VALUES {pairs}),
facts AS (SELECT n.adsh, n.tag, n.version, n.ddate, n.qtrs, n.value, m.feature, s.cik, s.form,
    s.period, s.filed, s.source_quarter
  FROM num n JOIN tagmap m USING (tag) JOIN tgt s USING (adsh)
  WHERE uom = 'USD' AND COALESCE(coreg, '') = ''),
pfacts AS (SELECT * FROM facts WHERE ddate = period AND (
   (qtrs = 0 AND feature IN ('assets','liabilities','equity','current_assets','current_liabilities','cash'))
   OR (feature IN ('revenue','net_income','operating_income','operating_cash_flow')
       AND ((replace(form,'/A','') = '10-Q' AND qtrs IN (1,2,3))
         OR (replace(form,'/A','') = '10-K' AND qtrs = 4))))),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY adsh, feature
    ORDER BY qtrs, tag, value DESC, version) AS rn FROM pfacts) WHERE rn = 1)"""


PANEL_FEATURES = [
    "assets", "liabilities", "equity", "current_assets", "current_liabilities", "cash",
    "revenue", "net_income", "operating_income", "operating_cash_flow",
]


def panel_sql() -> str:
    cols = ", ".join(f"max(CASE WHEN feature = '{f}' THEN value END) AS {f}" for f in PANEL_FEATURES)
    return f"""{SUBMISSIONS}, {numeric_facts_sql()},
panel AS (SELECT adsh, cik, form, filed, period, source_quarter, {cols}
  FROM best GROUP BY adsh, cik, form, filed, period, source_quarter)"""


def wide_facts(spark, sf_dir) -> DataFrame:
    """A dense panel for ratio and sequence operators: sums per order as features."""
    f = filings(spark, sf_dir).drop("assets")
    line = table(spark, sf_dir, "lineitem")
    sums = line.groupBy(F.col("l_orderkey").alias("adsh")).agg(
        F.sum("l_extendedprice").alias("assets"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("liabilities"),
        F.sum("l_quantity").alias("revenue"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("net_income"),
    )
    return f.join(sums, "adsh", "left")


WIDE = f"""{FILINGS}, wide AS (SELECT f.cik, f.adsh, f.filed, f.form, s.assets, s.liabilities,
   s.revenue, s.net_income FROM filings f LEFT JOIN (
   SELECT l_orderkey AS adsh, sum(l_extendedprice) AS assets,
     sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS liabilities,
     sum(l_quantity) AS revenue,
     sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS net_income
   FROM lineitem GROUP BY l_orderkey) s USING (adsh))"""


# --- prices and macro ---------------------------------------------------------


def prices(spark, sf_dir) -> DataFrame:
    """One row per (security, day): mean price and total quantity of the day."""
    trades = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity"
    )
    return (
        spread(trades, "security_id", "date")
        .groupBy("security_id", "date")
        .agg(
            F.avg("l_extendedprice").alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
        .withColumns({"source": F.lit("lineitem"), "retrieved_at": F.lit("2002-01-01")})
    )


PRICES = """prices AS (SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS date,
   avg(l_extendedprice) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""


def macro_series(spark, sf_dir) -> DataFrame:
    """Mean order value per date and priority, named as five macro series."""
    named = F.create_map(*[F.lit(x) for kv in PRIORITY_SERIES.items() for x in kv])
    return (
        table(spark, sf_dir, "orders")
        .groupBy(named[F.col("o_orderpriority")].alias("series"), F.to_date("o_orderdate").alias("date"))
        .agg(F.avg("o_totalprice").alias("value"))
    )


PRIORITY_SERIES = {
    "1-URGENT": "treasury_3m",
    "2-HIGH": "treasury_10y",
    "3-MEDIUM": "cpi",
    "4-NOT SPECIFIED": "industrial_production",
    "5-LOW": "unemployment",
}

MACRO = (
    "spine AS (SELECT CAST(o_orderdate AS DATE) AS date, "
    + ", ".join(
        f"avg(o_totalprice) FILTER (WHERE o_orderpriority = '{p}') AS {s}"
        for p, s in PRIORITY_SERIES.items()
    )
    + " FROM orders GROUP BY 1), macro AS (SELECT date, "
    + ", ".join(f"last_value({s} IGNORE NULLS) OVER (ORDER BY date) AS {s}" for s in PRIORITY_SERIES.values())
    + " FROM spine)"
)


def macro(spark, sf_dir) -> DataFrame:
    from knowndate.operators.macro import macro_panel

    return macro_panel(macro_series(spark, sf_dir), list(PRIORITY_SERIES.values()))


# --- validity links -----------------------------------------------------------


def links(spark, sf_dir) -> DataFrame:
    """Dated issuer-to-security links; some reversed, undated or not accepted."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("p"), "o_orderdate", "o_orderkey"
    )
    return (
        spread(orders, "cik", "p")
        .groupBy("cik", "p")
        .agg(
            F.to_date(F.min("o_orderdate")).alias("lo"),
            F.to_date(F.max("o_orderdate")).alias("hi"),
            F.min("o_orderkey").alias("k"),
        )
        .select(
            "cik",
            F.concat(F.col("p"), F.lit("/"), F.col("cik").cast("string")).alias("security_id"),
            F.col("lo").alias("valid_from"),
            F.when(F.col("k") % 13 != 0, F.col("hi")).alias("valid_to"),
            F.when(F.col("k") % 5 < 2, "accepted_identifier")
            .when(F.col("k") % 5 == 2, "review_exact_name")
            .otherwise("rejected")
            .alias("decision"),
            F.concat(F.lit("iss"), F.col("cik").cast("string")).alias("issuer_id"),
            F.col("p").alias("security_name"),
            F.lit("orders").alias("source"),
            F.col("k").cast("string").alias("source_identifier"),
        )
    )


LINKS = """links AS (SELECT cik, p || '/' || cik AS security_id, lo AS valid_from,
   CASE WHEN k % 13 <> 0 THEN hi END AS valid_to,
   CASE WHEN k % 5 < 2 THEN 'accepted_identifier' WHEN k % 5 = 2 THEN 'review_exact_name'
     ELSE 'rejected' END AS decision, 'iss' || cik AS issuer_id, p AS security_name,
   CAST(k AS VARCHAR) AS source_identifier
  FROM (SELECT o_custkey AS cik, o_orderpriority AS p, CAST(min(o_orderdate) AS DATE) AS lo,
     CAST(max(o_orderdate) AS DATE) AS hi, min(o_orderkey) AS k FROM orders GROUP BY 1, 2))"""


# --- issuers, names, securities ------------------------------------------------


def tickers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return c.select(
        F.col("c_custkey").alias("cik"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker")
    )


TICKERS = """tickers AS (SELECT c_custkey AS cik, 'T' || c_custkey AS ticker FROM customer
   WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"""


def _words():
    return F.split("p_name", " ")[0], F.split("p_name", " ")[1]


def names(spark, sf_dir) -> DataFrame:
    """Historical issuer names: the product words in reverse, with brand and suffix."""
    first, second = _words()
    c = table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 9").select("c_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return c.join(p, c.c_custkey == p.p_partkey).select(
        F.col("c_custkey").alias("cik"),
        F.concat_ws(" ", second, first, "p_brand", F.lit("Inc.")).alias("historical_name"),
    )


NAMES = """names AS (SELECT c_custkey AS cik, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
   || ' ' || p_brand || ' Inc.' AS historical_name FROM customer JOIN part ON c_custkey = p_partkey
   WHERE c_custkey % 10 <> 9)"""


def filing_names(spark, sf_dir) -> DataFrame:
    """Names on filings: words in order, joined into one, or reversed; some issuers absent."""
    first, second = _words()
    o = table(spark, sf_dir, "orders").filter("o_custkey % 7 <> 6")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    turn = F.col("o_orderkey") % 3
    name = (
        F.when(turn == 0, F.concat_ws(" ", first, second, "p_brand", F.lit("Corp")))
        .when(turn == 1, F.concat(first, second, F.lit(" "), F.col("p_brand")))
        .otherwise(F.concat_ws(" ", second, first, "p_brand", F.lit("Inc.")))
    )
    form = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "10-K")
        .when(F.col("o_orderpriority") == "2-HIGH", "8-K")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "10-Q/A")
        .otherwise("S-1")
    )
    return o.join(p, o.o_custkey == p.p_partkey).select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
        F.col("o_orderkey").alias("adsh"),
        name.alias("name"),
        F.to_date("o_orderdate").alias("filed"),
        form.alias("form"),
    )


FILING_NAMES = """fnames AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, o_orderkey AS adsh,
   CASE o_orderkey % 3 WHEN 0 THEN p_name || ' ' || p_brand || ' Corp'
     WHEN 1 THEN replace(p_name, ' ', '') || ' ' || p_brand
     ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' ' || p_brand || ' Inc.' END AS name,
   CAST(o_orderdate AS DATE) AS filed,
   CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '8-K' WHEN '3-MEDIUM' THEN '10-Q/A'
     ELSE 'S-1' END AS form
   FROM orders JOIN part ON o_custkey = p_partkey WHERE o_custkey % 7 <> 6)"""


def cusip_of(number) -> "F.Column":
    """Nine characters with a right check digit from a number."""
    from knowndate.functions.identifiers import bind, cusip_check_digit

    body = F.lpad(number.cast("string"), 8, "0")
    return bind(body, lambda t: F.concat(t, cusip_check_digit(t).cast("string")))


def us_isin_of(cusip) -> "F.Column":
    from knowndate.functions.identifiers import bind, luhn_total

    def complete(body):
        digit = (10 - luhn_total(F.concat(body, F.lit("0"))) % 10) % 10
        return F.concat(body, digit.cast("int").cast("string"))

    return bind(F.concat(F.lit("US"), cusip), complete)


def cusip_of_sql(number: str) -> str:
    from knowndate.plans.sqltext import check_digit

    body = f"lpad(CAST({number} AS VARCHAR), 8, '0')"
    return f"({body} || CAST({check_digit(body)} AS VARCHAR))"


def us_isin_of_sql(cusip: str) -> str:
    from knowndate.plans.sqltext import luhn_total

    body = f"('US' || {cusip})"
    return f"({body} || CAST(CAST((10 - {luhn_total(body + chr(39).join(['||', '0', '']))} % 10) % 10 AS INTEGER) AS VARCHAR))"


def universe(spark, sf_dir) -> DataFrame:
    """Securities with names, ISINs (some missing) and a delisting flag (some unknown)."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    suffix = F.when(size % 3 == 0, " Co").when(size % 3 == 1, " Ltd").otherwise("")
    return p.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("security_id"),
        F.concat("p_name", F.lit(" "), "p_brand", suffix).alias("security_name"),
        F.when(size % 4 != 0, us_isin_of(cusip_of(F.col("p_partkey")))).alias("isin"),
        F.when(size % 5 != 0, size % 2 == 0).alias("is_delisted"),
        F.col("p_partkey").alias("ordinal"),
    )


UNIVERSE = f"""universe AS (SELECT 'P' || p_partkey AS security_id,
   p_name || ' ' || p_brand || CASE p_size % 3 WHEN 0 THEN ' Co' WHEN 1 THEN ' Ltd' ELSE '' END AS security_name,
   CASE WHEN p_size % 4 <> 0 THEN {us_isin_of_sql(cusip_of_sql('p_partkey'))} END AS isin,
   CASE WHEN p_size % 5 <> 0 THEN p_size % 2 = 0 END AS is_delisted, p_partkey AS ordinal FROM part)"""


def master(spark, sf_dir) -> DataFrame:
    from knowndate.operators.identity import identity_master

    return identity_master(cohort(spark, sf_dir), tickers(spark, sf_dir), names(spark, sf_dir))


def master_sql() -> str:
    return f"""{cohort_sql()}, {TICKERS}, {NAMES}, master AS (
  SELECT lpad(CAST(c.cik AS VARCHAR), 10, '0') AS cik, min(filed) AS first_filing, max(filed) AS last_filing,
    count(*) AS observations, CAST(COALESCE(sum(label), 0) AS BIGINT) AS distress_observations,
    c.cik IN (SELECT cik FROM tickers) AS has_current_ticker,
    c.cik IN (SELECT cik FROM names) AS has_historical_name
  FROM cohort c GROUP BY c.cik)"""


# --- documents with identifiers -----------------------------------------------


def documents(spark, sf_dir) -> DataFrame:
    """Whole document texts followed by a labelled identifier and a security phrase."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    good = cusip_of(F.lit(3780000) + k % 25)
    broken = F.concat(
        F.substring(good, 1, 8), ((F.substring(good, 9, 1).cast("int") + 1) % 10).cast("string")
    )
    phrase = F.element_at(
        F.array(*[F.lit(x) for x in PHRASES]), (k % len(PHRASES) + 1).cast("int")
    )
    kinds = F.element_at(F.array(*[F.lit(x) for x in DOC_TYPES]), (k % len(DOC_TYPES) + 1).cast("int"))
    isin = F.when(k % 4 == 1, F.concat(F.lit(" isin: "), us_isin_of(good))).otherwise("")
    text = F.concat(
        "text", F.lit(" "), phrase, F.lit(" Cusip No. "), F.when(k % 7 == 0, broken).otherwise(good), isin
    )
    return d.select(
        F.lpad((k % 50).cast("string"), 10, "0").alias("cik"),
        F.concat(F.lit("A"), F.floor(k / 3).cast("string")).alias("accession"),
        F.date_add(F.lit("2000-01-01").cast("date"), (k % 1000).cast("int"))
        .cast("string")
        .alias("filing_date"),
        kinds.alias("document_type"),
        F.concat(F.lit("doc/"), k.cast("string")).alias("source"),
        F.concat(F.lit("S"), F.floor(k / 2).cast("string")).alias("document_sha256"),
        F.when(k % 13 != 0, F.concat(F.lit("P"), (k % 50).cast("string"))).alias(
            "candidate_security_id"
        ),
        text.alias("text"),
    )


PHRASES = ["Common Stock par value", "Senior Notes due 2010", "Preferred Stock series", "Units", "Class A"]
DOC_TYPES = ["10-K", "8-k", "EX-2.1", "EX-21", "EX-4", "S-1"]


def documents_sql() -> str:
    good = cusip_of_sql("(3780000 + doc_id % 25)")
    phrases = ", ".join(f"'{p}'" for p in PHRASES)
    kinds = ", ".join(f"'{p}'" for p in DOC_TYPES)
    return f"""dc AS (SELECT doc_id, text AS body, {good} AS good FROM documents),
docs AS (SELECT lpad(CAST(doc_id % 50 AS VARCHAR), 10, '0') AS cik, 'A' || (doc_id // 3) AS accession,
   CAST(DATE '2000-01-01' + CAST(doc_id % 1000 AS INTEGER) AS VARCHAR) AS filing_date,
   list_extract([{kinds}], CAST(doc_id % {len(DOC_TYPES)} + 1 AS INTEGER)) AS document_type,
   'doc/' || doc_id AS source, 'S' || (doc_id // 2) AS document_sha256,
   CASE WHEN doc_id % 13 <> 0 THEN 'P' || (doc_id % 50) END AS candidate_security_id,
   body || ' ' || list_extract([{phrases}], CAST(doc_id % {len(PHRASES)} + 1 AS INTEGER)) || ' Cusip No. '
     || CASE WHEN doc_id % 7 = 0 THEN substr(good, 1, 8) || ((CAST(substr(good, 9, 1) AS INTEGER) + 1) % 10)
        ELSE good END
     || CASE WHEN doc_id % 4 = 1 THEN ' isin: ' || {us_isin_of_sql('good')} ELSE '' END AS text
   FROM dc)"""


def evidence_sql() -> str:
    """CTE ``evid``: one row per document and valid identifier with its context."""
    from knowndate.functions.identifiers import CUSIP_LABEL, ISIN_LABEL
    from knowndate.plans.sqltext import security_context, valid_cusip, valid_isin

    return f"""{documents_sql()},
found AS (
  SELECT d.*, 'CUSIP' AS identifier_type, unnest(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{CUSIP_LABEL}', 1), lambda x: upper(x))))) AS identifier FROM docs d
  UNION ALL
  SELECT d.*, 'ISIN', unnest(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{ISIN_LABEL}', 1), lambda x: upper(x))))) FROM docs d),
valid AS (SELECT * FROM found WHERE CASE identifier_type WHEN 'CUSIP' THEN {valid_cusip('identifier')}
   ELSE {valid_isin('identifier')} END),
placed AS (SELECT *, strpos(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), identifier) - 1 AS s FROM valid),
win AS (SELECT *, substr(text, greatest(s - 220, 0) + 1, s + length(identifier) + 220 - greatest(s - 220, 0)) AS ctx FROM placed),
evid AS (SELECT *, {security_context('lower(ctx)')} AS security_context FROM win),
evid2 AS (SELECT *, security_context = 'common_equity' AS common_equity_context FROM evid)"""
