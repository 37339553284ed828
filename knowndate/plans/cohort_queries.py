"""Queries for the cohort, label, context and sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowndate.operators import asof, cohort, labels, macro, market, sequences
from knowndate.operators.ordered import day_positions
from knowndate.plans import bindings as b
from knowndate.plans.registry import query

RATIO_SQL = {
    n: f"{a} / NULLIF({d}, 0)" for n, (a, d) in cohort.RATIOS.items()
}


def _day(name):
    return F.col(name).cast("string").alias(name)


def _r(name, digits=6):
    return F.round(F.col(name), digits).alias(name)


# --- labels --------------------------------------------------------------------


def _label_output(df):
    return df.select(
        "cik",
        "adsh",
        _day("filed"),
        F.col("distress_12m").cast("string").alias("distress_12m"),
        "label_mature",
        "label_window_complete",
        "days_to_distress",
        _day("next_distress_date"),
        _day("label_window_end"),
    )


def _label_select(horizon=365):
    return f"""SELECT cik, adsh, CAST(filed AS VARCHAR) AS filed, CAST(label AS VARCHAR) AS distress_12m,
   complete OR hit AS label_mature, complete AS label_window_complete,
   CAST(nxt - filed AS DOUBLE) AS days_to_distress, CAST(nxt AS VARCHAR) AS next_distress_date,
   CAST(filed + {horizon} AS VARCHAR) AS label_window_end FROM cohort"""


@query("j08_forward_label", f"WITH {b.cohort_sql()} {_label_select()}")
def forward_label(spark, sf_dir):
    return _label_output(b.cohort(spark, sf_dir))


@query(
    "j08_forward_label_embargo_no_cutoff",
    f"WITH {b.cohort_sql(200, 30, None)} {_label_select(200)}",
)
def forward_label_embargo(spark, sf_dir):
    return _label_output(
        b.cohort(spark, sf_dir, horizon_days=200, embargo_days=30, observed_through=None)
    )


@query(
    "p08_modelling_population",
    f"""WITH {b.cohort_sql()} SELECT cik, adsh, CAST(label AS BIGINT) AS distress_12m
    FROM cohort WHERE complete AND label IS NOT NULL""",
)
def modelling_population(spark, sf_dir):
    return labels.modelling_population(b.cohort(spark, sf_dir)).select("cik", "adsh", "distress_12m")


@query(
    "p09_temporal_split",
    f"""WITH {b.cohort_sql()} SELECT {b.SPLIT_SQL} AS split, count(*) AS n,
    CAST(sum(label) AS BIGINT) AS positives, CAST(min(filed) AS VARCHAR) AS first_filed,
    CAST(max(filed) AS VARCHAR) AS last_filed
    FROM cohort WHERE complete AND label IS NOT NULL GROUP BY 1""",
)
def temporal_split(spark, sf_dir):
    m = labels.modelling_population(b.cohort(spark, sf_dir))
    parts = labels.temporal_split(m, b.TRAIN_END, b.VALIDATION_END)
    return parts.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("distress_12m").alias("positives"),
        F.min("filed").cast("string").alias("first_filed"),
        F.max("filed").cast("string").alias("last_filed"),
    )


@query(
    "p10_label_window_end",
    f"""WITH {b.FILINGS} SELECT adsh, CAST(filed + 365 AS VARCHAR) AS label_window_end FROM filings""",
)
def label_window_end(spark, sf_dir):
    f = b.filings(spark, sf_dir)
    return f.select("adsh", F.date_add("filed", 365).cast("string").alias("label_window_end"))


_CENSOR = """count(*) AS rows_before,
   count(*) FILTER (WHERE complete) AS rows_window_complete,
   count(*) FILTER (WHERE NOT complete) AS rows_censored,
   count(*) FILTER (WHERE NOT complete AND label IS NOT NULL) AS censored_with_knowable_label,
   count(*) FILTER (WHERE NOT complete AND label = 1) AS censored_knowable_positives,
   count(*) FILTER (WHERE complete AND label IS NOT NULL) AS rows_after,
   count(*) FILTER (WHERE NOT (complete AND label IS NOT NULL)) AS rows_dropped,
   count(*) FILTER (WHERE complete AND label = 1) AS positives_after,
   round(avg(label) FILTER (WHERE complete), 8) AS prevalence_after,
   CAST(min(filed) FILTER (WHERE NOT complete) AS VARCHAR) AS censored_first_filed,
   CAST(max(filed) FILTER (WHERE NOT complete) AS VARCHAR) AS censored_last_filed"""


@query(
    "a03_censoring_inventory",
    f"""WITH {b.cohort_sql()}, s AS (SELECT *, {b.SPLIT_SQL} AS split FROM cohort)
    SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, {_CENSOR}
    FROM s GROUP BY ROLLUP (split)""",
)
def censoring(spark, sf_dir):
    parts = labels.temporal_split(b.cohort(spark, sf_dir), b.TRAIN_END, b.VALIDATION_END)
    out = labels.censoring_inventory(parts)
    return out.withColumns(
        {
            "prevalence_after": F.round("prevalence_after", 8),
            "censored_first_filed": F.col("censored_first_filed").cast("string"),
            "censored_last_filed": F.col("censored_last_filed").cast("string"),
        }
    )


@query(
    "p19_normalize_events",
    """WITH raw AS (SELECT CASE o_custkey % 4 WHEN 0 THEN '000' || o_custkey
        WHEN 1 THEN o_custkey || '.0' WHEN 2 THEN 'CIK' || o_custkey
        ELSE CAST(o_custkey AS VARCHAR) END AS cik_text, o_custkey,
        CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS event_date,
        CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS event_type FROM orders)
    SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS cik, CAST(event_date AS VARCHAR) AS event_date,
      event_type FROM raw WHERE event_date IS NOT NULL AND event_type IS NOT NULL""",
)
def normalize_events(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    key = F.col("o_custkey").cast("string")
    raw = o.select(
        F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("000"), key))
        .when(F.col("o_custkey") % 4 == 1, F.concat(key, F.lit(".0")))
        .when(F.col("o_custkey") % 4 == 2, F.concat(F.lit("CIK"), key))
        .otherwise(key)
        .alias("cik"),
        F.when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise("not a date")
        .alias("event_date"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderstatus")).alias("event_type"),
    )
    return labels.normalize_events(raw).select("cik", _day("event_date"), "event_type")


# --- cohort construction -----------------------------------------------------------


@query(
    "p01_eligible_submissions",
    f"""WITH {b.SUBMISSIONS} SELECT adsh, cik, form, CAST(filed AS VARCHAR) AS filed,
    CAST(period AS VARCHAR) AS period FROM elig""",
)
def eligible(spark, sf_dir):
    out = cohort.eligible_submissions(b.submissions(spark, sf_dir))
    return out.select("adsh", "cik", "form", _day("filed"), _day("period"))


@query(
    "p02_target_forms",
    f"""WITH {b.SUBMISSIONS} SELECT form, source_quarter, count(*) AS n FROM tgt GROUP BY 1, 2""",
)
def targets(spark, sf_dir):
    out = cohort.target_forms(cohort.eligible_submissions(b.submissions(spark, sf_dir)))
    return out.groupBy("form", "source_quarter").agg(F.count(F.lit(1)).alias("n"))


def _chosen(spark, sf_dir):
    return cohort.target_forms(cohort.eligible_submissions(b.submissions(spark, sf_dir)))


_NUM = f"{b.SUBMISSIONS}, {b.numeric_facts_sql()}"


@query(
    "p03_canonical_facts",
    f"""WITH {_NUM} SELECT adsh, cik, tag, feature, CAST(ddate AS VARCHAR) AS ddate,
    CAST(qtrs AS BIGINT) AS qtrs, round(value, 2) AS value FROM facts""",
)
def canonical(spark, sf_dir):
    facts = cohort.canonical_facts(b.numeric_facts(spark, sf_dir), _chosen(spark, sf_dir))
    return facts.select(
        "adsh", "cik", "tag", "feature", _day("ddate"), F.col("qtrs").cast("bigint"), _r("value", 2)
    )


@query(
    "j01_facts_join_submissions",
    f"""WITH {_NUM} SELECT form, feature, count(*) AS n, round(sum(value), 2) AS total
    FROM facts GROUP BY 1, 2""",
)
def facts_join(spark, sf_dir):
    facts = cohort.canonical_facts(b.numeric_facts(spark, sf_dir), _chosen(spark, sf_dir))
    return facts.groupBy("form", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "j02_facts_semi_join",
    f"""WITH {_NUM} SELECT tag, count(*) AS n FROM num WHERE adsh IN (SELECT adsh FROM tgt) GROUP BY 1""",
)
def facts_semi(spark, sf_dir):
    kept = cohort.facts_of(b.numeric_facts(spark, sf_dir), _chosen(spark, sf_dir))
    return kept.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p04_period_correct_facts",
    f"""WITH {_NUM} SELECT adsh, form, feature, tag, CAST(qtrs AS BIGINT) AS qtrs,
    round(value, 2) AS value FROM pfacts""",
)
def period_correct(spark, sf_dir):
    facts = cohort.canonical_facts(b.numeric_facts(spark, sf_dir), _chosen(spark, sf_dir))
    out = cohort.period_correct_facts(facts)
    return out.select(
        "adsh", "form", "feature", "tag", F.col("qtrs").cast("bigint"), _r("value", 2)
    )


@query(
    "w01_best_fact",
    f"""WITH {_NUM} SELECT adsh, feature, tag, CAST(qtrs AS BIGINT) AS qtrs,
    round(value, 2) AS value FROM best""",
)
def best_fact(spark, sf_dir):
    facts = cohort.canonical_facts(b.numeric_facts(spark, sf_dir), _chosen(spark, sf_dir))
    out = cohort.best_facts(cohort.period_correct_facts(facts))
    return out.select("adsh", "feature", "tag", F.col("qtrs").cast("bigint"), _r("value", 2))


_PANEL_OUT = ", ".join(f"round({f}, 2) AS {f}" for f in b.PANEL_FEATURES)


@query(
    "a01_submission_matrix",
    f"""WITH {b.panel_sql()} SELECT adsh, cik, form, CAST(filed AS VARCHAR) AS filed, {_PANEL_OUT}
    FROM panel""",
)
def matrix(spark, sf_dir):
    facts = cohort.canonical_facts(b.numeric_facts(spark, sf_dir), _chosen(spark, sf_dir))
    out = cohort.submission_matrix(cohort.period_correct_facts(facts))
    return out.select("adsh", "cik", "form", _day("filed"), *[_r(f, 2) for f in b.PANEL_FEATURES])


@query(
    "s03_cohort_fundamentals",
    f"""WITH {b.panel_sql()} SELECT adsh, cik, form, CAST(filed AS VARCHAR) AS filed, source_quarter,
    {", ".join(f"round({e}, 6) AS {n}" for n, e in RATIO_SQL.items())} FROM panel""",
)
def fundamentals(spark, sf_dir):
    out = cohort.fundamentals(b.submissions(spark, sf_dir), b.numeric_facts(spark, sf_dir))
    return out.select(
        "adsh", "cik", "form", _day("filed"), "source_quarter", *[_r(n) for n in cohort.RATIOS]
    )


@query(
    "p08_p09_cohort_from_raw_facts",
    f"""WITH {b.panel_sql()}, {b.EVENTS}, lab AS (SELECT p.*, (SELECT min(e.event_date) FROM ev e WHERE e.cik = p.cik AND e.event_date > p.filed) AS nxt FROM panel p)
    SELECT adsh, cik, form, CAST(filed AS VARCHAR) AS filed, source_quarter, {b.SPLIT_SQL} AS split, CAST(COALESCE(nxt <= filed + 365, FALSE) AS BIGINT) AS distress_12m,
    {", ".join(f"round({e}, 6) AS {n}" for n, e in RATIO_SQL.items())} FROM lab WHERE filed + 365 <= DATE '{b.CUTOFF}'""",
)
def cohort_from_raw(spark, sf_dir):
    raw = (b.submissions(spark, sf_dir), b.numeric_facts(spark, sf_dir), b.distress_events(spark, sf_dir))
    out = cohort.modelling_cohort(*raw, b.CUTOFF, b.TRAIN_END, b.VALIDATION_END)
    ratios = [_r(n) for n in cohort.RATIOS]
    return out.select("adsh", "cik", "form", _day("filed"), "source_quarter", "split", labels.LABEL, *ratios)


@query(
    "a07_quarter_funnel",
    f"""WITH {b.panel_sql()}, q AS (SELECT DISTINCT source_quarter FROM sub)
    SELECT q.source_quarter,
     (SELECT count(*) FROM sub s WHERE s.source_quarter = q.source_quarter) AS raw_submissions,
     (SELECT count(*) FROM sub s WHERE s.source_quarter = q.source_quarter AND filed IS NULL) AS filed_nulls,
     (SELECT count(*) FROM elig s WHERE s.source_quarter = q.source_quarter) AS eligible_submissions,
     (SELECT count(*) FROM tgt s WHERE s.source_quarter = q.source_quarter) AS target_submissions,
     (SELECT count(*) FROM num n JOIN tgt s USING (adsh) WHERE s.source_quarter = q.source_quarter) AS numeric_rows,
     (SELECT count(*) FROM facts f WHERE f.source_quarter = q.source_quarter) AS canonical_facts,
     (SELECT count(*) FROM panel p WHERE p.source_quarter = q.source_quarter) AS panel_rows,
     (SELECT CAST(min(filed) AS VARCHAR) FROM panel p WHERE p.source_quarter = q.source_quarter) AS panel_filed_min,
     (SELECT CAST(max(filed) AS VARCHAR) FROM panel p WHERE p.source_quarter = q.source_quarter) AS panel_filed_max
    FROM q""",
)
def funnel(spark, sf_dir):
    out = cohort.quarter_funnel(b.submissions(spark, sf_dir), b.numeric_facts(spark, sf_dir))
    return out.drop("form_min", "form_max").withColumns(
        {c: F.col(c).cast("string") for c in ("panel_filed_min", "panel_filed_max")}
    )


@query(
    "w02_last_row_per_filing",
    f"""WITH {b.SUBMISSIONS}, twice AS (SELECT adsh, cik, filed, source_quarter FROM elig
      UNION ALL SELECT adsh, cik, filed + 1, source_quarter || 'b' FROM elig WHERE adsh % 3 = 0)
    SELECT adsh, cik, CAST(filed AS VARCHAR) AS filed, source_quarter FROM (
      SELECT *, row_number() OVER (PARTITION BY adsh ORDER BY cik DESC, filed DESC, source_quarter DESC) AS rn
      FROM twice) WHERE rn = 1""",
)
def last_row(spark, sf_dir):
    one = cohort.eligible_submissions(b.submissions(spark, sf_dir)).select(
        "adsh", "cik", "filed", "source_quarter"
    )
    again = one.filter("adsh % 3 = 0").withColumns(
        {
            "filed": F.date_add("filed", 1),
            "source_quarter": F.concat("source_quarter", F.lit("b")),
        }
    )
    out = cohort.last_per_filing(macro.widen([one, again]))
    return out.select("adsh", "cik", _day("filed"), "source_quarter")


@query(
    "u01_union_of_panels",
    """SELECT form, sum(n)::BIGINT AS n, sum(with_assets)::BIGINT AS with_assets FROM (
      SELECT o_orderpriority AS form, count(*) AS n, count(*) AS with_assets FROM orders
        WHERE o_orderstatus = 'F' GROUP BY 1
      UNION ALL SELECT o_orderpriority, count(*), 0 FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
    GROUP BY 1""",
)
def union_panels(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").withColumn("form", F.col("o_orderpriority"))
    full = o.filter("o_orderstatus = 'F'").select("form", F.col("o_totalprice").alias("assets"))
    bare = o.filter("o_orderstatus <> 'F'").select("form")
    return macro.widen([full, bare]).groupBy("form").agg(
        F.count(F.lit(1)).alias("n"), F.count("assets").alias("with_assets")
    )


@query(
    "p05_knowledge_cutoff",
    f"""WITH {b.FILINGS} SELECT cik, adsh, CAST(filed AS VARCHAR) AS filed FROM filings
    WHERE filed <= DATE '1998-06-30'""",
)
def knowledge_cutoff(spark, sf_dir):
    out = cohort.knowledge_cutoff(b.filings(spark, sf_dir), "1998-06-30")
    return out.select("cik", "adsh", _day("filed"))


@query(
    "p06_financial_ratios",
    f"""WITH {b.WIDE} SELECT adsh, round(liabilities / NULLIF(assets, 0), 8) AS liabilities_to_assets,
    round(net_income / NULLIF(assets, 0), 8) AS roa, round(net_income / NULLIF(revenue, 0), 8) AS net_margin,
    CAST(NULL AS DOUBLE) AS current_ratio FROM wide""",
)
def ratios(spark, sf_dir):
    out = cohort.add_ratios(b.wide_facts(spark, sf_dir))
    return out.select(
        "adsh", _r("liabilities_to_assets", 8), _r("roa", 8), _r("net_margin", 8), "current_ratio"
    )


@query(
    "p07_record_ratios",
    f"""WITH {b.WIDE} SELECT adsh, round(liabilities / NULLIF(assets, 0), 8) AS debt_to_assets_proxy,
    CAST(NULL AS DOUBLE) AS debt_to_equity_proxy, CAST(NULL AS DOUBLE) AS operating_cf_margin,
    round(net_income / NULLIF(revenue, 0), 8) AS net_margin FROM wide""",
)
def record_ratios(spark, sf_dir):
    out = cohort.add_record_ratios(b.wide_facts(spark, sf_dir))
    return out.select(
        "adsh",
        _r("debt_to_assets_proxy", 8),
        "debt_to_equity_proxy",
        "operating_cf_margin",
        _r("net_margin", 8),
    )


@query(
    "a02_cohort_inventory",
    f"""WITH {b.cohort_sql()} SELECT count(*) AS rows, count(DISTINCT cik) AS companies,
    CAST(min(filed) AS VARCHAR) AS start, CAST(max(filed) AS VARCHAR) AS "end",
    count(*) FILTER (WHERE complete AND label IS NOT NULL) AS modelling_rows,
    count(*) FILTER (WHERE complete AND label = 1) AS positive_observations,
    round(avg(label) FILTER (WHERE complete), 8) AS prevalence,
    round(avg(CASE WHEN assets > 100000 THEN 1.0 ELSE 0.0 END), 8) AS coverage_roa,
    (SELECT count(*) FROM ev) AS distress_events FROM cohort""",
)
def inventory(spark, sf_dir):
    c = b.cohort(spark, sf_dir).withColumn("roa", F.when(F.col("assets") > 100000, F.col("assets")))
    ev = labels.normalize_events(b.distress_events(spark, sf_dir))
    out = cohort.cohort_inventory(c, ev)
    return out.withColumns(
        {"prevalence": F.round("prevalence", 8), "coverage_roa": F.round("coverage_roa", 8)}
    )


# --- market and macro context -----------------------------------------------------------


_W = "OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def _roll(agg, col, n, least):
    w = _W.format(n=n - 1)
    return f"CASE WHEN count({col}) {w} >= {least} THEN {agg}({col}) {w} END"


def _ret(n):
    return (
        f"close / NULLIF(lag(close, {n}) OVER (PARTITION BY security_id ORDER BY date), 0) - 1"
    )


def _market_sql(columns):
    return f"""{b.PRICES}, daily AS (SELECT *, {_ret(1)} AS daily FROM prices),
losses AS (SELECT *, CASE WHEN daily < 0 THEN daily END AS loss FROM daily),
feat AS (SELECT security_id, date, {", ".join(f"{e} AS {n}" for n, e in columns.items())} FROM losses)"""


def _z(n, least):
    return (
        f"(volume - {_roll('avg', 'volume', n, least)}) / NULLIF({_roll('stddev_samp', 'volume', n, least)}, 0)"
    )


ISSUER_SQL = {
    "ret_21d": _ret(21),
    "ret_63d": _ret(63),
    "ret_252d": _ret(252),
    "vol_63d": f"({_roll('stddev_samp', 'daily', 63, 20)}) * sqrt(252)",
    "drawdown_252d": f"close / ({_roll('max', 'close', 252, 20)}) - 1",
    "distance_52w_high": f"close / ({_roll('max', 'close', 252, 20)}) - 1",
    "volume_z_63d": _z(63, 20),
}
SECURITY_SQL = {
    **{f"ret_{n}d": _ret(n) for n in (5, 21, 63, 126, 252)},
    "vol_21d": f"({_roll('stddev_samp', 'daily', 21, 10)}) * sqrt(252)",
    "vol_63d": f"({_roll('stddev_samp', 'daily', 63, 21)}) * sqrt(252)",
    "drawdown_63d": f"close / ({_roll('max', 'close', 63, 20)}) - 1",
    "drawdown_252d": f"close / ({_roll('max', 'close', 252, 20)}) - 1",
    "distance_52w_high": f"close / ({_roll('max', 'close', 252, 20)}) - 1",
    "volume_z_21d": _z(21, 10),
    "volume_z_63d": _z(63, 21),
    "downside_vol_63d": f"({_roll('stddev_samp', 'loss', 63, 20)}) * sqrt(252)",
    "max_loss_63d": _roll("min", "daily", 63, 20),
}


def _rounded(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


@query(
    "w03_issuer_market_features",
    f"""WITH {_market_sql(ISSUER_SQL)} SELECT security_id AS cik, CAST(date AS VARCHAR) AS date,
    {_rounded(ISSUER_SQL)} FROM feat""",
)
def issuer_features(spark, sf_dir):
    p = b.prices(spark, sf_dir).withColumnRenamed("security_id", "cik")
    out = market.issuer_market_features(p)
    return out.select("cik", _day("date"), *[_r(c) for c in ISSUER_SQL])


@query(
    "w04_security_market_features",
    f"""WITH {_market_sql(SECURITY_SQL)} SELECT security_id, CAST(date AS VARCHAR) AS date,
    {_rounded(SECURITY_SQL)} FROM feat""",
)
def security_features(spark, sf_dir):
    out = market.security_market_features(b.prices(spark, sf_dir))
    return out.select("security_id", _day("date"), *[_r(c) for c in SECURITY_SQL])


def _securities(spark, sf_dir):
    """Filings with a security id; every 50th has none."""
    n = b.table(spark, sf_dir, "supplier").agg(F.max("s_suppkey") + 1).first()[0]
    return b.filings(spark, sf_dir).withColumn(
        "security_id", F.when(F.col("adsh") % 50 != 0, F.col("cik") % n)
    )


_SEC_FILINGS = """secf AS (SELECT *, CASE WHEN adsh % 50 <> 0
   THEN cik % (SELECT max(s_suppkey) + 1 FROM supplier) END AS security_id FROM filings)"""


@query(
    "j09_market_asof_issuer",
    f"""WITH {b.FILINGS}, {_SEC_FILINGS}, {_market_sql(ISSUER_SQL)}
    SELECT f.adsh, f.security_id AS cik, CAST(p.date AS VARCHAR) AS date, {_rounded(ISSUER_SQL)}
    FROM secf f ASOF LEFT JOIN feat p ON f.security_id = p.security_id AND f.filed >= p.date""",
)
def market_asof_issuer(spark, sf_dir):
    f = _securities(spark, sf_dir).drop("cik").withColumnRenamed("security_id", "cik")
    p = b.prices(spark, sf_dir).withColumnRenamed("security_id", "cik")
    out = market.attach_issuer_market(f, market.issuer_market_features(p))
    return out.select("adsh", "cik", _day("date"), *[_r(c) for c in ISSUER_SQL])


@query(
    "j11_market_asof_security",
    f"""WITH {b.FILINGS}, {_SEC_FILINGS}, {_market_sql(SECURITY_SQL)}
    SELECT f.adsh, f.security_id, CAST(p.date AS VARCHAR) AS date, {_rounded(SECURITY_SQL)}
    FROM secf f ASOF LEFT JOIN feat p ON f.security_id = p.security_id AND f.filed >= p.date""",
)
def market_asof_security(spark, sf_dir):
    features = market.security_market_features(b.prices(spark, sf_dir))
    out = market.attach_security_market(_securities(spark, sf_dir), features)
    return out.select("adsh", "security_id", _day("date"), *[_r(c) for c in SECURITY_SQL])


_MACRO_F = f"""{b.MACRO}, mfeat AS (SELECT *, treasury_10y - treasury_3m AS yield_curve_10y_3m,
   cpi / NULLIF(lag(cpi, 12) OVER (ORDER BY date), 0) - 1 AS cpi_yoy,
   industrial_production / NULLIF(lag(industrial_production, 12) OVER (ORDER BY date), 0) - 1
     AS industrial_production_yoy FROM macro)"""
_MACRO_COLS = [c for c in macro.MACRO_FEATURES if c != "credit_spread"]


@query(
    "s12_macro_panel",
    f"WITH {b.MACRO} SELECT CAST(date AS VARCHAR) AS date, {_rounded(b.PRIORITY_SERIES.values())} FROM macro",
)
def macro_panel(spark, sf_dir):
    return b.macro(spark, sf_dir).select(_day("date"), *[_r(c) for c in b.PRIORITY_SERIES.values()])


@query(
    "u02_union_of_dates",
    """SELECT DISTINCT CAST(CAST(d AS DATE) AS VARCHAR) AS date FROM (
      SELECT o_orderdate AS d FROM orders UNION ALL SELECT l_shipdate FROM lineitem)""",
)
def union_dates(spark, sf_dir):
    a = b.filings(spark, sf_dir).select(F.col("filed").alias("date"))
    p = b.prices(spark, sf_dir).select("date")
    return a.union(p).distinct().select(_day("date"))


@query(
    "j05_macro_series_on_spine",
    f"""WITH {b.MACRO} SELECT CAST(date AS VARCHAR) AS date, {_rounded(b.PRIORITY_SERIES.values())}
    FROM spine""",
)
def macro_spine(spark, sf_dir):
    series = b.macro_series(spark, sf_dir)
    names = list(b.PRIORITY_SERIES.values())
    wide = series.groupBy("date").pivot("series", names).agg(F.max("value"))
    return wide.select(_day("date"), *[_r(c) for c in names])


@query(
    "w05_macro_transforms",
    f"WITH {_MACRO_F} SELECT CAST(date AS VARCHAR) AS date, {_rounded(_MACRO_COLS)} FROM mfeat",
)
def macro_transforms(spark, sf_dir):
    out = macro.macro_features(b.macro(spark, sf_dir))
    return out.select(_day("date"), *[_r(c) for c in _MACRO_COLS])


@query(
    "w06_forward_fill",
    """WITH daily AS (SELECT CAST(ts AS DATE) AS date, event_type AS series, avg(value) AS value
        FROM events GROUP BY 1, 2), names AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events),
      g AS (SELECT n.date, max(CASE WHEN series = 'error' THEN value END) AS error,
        max(CASE WHEN series = 'purchase' THEN value END) AS purchase
        FROM names n LEFT JOIN daily d ON n.date = d.date GROUP BY 1)
    SELECT CAST(date AS VARCHAR) AS date, round(last_value(error IGNORE NULLS) OVER (ORDER BY date), 6) AS error,
      round(last_value(purchase IGNORE NULLS) OVER (ORDER BY date), 6) AS purchase FROM g""",
)
def forward_fill(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    daily = e.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("date")).agg(
        F.avg("value").alias("value")
    )
    out = macro.macro_panel(daily, ["error", "purchase"])
    return out.select(_day("date"), _r("error"), _r("purchase"))


@query(
    "j10_macro_asof",
    f"""WITH {b.FILINGS}, {_MACRO_F} SELECT f.adsh, CAST(m.date AS VARCHAR) AS date_macro,
    {_rounded(_MACRO_COLS)} FROM filings f ASOF LEFT JOIN mfeat m ON f.filed - 3 >= m.date""",
)
def macro_asof(spark, sf_dir):
    """Filings look three days back, so that not every date matches exactly."""
    f = b.filings(spark, sf_dir).withColumn("filed", F.date_sub("filed", 3))
    out = macro.attach_macro(f, macro.macro_features(b.macro(spark, sf_dir)))
    return out.select("adsh", _day("date_macro"), *[_r(c) for c in _MACRO_COLS])


@query(
    "j09_j10_point_in_time_context",
    f"""WITH {b.FILINGS}, {_SEC_FILINGS}, {_market_sql(ISSUER_SQL)}, {_MACRO_F}
    SELECT f.adsh, CAST(p.date AS VARCHAR) AS date, round(p.ret_21d, 6) AS ret_21d,
      CAST(m.date AS VARCHAR) AS date_macro, round(m.cpi_yoy, 6) AS cpi_yoy
    FROM secf f ASOF LEFT JOIN feat p ON f.security_id = p.security_id AND f.filed >= p.date
    ASOF LEFT JOIN mfeat m ON f.filed >= m.date""",
)
def context(spark, sf_dir):
    f = _securities(spark, sf_dir).drop("cik").withColumnRenamed("security_id", "cik")
    p = b.prices(spark, sf_dir).withColumnRenamed("security_id", "cik")
    out = macro.point_in_time_context(f, p, b.macro(spark, sf_dir))
    return out.select("adsh", _day("date"), _r("ret_21d"), _day("date_macro"), _r("cpi_yoy"))


@query(
    "a06_macro_profile",
    f"""WITH {b.MACRO}, long AS (UNPIVOT (SELECT * FROM macro) ON
       {", ".join(b.PRIORITY_SERIES.values())} INTO NAME feature VALUE value),
     n AS (SELECT count(*) AS rows FROM macro)
    SELECT feature, (SELECT rows FROM n) AS rows, count(value) AS non_null,
      round(count(value) / (SELECT rows FROM n), 8) AS coverage,
      CAST(min(date) AS VARCHAR) AS first_available, CAST(max(date) AS VARCHAR) AS last_available,
      round(min(value), 6) AS min, round(max(value), 6) AS max, CAST(0 AS BIGINT) AS duplicate_dates,
      TRUE AS passed FROM long GROUP BY feature""",
)
def macro_profile(spark, sf_dir):
    out = macro.macro_profile(b.macro(spark, sf_dir))
    return out.withColumns(
        {"coverage": F.round("coverage", 8), "min": F.round("min", 6), "max": F.round("max", 6)}
    )


@query(
    "j12_security_interval_join",
    f"""WITH {b.FILINGS}, {b.LINKS}, m AS (SELECT f.adsh, count(l.security_id) AS n,
       min(l.security_id) AS sid FROM filings f LEFT JOIN links l ON f.cik = l.cik
       AND l.decision = 'accepted_identifier' AND l.valid_from <= f.filed AND l.valid_to >= f.filed
       GROUP BY f.adsh)
    SELECT adsh, CASE WHEN n = 1 THEN sid END AS security_id, CASE WHEN n = 1 THEN 'accepted'
      WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS security_resolution FROM m""",
)
def interval_join(spark, sf_dir):
    out = asof.attach_security(b.filings(spark, sf_dir), b.links(spark, sf_dir))
    return out.select("adsh", "security_id", "security_resolution")


@query(
    "w10_security_master_audit",
    f"""WITH {b.LINKS}, s AS (SELECT *, max(valid_to) OVER (PARTITION BY issuer_id ORDER BY valid_from,
        source_identifier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
        FROM links)
    SELECT count(*) AS rows, count(DISTINCT issuer_id) AS securities,
      count(DISTINCT security_name) AS issuers, CAST(0 AS BIGINT) AS reversed_intervals,
      CAST(0 AS BIGINT) AS duplicate_evidence,
      count(*) FILTER (WHERE valid_from <= reach) AS overlapping_intervals, TRUE AS passed FROM s""",
)
def master_audit(spark, sf_dir):
    """The issuer plays the security here, so that intervals of one key overlap."""
    m = b.links(spark, sf_dir)
    m = m.withColumns({"security_id": F.col("issuer_id"), "issuer_id": F.col("security_name")})
    return market.security_master_audit(m)


@query(
    "w09_price_gaps",
    f"""WITH {b.PRICES}, g AS (SELECT security_id, date - lag(date) OVER (PARTITION BY security_id
        ORDER BY date) AS gap FROM prices)
    SELECT security_id, count(*) AS rows, CAST(COALESCE(max(gap), 0) AS BIGINT) AS max_calendar_gap_days,
      count(*) FILTER (WHERE gap > 14) AS gaps_over_threshold FROM g GROUP BY 1""",
)
def gaps(spark, sf_dir):
    out = market.price_gaps(b.prices(spark, sf_dir))
    return out.withColumn("max_calendar_gap_days", F.col("max_calendar_gap_days").cast("bigint"))


@query(
    "p11_market_missingness",
    f"""WITH {_market_sql(ISSUER_SQL)} SELECT security_id, CAST(date AS VARCHAR) AS date,
    ret_63d IS NOT NULL OR ret_252d IS NOT NULL OR vol_63d IS NOT NULL AS market_data_available,
    CAST(ret_63d IS NULL AS BIGINT) AS ret_63d__missing, CAST(ret_252d IS NULL AS BIGINT) AS ret_252d__missing,
    CAST(vol_63d IS NULL AS BIGINT) AS vol_63d__missing FROM feat""",
)
def missingness(spark, sf_dir):
    p = market.issuer_market_features(b.prices(spark, sf_dir), "security_id")
    names = ["ret_63d", "ret_252d", "vol_63d", "not_there"]
    out = market.market_missingness(p, names)
    return out.select(
        "security_id",
        _day("date"),
        "market_data_available",
        *[F.col(f"{c}__missing").cast("bigint").alias(f"{c}__missing") for c in names[:3]],
    )


_DELIST = """d AS (SELECT s_suppkey AS security_id, DATE '2001-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS delist_date,
   CASE WHEN s_suppkey % 3 <> 0 THEN -s_acctbal / 10000 END AS delist_return, s_name AS source_identifier
   FROM supplier)"""


@query(
    "f22_delisting_observations",
    f"""WITH {_DELIST} SELECT security_id, CAST(delist_date AS VARCHAR) AS date,
    round(delist_return, 8) AS delist_return, TRUE AS is_delisting_observation, 'supplier' AS source,
    source_identifier FROM d WHERE delist_return IS NOT NULL""",
)
def delistings(spark, sf_dir):
    out = market.delisting_observations(delisting_table(spark, sf_dir))
    return out.withColumns(
        {"date": F.col("date").cast("string"), "delist_return": F.round("delist_return", 8)}
    )


def delisting_table(spark, sf_dir):
    s = b.table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("security_id"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("s_suppkey") % 300).cast("int")).alias(
            "delist_date"
        ),
        F.lit("500").alias("delist_code"),
        F.when(F.col("s_suppkey") % 3 != 0, -F.col("s_acctbal") / 10000).alias("delist_return"),
        F.lit("supplier").alias("source"),
        F.col("s_name").alias("source_identifier"),
    )


# --- sequences -----------------------------------------------------------------------------


_LAG = "lag({c}, {k}) OVER (PARTITION BY cik ORDER BY filed, adsh)"


def _chg(c, k):
    return f"round({c} / NULLIF({_LAG.format(c=c, k=k)}, 0) - 1, 6)"


@query(
    "w07_change_features",
    f"""WITH {b.WIDE} SELECT adsh, {_chg('assets', 1)} AS assets__qoq, {_chg('assets', 4)} AS assets__yoy,
    {_chg('revenue', 1)} AS revenue__qoq, {_chg('revenue', 4)} AS revenue__yoy FROM wide""",
)
def changes(spark, sf_dir):
    out = sequences.add_changes(b.wide_facts(spark, sf_dir), ["assets", "revenue"])
    return out.select(
        "adsh", _r("assets__qoq"), _r("assets__yoy"), _r("revenue__qoq"), _r("revenue__yoy")
    )


_SEQ_W = "OVER (PARTITION BY cik ORDER BY filed, adsh ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"


@query(
    "w08_trailing_sequences",
    f"""WITH {b.WIDE}, s AS (SELECT adsh, count(*) {_SEQ_W} AS length,
       list([COALESCE(assets, 0), COALESCE(revenue, 0)]) {_SEQ_W} AS past FROM wide)
    SELECT adsh, length, CAST(8 - length AS BIGINT) AS padded_steps,
      round(list_sum(list_transform(past, lambda x: x[1])), 2) AS assets_sum,
      round(past[length][1], 2) AS last_assets, round(past[1][2], 2) AS first_revenue
    FROM s WHERE length >= 2""",
)
def trailing(spark, sf_dir):
    wide = b.wide_facts(spark, sf_dir).fillna(0.0, ["assets", "revenue"])
    out = sequences.build_sequences(wide, ["assets", "revenue"])
    seq = F.col("sequence")
    total = F.aggregate(seq, F.lit(0.0), lambda a, v: a + v[0])
    return out.select(
        "adsh",
        F.col("length").cast("bigint").alias("length"),
        F.size(F.filter(F.slice(seq, 1, F.lit(8) - F.col("length")), lambda v: v[0] == 0))
        .cast("bigint")
        .alias("padded_steps"),
        F.round(total, 2).alias("assets_sum"),
        F.round(F.element_at(F.element_at(seq, -1), 1), 2).alias("last_assets"),
        F.round(F.element_at(F.element_at(seq, F.lit(9) - F.col("length")), 2), 2).alias(
            "first_revenue"
        ),
    )


@query(
    "k06_filing_order",
    f"""WITH {b.FILINGS} SELECT adsh, cik, row_number() OVER (PARTITION BY cik ORDER BY filed, adsh) - 1 AS pos,
    count(*) OVER (PARTITION BY cik) AS n FROM filings""",
)
def filing_order(spark, sf_dir):
    out = day_positions(b.filings(spark, sf_dir), ["cik"], "filed", "adsh")
    return out.select("adsh", "cik", "pos", F.col("pos__n").alias("n"))


@query(
    "p17_validation_era_only",
    f"""WITH {b.WIDE} SELECT adsh, {_chg('assets', 1)} AS assets__qoq FROM wide
    WHERE filed <= DATE '{b.VALIDATION_END}'""",
)
def validation_era(spark, sf_dir):
    """The cutoff is applied before any feature work and reaches the scan."""
    early = cohort.knowledge_cutoff(b.wide_facts(spark, sf_dir), b.VALIDATION_END)
    return sequences.add_changes(early, ["assets"]).select("adsh", _r("assets__qoq"))
