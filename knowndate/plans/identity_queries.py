"""Queries for keys, names, identifiers, identity, matching and evidence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowndate.functions import identifiers as ids
from knowndate.functions import keys, names
from knowndate.operators import evidence, identity, labels, matching
from knowndate.plans import bindings as b
from knowndate.plans import sqltext as q
from knowndate.plans.registry import query
from knowndate.sources import lists


def _day(name):
    return F.col(name).cast("string").alias(name)


def _r(name, digits=8):
    return F.round(name, digits).alias(name)


# --- keys ----------------------------------------------------------------------------


@query(
    "f14_cik_keys",
    """WITH k AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS s FROM customer)
    SELECT c_custkey, s AS label_key,
      CASE c_custkey % 5 WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE lpad(s, 10, '0') END AS filing_key,
      CASE c_custkey % 5 WHEN 0 THEN lpad(s, 10, '0') WHEN 1 THEN lpad(s, 10, '0')
        WHEN 2 THEN lpad('CIK' || s, 10, '0') WHEN 3 THEN lpad('00' || s, CAST(greatest(10, length(s) + 2) AS INT), '0')
        ELSE lpad(' ' || s || '.5', CAST(greatest(10, length(s) + 3) AS INT), '0') END AS coverage_key,
      CASE WHEN c_custkey % 5 IN (0, 3) AND c_custkey > 0 THEN lpad(s, 10, '0') ELSE 'unavailable' END AS observation_key
    FROM k""",
)
def cik_keys(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    turn = F.col("c_custkey") % 5
    raw = (
        F.when(turn == 0, k)
        .when(turn == 1, F.concat(k, F.lit(".0")))
        .when(turn == 2, F.concat(F.lit("CIK"), k))
        .when(turn == 3, F.concat(F.lit("00"), k))
        .otherwise(F.concat(F.lit(" "), k, F.lit(".5")))
    )
    c = b.table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    r = F.col("raw")
    return c.select(
        "c_custkey",
        keys.cik_label_key(r).alias("label_key"),
        keys.cik_filing_key(r).alias("filing_key"),
        keys.cik_coverage_key(r).alias("coverage_key"),
        keys.cik_observation_key(r).alias("observation_key"),
    )


_IDS = """ids AS (SELECT CASE WHEN cik % 20 = 0 THEN 'unavailable' ELSE lpad(CAST(cik AS VARCHAR), 10, '0') END AS cik,
   CASE WHEN adsh % 9 = 0 THEN 'unavailable' ELSE CAST(adsh AS VARCHAR) END AS adsh,
   CAST(filed AS VARCHAR) AS filed, nxt FROM cohort),
 ids2 AS (SELECT cik, adsh, filed, CASE WHEN cik = 'unavailable' THEN cik WHEN adsh <> 'unavailable' THEN cik || ':' || adsh
     ELSE cik || ':' || filed END AS observation_id,
   CASE WHEN cik <> 'unavailable' AND nxt IS NOT NULL THEN cik || ':' || CAST(nxt AS VARCHAR) ELSE 'unavailable' END AS event_id
   FROM ids)"""


def _observation_ids(spark, sf_dir):
    c = b.cohort(spark, sf_dir).select("cik", "adsh", "filed", "next_distress_date")
    c = c.withColumns(
        {
            "cik": F.when(F.col("cik") % 20 != 0, F.col("cik").cast("string")),
            "adsh": F.when(F.col("adsh") % 9 != 0, F.col("adsh").cast("string")).otherwise(" "),
        }
    )
    return keys.with_observation_ids(c).drop("next_distress_date")


@query("f15_observation_ids", f"WITH {b.cohort_sql()}, {_IDS} SELECT * FROM ids2")
def observation_ids(spark, sf_dir):
    return _observation_ids(spark, sf_dir)


_COVER = """count(*) AS rows, count(DISTINCT cik) FILTER (WHERE cik <> 'unavailable') AS unique_ciks,
  count(*) FILTER (WHERE cik = 'unavailable') AS ciks_unavailable, CAST(0 AS BIGINT) AS ciks_invalid,
  count(*) FILTER (WHERE cik <> 'unavailable') AS rows_with_valid_cik,
  count(DISTINCT observation_id) FILTER (WHERE cik <> 'unavailable') AS unique_observation_ids,
  count(*) FILTER (WHERE event_id <> 'unavailable') AS rows_with_linked_event,
  count(DISTINCT event_id) FILTER (WHERE event_id <> 'unavailable') AS unique_linked_events"""


@query("a24_identifier_coverage", f"WITH {b.cohort_sql()}, {_IDS} SELECT {_COVER} FROM ids2")
def id_coverage(spark, sf_dir):
    return evidence.identifier_coverage(_observation_ids(spark, sf_dir))


@query(
    "g12_bootstrap_readiness",
    f"""WITH {b.cohort_sql()}, {_IDS}, c AS (SELECT {_COVER} FROM ids2)
    SELECT rows, CASE WHEN ciks_unavailable > 0 THEN 'test_ciks_unavailable' ELSE '' END AS blockers,
      ciks_unavailable = 0 AS supports_cluster_bootstrap FROM c""",
)
def readiness(spark, sf_dir):
    out = evidence.bootstrap_readiness(
        evidence.identifier_coverage(_observation_ids(spark, sf_dir))
    )
    return out.select("rows", F.array_join("blockers", ",").alias("blockers"), "supports_cluster_bootstrap")


@query(
    "f16_observation_quarters",
    f"""WITH {b.FILINGS}, l AS (SELECT cik, max(filed) AS d FROM filings GROUP BY 1),
     i AS (SELECT cik, year(d) * 4 + quarter(d) - 1 - back AS i FROM l, (VALUES (0), (4), (8), (12)) t(back))
    SELECT cik, CAST(i AS BIGINT) AS quarter_index, (i // 4) || 'Q' || (i % 4 + 1) AS vintage FROM i""",
)
def quarters(spark, sf_dir):
    last = b.filings(spark, sf_dir).groupBy("cik").agg(F.max("filed").alias("d"))
    i = last.select("cik", F.explode(keys.observation_quarters(F.col("d"))).alias("i"))
    return i.select(
        "cik", F.col("i").cast("bigint").alias("quarter_index"), keys.quarter_label(F.col("i")).alias("vintage")
    )


# --- names --------------------------------------------------------------------------------


@query(
    "f01_entity_name_keys",
    f"""WITH {b.NAMES} SELECT cik, historical_name, {q.name_key('historical_name')} AS name_key FROM names
    UNION ALL SELECT c_custkey, c_name || ', LLC', {q.name_key("c_name || ', LLC'")} FROM customer""",
)
def name_keys(spark, sf_dir):
    n = b.names(spark, sf_dir)
    c = b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cik"), F.concat("c_name", F.lit(", LLC")).alias("historical_name")
    )
    return n.unionByName(c).withColumn("name_key", names.entity_name_key(F.col("historical_name")))


@query("f01_entity_name_keys_unicode")
def name_keys_unicode(spark, sf_dir):
    t = b.table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", names.entity_name_key(F.col("text")).alias("name_key"))


_PAIRS = f"""{b.NAMES}, pairs AS (SELECT cik, {q.name_key('historical_name')} AS a,
   {q.name_key("p_name || ' ' || p_brand || ' ' || p_type")} AS n, historical_name,
   p_name || ' ' || p_brand || ' ' || p_type AS security_name, p_size
   FROM names JOIN part ON p_partkey = cik)"""
_JAC = """len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(n, ' ')))) /
   len(list_distinct(list_concat(string_split(a, ' '), string_split(n, ' '))))"""


def _name_pairs(spark, sf_dir):
    n = b.names(spark, sf_dir)
    p = b.table(spark, sf_dir, "part").withColumn(
        "security_name", F.concat_ws(" ", "p_name", "p_brand", "p_type")
    )
    return n.join(p, n.cik == p.p_partkey).select(
        "cik", F.col("historical_name").alias("sec_name"), "security_name", "p_size"
    )


@query("f02_token_jaccard", f"WITH {_PAIRS} SELECT cik, round({_JAC}, 8) AS jaccard FROM pairs")
def jaccard(spark, sf_dir):
    keyed = _name_pairs(spark, sf_dir).withColumns(
        {
            "a": names.entity_name_key(F.col("sec_name")),
            "n": names.entity_name_key(F.col("security_name")),
        }
    )
    return keyed.select("cik", F.round(names.token_jaccard(F.col("a"), F.col("n")), 8).alias("jaccard"))


@query(
    "f03_name_similarity",
    f"""WITH RECURSIVE {_PAIRS}, keys AS (SELECT DISTINCT a, n FROM pairs WHERE a <> '' AND n <> ''), {q.name_scores("keys")}
    SELECT cik, p.a, p.n, round(coalesce(score, 0), 8) AS score FROM pairs p LEFT JOIN scores USING (a, n)""",
)
def similarity(spark, sf_dir):
    keyed = _name_pairs(spark, sf_dir).withColumns(
        {
            "a": names.entity_name_key(F.col("sec_name")),
            "n": names.entity_name_key(F.col("security_name")),
        }
    )
    score = F.greatest(
        names.token_jaccard(F.col("a"), F.col("n")), names.sequence_ratio(F.col("a"), F.col("n"))
    )
    return keyed.select("cik", "a", "n", F.round(score, 8).alias("score"))


@query(
    "f04_list_name_keys",
    f"""SELECT p_partkey, {q.list_key("p_name || ' International Holdings ' || p_brand || ' Limited'")} AS list_key FROM part""",
)
def list_keys(spark, sf_dir):
    text = F.concat("p_name", F.lit(" International Holdings "), "p_brand", F.lit(" Limited"))
    key = names.list_name_key(names.entity_name_key(text))
    return b.table(spark, sf_dir, "part").select("p_partkey", key.alias("list_key"))


@query(
    "j13_evaluate_candidates",
    f"""WITH {_PAIRS}, s AS (SELECT *, CASE WHEN a = n THEN 1.0 ELSE {_JAC} END AS score,
       DATE '2000-01-01' + p_size AS vf, DATE '2000-01-01' + 2 * p_size AS vt, p_size % 3 = 0 AS ie FROM pairs),
     o AS (SELECT *, greatest(DATE '2000-01-21', vf) <= least(DATE '2000-02-10', vt) AS ov FROM s)
    SELECT cik, round(score, 8) AS name_score, ov AS date_overlap,
      CASE WHEN ie AND ov THEN 'accepted_identifier' WHEN score >= 0.98 AND ov THEN 'review_exact_name'
        WHEN score >= 0.85 AND ov THEN 'review_candidate' ELSE 'rejected' END AS decision FROM o""",
)
def evaluate(spark, sf_dir):
    start = F.lit("2000-01-01").cast("date")
    pairs = _name_pairs(spark, sf_dir).withColumns(
        {
            "issuer_start": F.lit("2000-01-21").cast("date"),
            "issuer_end": F.lit("2000-02-10").cast("date"),
            "valid_from": F.date_add(start, F.col("p_size")),
            "valid_to": F.date_add(start, 2 * F.col("p_size")),
            "identifier_evidence": F.col("p_size") % 3 == 0,
        }
    )
    out = identity.evaluate_candidates(pairs)
    return out.select("cik", _r("name_score"), "date_overlap", "decision")


@query(
    "f13_candidate_decision",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'accepted_identifier'
      WHEN 1 - l_discount / 2 >= 0.98 AND l_linestatus = 'O' THEN 'review_exact_name'
      WHEN 1 - l_discount / 2 >= 0.85 AND l_linestatus = 'O' THEN 'review_candidate' ELSE 'rejected' END AS decision
    FROM lineitem""",
)
def decision(spark, sf_dir):
    line = b.table(spark, sf_dir, "lineitem")
    out = identity.candidate_decision(
        1 - F.col("l_discount") / 2, F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    )
    return line.select("l_orderkey", "l_linenumber", out.alias("decision"))


# --- identity master ---------------------------------------------------------------------


@query(
    "j04_identity_master",
    f"""WITH {b.master_sql()} SELECT cik, CAST(first_filing AS VARCHAR) AS first_filing,
    CAST(last_filing AS VARCHAR) AS last_filing, observations, distress_observations, has_current_ticker,
    has_historical_name, CASE WHEN has_current_ticker THEN 'current_ticker'
      WHEN has_historical_name THEN 'historical_name_only' ELSE 'unresolved' END AS identity_status FROM master""",
)
def master(spark, sf_dir):
    return b.master(spark, sf_dir).select(
        "cik", _day("first_filing"), _day("last_filing"), "observations", "distress_observations",
        "has_current_ticker", "has_historical_name", "identity_status",
    )


@query(
    "u03_distinct_issuer_values",
    f"""WITH {b.FILING_NAMES} SELECT DISTINCT cik, name FROM fnames""",
)
def distinct_values(spark, sf_dir):
    return identity.issuer_values(b.filing_names(spark, sf_dir), "name")


@query(
    "a05_identity_audit",
    f"""WITH {b.master_sql()}, h AS (SELECT *, distress_observations > 0 AS d,
        distress_observations > 0 AND NOT has_current_ticker AS hard FROM master)
    SELECT count(*) AS cohort_companies, round(avg(has_historical_name::INT), 8) AS historical_name_coverage,
      round(avg(has_current_ticker::INT), 8) AS current_ticker_coverage, count(*) FILTER (WHERE d) AS distressed_companies,
      count(*) FILTER (WHERE hard) AS distressed_without_current_ticker,
      count(*) FILTER (WHERE hard AND has_historical_name) AS distressed_without_current_ticker_with_historical_names,
      round(count(*) FILTER (WHERE hard AND has_historical_name) / count(*) FILTER (WHERE hard), 8) AS distressed_name_recovery_rate,
      count(*) FILTER (WHERE NOT has_current_ticker AND NOT has_historical_name) AS unresolved_companies FROM h""",
)
def audit(spark, sf_dir):
    out = identity.identity_audit(b.master(spark, sf_dir))
    rates = ["historical_name_coverage", "current_ticker_coverage", "distressed_name_recovery_rate"]
    return out.withColumns({c: F.round(c, 8) for c in rates})


_FLAG = f"""WITH {b.cohort_sql()}, {b.TICKERS}, f AS (SELECT c.*, cik IN (SELECT cik FROM tickers) AS known,
   year(filed) AS y, {b.SPLIT_SQL} AS split FROM cohort c)"""


def _flagged(spark, sf_dir):
    parts = labels.temporal_split(b.cohort(spark, sf_dir), b.TRAIN_END, b.VALIDATION_END)
    return identity.flag_current_ticker(parts, b.tickers(spark, sf_dir))


@query(
    "j18_ticker_membership",
    f"{_FLAG} SELECT adsh, known AS has_current_ticker FROM f",
)
def membership(spark, sf_dir):
    return _flagged(spark, sf_dir).select("adsh", "has_current_ticker")


@query(
    "a04_ticker_coverage",
    f"""{_FLAG} SELECT CASE WHEN grouping(y) = 0 THEN 'year' WHEN grouping(split) = 0 THEN 'split' ELSE 'overall' END AS level,
      COALESCE(CAST(y AS VARCHAR), split, 'all') AS group_name, count(*) AS rows, count(DISTINCT cik) AS companies,
      count(*) FILTER (WHERE known) AS mapped_rows, round(avg(known::INT), 8) AS row_coverage,
      count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 1 AND known) AS mapped_positives
    FROM f GROUP BY GROUPING SETS ((), (y), (split))""",
)
def coverage(spark, sf_dir):
    return identity.ticker_coverage(_flagged(spark, sf_dir)).withColumn(
        "row_coverage", F.round("row_coverage", 8)
    )


@query(
    "a04_positive_coverage",
    f"""{_FLAG} SELECT round(avg(known::INT), 8) AS positive_row_coverage,
      count(DISTINCT cik) FILTER (WHERE NOT known) AS unmapped_positive_companies FROM f WHERE label = 1""",
)
def positive(spark, sf_dir):
    return identity.positive_coverage(_flagged(spark, sf_dir)).withColumn(
        "positive_row_coverage", F.round("positive_row_coverage", 8)
    )


_HARD = f"""{b.master_sql()}, hard AS (SELECT * FROM master WHERE distress_observations > 0 AND NOT has_current_ticker)"""


@query(
    "p12_hard_cases",
    f"""WITH {_HARD} SELECT cik, CAST(first_filing AS VARCHAR) AS first_filing, distress_observations FROM hard
    ORDER BY hard.first_filing, distress_observations DESC, cik LIMIT 100""",
)
def hard(spark, sf_dir):
    out = identity.hard_cases(b.master(spark, sf_dir), 100)
    return out.select("cik", _day("first_filing"), "distress_observations")


_ERA = ", ".join(
    f"min(year({s}_filing)) AS {s}_filing_year_min, max(year({s}_filing)) AS {s}_filing_year_max, "
    f"count(*) FILTER (WHERE year({s}_filing) < 1996) AS {s}_filing_before_1996, "
    f"count(*) FILTER (WHERE year({s}_filing) BETWEEN 1996 AND 2019) AS {s}_filing_1996_2019, "
    f"count(*) FILTER (WHERE year({s}_filing) >= 2020) AS {s}_filing_2020_plus"
    for s in ("first", "last")
)


@query("a21_era_profile", f"WITH {_HARD} SELECT count(*) AS hard_cases, {_ERA} FROM hard")
def era(spark, sf_dir):
    return identity.era_profile(identity.hard_cases(b.master(spark, sf_dir)))


@query(
    "a21_era_decades",
    f"WITH {_HARD} SELECT year(first_filing) // 10 * 10 AS decade, count(*) AS issuers FROM hard GROUP BY 1",
)
def decades(spark, sf_dir):
    return identity.era_decades(identity.hard_cases(b.master(spark, sf_dir)))


@query(
    "k03_probe_sample",
    f"""WITH {b.master_sql()} (SELECT cik, 'distressed_no_current_ticker' AS probe_group FROM master
      WHERE distress_observations > 0 AND NOT has_current_ticker
      ORDER BY distress_observations DESC, observations DESC, cik LIMIT 50)
    UNION ALL (SELECT cik, 'nondistressed' FROM master WHERE distress_observations = 0
      ORDER BY observations DESC, cik LIMIT 50)""",
)
def sample(spark, sf_dir):
    return identity.probe_sample(b.master(spark, sf_dir)).select("cik", "probe_group")


@query(
    "k04_evenly_spaced_cases",
    f"""WITH {b.master_sql()}, h AS (SELECT cik, last_filing, row_number() OVER (ORDER BY last_filing, cik) - 1 AS pos,
        count(*) OVER () AS n FROM master WHERE distress_observations > 0 AND NOT has_current_ticker)
    SELECT cik, CAST(last_filing AS VARCHAR) AS last_filing FROM h
    WHERE pos IN (SELECT CAST(round_even(i * (n - 1) / 4, 0) AS BIGINT) FROM range(5) t(i))""",
)
def spaced(spark, sf_dir):
    cases = identity.hard_cases(b.master(spark, sf_dir), None)
    return lists.evenly_spaced_cases(cases).select("cik", _day("last_filing"))


_PROBE = f"""{b.master_sql()}, {b.LINKS}, {b.PRICES}, sample AS (
   (SELECT cik, 'distressed_no_current_ticker' AS g FROM master WHERE distress_observations > 0 AND NOT has_current_ticker
      ORDER BY distress_observations DESC, observations DESC, cik LIMIT 50)
   UNION ALL (SELECT cik, 'nondistressed' FROM master WHERE distress_observations = 0 ORDER BY observations DESC, cik LIMIT 50)),
 acc AS (SELECT DISTINCT lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, CAST(cik % 1000 AS VARCHAR) AS sid FROM links WHERE decision = 'accepted_identifier'),
 res AS (SELECT DISTINCT cik FROM acc), pri AS (SELECT DISTINCT cik FROM acc WHERE sid IN (SELECT CAST(security_id AS VARCHAR) FROM prices)),
 by_g AS (SELECT g AS probe_group, count(*) AS companies, count(*) FILTER (WHERE cik IN (FROM res)) AS resolved,
   count(*) FILTER (WHERE cik IN (FROM pri)) AS priced FROM sample GROUP BY 1
   UNION ALL SELECT 'all', (SELECT count(*) FROM sample), (SELECT count(*) FROM res), (SELECT count(*) FROM pri)),
 probe AS (SELECT *, resolved / companies AS resolved_rate, priced / companies AS priced_rate FROM by_g)"""


def _probe(spark, sf_dir):
    links = b.links(spark, sf_dir).select(
        F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"),
        (F.col("cik") % 1000).alias("security_id"),
        "decision",
    )
    return identity.probe_summary(
        identity.probe_sample(b.master(spark, sf_dir)), links, b.prices(spark, sf_dir)
    )


@query(
    "a15_provider_probe",
    f"""WITH {_PROBE} SELECT probe_group, companies, resolved, priced, round(resolved_rate, 8) AS resolved_rate,
    round(priced_rate, 8) AS priced_rate FROM probe""",
)
def probe(spark, sf_dir):
    return _probe(spark, sf_dir).withColumns(
        {"resolved_rate": F.round("resolved_rate", 8), "priced_rate": F.round("priced_rate", 8)}
    )


@query(
    "u05_resolved_in_group",
    f"""WITH {_PROBE} SELECT DISTINCT cik FROM sample WHERE g = 'nondistressed' INTERSECT SELECT cik FROM res""",
)
def resolved_in_group(spark, sf_dir):
    group = identity.probe_sample(b.master(spark, sf_dir)).filter("probe_group = 'nondistressed'")
    accepted = b.links(spark, sf_dir).filter("decision = 'accepted_identifier'")
    resolved = accepted.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))
    return group.select("cik").join(resolved.distinct(), "cik", "left_semi")


@query(
    "g07_provider_probe_gate",
    f"""WITH {_PROBE}, r AS (SELECT max(resolved_rate) FILTER (WHERE probe_group = 'distressed_no_current_ticker') AS hr,
       max(priced_rate) FILTER (WHERE probe_group = 'distressed_no_current_ticker') AS hp,
       max(priced_rate) FILTER (WHERE probe_group = 'all') AS o FROM probe)
    SELECT round(hr, 8) AS hard_resolution_rate, round(hp, 8) AS hard_priced_rate, round(o, 8) AS overall_priced_rate,
      hr >= 0.8 AND hp >= 0.7 AND o >= 0.8 AS passed,
      CAST((hr < 0.8)::INT + (hp < 0.7)::INT + (o < 0.8)::INT AS INTEGER) AS reasons FROM r""",
)
def probe_gate(spark, sf_dir):
    from knowndate.operators.checks import provider_probe_gate

    out = provider_probe_gate(_probe(spark, sf_dir))
    rates = ["hard_resolution_rate", "hard_priced_rate", "overall_priced_rate"]
    return out.withColumns({c: F.round(c, 8) for c in rates}).withColumn("reasons", F.size("reasons"))


@query(
    "a10_alias_map",
    f"WITH {b.FILING_NAMES} SELECT DISTINCT cik, name FROM fnames WHERE {q.name_key('name')} <> ''",
)
def alias_map(spark, sf_dir):
    return identity.alias_map(b.filing_names(spark, sf_dir))


@query(
    "u04_enriched_aliases",
    f"""WITH {_HARD}, {b.FILING_NAMES}, a AS (SELECT lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, historical_name AS alias FROM names
      UNION SELECT cik, name FROM fnames)
    SELECT cik, alias FROM a WHERE cik IN (SELECT cik FROM hard)""",
)
def enriched(spark, sf_dir):
    cases = identity.hard_cases(b.master(spark, sf_dir))
    return identity.case_aliases(cases, b.names(spark, sf_dir), b.filing_names(spark, sf_dir))


_FRESH = f"""{b.master_sql()}, {b.FILING_NAMES},
 fk AS (SELECT DISTINCT cik, {q.name_key('name')} AS k FROM fnames),
 hk AS (SELECT DISTINCT lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, {q.name_key('historical_name')} AS k FROM names),
 det AS (SELECT m.cik, last_filing >= DATE '2009-01-01' AS el, m.cik IN (SELECT cik FROM fnames) AS ob,
   (SELECT count(*) FROM fk WHERE fk.cik = m.cik) AS n,
   (SELECT count(*) FROM fk WHERE fk.cik = m.cik AND k <> '' AND k NOT IN (SELECT k FROM hk WHERE hk.cik = m.cik)) AS fresh
   FROM master m WHERE distress_observations > 0 AND NOT has_current_ticker)"""


def _incremental(spark, sf_dir):
    cases = identity.hard_cases(b.master(spark, sf_dir), None)
    return identity.incremental_names(cases, b.names(spark, sf_dir), b.filing_names(spark, sf_dir))


@query(
    "j20_incremental_names",
    f"""WITH {_FRESH} SELECT cik, el AS fsds_eligible, ob AS fsds_observed, n AS fsds_name_count,
    fresh AS incremental_name_count, CASE WHEN NOT el THEN 'out_of_scope' WHEN ob THEN 'observed' ELSE 'eligible_missing' END AS status FROM det""",
)
def incremental(spark, sf_dir):
    return _incremental(spark, sf_dir).drop("first_filing", "last_filing")


@query(
    "j20_incremental_report",
    f"""WITH {_FRESH} SELECT count(*) AS hard_cases, count(*) FILTER (WHERE el) AS eligible,
    count(*) FILTER (WHERE NOT el) AS out_of_scope, count(*) FILTER (WHERE el AND ob) AS eligible_observed,
    count(*) FILTER (WHERE el AND NOT ob) AS eligible_missing, count(*) FILTER (WHERE el AND fresh > 0) AS with_incremental_names FROM det""",
)
def incremental_report(spark, sf_dir):
    out = identity.incremental_report(_incremental(spark, sf_dir))
    return out.drop("eligible_coverage", "incremental_name_rate")


# --- matching -------------------------------------------------------------------------------


def _match(limit: int, least: float, filing_names: bool = True) -> str:
    """CTEs up to ``found``: the best ``limit`` securities per hard case at ``least`` or more."""
    extra = f"UNION SELECT cik, name, FALSE FROM fnames WHERE {q.name_key('name')} <> ''" if filing_names else ""
    return f"""{_HARD}, {b.FILING_NAMES}, {b.UNIVERSE},
  said AS (SELECT cik, alias, bool_or(old) AS old FROM (
    SELECT lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, historical_name AS alias, TRUE AS old FROM names {extra}) GROUP BY ALL),
  keyed AS (SELECT cik, alias, old, {q.name_key('alias')} AS a FROM said SEMI JOIN hard USING (cik)),
  unames AS (SELECT *, {q.name_key('security_name')} AS n FROM universe),
  keys AS (SELECT a, n FROM (SELECT DISTINCT a FROM keyed WHERE a <> ''), (SELECT DISTINCT n FROM unames WHERE n <> '')
    WHERE greatest(2.0 * least(len(a), len(n)) / (len(a) + len(n)),
      len(list_intersect(string_split(a, ' '), string_split(n, ' '))) / 1.0) >= {least}),
  {q.name_scores("keys")},
  best AS (SELECT cik, n, max(score) AS score, arg_min(alias, struct_pack(s := -score, alias := alias)) AS sec_alias
    FROM keyed JOIN scores USING (a) WHERE score >= {least} GROUP BY cik, n),
  candidates AS (SELECT cik, sec_alias, security_id, security_name, n AS name_key, score, isin, is_delisted, ordinal,
      count(*) FILTER (WHERE score = top) OVER (PARTITION BY cik) AS top_ties,
      row_number() OVER (PARTITION BY cik ORDER BY score DESC, is_delisted DESC NULLS LAST, ordinal) AS rank
    FROM (SELECT *, max(score) OVER (PARTITION BY cik) AS top FROM best) JOIN unames USING (n)),
  found AS (SELECT * FROM candidates WHERE rank <= {limit})"""


_STRENGTH = f"""{_match(5, 0.45)},
  rolled AS (SELECT cik, count(*) AS n, max(score) FILTER (WHERE rank = 1) AS top_score,
      max(score) FILTER (WHERE rank = 2) AS second_score, any_value(top_ties) AS top_ties FROM found GROUP BY cik),
  shown AS (SELECT f.cik, string_agg(f.security_id, ',' ORDER BY f.rank) AS ids, string_agg(f.security_name, ',' ORDER BY f.rank) AS names,
      string_agg(COALESCE(f.isin, ''), ',' ORDER BY f.rank) AS isins, string_agg(f.name_key, ',' ORDER BY f.rank) AS name_keys
    FROM found f JOIN rolled r ON r.cik = f.cik AND r.top_score = f.score GROUP BY f.cik),
  classes AS (SELECT c.cik, count(DISTINCT c.security_id) AS n_ids, count(DISTINCT c.name_key) AS n_names,
      count(NULLIF(c.isin, '')) AS filled, count(DISTINCT NULLIF(c.isin, '')) AS n_isins
    FROM candidates c JOIN rolled r ON r.cik = c.cik AND r.top_score = c.score GROUP BY c.cik),
  tied AS (SELECT * FROM shown JOIN classes USING (cik)),
  strength AS (SELECT h.cik, COALESCE(n, 0) AS candidate_count, t.security_id AS top_security_id, t.security_name AS top_security_name,
      top_score, second_score, COALESCE(top_score - second_score, top_score) AS margin,
      COALESCE(abs(top_score - second_score) < 1e-12, FALSE) AS top_score_tied,
      COALESCE(top_score - second_score < {identity.NEAR_TIE}, FALSE) AS top_score_near_tied,
      COALESCE(r.top_ties, 0) AS top_tied_candidate_count, ids AS top_tied_security_ids, names AS top_tied_security_names,
      isins AS top_tied_isins, name_keys AS top_tied_name_keys, t.is_delisted, t.isin, t.isin IS NOT NULL AS isin_present,
      COALESCE(top_score >= {identity.HIGH_SCORE} AND COALESCE(top_score - second_score, top_score) >= {identity.HIGH_MARGIN}, FALSE) AS high_margin,
      tied.* EXCLUDE (cik, ids, names, isins, name_keys)
    FROM hard h LEFT JOIN rolled r USING (cik) LEFT JOIN found t ON t.cik = h.cik AND t.rank = 1 LEFT JOIN tied ON tied.cik = h.cik)"""

_DETAIL = f"""{_match(5, 0.45, False)}, detail AS (SELECT h.cik, rank, security_id, score,
  CASE WHEN rank = 1 THEN score - COALESCE(lead(score) OVER (PARTITION BY h.cik ORDER BY rank), 0) END AS margin
  FROM hard h LEFT JOIN found USING (cik))"""


def _first_discovered(n: int) -> str:
    return f"""{_match(10, 0.72, False)}, discovered AS (SELECT f.*, first_filing, last_filing FROM found f JOIN (
      SELECT cik, first_filing, last_filing FROM hard SEMI JOIN found USING (cik)
      ORDER BY first_filing, distress_observations DESC, cik LIMIT {n}) USING (cik))"""


_FOUND = """cik, sec_alias, security_id, security_name, name_key, round(score, 8) AS discovery_score, isin, is_delisted, rank,
  CAST(top_ties AS BIGINT) AS top_ties, TRUE AS discovery_only"""


def _strength(spark, sf_dir):
    return identity.candidate_strength(
        identity.hard_cases(b.master(spark, sf_dir)),
        b.names(spark, sf_dir),
        b.filing_names(spark, sf_dir),
        b.universe(spark, sf_dir),
    )


@query("j14_discover_candidates", f"WITH RECURSIVE {_match(10, 0.72)} SELECT {_FOUND} FROM found")
def discover(spark, sf_dir):
    cases = identity.hard_cases(b.master(spark, sf_dir))
    aliases = identity.case_aliases(cases, b.names(spark, sf_dir), b.filing_names(spark, sf_dir))
    return matching.discover(aliases, b.universe(spark, sf_dir)).withColumn(
        "discovery_score", F.round("discovery_score", 8)
    )


@query(
    "j15_name_coverage",
    f"""WITH RECURSIVE {_match(1, 0.001)},
      entries AS (SELECT upper(security_name) AS issuer_name, arg_min(struct_pack(c := substr(isin, 3, 9)), ordinal).c AS cusip, min(ordinal) AS ordinal,
        any_value(n) AS n FROM unames GROUP BY 1),
      heads AS (SELECT n, arg_min(struct_pack(o := ordinal, name := issuer_name, cusip := cusip), ordinal) AS e FROM entries GROUP BY n),
      hit AS (SELECT cik, arg_max(e, struct_pack(s := score, o := -e.o)) AS e, max(score) AS score, bool_or(a = n) AS exact
        FROM keyed JOIN scores USING (a) JOIN heads USING (n) WHERE score >= 0.001 GROUP BY cik),
      told AS (SELECT cik, count(*) AS c FROM keyed GROUP BY cik)
    SELECT h.cik, COALESCE(c, 0) AS alias_count, COALESCE(score, 0) AS best_score, e.name AS best_official_name, e.cusip AS best_cusip,
      COALESCE(exact, FALSE) AS exact_normalized_name_hit, COALESCE(score, 0) >= 0.9 AS candidate_hit
    FROM hard h LEFT JOIN told USING (cik) LEFT JOIN hit USING (cik)""",
)
def name_coverage(spark, sf_dir):
    cases = identity.hard_cases(b.master(spark, sf_dir))
    aliases = identity.case_aliases(cases, b.names(spark, sf_dir), b.filing_names(spark, sf_dir))
    official = b.universe(spark, sf_dir).select(
        F.upper("security_name").alias("issuer_name"), F.substring("isin", 3, 9).alias("cusip"), "ordinal"
    )
    return matching.name_coverage(cases, aliases, official)


_SHOWN = """cik, candidate_count, top_security_id, top_security_name, round(top_score, 8) AS top_score, round(second_score, 8) AS second_score,
  round(margin, 8) AS margin, top_score_tied, top_score_near_tied, CAST(top_tied_candidate_count AS BIGINT) AS top_tied_candidate_count,
  top_tied_security_ids, top_tied_security_names, top_tied_isins, top_tied_name_keys, is_delisted, isin, isin_present, high_margin"""


@query("a11_candidate_strength", f"WITH RECURSIVE {_STRENGTH} SELECT {_SHOWN} FROM strength")
def strength(spark, sf_dir):
    out = _strength(spark, sf_dir).drop(*matching.TIE_KEYS)
    return out.withColumns(
        {
            c: F.array_join(c, ",")
            for c in ("top_tied_security_ids", "top_tied_security_names", "top_tied_isins", "top_tied_name_keys")
        }
    ).withColumns({c: F.round(c, 8) for c in ("top_score", "second_score", "margin")})


@query(
    "a11_strength_report",
    f"""WITH RECURSIVE {_STRENGTH} SELECT count(*) AS issuers, count(*) FILTER (WHERE candidate_count > 0) AS with_candidate,
      count(*) FILTER (WHERE top_score >= {identity.HIGH_SCORE}) AS top_score_ge_090, count(*) FILTER (WHERE high_margin) AS high_margin_candidates,
      count(*) FILTER (WHERE top_score_tied) AS top_score_ties, count(*) FILTER (WHERE top_score_near_tied) AS top_score_near_ties_lt_002,
      count(*) FILTER (WHERE is_delisted) AS delisted_top_candidates, count(*) FILTER (WHERE isin_present) AS top_candidates_with_isin,
      round(median(top_score), 8) AS top_score_median, round(median(margin), 8) AS margin_median FROM strength""",
)
def strength_report(spark, sf_dir):
    out = identity.strength_report(_strength(spark, sf_dir))
    return out.withColumns({c: F.round(c, 8) for c in ("top_score_median", "margin_median")})


@query(
    "a12_discovery_comparison",
    f"""WITH RECURSIVE {_match(5, 0.45)},
      told AS (SELECT cik, count(*) FILTER (WHERE old) AS b, count(*) AS c FROM keyed GROUP BY cik),
      pairs AS (SELECT cik, n, max(score) FILTER (WHERE old) AS b, max(score) AS c FROM keyed JOIN scores USING (a)
        WHERE score >= 0.45 GROUP BY cik, n),
      sides AS (SELECT cik, least(5, count(b)) AS b_n, max(b) AS b_top, least(5, count(*)) AS c_n, max(c) AS c_top
        FROM pairs JOIN unames USING (n) GROUP BY cik)
    SELECT h.cik, COALESCE(b, 0) AS before_aliases, COALESCE(b_n, 0) AS before_candidates, round(b_top, 8) AS before_top_score,
      COALESCE(c, 0) AS after_aliases, COALESCE(c_n, 0) AS after_candidates, round(c_top, 8) AS after_top_score,
      COALESCE(b_n, 0) = 0 AND COALESCE(c_n, 0) > 0 AS new_candidate, COALESCE(c_n, 0) > COALESCE(b_n, 0) AS candidate_count_increased,
      c_top IS NOT NULL AND (b_top IS NULL OR c_top > b_top) AS top_score_improved
    FROM hard h LEFT JOIN told USING (cik) LEFT JOIN sides USING (cik)""",
)
def comparison(spark, sf_dir):
    out = identity.compare_discovery(
        identity.hard_cases(b.master(spark, sf_dir)),
        b.names(spark, sf_dir),
        b.filing_names(spark, sf_dir),
        b.universe(spark, sf_dir),
    )
    return out.withColumns({c: F.round(c, 8) for c in ("before_top_score", "after_top_score")})


_BANDS = ", ".join(
    f"count(*) FILTER (WHERE rank = 1 AND score >= {lo} AND score < {hi}) AS band_{int(lo * 100):03d}_{int(min(hi, 1) * 100):03d}"
    for lo, hi in identity.SCORE_BANDS
)


@query(
    "a13_discovery_summary",
    f"""WITH RECURSIVE {_DETAIL} SELECT count(*) FILTER (WHERE rank = 1 OR rank IS NULL) AS issuers_examined,
      count(*) FILTER (WHERE rank = 1) AS with_candidates, count(*) FILTER (WHERE rank IS NULL) AS without_candidates, {_BANDS},
      round(median(score) FILTER (WHERE rank = 1), 8) AS top_score_median, round(max(score) FILTER (WHERE rank = 1), 8) AS top_score_max,
      round(median(margin), 8) AS margin_median FROM detail""",
)
def summary(spark, sf_dir):
    detail = identity.discovery_detail(
        identity.hard_cases(b.master(spark, sf_dir)), b.names(spark, sf_dir), b.universe(spark, sf_dir)
    )
    out = identity.discovery_summary(detail)
    return out.withColumns({c: F.round(c, 8) for c in ("top_score_median", "top_score_max", "margin_median")})


@query(
    "w11_candidate_margins",
    f"""WITH RECURSIVE {_DETAIL} SELECT cik, security_id, round(score, 8) AS score, round(margin, 8) AS margin FROM detail WHERE rank = 1""",
)
def margins(spark, sf_dir):
    return identity.discovery_detail(
        identity.hard_cases(b.master(spark, sf_dir)), b.names(spark, sf_dir), b.universe(spark, sf_dir)
    ).filter("rank = 1").select("cik", "security_id", _r("score"), _r("margin"))


@query(
    "k01_k02_hard_case_discovery",
    f"WITH RECURSIVE {_first_discovered(10)} SELECT {_FOUND}, first_filing, last_filing FROM discovered",
)
def hard_discovery(spark, sf_dir):
    out = identity.discovery_for_hard_cases(
        b.master(spark, sf_dir), b.names(spark, sf_dir), b.universe(spark, sf_dir)
    )
    return out.withColumn("discovery_score", F.round("discovery_score", 8))


@query(
    "p16_depth_probe",
    f"""WITH RECURSIVE {_first_discovered(20)}, led AS (SELECT *, COALESCE(lead(score) OVER (PARTITION BY cik ORDER BY rank), 0) AS second_score FROM discovered)
    SELECT {_FOUND}, first_filing, last_filing, round(second_score, 8) AS second_score,
      'high-margin-discovery-access-test-only' AS candidate_basis FROM led
    WHERE rank = 1 AND score >= {identity.HIGH_SCORE} AND score - second_score >= {identity.HIGH_MARGIN} ORDER BY first_filing, cik LIMIT 3""",
)
def depth(spark, sf_dir):
    found = identity.discovery_for_hard_cases(
        b.master(spark, sf_dir), b.names(spark, sf_dir), b.universe(spark, sf_dir), 20
    )
    out = identity.depth_probe(found)
    return out.withColumns({c: F.round(c, 8) for c in ("discovery_score", "second_score")})


@query(
    "a18_tie_composition",
    f"""WITH RECURSIVE {_STRENGTH} SELECT cik, CASE WHEN n_ids < top_tied_candidate_count THEN 'duplicate_security_id' WHEN n_isins < filled THEN 'duplicate_isin'
        WHEN n_names = 1 THEN 'same_normalized_name_distinct_security' ELSE 'distinct_normalized_names' END AS tie_composition,
      CAST(top_tied_candidate_count AS BIGINT) AS top_tied_candidate_count FROM strength WHERE top_score_tied""",
)
def ties(spark, sf_dir):
    return identity.tie_composition(_strength(spark, sf_dir))


@query(
    "a19_entity_collapse",
    f"""WITH RECURSIVE {_STRENGTH} SELECT count(*) AS tied_issuers, count(*) FILTER (WHERE n_names = 1) AS all_same_normalized_name,
      count(*) FILTER (WHERE filled > 0 AND n_isins = 1) AS all_nonempty_isins_same,
      count(*) FILTER (WHERE n_names = 1 AND n_isins > 1) AS same_name_distinct_isins,
      count(*) FILTER (WHERE n_names > 1 AND filled > n_isins) AS different_names_shared_isin,
      count(*) FILTER (WHERE filled < top_tied_candidate_count) AS ties_with_missing_isin,
      count(*) FILTER (WHERE filled > n_isins) AS ties_with_duplicate_isin FROM strength WHERE top_score_tied""",
)
def collapse(spark, sf_dir):
    return identity.tie_collapse_report(identity.tie_collapse_keys(_strength(spark, sf_dir)))


def _scored_universe(spark, sf_dir):
    """Every security as a scored candidate: score and margin from size and price."""
    p = b.table(spark, sf_dir, "part")
    u = b.universe(spark, sf_dir)
    return u.join(p, u.ordinal == p.p_partkey).select(
        F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("cik"),
        F.col("security_id").alias("top_security_id"),
        (1 - (F.col("p_size") % 21) / 100.0).alias("top_score"),
        (F.col("p_partkey") % 20 / 100.0).alias("margin"),
        "isin",
        F.col("isin").isNotNull().alias("isin_present"),
        "is_delisted",
        F.lit(5).alias("candidate_count"),
    )


_TIERS = f"""cand AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik, 'P' || p_partkey AS top_security_id,
   1 - (p_size % 21) / 100.0::DOUBLE AS top_score, (p_partkey % 20) / 100.0::DOUBLE AS margin,
   CASE WHEN p_size % 4 <> 0 THEN {b.us_isin_of_sql(b.cusip_of_sql('p_partkey'))} END AS isin,
   CASE WHEN p_size % 5 <> 0 THEN p_size % 2 = 0 END AS is_delisted FROM part)"""


@query(
    "p15_evidence_tiers",
    f"""WITH {_TIERS} SELECT cik, CASE WHEN top_score >= 0.9 AND margin >= 0.08 THEN 'A_high_margin' WHEN top_score >= 0.9
      THEN 'B_strong_ambiguous' ELSE 'C_weak_needs_identifier' END AS evidence_tier,
      CASE WHEN isin IS NOT NULL THEN 'isin_corroboration' ELSE 'cusip_or_historical_ticker_required' END AS identifier_priority,
      top_score >= 0.9 AND margin >= 0.08 AS price_probe_eligible, FALSE AS accepted_security FROM cand""",
)
def tiers(spark, sf_dir):
    out = identity.evidence_tiers(_scored_universe(spark, sf_dir))
    return out.select(
        "cik", "evidence_tier", "identifier_priority", "price_probe_eligible", "accepted_security"
    )


_TARGETS = f"""{_TIERS}, tgts AS (SELECT *, CASE WHEN top_score >= 0.9 AND margin >= 0.08 THEN 'A_high_margin_isin'
   WHEN top_score >= 0.9 THEN 'B_strong_ambiguous_isin' ELSE 'C_weak_isin' END AS target_priority FROM cand
   WHERE isin IS NOT NULL ORDER BY target_priority, top_score DESC, margin DESC, cik LIMIT 56)"""


def _targets(spark, sf_dir):
    return identity.identifier_targets(_scored_universe(spark, sf_dir))


@query(
    "p14_identifier_targets",
    f"WITH {_TARGETS} SELECT cik, top_security_id, isin, target_priority FROM tgts",
)
def targets(spark, sf_dir):
    return _targets(spark, sf_dir).select("cik", "top_security_id", "isin", "target_priority")


@query(
    "a14_target_summary",
    f"""WITH {_TIERS}, t AS (SELECT CASE WHEN top_score >= 0.9 AND margin >= 0.08 THEN 'A_high_margin' WHEN top_score >= 0.9
      THEN 'B_strong_ambiguous' ELSE 'C_weak_needs_identifier' END AS evidence_tier FROM cand)
    SELECT evidence_tier, count(*) AS n FROM t GROUP BY 1""",
)
def target_summary(spark, sf_dir):
    return identity.counts_by(identity.evidence_tiers(_scored_universe(spark, sf_dir)), "evidence_tier")


_PLAN = f"""{_TARGETS}, {b.FILING_NAMES}, ranked AS (SELECT f.*, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, adsh) AS rn
     FROM fnames f WHERE form IN ('10-K','10-K/A','10-Q','10-Q/A','8-K','8-K/A')),
 plan AS (SELECT t.cik, top_security_id AS candidate_security_id, target_priority, adsh AS accession,
     CAST(filed AS VARCHAR) AS filing_date, form FROM tgts t JOIN ranked r USING (cik) WHERE rn <= 6)"""


@query("j19_retrieval_plan", f"WITH {_PLAN} SELECT * FROM plan")
def plan(spark, sf_dir):
    out = identity.retrieval_plan(_targets(spark, sf_dir), b.filing_names(spark, sf_dir))
    return out.drop("retrieval_status")


@query(
    "j07_pilot_plan",
    f"WITH {_PLAN} SELECT cik, accession, filing_date FROM plan WHERE target_priority = 'A_high_margin_isin'",
)
def pilot(spark, sf_dir):
    t = _targets(spark, sf_dir)
    out = identity.pilot_plan(t, identity.retrieval_plan(t, b.filing_names(spark, sf_dir)))
    return out.select("cik", "accession", "filing_date")


@query(
    "a14_plan_summary",
    f"""WITH {_PLAN}, c AS (SELECT cik, count(*) AS n FROM plan GROUP BY 1)
    SELECT count(*) AS targets, CAST(sum(n) AS BIGINT) AS planned_filings, max(n) AS max_filings_per_target FROM c""",
)
def plan_summary(spark, sf_dir):
    return identity.plan_summary(
        identity.retrieval_plan(_targets(spark, sf_dir), b.filing_names(spark, sf_dir))
    )


@query(
    "j03_names_semi_join",
    f"WITH {_TARGETS}, {b.FILING_NAMES} SELECT DISTINCT adsh, cik, name, CAST(filed AS VARCHAR) AS filed, form FROM fnames WHERE cik IN (SELECT cik FROM tgts)",
)
def names_semi(spark, sf_dir):
    from knowndate.sources.readers import filing_names

    out = filing_names(b.filing_names(spark, sf_dir), _targets(spark, sf_dir))
    return out.select("adsh", "cik", "name", _day("filed"), "form")


@query(
    "a20_isin_coverage",
    """SELECT COALESCE(CAST(CASE WHEN p_size % 5 <> 0 THEN p_size % 2 = 0 END AS VARCHAR), 'unknown') AS is_delisted,
      count(*) AS rows, count(*) FILTER (WHERE p_size % 4 <> 0) AS with_isin,
      count(*) FILTER (WHERE p_size % 4 = 0) AS without_isin, round(avg((p_size % 4 <> 0)::INT), 8) AS coverage_rate
    FROM part GROUP BY 1""",
)
def isin_coverage(spark, sf_dir):
    out = identity.isin_coverage(b.universe(spark, sf_dir))
    return out.withColumns(
        {
            "is_delisted": F.coalesce(F.col("is_delisted").cast("string"), F.lit("unknown")),
            "coverage_rate": F.round("coverage_rate", 8),
        }
    )


_CASES = f"""{b.master_sql()}, {b.FILING_NAMES}, cases AS (SELECT cik, last_filing FROM master WHERE distress_observations > 0 AND NOT has_current_ticker),
 asked AS (SELECT cik, (i // 4) || 'Q' || (i % 4 + 1) AS vintage FROM (SELECT cik, year(last_filing) * 4 + quarter(last_filing) - 1 - back AS i
    FROM cases, (VALUES (0), (4), (8), (12)) t(back))),
 ofc AS (SELECT (1997 + p_size % 5) || 'Q' || (p_partkey % 4 + 1) AS vintage, upper(p_name || ' ' || p_brand) AS issuer_name FROM part),
 okeys AS (SELECT DISTINCT vintage, {q.list_key('issuer_name')} AS k FROM ofc),
 akeys AS (SELECT DISTINCT cik, {q.list_key('name')} AS k FROM fnames)"""


def _official(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    vintage = F.concat(
        (F.lit(1997) + F.col("p_size") % 5).cast("string"),
        F.lit("Q"),
        (F.col("p_partkey") % 4 + 1).cast("string"),
    )
    return p.select(
        vintage.alias("vintage"), F.upper(F.concat("p_name", F.lit(" "), "p_brand")).alias("issuer_name")
    )


@query(
    "j16_list_hits",
    f"""WITH {_CASES} SELECT a.cik, a.vintage, count(o.k) > 0 AS exact_discovery_hit, count(o.k) AS matched_keys, min(o.k) AS first_key
    FROM asked a LEFT JOIN akeys k ON k.cik = a.cik LEFT JOIN okeys o ON o.vintage = a.vintage AND o.k = k.k GROUP BY 1, 2""",
)
def list_hits(spark, sf_dir):
    cases = identity.hard_cases(b.master(spark, sf_dir), None)
    aliases = b.filing_names(spark, sf_dir).select("cik", F.col("name").alias("alias"))
    return matching.list_hits(cases, aliases, _official(spark, sf_dir))


@query(
    "j16_missing_controls",
    f"""WITH {_CASES}, v AS (SELECT DISTINCT vintage FROM ofc), c(name) AS (VALUES ('SMALL RING BRAND 2 INC'), ('APPLE INC'))
    SELECT v.vintage, c.name FROM v, c WHERE NOT EXISTS (SELECT 1 FROM okeys o WHERE o.vintage = v.vintage AND o.k = {q.list_key('c.name')})""",
)
def controls(spark, sf_dir):
    official = _official(spark, sf_dir)
    return matching.missing_controls(official, official, ["SMALL RING BRAND 2 INC", "APPLE INC"])


# --- identifiers and evidence -------------------------------------------------------------


@query(
    "f05_cusip_check_digits",
    f"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lpad(CAST(p_partkey * 7 AS VARCHAR), 9, '0')
       WHEN p_partkey % 3 = 1 THEN {b.cusip_of_sql('p_partkey * 7919')} ELSE substr(upper(replace(p_name, ' ', '')) || p_partkey, 1, 8) || p_size % 10 END AS cusip FROM part)
    SELECT p_partkey, cusip, {q.valid_cusip('cusip')} AS valid FROM c""",
)
def cusips(spark, sf_dir):
    k = F.col("p_partkey")
    word = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), k.cast("string"))
    cusip = (
        F.when(k % 3 == 0, F.lpad((k * 7).cast("string"), 9, "0"))
        .when(k % 3 == 1, b.cusip_of(k * 7919))
        .otherwise(F.concat(F.substring(word, 1, 8), (F.col("p_size") % 10).cast("string")))
    )
    p = b.table(spark, sf_dir, "part").select("p_partkey", cusip.alias("cusip"))
    return p.withColumn("valid", ids.valid_cusip(F.col("cusip")))


@query(
    "f06_isin_checks",
    f"""WITH c AS (SELECT p_partkey, {b.us_isin_of_sql(b.cusip_of_sql('p_partkey'))} AS good FROM part),
     d AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN good WHEN 1 THEN substr(good, 1, 11) || ((CAST(substr(good, 12, 1) AS INT) + 1) % 10)
       WHEN 2 THEN 'XX' || substr(good, 3) ELSE 'GB' || substr(good, 3) END AS isin FROM c)
    SELECT p_partkey, isin, {q.valid_isin('isin')} AS valid FROM d""",
)
def isins(spark, sf_dir):
    k = F.col("p_partkey")
    good = b.us_isin_of(b.cusip_of(k))
    bump = ((F.substring(good, 12, 1).cast("int") + 1) % 10).cast("string")
    isin = (
        F.when(k % 4 == 0, good)
        .when(k % 4 == 1, F.concat(F.substring(good, 1, 11), bump))
        .when(k % 4 == 2, F.concat(F.lit("XX"), F.substring(good, 3, 10)))
        .otherwise(F.concat(F.lit("GB"), F.substring(good, 3, 10)))
    )
    p = b.table(spark, sf_dir, "part").select("p_partkey", isin.alias("isin"))
    return p.withColumn("valid", ids.valid_isin(F.col("isin")))


@query(
    "p13_priority_documents",
    f"WITH {b.documents_sql()} SELECT source, document_type IN ('10-K', '8-k', 'EX-2.1', 'EX-4') AS priority FROM docs",
)
def priority(spark, sf_dir):
    d = b.documents(spark, sf_dir)
    return d.select("source", ids.is_priority_document(F.col("document_type")).alias("priority"))


@query(
    "f07_f20_identifier_evidence",
    f"""WITH {b.evidence_sql()} SELECT source, COALESCE(string_agg(identifier, ',' ORDER BY identifier) FILTER (WHERE identifier_type = 'CUSIP'), '') AS cusips,
      COALESCE(string_agg(identifier, ',' ORDER BY identifier) FILTER (WHERE identifier_type = 'ISIN'), '') AS isins
    FROM valid WHERE document_type IN ('10-K', '8-k', 'EX-2.1', 'EX-4') GROUP BY 1""",
)
def doc_evidence(spark, sf_dir):
    out = evidence.identifier_evidence(b.documents(spark, sf_dir))
    return out.select(
        "source", F.array_join("cusips", ",").alias("cusips"), F.array_join("isins", ",").alias("isins")
    )


@query(
    "f19_exploded_identifiers",
    f"""WITH {b.evidence_sql()} SELECT source, identifier_type, identifier FROM valid
    WHERE document_type IN ('10-K', '8-k', 'EX-2.1', 'EX-4')""",
)
def exploded(spark, sf_dir):
    out = evidence.explode_identifiers(evidence.identifier_evidence(b.documents(spark, sf_dir)))
    return out.select("source", "identifier_type", "identifier")


@query(
    "f11_f12_identifier_context",
    f"""WITH {b.evidence_sql()} SELECT source, identifier_type, identifier, CAST(s AS BIGINT) AS match_start, ctx AS context,
    security_context FROM evid2""",
)
def contexts(spark, sf_dir):
    out = evidence.contextual_evidence(b.documents(spark, sf_dir))
    return out.select(
        "source",
        "identifier_type",
        "identifier",
        F.col("identifier_match_start").cast("bigint").alias("match_start"),
        F.col("identifier_context").alias("context"),
        "security_context",
    )


@query(
    "f21_pilot_evidence",
    f"""WITH {b.evidence_sql()} SELECT cik, accession, 'P' || CAST(cik AS BIGINT) AS candidate_security_id,
      identifier_type, identifier, security_context, count(*) AS n FROM evid2 WHERE CAST(cik AS BIGINT) % 4 = 1 GROUP BY ALL""",
)
def pilot_evidence(spark, sf_dir):
    d = b.documents(spark, sf_dir)
    plan = d.filter(F.col("cik").cast("bigint") % 4 == 1).select(
        "cik",
        "accession",
        F.concat(F.lit("P"), F.col("cik").cast("bigint").cast("string")).alias("candidate_security_id"),
        F.lit("2001-01-01").alias("filing_date"),
        F.lit("10-K").alias("form"),
    ).distinct()
    docs = d.select("cik", "accession", "document_type", "document_sha256", "text")
    out = evidence.pilot_evidence(plan, docs)
    return out.groupBy(
        "cik", "accession", "candidate_security_id", "identifier_type", "identifier", "security_context"
    ).agg(F.count(F.lit(1)).alias("n"))


def _evidence(spark, sf_dir):
    return evidence.contextual_evidence(b.documents(spark, sf_dir))


@query(
    "a08_evidence_by_target",
    f"""WITH {b.evidence_sql()} SELECT cik, count(*) AS evidence_rows, count(DISTINCT identifier) AS unique_identifiers,
    count(*) FILTER (WHERE common_equity_context) AS common_equity_rows, count(DISTINCT document_sha256) AS documents FROM evid2 GROUP BY 1""",
)
def by_target(spark, sf_dir):
    return evidence.evidence_by_target(_evidence(spark, sf_dir))


@query(
    "a08_evidence_quality",
    f"""WITH {b.evidence_sql()}, c AS (SELECT *, count(*) OVER (PARTITION BY cik, identifier_type, identifier) > 1 AS dup FROM evid2)
    SELECT count(*) AS rows, count(DISTINCT cik) AS targets, count(*) FILTER (WHERE common_equity_context) AS common_equity_rows,
      count(DISTINCT cik || identifier_type || identifier) AS unique_identifiers,
      count(DISTINCT cik) FILTER (WHERE common_equity_context) AS targets_with_common_equity,
      round(avg(dup::INT), 8) AS duplicate_rate FROM c""",
)
def quality(spark, sf_dir):
    return evidence.evidence_quality(_evidence(spark, sf_dir)).withColumn(
        "duplicate_rate", F.round("duplicate_rate", 8)
    )


_CORR = f"""{b.evidence_sql()}, corr AS (SELECT cik, candidate_security_id, identifier_type, identifier, count(*) AS evidence_rows,
   count(DISTINCT document_sha256) AS independent_documents, count(DISTINCT accession) AS independent_accessions,
   min(filing_date) AS first_filing_date, max(filing_date) AS last_filing_date FROM evid2 WHERE common_equity_context GROUP BY 1, 2, 3, 4)"""


@query(
    "a09_corroboration",
    f"""WITH {_CORR} SELECT *, CASE WHEN independent_accessions >= 2 THEN 'multi_accession' WHEN independent_documents >= 2
      THEN 'multi_document' ELSE 'single_document' END AS corroboration_status FROM corr""",
)
def corroboration(spark, sf_dir):
    return evidence.corroboration(_evidence(spark, sf_dir)).drop("acceptance_status")


@query(
    "a09_corroboration_report",
    f"""WITH {_CORR} SELECT count(DISTINCT cik) AS targets, count(*) AS candidate_identifiers,
      count(*) FILTER (WHERE independent_documents >= 2) AS multi_document,
      count(*) FILTER (WHERE independent_accessions >= 2) AS multi_accession,
      count(*) FILTER (WHERE independent_documents = 1) AS single_document FROM corr""",
)
def corroboration_report(spark, sf_dir):
    return evidence.corroboration_report(evidence.corroboration(_evidence(spark, sf_dir)))


@query(
    "a22_cusip_validity",
    f"""WITH {b.evidence_sql()}, c AS (SELECT CASE WHEN doc_n % 3 = 0 THEN substr(identifier, 1, 8) || 'X' ELSE identifier END AS identifier,
       common_equity_context FROM (SELECT *, CAST(substr(source, 5) AS BIGINT) AS doc_n FROM evid2) WHERE identifier_type = 'CUSIP'),
     v AS (SELECT *, {q.valid_cusip('identifier')} AS ok FROM c)
    SELECT count(*) AS cusip_rows, count(DISTINCT identifier) AS cusip_unique, count(*) FILTER (WHERE ok) AS valid_rows,
      count(DISTINCT identifier) FILTER (WHERE ok) AS valid_unique, count(*) FILTER (WHERE common_equity_context) AS common_equity_rows,
      count(*) FILTER (WHERE common_equity_context AND ok) AS common_equity_valid_rows,
      count(DISTINCT identifier) FILTER (WHERE common_equity_context) AS common_equity_unique,
      count(DISTINCT identifier) FILTER (WHERE common_equity_context AND ok) AS common_equity_valid_unique FROM v""",
)
def validity(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    spoiled = F.substring("source", 5, 20).cast("bigint") % 3 == 0
    e = e.withColumn(
        "identifier",
        F.when(
            spoiled & (F.col("identifier_type") == "CUSIP"),
            F.concat(F.substring("identifier", 1, 8), F.lit("X")),
        ).otherwise(F.col("identifier")),
    )
    return evidence.cusip_validity(e)


def _isin_targets(spark, sf_dir):
    """Targets of the evidence issuers: ISINs around the documents' identifiers."""
    d = b.table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("k")).distinct()
    near = F.lit(3780000) + F.col("k") % 25
    other = F.when(F.col("k") % 3 == 0, near).when(F.col("k") % 3 == 1, near + 1).otherwise(near + 5000)
    return d.select(
        F.lpad(F.col("k").cast("string"), 10, "0").alias("cik"),
        F.concat(F.lit("P"), F.col("k").cast("string")).alias("top_security_id"),
        F.when(F.col("k") % 10 != 9, b.us_isin_of(b.cusip_of(other))).alias("isin"),
        F.lit("A_high_margin_isin").alias("target_priority"),
    )


_TSQL = f"""tgt AS (SELECT lpad(CAST(k AS VARCHAR), 10, '0') AS cik, 'P' || k AS sid, CASE WHEN k % 10 <> 9 THEN
   {b.cusip_of_sql('(CASE k % 3 WHEN 0 THEN near WHEN 1 THEN near + 1 ELSE near + 5000 END)')} END AS cc
   FROM (SELECT DISTINCT doc_id % 50 AS k, 3780000 + (doc_id % 50) % 25 AS near FROM documents)),
 inter AS (SELECT c.cik, c.candidate_security_id, identifier, cc AS candidate_cusip, CASE WHEN cc IS NULL THEN 'unusable' WHEN identifier = cc THEN 'exact'
   WHEN substr(identifier, 1, 8) = substr(cc, 1, 8) THEN 'same_security_body_check_digit_difference'
   WHEN substr(identifier, 1, 6) = substr(cc, 1, 6) THEN 'same_issuer_root_different_issue' ELSE 'different_issuer_root' END AS identifier_relationship
   FROM corr c LEFT JOIN tgt t ON t.cik = c.cik AND t.sid = c.candidate_security_id
   WHERE identifier_type = 'CUSIP' AND independent_accessions >= 2)"""


def _intersection(spark, sf_dir):
    return identity.intersect_identifiers(
        evidence.corroboration(_evidence(spark, sf_dir)), _isin_targets(spark, sf_dir)
    )


@query(
    "j06_identifier_intersection",
    f"""WITH {_CORR}, {_TSQL} SELECT *, identifier_relationship = 'exact' AS identifier_match FROM inter""",
)
def intersection(spark, sf_dir):
    return _intersection(spark, sf_dir).select(
        "cik", "candidate_security_id", "identifier", "candidate_cusip", "identifier_relationship", "identifier_match"
    )


@query(
    "j06_intersection_report",
    f"""WITH {_CORR}, {_TSQL} SELECT CASE WHEN grouping(identifier_relationship) = 1 THEN 'all' ELSE identifier_relationship END AS identifier_relationship,
     count(*) AS rows, count(DISTINCT cik) AS issuers FROM inter GROUP BY ROLLUP (identifier_relationship)""",
)
def intersection_report(spark, sf_dir):
    return identity.intersection_report(_intersection(spark, sf_dir))


@query(
    "f09_cusip_from_us_isin",
    f"""WITH c AS (SELECT p_partkey, {b.us_isin_of_sql(b.cusip_of_sql('p_partkey'))} AS good FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN substr(good, 3, 9) END AS cusip FROM c""",
)
def us_cusips(spark, sf_dir):
    good = b.us_isin_of(b.cusip_of(F.col("p_partkey")))
    isin = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("CA"), F.substring(good, 3, 10))).otherwise(
        F.concat(F.lit(" "), F.lower(good))
    )
    p = b.table(spark, sf_dir, "part").select("p_partkey", isin.alias("isin"))
    return p.select("p_partkey", ids.cusip_from_us_isin(F.col("isin")).alias("cusip"))


@query(
    "f10_identifier_relationship",
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, {b.cusip_of_sql('l_partkey')} AS a, {b.cusip_of_sql('l_suppkey')} AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN a = s THEN 'exact' WHEN substr(a, 1, 8) = substr(s, 1, 8) THEN 'same_security_body_check_digit_difference'
      WHEN substr(a, 1, 6) = substr(s, 1, 6) THEN 'same_issuer_root_different_issue' ELSE 'different_issuer_root' END AS relationship FROM c""",
)
def relationship(spark, sf_dir):
    line = b.table(spark, sf_dir, "lineitem")
    out = ids.identifier_relationship(b.cusip_of(F.col("l_partkey")), b.cusip_of(F.col("l_suppkey")))
    return line.select("l_orderkey", "l_linenumber", out.alias("relationship"))


@query(
    "f08_corroborate_candidate",
    f"""WITH c AS (SELECT p_partkey, {b.cusip_of_sql('p_partkey')} AS cu FROM part),
     d AS (SELECT p_partkey, cu, {b.us_isin_of_sql('cu')} AS isin FROM c)
    SELECT p_partkey, p_partkey % 4 = 0 AS exact_isin_match, p_partkey % 4 = 1 AS isin_embedded_cusip_match,
      p_partkey % 4 IN (0, 1) AS identifier_corroborated FROM d""",
)
def corroborate(spark, sf_dir):
    k = F.col("p_partkey")
    cusip = b.cusip_of(k)
    isin = b.us_isin_of(cusip)
    p = b.table(spark, sf_dir, "part").select(
        "p_partkey",
        isin.alias("isin"),
        F.when(k % 4 == 0, F.array(F.lower(isin))).otherwise(F.array(F.lit("US0000000000"))).alias("isins"),
        F.when(k % 4 == 1, F.array(cusip))
        .when(k % 4 == 2, F.array(F.concat(F.substring(cusip, 1, 8), F.lit("X"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("cusips"),
    )
    out = ids.corroboration(F.col("isin"), F.col("isins"), F.col("cusips"))
    return p.select("p_partkey", F.inline(F.array(out)))
