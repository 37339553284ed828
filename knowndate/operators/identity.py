"""Issuer identity: master table, hard cases, candidate strength, evidence tiers.

Lists per issuer (names, tickers) stay long tables with one row per value, so that no
issuer has to fit into one array; only lists that are short by definition (securities
tied at the top of a five-row candidate list) are arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowndate.functions.identifiers import clean, cusip_from_us_isin, identifier_relationship
from knowndate.functions.keys import cik_coverage_key, cik_filing_key
from knowndate.functions.names import entity_name_key
from knowndate.operators.checks import need_columns
from knowndate.operators.labels import LABEL
from knowndate.operators.matching import TIE_KEYS, discover
from knowndate.operators.ordered import exact_quantiles
from knowndate.session import cut_lineage

# --- fixed values -----------------------------------------------------------
HIGH_SCORE = 0.90
HIGH_MARGIN = 0.08
NEAR_TIE = 0.02
SCORE_BANDS = [(0.0, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.01)]
PRIORITY_FORMS = ["10-K", "10-K/A", "10-Q", "10-Q/A", "8-K", "8-K/A"]
DATASET_START = "2009-01-01"
# ----------------------------------------------------------------------------


def issuer_values(table: DataFrame, column: str) -> DataFrame:
    """Distinct (cik, value) pairs of tickers or names, keyed like the master."""
    return (
        table.filter(F.col(column).isNotNull())
        .select(cik_coverage_key(F.col("cik")).alias("cik"), F.col(column).cast("string").alias(column))
        .distinct()
    )


def identity_master(cohort: DataFrame, tickers: DataFrame, names: DataFrame) -> DataFrame:
    """One row per issuer: filing span, distress count, known tickers and names."""
    base = cohort.groupBy(cik_coverage_key(F.col("cik")).alias("cik")).agg(
        F.min("filed").alias("first_filing"),
        F.max("filed").alias("last_filing"),
        F.count(F.lit(1)).alias("observations"),
        F.coalesce(F.sum(F.col(LABEL).cast("bigint")), F.lit(0)).alias("distress_observations"),
    )

    def rollup(table, column, out):
        return issuer_values(table, column).groupBy("cik").agg(
            F.count(F.lit(1)).alias(f"{out}_count"), F.min(column).alias(f"first_{out}")
        )

    joined = base.join(rollup(tickers, "ticker", "ticker"), "cik", "left").join(
        rollup(names, "historical_name", "name"), "cik", "left"
    )
    has_ticker, has_name = F.col("ticker_count").isNotNull(), F.col("name_count").isNotNull()
    return joined.withColumns(
        {
            "has_current_ticker": has_ticker,
            "has_historical_name": has_name,
            "identity_status": F.when(has_ticker, "current_ticker")
            .when(has_name, "historical_name_only")
            .otherwise("unresolved"),
            "ticker_count": F.coalesce("ticker_count", F.lit(0)),
            "name_count": F.coalesce("name_count", F.lit(0)),
        }
    )


def identity_audit(master: DataFrame) -> DataFrame:
    """One row of identity coverage rates."""
    distressed = F.col("distress_observations") > 0
    hard = distressed & ~F.col("has_current_ticker")
    named = hard & F.col("has_historical_name")
    return master.agg(
        F.count(F.lit(1)).alias("cohort_companies"),
        F.avg(F.col("has_historical_name").cast("double")).alias("historical_name_coverage"),
        F.avg(F.col("has_current_ticker").cast("double")).alias("current_ticker_coverage"),
        F.count_if(distressed).alias("distressed_companies"),
        F.count_if(hard).alias("distressed_without_current_ticker"),
        F.count_if(named).alias("distressed_without_current_ticker_with_historical_names"),
        F.coalesce(F.try_divide(F.count_if(named), F.count_if(hard)), F.lit(1.0)).alias(
            "distressed_name_recovery_rate"
        ),
        F.count_if(F.col("identity_status") == "unresolved").alias("unresolved_companies"),
    )


def flag_current_ticker(cohort: DataFrame, tickers: DataFrame) -> DataFrame:
    """Add ``cik_norm`` and whether the issuer is in the ticker map."""
    known = tickers.select(cik_coverage_key(F.col("cik")).alias("cik_norm")).distinct()
    return (
        cohort.withColumn("cik_norm", cik_coverage_key(F.col("cik")))
        .join(known.withColumn("__known", F.lit(True)), "cik_norm", "left")
        .withColumn("has_current_ticker", F.coalesce("__known", F.lit(False)))
        .drop("__known")
    )


def ticker_coverage(flagged: DataFrame) -> DataFrame:
    """Coverage overall, per filing year and per split (needs ``split``).

    Rows are first combined per (year, split, issuer); the grouping sets then work on
    that table.
    """
    mapped = F.col("has_current_ticker")
    small = flagged.groupBy(F.year("filed").alias("year"), "split", "cik_norm").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(mapped).alias("m"),
        F.count_if(F.col(LABEL) == 1).alias("pos"),
        F.count_if(mapped & (F.col(LABEL) == 1)).alias("mpos"),
    )
    grouped = small.groupingSets([[], ["year"], ["split"]], "year", "split").agg(
        F.grouping("year").alias("gy"),
        F.grouping("split").alias("gs"),
        F.sum("n").alias("rows"),
        F.count_distinct("cik_norm").alias("companies"),
        F.sum("m").alias("mapped_rows"),
        (F.sum("m") / F.sum("n")).alias("row_coverage"),
        F.sum("pos").alias("positives"),
        F.sum("mpos").alias("mapped_positives"),
    )
    level = F.when(F.col("gy") == 0, "year").when(F.col("gs") == 0, "split").otherwise("overall")
    name = F.coalesce(F.col("year").cast("string"), F.col("split"), F.lit("all"))
    return grouped.select(
        level.alias("level"),
        name.alias("group_name"),
        "rows",
        "companies",
        "mapped_rows",
        "row_coverage",
        "positives",
        "mapped_positives",
    )


def positive_coverage(flagged: DataFrame) -> DataFrame:
    """One row: mapped share of positive filings, issuers of unmapped positives."""
    per = flagged.filter(F.col(LABEL) == 1).groupBy("cik_norm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_current_ticker").alias("m")
    )
    return per.agg(
        F.try_divide(F.sum("m"), F.sum("n")).alias("positive_row_coverage"),
        F.count_if(F.col("m") < F.col("n")).alias("unmapped_positive_companies"),
    )


def is_hard_case() -> Column:
    return (F.col("distress_observations") > 0) & ~F.col("has_current_ticker")


def hard_cases(master: DataFrame, limit: int | None = None) -> DataFrame:
    """Distressed issuers without a current ticker: all, or the oldest ``limit``."""
    hard = master.filter(is_hard_case())
    if limit is None:
        return hard
    order = [F.col("first_filing").asc(), F.col("distress_observations").desc(), F.col("cik").asc()]
    return hard.orderBy(*order).limit(limit)


def era_profile(hard: DataFrame) -> DataFrame:
    """One row: filing-year range and era counts of the hard cases."""
    out = [F.count(F.lit(1)).alias("hard_cases")]
    for side in ("first", "last"):
        year = F.year(f"{side}_filing")
        out += [
            F.min(year).alias(f"{side}_filing_year_min"),
            F.max(year).alias(f"{side}_filing_year_max"),
            F.count_if(year < 1996).alias(f"{side}_filing_before_1996"),
            F.count_if(year.between(1996, 2019)).alias(f"{side}_filing_1996_2019"),
            F.count_if(year >= 2020).alias(f"{side}_filing_2020_plus"),
        ]
    return hard.agg(*out)


def era_decades(hard: DataFrame) -> DataFrame:
    decade = (F.floor(F.year("first_filing") / 10) * 10).cast("int")
    return hard.groupBy(decade.alias("decade")).agg(F.count(F.lit(1)).alias("issuers"))


def alias_map(filing_names: DataFrame) -> DataFrame:
    """Distinct usable (cik, name) pairs of filing names."""
    pairs = filing_names.filter(F.col("name").isNotNull()).select(
        cik_filing_key(F.col("cik")).alias("cik"), F.col("name").cast("string").alias("name")
    )
    keyed = pairs.distinct().withColumn("__key", entity_name_key(F.col("name")))
    return keyed.filter("__key <> ''").drop("__key")


def case_aliases(cases: DataFrame, names: DataFrame, filing_names: DataFrame | None) -> DataFrame:
    """(cik, alias) of the cases: historical names, plus filing names when given."""
    base = issuer_values(names, "historical_name").withColumnRenamed("historical_name", "alias")
    out = base.join(cases.select("cik"), "cik", "left_semi")
    if filing_names is not None:
        extra = alias_map(filing_names).withColumnRenamed("name", "alias")
        out = out.unionByName(extra.join(cases.select("cik"), "cik", "left_semi")).distinct()
    return out


def candidate_strength(
    cases: DataFrame,
    names: DataFrame,
    filing_names: DataFrame,
    universe: DataFrame,
    min_score: float = 0.45,
) -> DataFrame:
    """Top candidate per hard case: score, margin, number and keys of all ties (five of them shown)."""
    found = discover(case_aliases(cases, names, filing_names), universe, min_score, 5, tie_keys=True)
    top = F.max(F.when(F.col("rank") == 1, F.col("discovery_score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("discovery_score")))
    first_row = F.max(
        F.when(
            F.col("rank") == 1,
            F.struct("security_id", "security_name", "isin", "is_delisted"),
        )
    )
    at_most_five = F.array_sort(
        F.collect_list(
            F.struct("rank", "discovery_score", "security_id", "security_name", "isin", "name_key")
        )
    )
    rolled = found.groupBy("cik").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        top.alias("top_score"),
        second.alias("second_score"),
        first_row.alias("t"),
        *[F.max(c).alias(c) for c in ("top_ties", *TIE_KEYS)],
        at_most_five.alias("c"),
    )
    joined = cases.select("cik").join(rolled, "cik", "left")
    tied_rows = F.filter(F.col("c"), lambda x: x["discovery_score"] == F.col("top_score"))
    margin = F.coalesce(F.col("top_score") - F.col("second_score"), F.col("top_score"))
    gap = F.col("top_score") - F.col("second_score")
    isin = F.nullif(clean(F.col("t.isin")), F.lit(""))
    false = F.lit(False)
    return joined.select(
        "cik",
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.col("t.security_id").alias("top_security_id"),
        F.col("t.security_name").alias("top_security_name"),
        "top_score",
        "second_score",
        margin.alias("margin"),
        F.coalesce(F.abs(gap) < 1e-12, false).alias("top_score_tied"),
        F.coalesce(gap < NEAR_TIE, false).alias("top_score_near_tied"),
        F.coalesce("top_ties", F.lit(0)).alias("top_tied_candidate_count"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in TIE_KEYS],
        F.transform(tied_rows, lambda x: x["security_id"]).alias("top_tied_security_ids"),
        F.transform(tied_rows, lambda x: x["security_name"]).alias("top_tied_security_names"),
        F.transform(tied_rows, lambda x: F.coalesce(x["isin"], F.lit(""))).alias("top_tied_isins"),
        F.transform(tied_rows, lambda x: x["name_key"]).alias("top_tied_name_keys"),
        F.col("t.is_delisted").alias("is_delisted"),
        isin.alias("isin"),
        isin.isNotNull().alias("isin_present"),
        F.coalesce((F.col("top_score") >= HIGH_SCORE) & (margin >= HIGH_MARGIN), false).alias(
            "high_margin"
        ),
    )


def _with_medians(report: DataFrame, values: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``report`` (one row) with the exact median of each column of ``values``; NULL without values."""
    long = values.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("__of"), c.alias("__x")) for n, c in columns.items()])).alias("s")
    ).select("s.*")
    found = exact_quantiles(long, "__x", [0.5], ["__of"]).agg(
        *[F.max(F.when(F.col("__of") == n, F.col("quantile"))).alias(n) for n in columns]
    )
    return report.crossJoin(F.broadcast(found))


def strength_report(strength: DataFrame) -> DataFrame:
    """One row over all given cases."""
    strength = cut_lineage(strength)
    report = strength.agg(
        F.count(F.lit(1)).alias("issuers"),
        F.count_if(F.col("candidate_count") > 0).alias("with_candidate"),
        F.count_if(F.col("top_score") >= HIGH_SCORE).alias("top_score_ge_090"),
        F.count_if("high_margin").alias("high_margin_candidates"),
        F.count_if("top_score_tied").alias("top_score_ties"),
        F.count_if("top_score_near_tied").alias("top_score_near_ties_lt_002"),
        F.count_if("is_delisted").alias("delisted_top_candidates"),
        F.count_if("isin_present").alias("top_candidates_with_isin"),
    )
    medians = {"top_score_median": F.col("top_score"), "margin_median": F.col("margin")}
    return _with_medians(report, strength, medians)


def compare_discovery(
    cases: DataFrame,
    names: DataFrame,
    filing_names: DataFrame,
    universe: DataFrame,
    min_score: float = 0.45,
) -> DataFrame:
    """Candidates with historical names only against names enriched by filing names.

    Both sides are searched for at once, as two issuers each; a name that both hold is scored once.
    """
    sides = {"before": case_aliases(cases, names, None), "after": case_aliases(cases, names, filing_names)}
    marked = [aliases.withColumn("cik", F.concat(F.lit(f"{side} "), "cik")) for side, aliases in sides.items()]
    found = cut_lineage(discover(marked[0].unionByName(marked[1]), universe, min_score, 5))
    out = cases.select("cik")
    for side, aliases in sides.items():
        counts = aliases.groupBy("cik").agg(F.count(F.lit(1)).alias(f"{side}_aliases"))
        own = found.filter(F.col("cik").startswith(f"{side} ")).withColumn("cik", F.substring_index("cik", " ", -1))
        rolled = own.groupBy("cik").agg(
            F.count(F.lit(1)).alias(f"{side}_candidates"), F.max("discovery_score").alias(f"{side}_top_score")
        )
        out = out.join(counts, "cik", "left").join(rolled, "cik", "left")
    out = out.fillna(0, ["before_aliases", "after_aliases", "before_candidates", "after_candidates"])
    b, a = F.col("before_candidates"), F.col("after_candidates")
    better = F.col("after_top_score").isNotNull() & (
        F.col("before_top_score").isNull() | (F.col("after_top_score") > F.col("before_top_score"))
    )
    return out.withColumns(
        {
            "new_candidate": (b == 0) & (a > 0),
            "candidate_count_increased": a > b,
            "top_score_improved": better,
        }
    )


def comparison_report(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.count(F.lit(1)).alias("issuers"),
        F.count_if(F.col("before_candidates") > 0).alias("before_with_candidate"),
        F.count_if(F.col("after_candidates") > 0).alias("after_with_candidate"),
        F.count_if("new_candidate").alias("new_candidate_issuers"),
        F.count_if("candidate_count_increased").alias("candidate_count_increased"),
        F.count_if("top_score_improved").alias("top_score_improved"),
    )


def discovery_detail(
    cases: DataFrame, names: DataFrame, universe: DataFrame, min_score: float = 0.45
) -> DataFrame:
    """Five best candidates per case with the margin of the first; one NULL row if none."""
    found = discover(case_aliases(cases, names, None), universe, min_score, 5)
    w = W.partitionBy("cik").orderBy("rank")
    following = F.coalesce(F.lead("discovery_score").over(w), F.lit(0.0))
    found = found.withColumn(
        "margin", F.when(F.col("rank") == 1, F.col("discovery_score") - following)
    )
    return cases.select("cik").join(
        found.select(
            "cik",
            "rank",
            "security_id",
            "security_name",
            F.col("discovery_score").alias("score"),
            "margin",
            "sec_alias",
            "is_delisted",
        ),
        "cik",
        "left",
    )


def discovery_summary(detail: DataFrame) -> DataFrame:
    """One row: cases with and without candidates, score bands, medians."""
    detail = cut_lineage(detail)
    top = F.when(F.col("rank") == 1, F.col("score"))
    bands = [
        F.count_if((top >= lo) & (top < hi)).alias(
            f"band_{int(lo * 100):03d}_{int(min(hi, 1) * 100):03d}"
        )
        for lo, hi in SCORE_BANDS
    ]
    report = detail.agg(
        F.count_if((F.col("rank") == 1) | F.col("rank").isNull()).alias("issuers_examined"),
        F.count_if(F.col("rank") == 1).alias("with_candidates"),
        F.count_if(F.col("rank").isNull()).alias("without_candidates"),
        *bands,
        F.max(top).alias("top_score_max"),
    )
    return _with_medians(report, detail, {"top_score_median": top, "margin_median": F.col("margin")})


def discovery_for_hard_cases(
    master: DataFrame, names: DataFrame, universe: DataFrame, n_issuers: int = 10,
    examined: int | None = None,
) -> DataFrame:
    """Candidates of the first ``n_issuers`` hard cases that have any.

    ``examined`` may bound how many hard cases are scored; by default all are.
    """
    hard = hard_cases(master, examined)
    found = discover(case_aliases(hard, names, None), universe)
    span = hard.select("cik", "first_filing", "last_filing", "distress_observations")
    issuers = found.select("cik").distinct().join(span, "cik")
    order = [F.col("first_filing").asc(), F.col("distress_observations").desc(), F.col("cik").asc()]
    first = issuers.orderBy(*order).limit(n_issuers)
    return found.join(first.drop("distress_observations"), "cik")


def depth_probe(discovered: DataFrame, n: int = 3) -> DataFrame:
    """Top candidates with a high score and a clear margin, first ``n`` issuers."""
    w = W.partitionBy("cik").orderBy("rank")
    second = F.coalesce(F.lead("discovery_score").over(w), F.lit(0.0))
    clear = (F.col("discovery_score") >= HIGH_SCORE) & (
        F.col("discovery_score") - F.col("second_score") >= HIGH_MARGIN
    )
    return (
        discovered.withColumn("second_score", second)
        .filter((F.col("rank") == 1) & clear)
        .orderBy("first_filing", "cik")
        .limit(n)
        .withColumn("candidate_basis", F.lit("high-margin-discovery-access-test-only"))
    )


def evidence_tiers(strength: DataFrame) -> DataFrame:
    """Tier A/B/C, identifier priority and price-probe eligibility per candidate."""
    need_columns(strength, ["top_score", "margin", "isin_present", "is_delisted", "candidate_count"])
    strong = F.coalesce(F.col("top_score") >= HIGH_SCORE, F.lit(False))
    clear = F.coalesce(F.col("margin") >= HIGH_MARGIN, F.lit(False))
    return strength.withColumns(
        {
            "evidence_tier": F.when(strong & clear, "A_high_margin")
            .when(strong, "B_strong_ambiguous")
            .otherwise("C_weak_needs_identifier"),
            "identifier_priority": F.when(F.col("isin_present"), "isin_corroboration").otherwise(
                "cusip_or_historical_ticker_required"
            ),
            "price_probe_eligible": strong & clear,
            "accepted_security": F.lit(False),
        }
    )


def isin_flag_check(strength: DataFrame) -> DataFrame:
    """One row: candidates flagged with an ISIN that carry no value."""
    empty = F.coalesce(clean(F.col("isin")), F.lit("")) == ""
    out = strength.agg(F.count_if(F.col("isin_present") & empty).alias("inconsistent"))
    return out.withColumn("passed", F.col("inconsistent") == 0)


def identifier_targets(strength: DataFrame, max_targets: int = 56) -> DataFrame:
    """Candidates with an ISIN, best tiers first, at most ``max_targets``."""
    need_columns(
        strength,
        ["cik", "top_security_id", "top_score", "margin", "isin", "isin_present", "is_delisted"],
    )
    isin = F.nullif(clean(F.col("isin")), F.lit(""))
    strong = F.coalesce(F.col("top_score") >= HIGH_SCORE, F.lit(False))
    clear = F.coalesce(F.col("margin") >= HIGH_MARGIN, F.lit(False))
    kept = strength.withColumn("isin", isin).filter(
        F.col("isin_present") & F.col("isin").isNotNull() & F.col("top_security_id").isNotNull()
    )
    return (
        kept.withColumn(
            "target_priority",
            F.when(strong & clear, "A_high_margin_isin")
            .when(strong, "B_strong_ambiguous_isin")
            .otherwise("C_weak_isin"),
        )
        .orderBy("target_priority", F.col("top_score").desc(), F.col("margin").desc(), "cik")
        .limit(max_targets)
    )


def retrieval_plan(targets: DataFrame, filing_names: DataFrame, per_cik: int = 6) -> DataFrame:
    """Newest ``per_cik`` distinct filings of priority forms for each target."""
    newest = W.partitionBy("cik").orderBy(F.col("filed").desc(), "adsh")
    wanted = (
        filing_names.filter(F.col("form").isin(PRIORITY_FORMS))
        .join(targets.select("cik").distinct(), "cik", "left_semi")
        .groupBy("cik", "adsh")
        .agg(F.max("filed").alias("filed"), F.max_by("form", "filed").alias("form"))
        .withColumn("__rn", F.row_number().over(newest))
        .filter(F.col("__rn") <= per_cik)
    )
    return targets.select("cik", "top_security_id", "target_priority").join(wanted, "cik").select(
        "cik",
        F.col("top_security_id").alias("candidate_security_id"),
        "target_priority",
        F.col("adsh").alias("accession"),
        F.date_format("filed", "yyyy-MM-dd").alias("filing_date"),
        "form",
        F.lit("planned").alias("retrieval_status"),
    )


def pilot_plan(targets: DataFrame, plan: DataFrame) -> DataFrame:
    """The part of the plan that belongs to tier-A targets (many-to-one)."""
    need_columns(targets, ["cik", "top_security_id", "target_priority"])
    need_columns(plan, ["cik", "candidate_security_id", "filing_date", "accession"])
    tier = targets.filter(F.col("target_priority") == "A_high_margin_isin").select(
        "cik", F.col("top_security_id").alias("candidate_security_id")
    )
    return plan.join(tier, ["cik", "candidate_security_id"], "inner")


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row: targets, planned filings, most filings of one target."""
    per = plan.groupBy("cik").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("targets"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("planned_filings"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_filings_per_target"),
    )


def counts_by(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def tie_composition(strength: DataFrame) -> DataFrame:
    """Class of all securities tied at the top: duplicated ids, ISINs, equal or distinct names."""
    kind = (
        F.when(F.col("tied_ids") < F.col("top_tied_candidate_count"), "duplicate_security_id")
        .when(F.col("tied_isins") < F.col("tied_filled_isins"), "duplicate_isin")
        .when(F.col("tied_names") == 1, "same_normalized_name_distinct_security")
        .otherwise("distinct_normalized_names")
    )
    return strength.filter("top_score_tied").select(
        "cik", kind.alias("tie_composition"), "top_tied_candidate_count"
    )


def tie_collapse_keys(strength: DataFrame) -> DataFrame:
    """Which keys (name, ISIN) would merge the securities tied at the top, over all of them."""
    tied, names = F.col("top_tied_candidate_count"), F.col("tied_names")
    filled, isins = F.col("tied_filled_isins"), F.col("tied_isins")
    return strength.filter("top_score_tied").select(
        "cik",
        tied.alias("tied_count"),
        names.alias("unique_normalized_names"),
        filled.alias("nonempty_isin_count"),
        isins.alias("unique_nonempty_isins"),
        (names == 1).alias("all_same_name"),
        (filled > isins).alias("has_duplicate_isin"),
        ((filled > 0) & (isins == 1)).alias("all_nonempty_isins_same"),
        ((names == 1) & (isins > 1)).alias("same_name_distinct_isins"),
        ((names > 1) & (filled > isins)).alias("different_names_shared_isin"),
        (filled < tied).alias("missing_isin_in_tie"),
    )


def tie_collapse_report(keys: DataFrame) -> DataFrame:
    return keys.agg(
        F.count(F.lit(1)).alias("tied_issuers"),
        F.count_if("all_same_name").alias("all_same_normalized_name"),
        F.count_if("all_nonempty_isins_same").alias("all_nonempty_isins_same"),
        F.count_if("same_name_distinct_isins").alias("same_name_distinct_isins"),
        F.count_if("different_names_shared_isin").alias("different_names_shared_isin"),
        F.count_if("missing_isin_in_tie").alias("ties_with_missing_isin"),
        F.count_if("has_duplicate_isin").alias("ties_with_duplicate_isin"),
    )


def isin_coverage(universe: DataFrame) -> DataFrame:
    """ISIN coverage per delisted status; an unknown status is its own group."""
    has = F.coalesce(F.trim("isin") != "", F.lit(False))
    return universe.groupBy("is_delisted").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(has).alias("with_isin"),
        F.count_if(~has).alias("without_isin"),
        F.avg(has.cast("double")).alias("coverage_rate"),
    )


def probe_sample(master: DataFrame, n_distressed: int = 50, n_healthy: int = 50) -> DataFrame:
    """Hard distressed issuers and healthy ones with most history, labelled by group."""
    hard = master.filter(is_hard_case()).orderBy(
        F.col("distress_observations").desc(), F.col("observations").desc(), "cik"
    )
    healthy = master.filter(F.col("distress_observations") == 0).orderBy(
        F.col("observations").desc(), "cik"
    )
    return (
        hard.limit(n_distressed)
        .withColumn("probe_group", F.lit("distressed_no_current_ticker"))
        .unionByName(healthy.limit(n_healthy).withColumn("probe_group", F.lit("nondistressed")))
    )


def probe_summary(sample: DataFrame, candidates: DataFrame, prices: DataFrame) -> DataFrame:
    """Resolved and priced companies per probe group, plus the group ``all``.

    ``all`` counts every accepted company, in the sample or not, against the sample size.
    """
    text = lambda c: F.col(c).cast("string")
    accepted = candidates.filter(F.col("decision") == "accepted_identifier").select(
        text("cik").alias("cik"), text("security_id").alias("security_id")
    ).distinct()
    priced = accepted.join(
        prices.select(text("security_id").alias("security_id")).distinct(), "security_id", "left_semi"
    )
    flags = (
        accepted.select("cik").distinct().withColumn("resolved", F.lit(True))
        .join(priced.select("cik").distinct().withColumn("priced", F.lit(True)), "cik", "left")
    )
    members = sample.select(text("cik").alias("cik"), "probe_group").distinct()
    by_group = members.join(flags, "cik", "left").groupBy("probe_group").agg(
        F.count(F.lit(1)).alias("companies"),
        F.count_if("resolved").alias("resolved"),
        F.count_if("priced").alias("priced"),
    )
    totals = (
        members.select("cik", F.lit(True).alias("sampled")).distinct()
        .join(flags, "cik", "full")
        .agg(
            F.count_if("sampled").alias("companies"),
            F.count_if("resolved").alias("resolved"),
            F.count_if("priced").alias("priced"),
        )
        .select(F.lit("all").alias("probe_group"), "companies", "resolved", "priced")
    )
    base = F.greatest(F.col("companies"), F.lit(1))
    return by_group.unionByName(totals).withColumns(
        {"resolved_rate": F.col("resolved") / base, "priced_rate": F.col("priced") / base}
    )


def incremental_names(cases: DataFrame, names: DataFrame, filing_names: DataFrame) -> DataFrame:
    """Filing-name keys an issuer's historical names do not have, and era eligibility."""
    key = cik_filing_key(F.col("cik"))
    span = cases.select(key.alias("cik"), "first_filing", "last_filing")

    def keys(table, column):
        pairs = table.filter(F.col(column).isNotNull()).select(
            key.alias("cik"), F.col(column).alias("n")
        )
        keyed = pairs.distinct().withColumn("k", entity_name_key(F.col("n")))
        return keyed.select("cik", "k").distinct()

    frozen, observed = keys(names, "historical_name"), keys(filing_names, "name")
    seen = filing_names.select(key.alias("cik")).distinct().withColumn("fsds_observed", F.lit(True))
    total = observed.groupBy("cik").agg(F.count(F.lit(1)).alias("fsds_name_count"))
    fresh = (
        observed.filter("k <> ''").join(frozen, ["cik", "k"], "left_anti")
        .groupBy("cik").agg(F.count(F.lit(1)).alias("incremental_name_count"))
    )
    out = span.join(seen, "cik", "left").join(total, "cik", "left").join(fresh, "cik", "left")
    eligible = F.col("last_filing") >= F.lit(DATASET_START).cast("date")
    observed_flag = F.coalesce("fsds_observed", F.lit(False))
    return out.select(
        "cik",
        "first_filing",
        "last_filing",
        eligible.alias("fsds_eligible"),
        observed_flag.alias("fsds_observed"),
        F.coalesce("fsds_name_count", F.lit(0)).alias("fsds_name_count"),
        F.coalesce("incremental_name_count", F.lit(0)).alias("incremental_name_count"),
        F.when(~eligible, "out_of_scope")
        .when(observed_flag, "observed")
        .otherwise("eligible_missing")
        .alias("status"),
    )


def incremental_report(detail: DataFrame) -> DataFrame:
    eligible = F.col("fsds_eligible")
    new = eligible & (F.col("incremental_name_count") > 0)
    return detail.agg(
        F.count(F.lit(1)).alias("hard_cases"),
        F.count_if(eligible).alias("eligible"),
        F.count_if(~eligible).alias("out_of_scope"),
        F.count_if(eligible & F.col("fsds_observed")).alias("eligible_observed"),
        F.count_if(eligible & ~F.col("fsds_observed")).alias("eligible_missing"),
        F.try_divide(F.count_if(eligible & F.col("fsds_observed")), F.count_if(eligible)).alias(
            "eligible_coverage"
        ),
        F.count_if(new).alias("with_incremental_names"),
        F.try_divide(F.count_if(new), F.count_if(eligible)).alias("incremental_name_rate"),
    )


def evaluate_candidates(pairs: DataFrame) -> DataFrame:
    """Name score, interval overlap and decision for issuer–security pairs.

    Columns: sec_name, security_name, issuer_start, issuer_end, valid_from, valid_to,
    identifier_evidence.
    """
    from knowndate.functions.names import exact_or_jaccard

    keyed = pairs.withColumns(
        {
            "__a": entity_name_key(F.col("sec_name")),
            "__b": entity_name_key(F.col("security_name")),
        }
    ).withColumn("name_score", exact_or_jaccard(F.col("__a"), F.col("__b")))
    with_overlap = keyed.withColumn(
        "date_overlap",
        intervals_overlap(*[F.col(c) for c in ("issuer_start", "issuer_end", "valid_from", "valid_to")]),
    )
    decision = candidate_decision(
        F.col("name_score"), F.col("date_overlap"), F.col("identifier_evidence")
    )
    return with_overlap.withColumn("decision", decision).drop("__a", "__b")


def intervals_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    known = a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull()
    return F.coalesce(known & (F.greatest(a0, b0) <= F.least(a1, b1)), F.lit(False))


def candidate_decision(score: Column, overlap: Column, identifier: Column) -> Column:
    return (
        F.when(identifier & overlap, "accepted_identifier")
        .when((score >= 0.98) & overlap, "review_exact_name")
        .when((score >= 0.85) & overlap, "review_candidate")
        .otherwise("rejected")
    )


def intersect_identifiers(corroboration: DataFrame, targets: DataFrame) -> DataFrame:
    """CUSIPs seen in several accessions against the CUSIP inside the target's ISIN."""
    need_columns(
        corroboration,
        ["cik", "candidate_security_id", "identifier_type", "identifier", "independent_accessions"],
    )
    need_columns(targets, ["cik", "top_security_id", "isin", "target_priority"])
    t = targets.select(
        "cik",
        F.col("top_security_id").alias("candidate_security_id"),
        "isin",
        "target_priority",
        cusip_from_us_isin(F.col("isin")).alias("candidate_cusip"),
    )
    c = corroboration.filter(
        (F.col("identifier_type") == "CUSIP") & (F.col("independent_accessions") >= 2)
    )
    out = c.join(t, ["cik", "candidate_security_id"], "left")
    relation = identifier_relationship(F.col("identifier"), F.col("candidate_cusip"))
    return out.withColumns(
        {
            "identifier_relationship": relation,
            "identifier_match": relation == "exact",
            "review_status": F.lit("unreviewed"),
        }
    )


def intersection_report(intersection: DataFrame) -> DataFrame:
    """Rows and issuers per relationship, with the total as ``all``."""
    small = intersection.groupBy("identifier_relationship", "cik").agg(F.count(F.lit(1)).alias("n"))
    return small.rollup("identifier_relationship").agg(
        F.grouping("identifier_relationship").alias("g"),
        F.sum("n").alias("rows"),
        F.count_distinct("cik").alias("issuers"),
    ).select(
        F.when(F.col("g") == 1, "all").otherwise(F.col("identifier_relationship")).alias(
            "identifier_relationship"
        ),
        "rows",
        "issuers",
    )
