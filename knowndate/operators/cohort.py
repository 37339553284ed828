"""Quarterly submissions and numeric facts → one wide row per filing with ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowndate.functions.keys import yyyymmdd
from knowndate.operators.labels import LABEL, label_forward, modelling_population, temporal_split
from knowndate.session import spread

# --- fixed values -----------------------------------------------------------
TAG_FEATURES = {
    "Assets": "assets",
    "Liabilities": "liabilities",
    "StockholdersEquity": "equity",
    "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest": "equity",
    "AssetsCurrent": "current_assets",
    "LiabilitiesCurrent": "current_liabilities",
    "CashAndCashEquivalentsAtCarryingValue": "cash",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue",
    "Revenues": "revenue",
    "SalesRevenueNet": "revenue",
    "NetIncomeLoss": "net_income",
    "ProfitLoss": "net_income",
    "OperatingIncomeLoss": "operating_income",
    "NetCashProvidedByUsedInOperatingActivities": "operating_cash_flow",
}
INSTANT_FEATURES = ["assets", "liabilities", "equity", "current_assets", "current_liabilities", "cash"]
DURATION_FEATURES = ["revenue", "net_income", "operating_income", "operating_cash_flow"]
SUBMISSION_COLUMNS = ["adsh", "cik", "name", "sic", "form", "period", "filed", "fy", "fp", "afs"]
FACT_COLUMNS = ["adsh", "tag", "version", "ddate", "qtrs", "uom", "value", "coreg", "segments"]
ELIGIBLE_FORMS = ["10-K", "10-Q", "10-K/A", "10-Q/A"]
TARGET_FORMS = ["10-K", "10-Q"]
RATIOS = {
    "current_ratio": ("current_assets", "current_liabilities"),
    "liabilities_to_assets": ("liabilities", "assets"),
    "liabilities_to_equity": ("liabilities", "equity"),
    "roa": ("net_income", "assets"),
    "roe": ("net_income", "equity"),
    "operating_margin": ("operating_income", "revenue"),
    "net_margin": ("net_income", "revenue"),
    "operating_cf_margin": ("operating_cash_flow", "revenue"),
    "cash_to_liabilities": ("cash", "liabilities"),
}
# The as-of record names two ratios differently.
RECORD_RATIO_NAMES = {
    "liabilities_to_assets": "debt_to_assets_proxy",
    "liabilities_to_equity": "debt_to_equity_proxy",
}
# ----------------------------------------------------------------------------

FEATURES = INSTANT_FEATURES + DURATION_FEATURES


def _is_eligible() -> Column:
    days = [yyyymmdd(F.col(c)) for c in ("filed", "period")]
    known = [c.isNotNull() for c in (F.col("adsh"), F.col("cik"), *days)]
    return F.col("form").isin(ELIGIBLE_FORMS) & known[0] & known[1] & known[2] & known[3]


def eligible_submissions(sub: DataFrame) -> DataFrame:
    """Annual and quarterly reports with usable ids and dates."""
    out = sub.filter(F.col("form").isin(ELIGIBLE_FORMS)).withColumns(
        {"filed": yyyymmdd(F.col("filed")), "period": yyyymmdd(F.col("period"))}
    )
    return out.dropna(subset=["adsh", "cik", "filed", "period"])


def target_forms(sub: DataFrame, forms: list[str] = TARGET_FORMS) -> DataFrame:
    return sub.filter(F.col("form").isin(forms))


def facts_of(num: DataFrame, submissions: DataFrame) -> DataFrame:
    """Only facts of the given submissions (semi join)."""
    return num.join(submissions.select("adsh"), "adsh", "left_semi")


def _is_usable(num: DataFrame) -> Column:
    kept = F.col("tag").isin(list(TAG_FEATURES)) & (F.col("uom") == "USD")
    return kept & (F.coalesce(F.col("coreg"), F.lit("")) == "") if "coreg" in num.columns else kept


def _feature() -> Column:
    return F.create_map(*[F.lit(x) for pair in TAG_FEATURES.items() for x in pair])[F.col("tag")]


def usable_facts(num: DataFrame) -> DataFrame:
    """USD facts of the consolidated entity for mapped tags, with their feature name."""
    return num.filter(_is_usable(num)).withColumns({"feature": _feature(), "ddate": yyyymmdd(F.col("ddate"))})


def canonical_facts(num: DataFrame, submissions: DataFrame) -> DataFrame:
    """Usable facts with the columns of their submission (many-to-one on adsh).

    The right side must be unique per adsh: ``checks.duplicate_rows`` tells.
    """
    meta = [c for c in SUBMISSION_COLUMNS if c in submissions.columns]
    return usable_facts(num).join(submissions.select(*meta), "adsh", "inner")


def _base_form(form: Column) -> Column:
    return F.replace(form, F.lit("/A"), F.lit(""))


def _fits_period(instant: Column, quarters: Column) -> Column:
    base = _base_form(F.col("form"))
    long = ((base == "10-Q") & quarters.isin(1, 2, 3)) | ((base == "10-K") & (quarters == 4))
    return (F.col("ddate") == F.col("period")) & F.when(instant, quarters == 0).otherwise(long)


def period_correct_facts(facts: DataFrame) -> DataFrame:
    """Facts for the filing's own period with a duration that fits the form."""
    quarters = F.col("qtrs").try_cast("int")
    instant, known = F.col("feature").isin(INSTANT_FEATURES), F.col("feature").isin(FEATURES)
    return facts.withColumn("qtrs", quarters).filter(known & _fits_period(instant, quarters))


def _preference(facts: DataFrame) -> Column:
    """Sort key of competing facts: shortest duration, tag A→Z, then defined tie-breaks.

    Ties are left to input order by definition of the data; here the larger value
    wins, then the smaller version text, so that the choice does not flap.
    """
    version = F.col("version") if "version" in facts.columns else F.lit("")
    return F.struct(
        F.col("qtrs"), F.col("tag"), (-F.coalesce(F.col("value"), F.lit(float("-inf")))), version
    )


def best_facts(facts: DataFrame) -> DataFrame:
    """One fact per (adsh, feature): a map-side combined ``min_by``, not a window."""
    chosen = F.min_by(F.struct("tag", "qtrs", "value"), _preference(facts))
    return (
        facts.groupBy("adsh", "feature")
        .agg(chosen.alias("c"))
        .select("adsh", "feature", "c.tag", "c.qtrs", "c.value")
    )


def submission_matrix(facts: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Long facts → one row per filing, one column per feature, in one shuffle.

    The pivot values are given, so no job is needed to find them, and the choice
    among competing facts happens inside the same aggregation.
    """
    index = [c for c in SUBMISSION_COLUMNS if c in facts.columns]
    return (
        facts.groupBy(*index)
        .pivot("feature", features)
        .agg(F.min_by("value", _preference(facts)))
    )


def knowledge_cutoff(frame: DataFrame, as_of: str) -> DataFrame:
    """Only what was filed by ``as_of``; a plain comparison that reaches the scan."""
    return frame.filter(F.col("filed") <= F.lit(as_of).cast("date"))


def last_per_filing(panel: DataFrame) -> DataFrame:
    """Latest row per adsh; among quarters the later source wins.

    ``row_number() = 1`` is limited per map task before the shuffle.
    """
    order = [F.col(c).desc() for c in ("cik", "filed", "source_quarter")]
    w = W.partitionBy("adsh").orderBy(*order)
    return panel.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def _ratio(frame: DataFrame, top: str, bottom: str) -> Column:
    if top not in frame.columns or bottom not in frame.columns:
        return F.lit(None).cast("double")
    return F.try_divide(F.col(top).try_cast("double"), F.col(bottom).try_cast("double"))


def add_ratios(frame: DataFrame) -> DataFrame:
    """Nine ratios; zero denominators and absent inputs give NULL."""
    return frame.withColumns({n: _ratio(frame, a, b) for n, (a, b) in RATIOS.items()})


def add_record_ratios(frame: DataFrame) -> DataFrame:
    """The same ratios over the as-of record of one issuer, under its column names."""
    return frame.withColumns(
        {RECORD_RATIO_NAMES.get(n, n): _ratio(frame, a, b) for n, (a, b) in RATIOS.items()}
    )


def fundamentals(sub: DataFrame, num: DataFrame, forms: list[str] = TARGET_FORMS) -> DataFrame:
    """Submissions and facts of any number of quarters → wide panel with ratios.

    One lazy plan over all quarters; ``source_quarter`` is carried when present.
    """
    chosen = target_forms(eligible_submissions(sub), forms)
    facts = period_correct_facts(canonical_facts(num, chosen))
    panel = submission_matrix(facts)
    if "source_quarter" in sub.columns:
        keys = chosen.groupBy("adsh").agg(F.max("source_quarter").alias("source_quarter"))
        panel = panel.join(keys, "adsh")
    return add_ratios(panel)


def modelling_cohort(
    sub: DataFrame,
    num: DataFrame,
    events: DataFrame,
    observed_through: str,
    train_end: str,
    validation_end: str,
    horizon_days: int = 365,
) -> DataFrame:
    """Raw submissions, facts and events → labelled filings with ratios and their split, as one lazy plan.

    Left out are filings without a usable fact and those whose outcome window is still open.
    """
    panel = fundamentals(sub, num)
    labelled = label_forward(panel, events, horizon_days, observed_through=observed_through)
    return temporal_split(modelling_population(labelled), train_end, validation_end)


def quarter_funnel(sub: DataFrame, num: DataFrame, forms: list[str] = TARGET_FORMS) -> DataFrame:
    """Counts per stage and source quarter, from raw submissions to panel rows.

    Facts are read once and reduced, before they meet their submission, to counts per
    (adsh, period, duration, kind); one aggregate per submission then tells all later stages.
    Facts and submissions are dealt out by adsh once, for the counts, the join and the aggregate.
    Text samples of the raw columns become their smallest and largest value.
    """
    count = F.count(F.lit(1))
    eligible = eligible_submissions(sub)
    raw = sub.groupBy("source_quarter").agg(
        count.alias("raw_submissions"),
        F.count_if(F.col("filed").isNull()).alias("filed_nulls"),
        F.min(F.col("form")).alias("form_min"),
        F.max(F.col("form")).alias("form_max"),
        F.count_if(_is_eligible()).alias("eligible_submissions"),
    )
    chosen = spread(target_forms(eligible, forms).select(*_submission_columns(eligible), "source_quarter"), "adsh")
    usable = F.coalesce(_is_usable(num), F.lit(False))
    kind = F.when(usable, F.col("feature").isin(INSTANT_FEATURES))
    facts = num.withColumn("feature", _feature()).select(
        "adsh",
        kind.alias("instant"),
        F.when(usable, yyyymmdd(F.col("ddate"))).alias("ddate"),
        F.when(usable, F.col("qtrs").try_cast("int")).alias("qtrs"),
    )
    facts = spread(facts, "adsh").groupBy(*facts.columns).agg(count.alias("n"))
    fits = F.coalesce(_fits_period(F.col("instant"), F.col("qtrs")), F.lit(False))
    per_submission = chosen.join(facts, "adsh", "left").groupBy(*chosen.columns).agg(
        F.sum("n").alias("numeric_rows"),
        F.sum(F.when(F.col("instant").isNotNull(), F.col("n"))).alias("canonical_facts"),
        F.max(fits).alias("in_panel"),
    )
    panel_day = F.when(F.col("in_panel"), F.col("filed"))
    stages = per_submission.groupBy("source_quarter").agg(
        count.alias("target_submissions"),
        F.sum("numeric_rows").alias("numeric_rows"),
        F.sum("canonical_facts").alias("canonical_facts"),
        F.count_if("in_panel").alias("panel_rows"),
        F.min(panel_day).alias("panel_filed_min"),
        F.max(panel_day).alias("panel_filed_max"),
    )
    out = raw.join(stages, "source_quarter", "left")
    counts = [c for c in out.columns if c.endswith(("submissions", "rows", "facts"))]
    return out.fillna(0, subset=counts)


def _submission_columns(df: DataFrame) -> list[str]:
    return [c for c in SUBMISSION_COLUMNS if c in df.columns]


def cohort_inventory(
    frame: DataFrame, events: DataFrame, features: list[str] | None = None
) -> DataFrame:
    """One row: size, companies, span, events, modelling population, feature coverage."""
    features = features if features is not None else [c for c in RATIOS if c in frame.columns]
    modelling = F.coalesce(F.col("label_window_complete"), F.lit(False)) & F.col(LABEL).isNotNull()
    per_company = frame.groupBy("cik").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("filed").alias("lo"),
        F.max("filed").alias("hi"),
        F.count_if(modelling).alias("m"),
        F.count_if(modelling & (F.col(LABEL) == 1)).alias("pos"),
        *[F.count(c).alias(f"__{c}") for c in features],
    )
    base = per_company.agg(
        F.sum("n").alias("rows"),
        F.count("cik").alias("companies"),
        F.min("lo").cast("string").alias("start"),
        F.max("hi").cast("string").alias("end"),
        F.sum("m").alias("modelling_rows"),
        F.sum("pos").alias("positive_observations"),
        F.try_divide(F.sum("pos"), F.sum("m")).alias("prevalence"),
        *[F.try_divide(F.sum(f"__{c}"), F.sum("n")).alias(f"coverage_{c}") for c in features],
    )
    counted = events.agg(F.count(F.lit(1)).alias("distress_events"))
    return base.withColumn("__one", F.lit(1)).join(
        counted.withColumn("__one", F.lit(1)), "__one"
    ).drop("__one")
