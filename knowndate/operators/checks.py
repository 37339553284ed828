"""Set-level contracts: a check is a one-row DataFrame, ``require`` makes it fail."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowndate.session import spread

# --- fixed values -----------------------------------------------------------
PRICE_COLUMNS = ["security_id", "date", "close", "volume", "source", "retrieved_at"]
CANDIDATE_COLUMNS = [
    "security_id", "security_name", "valid_from", "valid_to", "source", "source_identifier",
]
MASTER_COLUMNS = [
    "security_id", "issuer_id", "security_name", "valid_from", "valid_to", "source",
    "source_identifier",
]
DELISTING_COLUMNS = [
    "security_id", "delist_date", "delist_code", "delist_return", "source", "source_identifier",
]
MODEL_EVIDENCE_FIELDS = [
    "schema_version", "model", "framework", "code_sha", "data_artifacts", "temporal_split",
    "features", "metrics", "limitations",
]
# ----------------------------------------------------------------------------


def need_columns(df: DataFrame, required: list[str]) -> None:
    """Schema-only check (no job)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def require(check: DataFrame, what: str) -> dict:
    """Eager: run a one-row check and raise unless its column ``passed`` is true."""
    row = check.head()
    result = row.asDict() if row else {}
    if not result.get("passed"):
        raise ValueError(f"{what} failed: {result}")
    return result


def duplicate_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: ``duplicate_key_rows`` beyond the first of each key.

    Counts per key are combined map-side, so one dominant key costs one row per task.
    """
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg(
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_key_rows")
    )


def contract(df: DataFrame, required: list[str], unique: list[str] | None = None) -> DataFrame:
    """One row: row count, null rate per required column, duplicates of the key, ``passed``.

    One aggregation: rows are reduced per key first and the key groups are then summed.
    """
    need_columns(df, required)
    key = unique or []
    per_key = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(c).isNull()).alias(f"__null_{c}") for c in required],
    )
    rows = F.coalesce(F.sum("__n"), F.lit(0))
    out = per_key.agg(
        rows.alias("rows"),
        *[F.try_divide(F.sum(f"__null_{c}"), rows).alias(f"null_rate_{c}") for c in required],
        (F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)) if key else F.lit(0).cast("bigint")).alias(
            "duplicate_key_rows"
        ),
    )
    return out.withColumn("passed", F.col("duplicate_key_rows") == 0)


def price_contract(prices: DataFrame) -> DataFrame:
    """Few prices share a key, so nothing is gained by counting before rows are dealt out."""
    need_columns(prices, PRICE_COLUMNS)
    return contract(spread(prices, "security_id", "date"), PRICE_COLUMNS, ["security_id", "date"])


def candidate_contract(candidates: DataFrame) -> DataFrame:
    return contract(candidates, CANDIDATE_COLUMNS)


def delisting_contract(delistings: DataFrame) -> DataFrame:
    return contract(delistings, DELISTING_COLUMNS, ["security_id", "delist_date"])


def price_plausibility(prices: DataFrame) -> DataFrame:
    """One row: non-positive closes, negative volumes, duplicate (security, date) rows."""
    need_columns(prices, PRICE_COLUMNS)
    per_key = spread(prices, "security_id", "date").groupBy("security_id", "date").agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if(F.col("close") <= 0).alias("__close"),
        F.count_if(F.col("volume") < 0).alias("__volume"),
    )
    out = per_key.agg(
        F.sum("__n").alias("rows"),
        F.sum("__close").alias("non_positive_close"),
        F.sum("__volume").alias("negative_volume"),
        F.sum(F.col("__n") - 1).alias("duplicate_key_rows"),
    )
    bad = F.col("non_positive_close") + F.col("negative_volume") + F.col("duplicate_key_rows")
    return out.withColumn("passed", bad == 0)


def survivorship_gate(
    frame: DataFrame,
    has_market: str = "has_market_data",
    max_positive_drop: float = 0.05,
    max_row_drop: float = 0.25,
    label: str = "distress_12m",
) -> DataFrame:
    """Losing market-less rows must not lose much of the population or of the events."""
    kept = F.coalesce(F.col(has_market), F.lit(False)).cast("double")
    out = frame.agg(
        (1 - F.avg(kept)).alias("row_drop_rate"),
        F.coalesce(1 - F.avg(F.when(F.col(label) == 1, kept)), F.lit(0.0)).alias(
            "positive_drop_rate"
        ),
    )
    return out.withColumns(
        {
            "max_row_drop": F.lit(max_row_drop),
            "max_positive_drop": F.lit(max_positive_drop),
            "passed": (F.col("row_drop_rate") <= max_row_drop)
            & (F.col("positive_drop_rate") <= max_positive_drop),
        }
    )


def same_row_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """Enrichment must not change the population size."""
    counted = before.select(F.lit(1).alias("__b"), F.lit(0).alias("__a")).unionByName(
        after.select(F.lit(0).alias("__b"), F.lit(1).alias("__a"))
    )
    out = counted.agg(
        F.coalesce(F.sum("__b"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("__a"), F.lit(0)).alias("rows_after"),
    )
    return out.withColumn("passed", F.col("rows_before") == F.col("rows_after"))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of the texts whose condition holds (NULL counts as not holding)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]))


def provider_probe_gate(
    probe: DataFrame,
    min_hard_resolution: float = 0.80,
    min_hard_priced: float = 0.70,
    min_overall_priced: float = 0.80,
) -> DataFrame:
    """Thresholds over the probe summary (rows per group plus ``all``)."""
    hard = F.col("probe_group") == "distressed_no_current_ticker"
    companies = F.greatest(F.coalesce(F.max(F.when(hard, F.col("companies"))), F.lit(0)), F.lit(1))
    rate = lambda c: F.coalesce(F.max(F.when(hard, F.col(c))), F.lit(0)) / companies
    out = probe.agg(
        rate("resolved").alias("hard_resolution_rate"),
        rate("priced").alias("hard_priced_rate"),
        F.coalesce(
            F.max(F.when(F.col("probe_group") == "all", F.col("priced_rate"))), F.lit(0.0)
        ).alias("overall_priced_rate"),
    )
    why = reasons(
        (
            F.col("hard_resolution_rate") < min_hard_resolution,
            "insufficient hard-case historical security resolution",
        ),
        (
            F.col("hard_priced_rate") < min_hard_priced,
            "insufficient hard-case historical price coverage",
        ),
        (F.col("overall_priced_rate") < min_overall_priced, "insufficient overall probe price coverage"),
    )
    return out.withColumn("reasons", why).withColumn("passed", F.size("reasons") == 0)


def identifier_promotion(evidence: DataFrame) -> DataFrame:
    """Per evidence row: reasons that block an acceptance review (ISO date texts)."""
    before = (F.col("candidate_valid_from") != "") & (
        F.col("filing_date") < F.col("candidate_valid_from")
    )
    after = (F.col("candidate_valid_to") != "") & (
        F.col("filing_date") > F.col("candidate_valid_to")
    )
    why = reasons(
        (~F.col("identifier_corroborated"), "identifier not independently corroborated"),
        (
            ~F.col("security_context").eqNullSafe("common_equity"),
            "identifier not in explicit common-equity context",
        ),
        (~F.col("cik_matches_filing"), "filing CIK does not match issuer under review"),
        (F.col("ambiguous_identifier"), "identifier evidence is ambiguous"),
        (before, "filing predates candidate validity"),
        (after, "filing postdates candidate validity"),
    )
    return evidence.withColumn("reasons", why).withColumn(
        "eligible_for_security_acceptance_review", F.size("reasons") == 0
    )


def assess_providers(providers: DataFrame) -> DataFrame:
    """Capability table → blockers and warnings per provider."""
    needed = ["historical_delisted", "identifier_history", "provenance", "point_in_time_identifiers"]
    return providers.withColumns(
        {
            "blockers": reasons(*[(~F.col(c), c) for c in needed]),
            "warnings": reasons(
                (~F.col("delisting_returns"), "no explicit delisting returns"),
                (~F.col("corporate_actions"), "no corporate-action feed"),
            ),
        }
    ).withColumn("eligible_for_historical_ablation", F.size("blockers") == 0)


def publication_gate(rights: DataFrame) -> DataFrame:
    """Usage-rights table → whether a public demo is allowed, per provider."""
    why = reasons(
        (~F.col("research_use"), "research use not permitted"),
        (~F.col("public_demo"), "public demo not permitted"),
    )
    return rights.withColumn("blockers", why).withColumns(
        {
            "public_demo_allowed": F.size("blockers") == 0,
            "raw_artifact_publishable": F.col("artifact_redistribution"),
            "derived_features_publishable": F.col("derived_feature_redistribution"),
        }
    )


def model_promotion(evidence: DataFrame) -> DataFrame:
    """Model-evidence table → reasons that block promotion.

    Columns: status, data_artifact_count, has_test_metrics, code_sha,
    limitations_declared, market_model, survivorship_gate_passed,
    current_vintage_macro.
    """
    why = reasons(
        (
            ~F.coalesce(F.col("status").isin("candidate", "promoted"), F.lit(False)),
            "experiment status is not candidate/promoted",
        ),
        (F.coalesce(F.col("data_artifact_count"), F.lit(0)) == 0, "missing frozen data lineage"),
        (~F.col("has_test_metrics"), "missing out-of-time test metrics"),
        (F.coalesce(F.col("code_sha"), F.lit("")) == "", "missing code SHA"),
        (~F.col("limitations_declared"), "limitations not declared"),
        (
            F.col("market_model") & ~F.coalesce(F.col("survivorship_gate_passed"), F.lit(False)),
            "market survivorship gate not passed",
        ),
        (F.col("current_vintage_macro"), "current-vintage macro evidence is exploratory"),
    )
    return evidence.withColumn("reasons", why).withColumn("passed", F.size("reasons") == 0)


def model_evidence_gaps(documents: DataFrame, value: str = "value") -> DataFrame:
    """JSON evidence documents (one per row) → missing top-level fields and ``passed``."""
    fields = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(f) for f in MODEL_EVIDENCE_FIELDS]), fields)
    artifacts = F.size(F.json_object_keys(F.get_json_object(value, "$.data_artifacts")))
    tested = F.get_json_object(value, "$.metrics.test").isNotNull()
    return documents.withColumns(
        {
            "missing_fields": F.array_sort(missing),
            "has_data_artifacts": F.coalesce(artifacts > 0, F.lit(False)),
            "has_test_metrics": tested,
        }
    ).withColumn(
        "passed",
        (F.size("missing_fields") == 0) & F.col("has_data_artifacts") & F.col("has_test_metrics"),
    )


def score_inputs(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: labels binary, probabilities finite and in [0, 1], table not empty."""
    bad_label = ~F.coalesce(F.col(y).isin(0, 1), F.lit(False))
    value = F.col(p)
    bad_p = ~F.coalesce((value >= 0) & (value <= 1) & ~F.isnan(value), F.lit(False))
    out = scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad_label).alias("bad_labels"),
        F.count_if(bad_p).alias("bad_probabilities"),
    )
    return out.withColumn(
        "passed",
        (F.col("rows") > 0) & (F.col("bad_labels") == 0) & (F.col("bad_probabilities") == 0),
    )


def fingerprint(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Order-free digest of a row set: sha256 of count, sum and xor of row hashes."""
    h = F.xxhash64(*columns)
    out = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(h.cast("decimal(38,0)")).alias("__s"),
        F.bit_xor(h).alias("__x"),
    )
    text = F.concat_ws("|", F.col("rows"), F.col("__s").cast("string"), F.col("__x"))
    return out.withColumn("fingerprint", F.sha2(text, 256)).drop("__s", "__x")


def fit_partition_guard(
    scored: DataFrame, columns: list[str], split: str = "split", fitted_on: str = "validation"
) -> DataFrame:
    """One row: the calibration rows exist and differ from the test rows."""
    marks = fingerprint(scored.filter(F.col(split).isin(fitted_on, "test")), columns, [split])
    pick = lambda s: F.max(F.when(F.col(split) == s, F.col("fingerprint")))
    out = marks.agg(pick(fitted_on).alias("fit_fingerprint"), pick("test").alias("test_fingerprint"))
    return out.withColumn(
        "passed",
        F.col("fit_fingerprint").isNotNull()
        & ~F.col("fit_fingerprint").eqNullSafe(F.col("test_fingerprint")),
    )


def ablation_contract(variants: DataFrame, ids: list[str], variant: str = "variant") -> DataFrame:
    """One row: every variant scored the same observation ids."""
    marks = fingerprint(variants, ids, [variant])
    out = marks.agg(
        F.count(F.lit(1)).alias("variants"),
        F.min("rows").alias("min_rows"),
        F.max("rows").alias("max_rows"),
        F.min("fingerprint").alias("__lo"),
        F.max("fingerprint").alias("__hi"),
    )
    return out.withColumns(
        {"primary_metric": F.lit("pr_auc"), "passed": F.col("__lo") == F.col("__hi")}
    ).drop("__lo", "__hi")


def url_escapes(selected: DataFrame, url: str = "url", base: str = "base_url") -> DataFrame:
    """One row: documents whose URL leaves its base folder."""
    prefix = F.concat(F.rtrim(F.col(base), F.lit("/")), F.lit("/"))
    inside = F.coalesce(F.startswith(F.col(url), prefix), F.lit(False))
    out = selected.agg(F.count(F.lit(1)).alias("documents"), F.count_if(~inside).alias("escaped"))
    return out.withColumn("passed", F.col("escaped") == 0)


def require_no_invalid(df: DataFrame, column: str, what: str) -> None:
    """Eager: raise when ``column`` holds NULLs (an unusable key, for example)."""
    check = df.agg(F.count_if(F.col(column).isNull()).alias("invalid"))
    require(check.withColumn("passed", F.col("invalid") == 0), what)
