"""Queries that train and apply models on the bound cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowndate.operators import labels, macro, modelling, sequences
from knowndate.plans import bindings as b
from knowndate.plans.registry import query
from knowndate.session import cut_lineage

FEATURES = ["liabilities_to_assets", "roa", "net_margin"]
MACRO = ["treasury_3m", "cpi_yoy"]


def modelling_frame(spark, sf_dir):
    from knowndate.operators.cohort import add_ratios

    labelled = labels.label_forward(
        b.wide_facts(spark, sf_dir), b.distress_events(spark, sf_dir), observed_through=b.CUTOFF
    )
    rows = labels.modelling_population(add_ratios(labelled))
    return labels.temporal_split(rows, b.TRAIN_END, b.VALIDATION_END).select(
        "cik", "adsh", "filed", "split", labels.LABEL, *FEATURES
    )


_FRAME = f"""{b.WIDE}, {b.EVENTS}, lab AS (SELECT w.*, (SELECT min(e.event_date) FROM ev e WHERE e.cik = w.cik AND e.event_date > w.filed) AS nxt FROM wide w),
 mf AS (SELECT adsh, {b.SPLIT_SQL} AS split, liabilities / NULLIF(assets, 0) AS liabilities_to_assets, net_income / NULLIF(assets, 0) AS roa,
   net_income / NULLIF(revenue, 0) AS net_margin FROM lab WHERE filed + 365 <= DATE '{b.CUTOFF}')"""


@query(
    "m01_train_statistics",
    f"""WITH {_FRAME}, l AS (FROM (SELECT split, liabilities_to_assets, roa, net_margin FROM mf) UNPIVOT INCLUDE NULLS (v FOR feature IN (liabilities_to_assets, roa, net_margin))),
     m AS (SELECT feature, median(v) AS med FROM l WHERE split = 'train' GROUP BY 1)
    SELECT feature, round(max(med), 8) AS median, round(avg(COALESCE(v, med)), 8) AS mean, round(stddev_pop(COALESCE(v, med)), 8) AS deviation
    FROM l JOIN m USING (feature) WHERE split = 'train' GROUP BY 1""",
)
def statistics(spark, sf_dir):
    stats = sequences.train_statistics(cut_lineage(modelling_frame(spark, sf_dir)), FEATURES)
    rows = [(c, round(m, 8), round(a, 8), round(s, 8)) for c, (m, a, s) in stats.items()]
    return spark.createDataFrame(rows, "feature string, median double, mean double, deviation double")


@query(
    "m01_standardized_features",
    f"""WITH {_FRAME}, s AS (SELECT median(roa) AS med FROM mf WHERE split = 'train'),
     t AS (SELECT avg(COALESCE(roa, med)) AS mean, stddev_pop(COALESCE(roa, med)) AS dev FROM mf, s WHERE split = 'train')
    SELECT adsh, round((COALESCE(roa, med) - mean) / dev, 6) AS roa FROM mf, s, t""",
)
def scaled(spark, sf_dir):
    frame = cut_lineage(modelling_frame(spark, sf_dir))
    out = sequences.standardized(frame, sequences.train_statistics(frame, ["roa"]))
    return out.select("adsh", F.round("roa", 6).alias("roa"))


@query("m02_logistic_baseline")
def logistic(spark, sf_dir):
    frame = cut_lineage(modelling_frame(spark, sf_dir))
    return modelling.evaluate(modelling.train_logistic(frame, FEATURES), frame)


@query("m03_boosted_tree")
def boosted(spark, sf_dir):
    frame = cut_lineage(modelling_frame(spark, sf_dir))
    return modelling.evaluate(modelling.train_boosted_tree(frame, FEATURES), frame)


_POPULATION = f"""WITH {b.WIDE}, {b.EVENTS}, lab AS (SELECT w.*, (SELECT min(e.event_date) FROM ev e WHERE e.cik = w.cik AND e.event_date > w.filed) AS nxt FROM wide w)
 SELECT {b.SPLIT_SQL} AS split, count(*) AS rows, CAST(count(*) FILTER (nxt <= filed + 365) AS BIGINT) AS positives,
   round(count(*) FILTER (nxt <= filed + 365) / count(*), 8) AS prevalence,
   CAST(sum(('0x' || substr(md5(CAST(adsh AS VARCHAR)), 1, 8))::BIGINT) AS BIGINT) AS id_digest, count(*) AS scored
 FROM lab WHERE filed + 365 <= DATE '{b.CUTOFF}' GROUP BY 1"""


@query("m02_scored_population", _POPULATION)
def logistic_population(spark, sf_dir):
    frame = cut_lineage(modelling_frame(spark, sf_dir))
    return modelling.scored_population(modelling.train_logistic(frame, FEATURES), frame)


@query("m03_scored_population", _POPULATION)
def boosted_population(spark, sf_dir):
    frame = cut_lineage(modelling_frame(spark, sf_dir))
    return modelling.scored_population(modelling.train_boosted_tree(frame, FEATURES), frame)


@query("m04_macro_ablation")
def ablation(spark, sf_dir):
    frame = modelling_frame(spark, sf_dir)
    with_macro = macro.attach_macro(frame, macro.macro_features(b.macro(spark, sf_dir)))
    with_macro = cut_lineage(with_macro)
    return modelling.macro_ablation(with_macro, FEATURES, MACRO)


@query("m15_batch_scoring")
def scoring(spark, sf_dir):
    frame = cut_lineage(modelling_frame(spark, sf_dir))
    fitted = modelling.train_logistic(frame, FEATURES)
    values = frame.filter("split = 'test'").select("adsh", *FEATURES)
    out = modelling.score_batch(fitted, values, "digest", ["adsh"])
    return out.withColumn("distress_12m_probability", F.round("distress_12m_probability", 6))
