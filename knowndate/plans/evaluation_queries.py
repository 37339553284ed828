"""Queries for metrics, calibration, bootstrap and score contracts.

Scores come from documents joined with their labels: y = toxic, p from the text
length, cluster = source.  ``p`` is rounded to two digits so that many rows tie.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from knowndate.operators import bootstrap, calibration, checks, metrics
from knowndate.operators.ordered import exact_quantiles
from knowndate.plans import bindings as b
from knowndate.plans import sqltext as q
from knowndate.plans.registry import query


def scored(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    y = b.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    p = F.round(F.least(F.col("n_chars") / 20000.0, F.lit(0.99)) + 0.002, 2)
    split = (
        F.when(F.col("doc_id") % 4 == 0, "train")
        .when(F.col("doc_id") % 4 == 1, "validation")
        .otherwise("test")
    )
    return d.join(y, "doc_id").select("doc_id", "source", "lang", "y", p.alias("p"), split.alias("split"))


SCORED = """scored AS (SELECT d.doc_id, d.source, d.lang, l.toxic AS y,
   round(least(d.n_chars / 20000.0, 0.99) + 0.002, 2) AS p,
   CASE d.doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split
   FROM documents d JOIN labels l USING (doc_id))"""

CURVE = f"""{SCORED}, dist AS (SELECT p AS score, count(*) AS n, sum(y) AS tp FROM scored GROUP BY 1),
curve AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(tp) OVER (ORDER BY score DESC) AS ctp,
   sum(n) OVER () AS tn, sum(tp) OVER () AS ttp FROM dist)"""


def _r(name, digits=8):
    return F.round(name, digits).alias(name)


@query(
    "w14_score_curve",
    f"""WITH {CURVE} SELECT score, n, CAST(tp AS BIGINT) AS tp, CAST(cn AS BIGINT) AS n__cum,
    CAST(ctp AS BIGINT) AS tp__cum, CAST(tn AS BIGINT) AS n__total, CAST(ttp AS BIGINT) AS tp__total FROM curve""",
)
def score_curve(spark, sf_dir):
    return metrics.score_curve(scored(spark, sf_dir))


_RANKING = """count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 8) AS prevalence,
  round(avg((p - y) ** 2), 8) AS brier"""


@query(
    "m05_ranking_metrics",
    f"""WITH {CURVE}, pos AS (SELECT p FROM scored WHERE y = 1), neg AS (SELECT p FROM scored WHERE y = 0)
    SELECT {_RANKING},
     (SELECT round(sum(tp * (ctp / cn)) / max(ttp), 8) FROM curve) AS pr_auc,
     (SELECT round(avg(CASE WHEN pos.p > neg.p THEN 1.0 WHEN pos.p = neg.p THEN 0.5 ELSE 0.0 END), 8)
        FROM pos, neg) AS roc_auc FROM scored""",
)
def ranking(spark, sf_dir):
    out = metrics.ranking_metrics(scored(spark, sf_dir))
    return out.select(
        "rows", "positives", _r("prevalence"), _r("pr_auc"), _r("roc_auc"), _r("brier")
    )


@query(
    "m05_ranking_metrics_by_split",
    f"""WITH {SCORED}, dist AS (SELECT split, p AS score, count(*) AS n, sum(y) AS tp FROM scored GROUP BY 1, 2),
     curve AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ctp FROM dist
        WINDOW w AS (PARTITION BY split ORDER BY score DESC))
    SELECT s.split, {_RANKING}, (SELECT round(sum(tp * (ctp / cn)) / sum(tp), 8) FROM curve c
       WHERE c.split = s.split) AS pr_auc FROM scored s GROUP BY s.split""",
)
def ranking_by_split(spark, sf_dir):
    out = metrics.ranking_metrics(scored(spark, sf_dir), by=["split"])
    return out.select("split", "rows", "positives", _r("prevalence"), _r("pr_auc"), _r("brier"))


@query(
    "m06_best_f1",
    f"""WITH {CURVE}, f AS (SELECT score, ctp / cn AS precision, ctp / ttp AS recall FROM curve),
     g AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM f)
    SELECT round(f1, 8) AS f1, round(precision, 8) AS precision, round(recall, 8) AS recall,
      score AS threshold FROM g ORDER BY g.f1 DESC, score LIMIT 1""",
)
def best_f1(spark, sf_dir):
    out = metrics.best_f1(scored(spark, sf_dir))
    return out.select(_r("f1"), _r("precision"), _r("recall"), "threshold")


@query(
    "k05_alert_budget",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, doc_id) AS rn,
       count(*) OVER () AS n, sum(y) OVER () AS tpa FROM scored),
     rates(rate) AS (VALUES (0.001::DOUBLE), (0.005), (0.01), (0.025), (0.05)),
     k AS (SELECT rate, greatest(ceil(rate * (SELECT count(*) FROM scored)), 1)::BIGINT AS k FROM rates)
    SELECT rate, k, CAST(sum(y) AS BIGINT) AS true_positives, round(sum(y) / k, 8) AS precision,
      round(sum(y) / greatest(max(tpa), 1), 8) AS recall,
      round(sum(y) / k / greatest(max(tpa) / max(n), 1e-12), 8) AS lift
    FROM k JOIN r ON r.rn <= k.k GROUP BY rate, k""",
)
def alerts(spark, sf_dir):
    out = metrics.alert_metrics(scored(spark, sf_dir), "doc_id")
    return out.select("rate", "k", "true_positives", _r("precision"), _r("recall"), _r("lift"))


@query(
    "m06_alerts_continuous_scores",
    """WITH s AS (SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
        o_totalprice / 1000000 AS p FROM orders),
     r AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS rn, count(*) OVER () AS n,
        sum(y) OVER () AS tpa FROM s),
     k AS (SELECT rate, greatest(ceil(rate * (SELECT count(*) FROM s)), 1)::BIGINT AS k
        FROM (VALUES (0.01::DOUBLE), (0.05)) t(rate))
    SELECT rate, k, CAST(sum(y) AS BIGINT) AS true_positives, round(sum(y) / k, 8) AS precision,
      round(sum(y) / greatest(max(tpa), 1), 8) AS recall FROM k JOIN r ON r.rn <= k.k GROUP BY rate, k""",
)
def alerts_continuous(spark, sf_dir):
    s = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (F.col("o_totalprice") / 1000000).alias("p"),
    )
    out = metrics.alert_metrics(s, "id", [0.01, 0.05])
    return out.select("rate", "k", "true_positives", _r("precision"), _r("recall"))


@query(
    "m08_log_loss_and_brier",
    f"""WITH {SCORED}, c AS (SELECT *, least(p * 1.1, 1.0) AS p_cal FROM scored)
    SELECT round(avg((p - y) ** 2), 8) AS raw_brier, round(avg((p_cal - y) ** 2), 8) AS calibrated_brier,
     round(avg(-ln(CASE WHEN y = 1 THEN greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)
       ELSE 1 - greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16) END)), 8) AS raw_log_loss,
     round(avg(-ln(CASE WHEN y = 1 THEN greatest(least(p_cal, 1 - 2.220446049250313e-16), 2.220446049250313e-16)
       ELSE 1 - greatest(least(p_cal, 1 - 2.220446049250313e-16), 2.220446049250313e-16) END)), 8) AS calibrated_log_loss
    FROM c""",
)
def losses(spark, sf_dir):
    c = scored(spark, sf_dir).withColumn("p_cal", F.least(F.col("p") * 1.1, F.lit(1.0)))
    out = calibration.calibration_report(c)
    return out.select(*[_r(n) for n in out.columns])


@query(
    "m09_reliability_bins",
    f"""WITH {SCORED}, g AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS rows,
       avg(p) AS mp, avg(y) AS er FROM scored GROUP BY 1)
    SELECT i AS bin, i / 10 AS lower, (i + 1) / 10 AS upper, COALESCE(rows, 0) AS rows,
      round(mp, 8) AS mean_probability, round(er, 8) AS event_rate
    FROM range(10) t(i) LEFT JOIN g ON g.bin = t.i""",
)
def bins(spark, sf_dir):
    out = calibration.reliability_bins(scored(spark, sf_dir))
    return out.withColumns(
        {"mean_probability": _r("mean_probability"), "event_rate": _r("event_rate")}
    )


@query(
    "m10_quantile_bins",
    f"""WITH {SCORED}, e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS edges FROM scored),
     i AS (SELECT s.*, len(list_filter(edges[2:len(edges)-1], lambda x: x <= s.p)) AS bin, edges FROM scored s, e)
    SELECT bin, round(edges[bin + 1], 8) AS lower, round(edges[bin + 2], 8) AS upper, count(*) AS rows,
      CAST(sum(y) AS BIGINT) AS positives, round(avg(p), 8) AS mean_probability, round(avg(y), 8) AS event_rate,
      'ok' AS status FROM i GROUP BY bin, edges""",
)
def qbins(spark, sf_dir):
    out = calibration.quantile_bins(scored(spark, sf_dir)).filter("rows > 0")
    return out.select(
        "bin", _r("lower"), _r("upper"), "rows", "positives", _r("mean_probability"),
        _r("event_rate"), "status",
    )


@query(
    "m01_exact_quantiles",
    """WITH l AS (SELECT l_returnflag AS flag, l_extendedprice AS v FROM lineitem),
     q AS (SELECT flag, unnest([0.025, 0.25, 0.5, 0.75, 0.975]) AS probability,
       unnest(quantile_cont(v, [0.025, 0.25, 0.5, 0.75, 0.975])) AS quantile FROM l GROUP BY flag)
    SELECT flag, CAST(probability AS DOUBLE) AS probability, round(quantile, 6) AS quantile FROM q""",
)
def quantiles(spark, sf_dir):
    line = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v")
    )
    out = exact_quantiles(line, "v", [0.025, 0.25, 0.5, 0.75, 0.975], ["flag"])
    return out.select("flag", "probability", _r("quantile", 6))


@query(
    "m11_calibration_offset",
    f"""WITH RECURSIVE {SCORED}, z AS (SELECT y, ln(q / (1 - q)) AS z FROM (SELECT y,
        least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM scored)),
     it(i, lo, hi) AS (SELECT 0, -40.0::DOUBLE, 40.0::DOUBLE UNION ALL
       SELECT i + 1, CASE WHEN s > 0 THEN (lo + hi) / 2 ELSE lo END,
              CASE WHEN s > 0 THEN hi ELSE (lo + hi) / 2 END
       FROM (SELECT i, lo, hi, (SELECT sum(y - 1 / (1 + exp(-(z + (lo + hi) / 2)))) FROM z) AS s
             FROM it WHERE i < 55))
    SELECT round((lo + hi) / 2, 7) AS intercept_only_offset FROM it WHERE i = 55""",
)
def offset(spark, sf_dir):
    value = calibration.calibration_offset(scored(spark, sf_dir))
    row = [(None if value is None else round(value, 7),)]
    return spark.createDataFrame(row, "intercept_only_offset double")


def _counts_sql(rows: str, clip: float, score: str = "p") -> str:
    """(score, z, n, tp) per distinct score of ``rows``."""
    return f"""SELECT score, ln(q / (1 - q)) AS z, n, tp FROM (SELECT {score} AS score,
     least(greatest({score}, {clip}), 1 - {clip}) AS q, count(*) AS n, sum(y) AS tp FROM {rows} GROUP BY 1, 2)"""


_EVEN = "SELECT ln(sum(tp) / (sum(n) - sum(tp))), 0.0::DOUBLE FROM"

_PLATT = f"""{SCORED}, val AS (SELECT * FROM scored WHERE split = 'validation'), pv AS ({_counts_sql("val", 1e-6)}),
 {q.newton("platt", "pv", f"{_EVEN} pv", 1.0)},
 tst AS (SELECT doc_id, y, p, 1 / (1 + exp(-(a + b * ln(q / (1 - q))))) AS p_cal
   FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM scored WHERE split = 'test'), platt WHERE i = 40)"""


@query("m07_platt_calibration", f"WITH RECURSIVE {_PLATT} SELECT doc_id, y, p, round(p_cal, 6) AS p_cal FROM tst")
def platt(spark, sf_dir):
    s = scored(spark, sf_dir)
    fitted = calibration.Calibrator("platt").fit(s.filter("split = 'validation'"))
    out = fitted.transform(s.filter("split = 'test'"))
    return out.select("doc_id", "y", "p", F.round("p_cal", 6).alias("p_cal"))


@query(
    "m07_isotonic_calibration",
    f"""WITH {SCORED}, d AS (SELECT p AS x, count(*) AS n, sum(y) AS tp FROM scored WHERE split = 'validation' GROUP BY 1),
     c AS (SELECT x, sum(n) OVER w AS cn, sum(tp) OVER w AS ct, sum(n) OVER w - n AS bn, sum(tp) OVER w - tp AS bt FROM d WINDOW w AS (ORDER BY x)),
     least_from AS (SELECT k.x, a.x AS start, min((e.ct - a.bt) / (e.cn - a.bn)) AS v FROM c k JOIN c a ON a.x <= k.x JOIN c e ON e.x >= k.x GROUP BY 1, 2),
     iso AS (SELECT x, max(v) AS v FROM least_from GROUP BY x),
     near AS (SELECT doc_id, y, p, (SELECT max(x) FROM iso WHERE x <= p) AS lo, (SELECT min(x) FROM iso WHERE x >= p) AS hi
       FROM scored WHERE split = 'test')
    SELECT doc_id, y, p, round(CASE WHEN lo IS NULL OR lo = hi THEN h.v WHEN hi IS NULL THEN l.v
      ELSE l.v + (h.v - l.v) * (p - lo) / (hi - lo) END, 6) AS p_cal
    FROM near LEFT JOIN iso l ON l.x = lo LEFT JOIN iso h ON h.x = hi""",
)
def isotonic(spark, sf_dir):
    s = scored(spark, sf_dir)
    fitted = calibration.Calibrator("isotonic").fit(s.filter("split = 'validation'"))
    out = fitted.transform(s.filter("split = 'test'"))
    return out.select("doc_id", "y", "p", F.round("p_cal", 6).alias("p_cal"))


def _rows_sql(section: str, numbers: dict[str, str], source: str) -> str:
    """One row per named number of a one-row source."""
    structs = ", ".join(f"struct_pack(m := '{k}', v := CAST({v} AS DOUBLE))" for k, v in numbers.items())
    return f"SELECT {section} AS section, t.m AS metric, t.v AS value FROM (SELECT unnest([{structs}]) AS t{', kind' if 'kind' in section else ''} FROM {source})"


def _diagnosis_sql(rows: str) -> str:
    """CTEs of the fits on ``rows`` (score, y), and ``diag``: one row of all numbers."""
    return f"""dg AS ({_counts_sql(rows, 1e-12, "score")}), {q.newton("joint", "dg", f"{_EVEN} dg")},
 {q.newton("shift", "dg", "SELECT 0.0::DOUBLE, 1.0::DOUBLE", free_slope=False)},
 dcurve AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ctp FROM dg WINDOW w AS (ORDER BY score DESC)),
 diag AS (SELECT (SELECT sum(n) FROM dg) AS rows, (SELECT sum(tp) / sum(n) FROM dg) AS prevalence,
   (SELECT sum(tp * (ctp / cn)) / sum(tp) FROM dcurve) AS ap, (SELECT a FROM shift WHERE i = 40) AS shift, a, b FROM joint WHERE i = 40)"""


_DIAGNOSIS = {
    "rows": "rows", "prevalence": "prevalence", "average_precision": "ap", "average_precision_over_prevalence": "ap / prevalence",
    "calibration_in_the_large": "shift", "intercept": "a", "slope": "b", "max_abs_mean_score": "0",
}


@query(
    "m12_calibration_diagnostics",
    f"""WITH RECURSIVE {SCORED}, sc AS (SELECT p AS score, y FROM scored), {_diagnosis_sql("sc")}
    SELECT metric, round(value, 6) AS value, CAST(NULL AS VARCHAR) AS status FROM ({_rows_sql("''", _DIAGNOSIS, "diag")})
    UNION ALL SELECT unnest(['calibration_in_the_large_status', 'joint_status', 'status']), NULL, 'ok'""",
)
def diagnostics(spark, sf_dir):
    report = calibration.calibration_diagnostics(scored(spark, sf_dir))
    number = lambda v: isinstance(v, (int, float))
    rows = [(k, round(float(v), 6) if number(v) else None, None if number(v) else v) for k, v in sorted(report.items())]
    return spark.createDataFrame(rows, "metric string, value double, status string")


def _loss_sql(p: str) -> str:
    eps = 2.220446049250313e-16
    return f"avg(-ln(CASE WHEN y = 1 THEN greatest(least({p}, 1 - {eps}), {eps}) ELSE 1 - greatest(least({p}, 1 - {eps}), {eps}) END))"


_QUALITY = {
    **{f"{name}_brier": f"avg(({p} - y) ** 2)" for name, p in (("raw", "p"), ("calibrated", "p_cal"), ("base_rate", "c"))},
    **{f"{name}_log_loss": _loss_sql(p) for name, p in (("raw", "p"), ("calibrated", "p_cal"), ("base_rate", "c"))},
    "oracle_test_base_rate_brier": "avg(y) * (1 - avg(y))",
}
_RANKS = {
    "rows": "sum(n)", "positives": "sum(tp)", "prevalence": "sum(tp) / sum(n)", "pr_auc": "sum(tp * (ctp / cn)) / sum(tp)",
    "roc_auc": "sum(tp * (tn - ttp - cn + ctp + (n - tp) / 2)) / (sum(tp) * (sum(n) - sum(tp)))",
    "brier": "sum(tp * (1 - score) ** 2 + (n - tp) * score ** 2) / sum(n)",
}
_EVIDENCE = f"""{_PLATT}, base AS (SELECT count(*) AS n, sum(y) AS tp FROM val),
 two AS (SELECT 'raw' AS kind, p AS score, y FROM tst UNION ALL SELECT 'calibrated', p_cal, y FROM tst),
 dist AS (SELECT kind, score, count(*) AS n, sum(y) AS tp FROM two GROUP BY ALL),
 curve AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ctp, sum(n) OVER (PARTITION BY kind) AS tn, sum(tp) OVER (PARTITION BY kind) AS ttp
   FROM dist WINDOW w AS (PARTITION BY kind ORDER BY score DESC)),
 cal AS (SELECT p_cal AS score, y FROM tst), {_diagnosis_sql("cal")},
 wide_bins AS (SELECT kind, least(floor(score * 10), 9) AS bin, avg(y) AS v FROM two GROUP BY ALL),
 edges AS (SELECT kind, list_sort(list_distinct(quantile_cont(score, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM two GROUP BY kind),
 q_bins AS (SELECT kind, len(list_filter(e[2:len(e) - 1], lambda x: x <= score)) AS bin, avg(y) AS v FROM two JOIN edges USING (kind) GROUP BY ALL),
 evidence AS ({_rows_sql("'population'", {"validation_rows": "n", "validation_positives": "tp", "baseline_probability": "tp / n"}, "base")}
   UNION ALL {_rows_sql("'diagnostics'", _DIAGNOSIS, "diag")}
   UNION ALL {_rows_sql("'probability_quality'", _QUALITY, "(SELECT *, (SELECT tp / n FROM base) AS c FROM tst)")}
   UNION ALL {_rows_sql("'ranking_' || kind", _RANKS, "curve GROUP BY kind")}
   UNION ALL SELECT 'reliability_' || k.kind, 'bin_' || i, v FROM (SELECT DISTINCT kind FROM two) k CROSS JOIN range(10) t(i) LEFT JOIN wide_bins w ON w.kind = k.kind AND w.bin = i
   UNION ALL SELECT 'quantile_reliability_' || k.kind, 'bin_' || i, v FROM (SELECT kind, unnest(range(greatest(len(e) - 1, 1))) AS i FROM edges) k
     LEFT JOIN q_bins w ON w.kind = k.kind AND w.bin = i)"""


@query("m13_probability_evidence", f"WITH RECURSIVE {_EVIDENCE} SELECT section, metric, round(value, 6) AS value FROM evidence")
def evidence(spark, sf_dir):
    return calibration.probability_evidence(scored(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    "m14_bootstrap_point_estimates",
    f"""WITH {SCORED}, t AS (SELECT *, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS q FROM scored)
    SELECT 'brier' AS metric, count(*) AS test_rows, count(DISTINCT source) AS unique_clusters,
      round(avg((y - 0.12) ** 2 - (y - p) ** 2), 8) AS baseline_minus_model FROM t
    UNION ALL SELECT 'log_loss', count(*), count(DISTINCT source),
      round(avg(-(y * ln(0.12) + (1 - y) * ln(0.88)) + (y * ln(q) + (1 - y) * ln(1 - q))), 8) FROM t""",
)
def bootstrap_points(spark, sf_dir):
    sums = bootstrap.cluster_sums(scored(spark, sf_dir), 0.12, "source")
    out = bootstrap.point_differences(sums)
    return out.withColumn("baseline_minus_model", F.round("baseline_minus_model", 8))


def _mixed_sql(inner: str, x: str, out: str, name: str) -> str:
    """CTEs that scramble a 32-bit number ``x`` of ``inner`` into ``out``."""
    one, two = bootstrap.MIX
    return f"""{name}1 AS (SELECT *, xor({x}, {x} >> 16) * {one} % 4294967296 AS x1 FROM {inner}),
 {name}2 AS (SELECT *, xor(x1, x1 >> 13) * {two} % 4294967296 AS x2 FROM {name}1),
 {name} AS (SELECT * EXCLUDE (x1, x2), xor(x2, x2 >> 16) AS {out} FROM {name}2)"""


_REPLICATES = 10_000


@query(
    "m14_cluster_bootstrap",
    f"""WITH {SCORED}, t AS (SELECT *, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS q FROM scored),
     k AS (SELECT source AS cluster, count(*) AS n, sum((y - 0.12) ** 2 - (y - p) ** 2) AS brier,
       sum(-(y * ln(0.12) + (1 - y) * ln(0.88)) + (y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss FROM t GROUP BY 1),
     placed AS (SELECT *, row_number() OVER (ORDER BY {q.crc32("cluster")} % 1024, cluster) - 1 AS idx FROM k),
     s AS (SELECT CAST(42 AS UBIGINT) AS seed), {_mixed_sql("s", "seed", "h0", "sa")}, {_mixed_sql("sa", "h0", "h1", "sb")},
     reps AS (SELECT rep, xor(h1, CAST(rep AS UBIGINT)) AS r FROM sb, range({_REPLICATES}) t(rep)), {_mixed_sql("reps", "r", "h2", "sc")},
     draws AS (SELECT rep, xor(h2, CAST(d AS UBIGINT)) AS u FROM sc, (SELECT unnest(range(count(*))) AS d FROM k)), {_mixed_sql("draws", "u", "h3", "sd")},
     res AS (SELECT rep, sum(brier) / sum(n) AS brier, sum(log_loss) / sum(n) AS log_loss
       FROM sd JOIN placed ON idx = h3 % (SELECT count(*) FROM k) GROUP BY rep),
     long AS (UNPIVOT res ON brier, log_loss INTO NAME metric VALUE v),
     point AS (UNPIVOT (SELECT sum(brier) / sum(n) AS brier, sum(log_loss) / sum(n) AS log_loss FROM k) ON brier, log_loss INTO NAME metric VALUE v)
    SELECT metric, (SELECT CAST(sum(n) AS BIGINT) FROM k) AS test_rows, (SELECT count(*) FROM k) AS unique_clusters,
      round(any_value(point.v), 8) AS baseline_minus_model, round(quantile_cont(long.v, 0.025), 8) AS lower_95,
      round(quantile_cont(long.v, 0.975), 8) AS upper_95, count(*) FILTER (WHERE long.v > 0) AS replicates_model_better,
      count(*) FILTER (WHERE long.v <= 0) AS replicates_model_not_better
    FROM long JOIN point USING (metric) GROUP BY metric""",
)
def cluster_bootstrap(spark, sf_dir):
    out = bootstrap.paired_cluster_bootstrap(scored(spark, sf_dir), 0.12, _REPLICATES, seed=42, cluster="source")
    return out.withColumns({c: F.round(c, 8) for c in ("baseline_minus_model", "lower_95", "upper_95")})


_RUN = """runs AS (SELECT lang, round(avg(y), 6) AS pr_auc, round(max(p), 6) AS lift,
   round(avg(p), 6) AS roc_auc FROM scored GROUP BY source, lang)"""


@query(
    "a25_run_spread",
    f"""WITH {SCORED}, {_RUN}, long AS (UNPIVOT (SELECT pr_auc, lift, roc_auc FROM runs) ON pr_auc, lift, roc_auc
      INTO NAME metric VALUE v)
    SELECT metric, round(median(v), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max,
      round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3,
      (SELECT count(*) FROM runs) AS runs, TRUE AS passed FROM long GROUP BY metric""",
)
def run_spread(spark, sf_dir):
    runs = scored(spark, sf_dir).groupBy("source", "lang").agg(
        F.round(F.avg("y"), 6).alias("pr_auc"),
        F.round(F.max("p"), 6).alias("lift"),
        F.round(F.avg("p"), 6).alias("roc_auc"),
    )
    runs = runs.withColumns({"status": F.lit("ok"), "population": F.lit("all")})
    out = metrics.run_spread(runs, ["pr_auc", "lift", "roc_auc"])
    return out.select(
        "metric", *[F.round(c, 6).alias(c) for c in ("median", "min", "max", "q1", "q3")],
        "runs", "passed",
    )


@query(
    "g13_score_inputs",
    f"""WITH {SCORED} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS bad_labels,
      count(*) FILTER (WHERE p * 2 > 1) AS bad_probabilities,
      count(*) FILTER (WHERE p * 2 > 1) = 0 AS passed FROM scored""",
)
def inputs(spark, sf_dir):
    return checks.score_inputs(scored(spark, sf_dir).withColumn("p", F.col("p") * 2))


@query(
    "g14_fit_partition_guard",
    f"""WITH {SCORED} SELECT count(*) FILTER (WHERE split = 'validation') > 0 AS passed FROM scored""",
)
def guard(spark, sf_dir):
    return checks.fit_partition_guard(scored(spark, sf_dir), ["doc_id", "y", "p"]).select("passed")


@query(
    "g15_ablation_contract",
    f"""WITH {SCORED} SELECT CAST(2 AS BIGINT) AS variants, count(*) AS min_rows, count(*) AS max_rows,
      'pr_auc' AS primary_metric, TRUE AS passed FROM scored""",
)
def ablation(spark, sf_dir):
    s = scored(spark, sf_dir).select("doc_id", "y")
    both = s.withColumn("variant", F.lit("financial")).unionByName(
        s.withColumn("variant", F.lit("financial_macro"))
    )
    return checks.ablation_contract(both, ["doc_id", "y"])


@query(
    "g15_ablation_contract_unequal",
    f"""WITH {SCORED} SELECT CAST(2 AS BIGINT) AS variants, count(*) FILTER (WHERE doc_id % 10 <> 0) AS min_rows, count(*) AS max_rows,
      'pr_auc' AS primary_metric, FALSE AS passed FROM scored""",
)
def ablation_unequal(spark, sf_dir):
    """The second variant was scored on fewer rows."""
    s = scored(spark, sf_dir).select("doc_id", "y")
    both = s.withColumn("variant", F.lit("financial")).unionByName(
        s.filter("doc_id % 10 <> 0").withColumn("variant", F.lit("financial_macro"))
    )
    return checks.ablation_contract(both, ["doc_id", "y"])


@query(
    "f18_logits",
    f"""WITH {SCORED}, q AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0.0 WHEN doc_id % 10 = 1 THEN 1.0 ELSE p END AS p FROM scored),
     c AS (SELECT doc_id, least(greatest(p, 1e-12), 1 - 1e-12) AS a, least(greatest(p, 1e-6), 1 - 1e-6) AS b FROM q)
    SELECT doc_id, round(ln(a / (1 - a)), 6) AS logit, round(ln(b / (1 - b)), 6) AS platt_logit FROM c""",
)
def logits(spark, sf_dir):
    """Also scores of exactly 0 and 1, which the clips keep finite."""
    last = F.col("doc_id") % 10
    q = scored(spark, sf_dir).withColumn("p", F.when(last == 0, 0.0).when(last == 1, 1.0).otherwise(F.col("p")))
    return q.select(
        "doc_id",
        F.round(calibration.logit(F.col("p")), 6).alias("logit"),
        F.round(calibration.logit(F.col("p"), calibration.PLATT_CLIP), 6).alias("platt_logit"),
    )
