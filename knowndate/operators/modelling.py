"""Rare-event models on Spark ML: preprocessing, training, ablation, batch scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowndate.operators.calibration import probabilities
from knowndate.operators.checks import need_columns
from knowndate.operators.labels import LABEL
from knowndate.operators.metrics import ranking_metrics
from knowndate.operators.sequences import standardized, train_statistics
from knowndate.session import cut_lineage

# --- fixed values -----------------------------------------------------------
BASELINE_FEATURES = [
    "current_ratio", "liabilities_to_assets", "liabilities_to_equity", "roa", "roe",
    "operating_margin", "net_margin", "cash_to_liabilities",
]
LEARNING_RATE = 0.05
MIN_LEAF_ROWS = 40
VALIDATION_SHARE = 0.15
PATIENCE = 25
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Preprocessing:
    """Training-only statistics: (median, mean, deviation) per feature.

    ``indicators`` are the features with gaps in the training rows; each gets a 0/1
    column that is scaled like the others (mean and deviation kept in ``flags``).
    """

    stats: dict[str, tuple[float, float, float]]
    flags: dict[str, tuple[float, float]]

    @property
    def columns(self) -> list[str]:
        return [*self.stats, *[f"{c}__missing" for c in self.flags]]

    def transform(self, frame: DataFrame) -> DataFrame:
        marked = frame.withColumns(
            {
                f"{c}__missing": (F.col(c).isNull().cast("double") - F.lit(mean)) / F.lit(dev)
                for c, (mean, dev) in self.flags.items()
            }
        )
        return standardized(marked, self.stats)


def fit_preprocessing(frame: DataFrame, features: list[str]) -> Preprocessing:
    """Statistics of the rows with ``split = 'train'``. Eager: a few numbers per feature."""
    stats = train_statistics(frame, features)
    train = frame.filter(F.col("split") == "train")
    gaps = train.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in stats]).head()
    flags = {c: (gaps[c], (gaps[c] * (1 - gaps[c])) ** 0.5) for c in stats if 0 < gaps[c] < 1}
    return Preprocessing(stats, flags)


@dataclass(frozen=True)
class Trained:
    """A fitted model with its feature contract."""

    name: str
    model: object
    preprocessing: Preprocessing
    features: list[str]
    config: dict = field(default_factory=dict)

    def predict(self, frame: DataFrame, out: str = "p") -> DataFrame:
        """Score rows; all features must be there."""
        need_columns(frame, self.features)
        ready = self.preprocessing.transform(frame.select("*", *_copies(self.features)))
        vectors = VectorAssembler(
            inputCols=self.preprocessing.columns, outputCol="__features"
        ).transform(ready)
        scored = self.model.transform(vectors).withColumn(out, probabilities("__probability"))
        restored = {c: F.col(f"__raw_{c}") for c in self.features}
        kept = [c for c in frame.columns]
        return scored.withColumns(restored).select(*kept, out)


def _copies(features: list[str]):
    return [F.col(c).alias(f"__raw_{c}") for c in features]


def _training_rows(frame: DataFrame, prep: Preprocessing, weights: dict[int, float]) -> DataFrame:
    ready = prep.transform(frame.filter(F.col("split") == "train"))
    ready = VectorAssembler(inputCols=prep.columns, outputCol="__features").transform(ready)
    weight = F.when(F.col(LABEL) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    return ready.withColumns({"__label": F.col(LABEL).cast("double"), "__weight": weight})


def _train_counts(frame: DataFrame) -> tuple[int, int]:
    row = frame.filter(F.col("split") == "train").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(LABEL).cast("bigint")).alias("tp")
    ).head()
    if not row["tp"] or row["tp"] == row["n"]:
        raise ValueError("training rows need both outcome classes")
    return row["n"], row["tp"]


def train_logistic(frame: DataFrame, features: list[str] = BASELINE_FEATURES) -> Trained:
    """Balanced ridge logistic regression (unit strength, 1000 iterations)."""
    present = [c for c in features if c in frame.columns]
    if not present:
        raise ValueError("no baseline features available")
    n, tp = _train_counts(frame)
    weights = {1: n / (2 * tp), 0: n / (2 * (n - tp))}
    prep = fit_preprocessing(frame, present)
    model = LogisticRegression(
        featuresCol="__features",
        labelCol="__label",
        weightCol="__weight",
        probabilityCol="__probability",
        rawPredictionCol="__raw",
        predictionCol="__prediction",
        regParam=1.0 / n,  # balanced weights add up to n
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
    ).fit(_training_rows(frame, prep, weights))
    return Trained("logistic_regression", model, prep, present, {"train_rows": n})


def train_boosted_tree(
    frame: DataFrame,
    features: list[str] = BASELINE_FEATURES,
    iterations: int = 300,
    depth: int = 5,
    key: str = "adsh",
    patience: int = PATIENCE,
) -> Trained:
    """Gradient-boosted trees with positive weight (1 - prevalence) / prevalence.

    Early stopping watches a share of the training rows chosen by a hash of ``key``, so the choice
    survives recomputation: training ends once their weighted loss has not fallen for ``patience``
    iterations, and the trees after the lowest loss are cut off (see ``_boosted``). A share without rows
    stops nothing. Spark has no L2 term for leaves.
    """
    present = [c for c in features if c in frame.columns]
    n, tp = _train_counts(frame)
    prevalence = tp / n
    weights = {1: (1 - prevalence) / prevalence, 0: 1.0}
    prep = fit_preprocessing(frame, present)
    held_out = F.pmod(F.xxhash64(key), F.lit(10_000)) < int(VALIDATION_SHARE * 10_000)
    rows = cut_lineage(
        _training_rows(frame, prep, weights).select("__features", "__label", "__weight", held_out.alias("__held_out"))
    )
    trees = GBTClassifier(
        featuresCol="__features",
        labelCol="__label",
        weightCol="__weight",
        predictionCol="__prediction",
        stepSize=LEARNING_RATE,
        maxDepth=depth,
        minInstancesPerNode=MIN_LEAF_ROWS,
        seed=42,
    )
    trees = trees.setRawPredictionCol("__raw").setProbabilityCol("__probability")
    model, losses = _boosted(trees, rows, weights, iterations, patience)
    config = {
        "positive_weight": weights[1],
        "iterations": len(losses),
        "kept_iterations": model.getNumTrees,
        "held_out_loss": losses,
    }
    return Trained("gradient_boosting", model, prep, present, config)


def stopping_point(losses: list[float], patience: int) -> tuple[int, bool]:
    """(iterations up to the lowest loss before training ends, whether patience ran out).

    Training ends at the first iteration that is ``patience`` iterations past the lowest loss so far; the earliest of
    equal losses counts.
    """
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def _boosted(trees: GBTClassifier, rows: DataFrame, weights: dict[int, float], iterations: int, patience: int):
    """A fitted ensemble, cut at the lowest held-out loss, and the losses of the iterations looked at.

    Spark can neither wait for a later gain nor go on with a fitted ensemble. So a short ensemble is fitted first and
    twice as long ones while patience lasts: together some two and a half times the longest at most. The loss of all stages comes
    from one pass per class, weighted here because Spark's staged loss has no weights.
    """
    fitting, watched = rows.filter(~F.col("__held_out")), rows.filter("__held_out")
    counts = {int(r["__label"]): r["n"] for r in watched.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    size = min(patience + 1, iterations) if counts else iterations
    while True:
        model = trees.copy().setMaxIter(size).fit(fitting)
        if not counts:
            return model, []
        share = {y: weights[y] * n / sum(weights[k] * m for k, m in counts.items()) for y, n in counts.items()}
        staged = {y: model.evaluateEachIteration(watched.filter(F.col("__label") == y)) for y in counts}
        losses = [sum(share[y] * staged[y][i] for y in counts) for i in range(size)]
        best, ended = stopping_point(losses, patience)
        if ended or size == iterations:
            return _first_trees(model, best), losses[: best + patience]
        size = min(2 * size, iterations)


def _first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble of the first ``n`` trees, with the same columns and parameters."""
    if n >= model.getNumTrees:
        return model
    context = SparkContext.getOrCreate()
    whole, jvm, gateway = model._java_obj, context._jvm, context._gateway
    ml = jvm.org.apache.spark.ml
    kept = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n)
    steps = gateway.new_array(jvm.double, n)
    every = whole.trees()
    for i in range(n):
        kept[i], steps[i] = every[i], float(whole.treeWeights()[i])
    part = ml.classification.GBTClassificationModel(whole.uid(), kept, steps)
    return GBTClassificationModel(whole.copyValues(part, whole.extractParamMap()))


def evaluate(model: Trained, frame: DataFrame) -> DataFrame:
    """Ranking metrics per split."""
    scored = model.predict(frame).withColumn("y", F.col(LABEL))
    return ranking_metrics(scored, by=["split"]).select(
        F.lit(model.name).alias("model"), "*"
    )


def scored_population(model: Trained, frame: DataFrame) -> DataFrame:
    """Rows, positives, ids and usable scores per split: a model must score the population it is judged on, and no other.

    ``id_digest`` adds up 32 bits of the MD5 of each ``adsh``, so it knows neither order nor partitions.
    """
    p = F.col("p")
    digest = F.conv(F.substring(F.md5(F.col("adsh").cast("string")), 1, 8), 16, 10).cast("bigint")
    return model.predict(frame).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(LABEL).cast("bigint")).alias("positives"),
        F.round(F.avg(F.col(LABEL).cast("double")), 8).alias("prevalence"),
        F.sum(digest).alias("id_digest"),
        F.count_if((p > 0) & (p < 1)).alias("scored"),
    )


def macro_ablation(
    frame: DataFrame, financial: list[str], macro: list[str], iterations: int = 300
) -> DataFrame:
    """The same rows and split with financial features and with macro features added."""
    variants = {"financial": financial, "financial_macro": [*financial, *macro]}
    parts = []
    for name, columns in variants.items():
        fitted = train_boosted_tree(frame, columns, iterations)
        parts.append(evaluate(fitted, frame).withColumn("variant", F.lit(name)))
    return parts[0].unionByName(parts[1])


def score_batch(
    model: Trained, values: DataFrame, model_digest: str, carried: list[str] | None = None
) -> DataFrame:
    """Score a feature table under an exact contract.

    Missing or unknown feature names are rejected; ``carried`` names non-feature columns
    that pass through.  Each row carries the digest of the model.
    """
    carried = carried or []
    given = [c for c in values.columns if c not in carried]
    unknown = sorted(set(given) - set(model.features))
    missing = sorted(set(model.features) - set(given))
    if unknown or missing:
        raise ValueError(f"feature contract mismatch: missing={missing}, unknown={unknown}")
    scored = model.predict(values, "distress_12m_probability")
    return scored.select(
        *carried, "distress_12m_probability", F.lit(model_digest).alias("model_sha256")
    )
