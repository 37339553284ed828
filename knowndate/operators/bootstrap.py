"""Paired issuer-cluster bootstrap of loss differences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowndate.operators.metrics import log_loss_terms
from knowndate.operators.ordered import dense_index, exact_quantiles
from knowndate.session import cut_lineage

#: Multipliers of the 32-bit scrambling, clusters of a block, replicates of a task, what is summed.
MIX = (2246822507, 3266489909)
BLOCK_ROWS, SLICE = 1 << 16, 250
VALUES = ["n", "brier", "log_loss"]


def cluster_sums(
    scored: DataFrame, baseline: float, cluster: str = "cik", y: str = "y", p: str = "p"
) -> DataFrame:
    """Per cluster: rows and summed loss differences (baseline minus model).

    Losses are additive, so these sums are all a resample needs; a cluster with a third
    of all rows is one row from here on.
    """
    label = F.col(y).cast("double")
    base = F.lit(float(baseline))
    brier = F.pow(label - base, F.lit(2)) - F.pow(label - F.col(p), F.lit(2))
    log_loss = log_loss_terms(label, base) - log_loss_terms(label, F.col(p))
    return scored.groupBy(F.col(cluster).cast("string").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(brier).alias("brier"),
        F.sum(log_loss).alias("log_loss"),
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 32-bit numbers, kept in 64 bits."""
    x = (x ^ (x >> np.uint64(16))) * np.uint64(MIX[0]) & np.uint64(0xFFFFFFFF)
    x = (x ^ (x >> np.uint64(13))) * np.uint64(MIX[1]) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def draws_of(seed: int, block: int, replicate: int, count: int, size: int) -> np.ndarray:
    """The places in a block of ``size`` clusters that ``count`` draws of one replicate fall on."""
    start = _mixed(np.array([seed & 0xFFFFFFFF], dtype=np.uint64))
    start = _mixed(_mixed(start ^ np.uint64(block)) ^ np.uint64(replicate))
    return (_mixed(start ^ np.arange(count, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def _block_counts(seed: int, replicate: int, sizes: list[int]) -> np.ndarray:
    """How many draws of a replicate fall into each block; one block takes them all."""
    if len(sizes) == 1:
        return np.array(sizes)
    random = np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, replicate]))
    return random.multinomial(sum(sizes), np.array(sizes) / sum(sizes))


def resampled_sums(sums: DataFrame, sizes: list[int], replicates: int, seed: int, block_rows: int) -> DataFrame:
    """(rep, n, brier, log_loss): summed over the clusters that each replicate draws.

    ``sums`` has a dense index ``idx``.  Blocks of neighbouring clusters are packed into one row each; a task
    draws within a block for a slice of the replicates, so no draw ever leaves it and only one row per block and
    replicate is shuffled.  ``sizes`` (one number per block) tell how many draws fall where.
    """
    block = F.floor(F.col("idx") / block_rows).cast("int")
    rows = F.sort_array(F.collect_list(F.struct("idx", "n", "brier", "log_loss")))  # at most block_rows
    packed = sums.groupBy(block.alias("block")).agg(rows.alias("rows")).select(
        "block", *[F.col(f"rows.{c}").cast("array<double>").alias(c) for c in VALUES]
    )
    starts = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(SLICE)))
    tasks = packed.withColumn("first", starts).repartition("block", "first")

    def draw(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values = np.array([row[c] for c in VALUES])
                reps = range(row["first"], min(row["first"] + SLICE, replicates))
                out = np.zeros((len(reps), len(VALUES)))
                for k, rep in enumerate(reps):
                    count = int(_block_counts(seed, rep, sizes)[row["block"]])
                    at = draws_of(seed, row["block"], rep, count, values.shape[1])
                    out[k] = values[:, at].sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(reps, dtype=np.int64)), *(pa.array(c) for c in out.T)], ["rep", *VALUES]
                )

    drawn = tasks.mapInArrow(draw, "rep long, " + ", ".join(f"{c} double" for c in VALUES))
    return drawn.groupBy("rep").agg(*[F.sum(c).alias(c) for c in VALUES])


def paired_cluster_bootstrap(
    scored: DataFrame,
    baseline: float,
    replicates: int = 10000,
    seed: int = 42,
    cluster: str = "cik",
    y: str = "y",
    p: str = "p",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Point estimate and 95 % interval per metric (``brier``, ``log_loss``).

    Each replicate draws as many clusters as there are, with replacement.  Draws are hashes of
    (seed, block, replicate, draw), so they do not depend on partitioning and a lost executor
    repeats them.  Eager: the sums per cluster are stored and counted.
    """
    if not 0 < baseline < 1:
        raise ValueError("baseline probability must be in (0, 1)")
    sums = cut_lineage(dense_index(cluster_sums(scored, baseline, cluster, y, p), "cluster", "idx"))
    check = sums.agg(
        F.count(F.lit(1)).alias("g"),
        F.count_if(F.col("cluster").isNull() | F.col("cluster").isin("", "unavailable")).alias("bad"),
    ).head()
    if check["bad"]:
        raise ValueError("complete usable cluster keys required")
    clusters = check["g"]
    if clusters < 2:
        raise ValueError("at least two clusters required")
    sizes = [min(block_rows, clusters - at) for at in range(0, clusters, block_rows)]
    drawn = resampled_sums(sums, sizes, replicates, seed, block_rows)
    resampled = cut_lineage(
        drawn.select(
            "rep", (F.col("brier") / F.col("n")).alias("brier"), (F.col("log_loss") / F.col("n")).alias("log_loss")
        ).unpivot(["rep"], ["brier", "log_loss"], "metric", "value")
    )
    q = exact_quantiles(resampled, "value", [0.025, 0.975], ["metric"])
    pick = lambda v: F.max(F.when(F.col("probability") == v, F.col("quantile")))
    bounds = q.groupBy("metric").agg(pick(0.025).alias("lower_95"), pick(0.975).alias("upper_95"))
    wins = resampled.groupBy("metric").agg(
        F.count_if(F.col("value") > 0).alias("replicates_model_better"),
        F.count_if(F.col("value") <= 0).alias("replicates_model_not_better"),
    )
    return point_differences(sums).join(bounds, "metric").join(wins, "metric")


def point_differences(sums: DataFrame) -> DataFrame:
    """Observed mean loss difference per metric with row and cluster counts."""
    total = sums.agg(
        (F.sum("brier") / F.sum("n")).alias("brier"),
        (F.sum("log_loss") / F.sum("n")).alias("log_loss"),
        F.sum("n").alias("test_rows"),
        F.count(F.lit(1)).alias("unique_clusters"),
    )
    return total.unpivot(
        ["test_rows", "unique_clusters"], ["brier", "log_loss"], "metric", "baseline_minus_model"
    )
