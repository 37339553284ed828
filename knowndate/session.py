"""Session defaults for tests and benches, lineage cutting for long plans, and how work is spread over tasks."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Partitions of a step whose state in a task grows with its rows, whatever the session's count for other steps.
LEAST_PARTITIONS = 64


def local_session(cpus: int | str | None = None, app: str = "knowndate") -> SparkSession:
    """A local session; on a cluster the caller brings its own session."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, which every cluster has to set.

    Only a single-process session (``local`` or ``local[n]``) that names none gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="knowndate-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, used where one frame feeds several eager passes."""
    sc = df.sparkSession.sparkContext
    folder = checkpoint_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, least: int = LEAST_PARTITIONS) -> DataFrame:
    """Deal rows out by ``keys`` to ``least`` tasks, or to the session's own count if that is larger.

    Aggregations, windows and joins on these keys stay on that partitioning.
    """
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(own, least), *keys)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later steps refer to instead of repeating their expressions.

    Catalyst copies an expression into every filter that it pushes below a projection; it pushes none below a generator.
    """
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(values)))
