"""File manifests, snapshot integrity, and sinks."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowndate.sources.streams import blocks, streamed_uri


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and sha256 of files below a folder.

    Empty files are not listed.  Tasks read the files in blocks, so a file may be larger than memory.  Where only Spark
    reaches the store, a file is one binary value of at most two gigabytes.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    name = F.regexp_extract("path", "([^/]+)$", 1).alias("name")
    some = files.select("path").first()
    if some is not None and streamed_uri(some["path"]) is None:
        return files.select(name, "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def digests(batches):
        for batch in batches:
            found = [_digest(path) for path in batch.column("path").to_pylist()]
            yield batch.append_column("sha256", pa.array(found, pa.string()))

    # the listing alone: no content is loaded; one file per task as far as there are tasks
    listed = files.select(name, "path", F.col("length").alias("bytes"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(tasks, F.xxhash64("path")).mapInArrow(
        digests, "name string, path string, bytes long, sha256 string"
    )


def _digest(path: str) -> str:
    digest = hashlib.sha256()
    for block in blocks(path):
        digest.update(block)
    return digest.hexdigest()


def cache_audit(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Expected quarters against the archives present."""
    quarter = F.regexp_extract("name", r"^(\d{4}q[1-4])", 1)
    have = manifest.select(quarter.alias("source_quarter"), "bytes", "sha256")
    return plan.select("source_quarter").join(have, "source_quarter", "left").select(
        "source_quarter",
        (F.coalesce("bytes", F.lit(0)) > 0).alias("cached"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.when(F.col("bytes") > 0, F.col("sha256")).alias("sha256"),
    )


def snapshot_check(manifest: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Archives against their recorded acquisition: digest, size and observation date.

    ``sidecars``: name, value (JSON with sha256, bytes, acquired_utc).  The observation
    cutoff is the UTC date of acquisition.
    """
    meta = F.from_json("value", "sha256 string, bytes bigint, acquired_utc string")
    recorded = sidecars.select("name", meta.alias("m"))
    day = F.try_to_date(F.substring("m.acquired_utc", 1, 10), "yyyy-MM-dd")
    out = manifest.join(recorded, "name", "left").select(
        "name",
        "bytes",
        (F.col("m.sha256").eqNullSafe(F.col("sha256")) & F.col("m.bytes").eqNullSafe(F.col("bytes"))).alias(
            "matches"
        ),
        day.alias("observed_through"),
    )
    return out.withColumn(
        "passed", F.col("matches") & (F.col("bytes") > 0) & F.col("observed_through").isNotNull()
    )


def write_partitioned(df: DataFrame, path: str, filed: str = "filed") -> None:
    """Parquet partitioned by filing year, clustered so that each year gets few files."""
    year = F.year(filed).alias("filed_year")
    rows = df.withColumn("filed_year", year)
    rows.repartition("filed_year", F.pmod(F.xxhash64(*df.columns[:2]), F.lit(64))).write.mode(
        "overwrite"
    ).partitionBy("filed_year").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines with sorted field names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def report_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with sorted field names, nulls kept."""
    fields: list[Column] = [F.col(c) for c in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
