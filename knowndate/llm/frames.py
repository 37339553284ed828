"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowndate.session import checkpoint_folder

#: The white space of the contracts: space, tab, line feed, VT, FF and CR. A word is a run of other characters.
BLANKS = "\\x20\\x09-\\x0D"


#: Rows of texts that travel to Python at once; texts can be long, and Spark's default of 10,000 rows has no bound in bytes.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS``; a smaller setting of the caller stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """All words of a text; a NULL text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder, and read back.

    Later passes read the files: nothing is computed twice, and a lost executor takes nothing with it.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int, label: str) -> DataFrame:
    """Written (doc_id, text, label) of at most ``sample_rows`` usable labelled ids, those with the smallest hashes.

    One row per id: several labels count as their largest, of several texts the one with the smallest hash is taken, so
    repeated rows cannot make the sample larger.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(ids), "doc_id")  # at most sample_rows ids
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("first")
    return written(rows.groupBy("doc_id").agg(first).select("doc_id", "first.text", "first.label"))


def shuffle_parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which whoever runs the job sets to fit the data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
