"""From raw documents to packed training sequences, one written stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowndate.llm import jaccard_join, mixing, packing, secret_scan, toxicity
from knowndate.llm.frames import table, written

ORACLE_SQL = None  # trained models and tokenizers are not SQL; tests hold the stages against brute force


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier scores below 0.3."""
    usable = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable)
    return toxicity.score(docs, model).filter("score < 0.3").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle sets linked at a Jaccard similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, jaccard_join.Likeness(words=5, at_least=80))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


#: Toxic text is gone by then: the domains are those of quality alone.
DOMAINS = ["good", "poor"]
TARGETS = {"good": 0.9, "poor": 0.1}


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their rates; each whose most likely domain is good is kept once at least."""
    model = mixing.train(docs, mixing.quality_domains(table(spark, sf_dir, "labels")), DOMAINS)
    mixed = written(mixing.with_posteriors(docs.select("doc_id", "text"), model).drop("text"))
    steps = mixing.fit_rates(mixed, DOMAINS, TARGETS, keep=("good", 1.05), whole="good")
    rows = mixing.with_rates(mixing.with_posteriors(docs, model), steps)
    return mixing.repeated(rows).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length token sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mixing", mix_domains),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
