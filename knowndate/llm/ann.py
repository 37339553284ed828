"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred, turned by principal axes and a learned rotation (iterative quantisation) and cut to signs,
64 bits. A code is split into eight substrings; each is a table from value to rows. Codes within Hamming radius R of a
query differ in at most R // 8 bits in one substring at least, so probing all values that near in every table finds
every such code. What is found is reranked by exact double-precision distances.

The radius is fitted: for ``calibration`` queries the true neighbours are found by a full pass, and R is the distance
of codes that covers ``recall`` of them. Queries that find fewer than k rows within R are searched again without a
radius. On vectors without structure the fitted R is large and most buckets are probed; the float distances saved are
then the gain.

Rotation and centre are fitted on a bounded sample (``sample_rows``, smallest hashes); every row is indexed. Equal
vectors are one entry with the k + 1 smallest ids, all that an answer can need, so a vector that a third of all rows
share costs as much as any other. Queries are sent to the rows in blocks of about ``block`` queries; tasks build the
tables over their batch of rows and return at most k + 1 entries a query.

Defined cases: NULL, zero or not finite vectors (and such with NULL components) take no part, nor do rows with a NULL
id or with another dimension than the most frequent one; repeated rows count once; equal distances sort by id; no rows
give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowndate.llm.frames import written

BITS, TABLES = 64, 8
#: Number of differing bits of two bytes, by their exclusive or; and the values within r bits of a value are v ^ near[r].
ONES = np.array([bin(v).count("1") for v in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class Coder:
    centre: np.ndarray
    turn: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """One row of eight bytes per vector."""
        return np.packbits((x - self.centre) @ self.turn > 0, axis=1)


def entries(vectors: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """Written (ids, vec): each distinct usable vector with its k + 1 smallest ids."""
    vec = F.col("vec")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(
        F.col("id").isNotNull() & vec.isNotNull()
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    )
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("vec") == (common.d if common else 0))
    first = rows.withColumn("hash", F.xxhash64("vec")).withColumn(
        "place", F.dense_rank().over(Window.partitionBy("hash", "vec").orderBy("id"))
    ).filter(F.col("place") <= k + 1)
    return written(first.groupBy("hash", "vec").agg(F.sort_array(F.collect_set("id")).alias("ids")))


def learn(rows: DataFrame, sample_rows: int, rounds: int = 30) -> Coder:
    """Principal axes and iterative quantisation on the entries with the smallest hashes."""
    x = np.array([r.vec for r in rows.orderBy("hash").limit(sample_rows).select("vec").collect()])
    centre = x.mean(axis=0)
    x = x - centre
    d = x.shape[1]
    axes = np.linalg.svd(x.T @ x)[0][:, : min(d, BITS)]
    z, random = x @ axes, np.random.default_rng(7)
    turns = []
    while sum(t.shape[1] for t in turns) < BITS:
        turn = np.linalg.qr(random.normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(z @ turn).T @ z)
            turn = (u @ v).T
        turns.append(axes @ turn)
    return Coder(centre, np.concatenate(turns, axis=1)[:, :BITS])


def probed(values: np.ndarray, codes: np.ndarray, radius: int):
    """For each query code the rows of a batch that share a bucket near enough in some table, then within the radius."""
    near = np.flatnonzero(ONES <= min(radius // TABLES, 8)).astype(np.uint8)
    tables = []
    for t in range(TABLES):
        order = np.argsort(values[:, t], kind="stable")
        tables.append((order, np.searchsorted(values[order, t], np.arange(257))))
    for q in range(len(codes)):
        seen = np.zeros(len(values), dtype=bool)
        for t, (order, edge) in enumerate(tables):
            v = (codes[q, t] ^ near).astype(np.int64)
            for a, b in zip(edge[v], edge[v + 1]):
                seen[order[a:b]] = True
        rows = np.flatnonzero(seen)
        apart = ONES[values[rows] ^ codes[q]].sum(axis=1, dtype=np.int64)
        inside = apart <= radius
        yield rows[inside], apart[inside]


def search_block(rows: DataFrame, ids: np.ndarray, x: np.ndarray, coder: Coder, radius: int, k: int) -> DataFrame:
    """(query, ids, score, apart): per task and query the k + 1 nearest entries among those that probing finds."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((ids, x, coder(x)))

    def run(batches):
        ids, x, codes = sent.value
        best: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            if not len(batch):
                continue
            vec = np.array(batch.column(0).flatten().to_numpy()).reshape(len(batch), -1)
            of = batch.column(1).to_pylist()
            first = np.array([i[0] for i in of])
            for q, (at, apart) in enumerate(probed(coder(vec), codes, radius)):
                away = np.sqrt(((vec[at] - x[q]) ** 2).sum(axis=1))
                top = np.lexsort((first[at], away))[: k + 1]
                some = [(float(away[j]), of[at[j]], int(apart[j])) for j in top]
                best[q] = sorted(best[q] + some, key=lambda e: (e[0], e[1][0]))[: k + 1]
        out = [(int(i), e[1], e[0], e[2]) for i, found in zip(ids, best) for e in found]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*out)], ["query", "ids", "score", "apart"]
            )

    return rows.select("vec", "ids").mapInArrow(run, "query long, ids array<long>, score double, apart long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    each = found.select("query", F.explode("ids").alias("vec_id"), "score", "apart").filter("vec_id <> query")
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return each.withColumn("rank", place).filter(F.col("rank") <= k)


def neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    sample_rows: int = 20_000, calibration: int = 64, recall: float = 0.97, block: int = 2048,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest other rows found for each row of ``queries`` (same columns)."""
    rows = entries(vectors, k, id_col, vec_col)
    known = rows.select("hash", F.col("vec").alias("same"))  # only usable vectors can be asked for
    asked = queries.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    asked = asked.join(known, (F.xxhash64("vec") == F.col("hash")) & (F.col("vec") == F.col("same")), "left_semi")
    asked = asked.filter("id is not null").dropDuplicates(["id"])
    asked = written(asked.withColumn("order", F.xxhash64(F.lit("query"), "id")))
    n = asked.count()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    coder = learn(rows, sample_rows)

    def block_of(part: DataFrame):
        got = part.select("id", "vec").collect()  # about ``block`` rows
        return np.array([r.id for r in got]), np.array([r.vec for r in got])

    trial = ranked(search_block(rows, *block_of(asked.orderBy("order").limit(calibration)), coder, BITS, k), k)
    radius = trial.agg(F.percentile("apart", F.lit(recall))).first()[0]  # over at most calibration * k rows
    radius = BITS if radius is None else int(np.ceil(radius))
    blocks = -(-n // block)
    done = []
    for b in range(blocks):
        part = asked.filter(F.pmod("order", F.lit(blocks)) == b)
        ids, x = block_of(part)
        if len(ids):
            done.append(written(ranked(search_block(rows, ids, x, coder, radius, k), k)))
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    few = asked.join(found.groupBy("query").count().filter(F.col("count") >= k), F.col("id") == F.col("query"), "left_anti")
    few = written(few)
    left = few.count()
    for b in range(-(-left // block)):
        ids, x = block_of(few.filter(F.pmod("order", F.lit(-(-left // block))) == b))
        if len(ids):
            again = written(ranked(search_block(rows, ids, x, coder, BITS, k), k))
            found = found.join(again.select("query").distinct(), "query", "left_anti").select(*again.columns).union(again)
    return found.select(
        F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").cast("long"), "score"
    )
