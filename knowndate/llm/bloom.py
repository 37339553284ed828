"""A Bloom filter of fixed size, to keep rows out of a shuffle that an exact join then decides.

The table has the same size whatever the input, so sending it to the tasks is bounded; with very many items it lets
more rows through, which costs time and never changes a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowndate.llm.hashing import U

BLOOM_BITS = 1 << 26


def bloom(items: DataFrame) -> np.ndarray:
    """Bits of the hashes in column ``item``: a table of fixed size whatever the input, summed on the map side."""
    place = F.pmod(F.col("item"), F.lit(BLOOM_BITS))
    words = items.select(
        F.shiftright(place, 6).cast("int").alias("w"), F.pmod(place, F.lit(64)).cast("int").alias("b")
    ).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    out = np.zeros(BLOOM_BITS // 64, dtype=np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(U)


def passes(bits: np.ndarray, items: np.ndarray) -> np.ndarray:
    place = np.mod(items.view(np.int64), BLOOM_BITS)
    return (bits[place >> 6] >> (place & 63).astype(U)) & U(1) != 0


def sent(items: DataFrame, column: str) -> Broadcast:
    """The table for the hashes in a column, on all executors."""
    return items.sparkSession.sparkContext.broadcast(bloom(items.select(F.col(column).alias("item"))))


def likely(rows: DataFrame, column: str, bits: Broadcast, wanted: bool = True) -> DataFrame:
    """Rows whose hash in a column may be among the items (or, if not ``wanted``, surely isn't)."""

    def run(batches):
        for batch in batches:
            keys = batch.column(batch.schema.names.index(column)).to_numpy().astype(np.int64)
            mask = passes(bits.value, keys) == wanted
            if mask.any():
                yield batch.filter(pa.array(mask))

    return rows.mapInArrow(run, rows.schema)
