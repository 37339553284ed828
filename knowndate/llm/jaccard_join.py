"""N-gram Jaccard join by PartEnum signatures: all links at or above a threshold, and the classes they form.

Sets are distinct word shingles. With Jaccard at least g, two sets of sizes a <= b <= a/g differ in at most
H = (1-g)/(1+g) (a+b) elements. Sizes fall into bands such that linked sets are in the same or in neighbouring bands;
for each such band pair the shingle domain is hashed into k + 1 + t parts, k being the largest H of the band pair. At
most k parts can differ, so linked sets agree on t + 1 parts at least: a signature is a part's number and content.
``t`` is chosen so that hardly any set has more than t empty parts; then one common part isn't empty, and empty parts
need no signature. Sets with more empty parts repeat the scheme under another hash.

Equal sets are one node before anything is joined. A group of nodes with one signature never emits its pairs: each
node meets the group's smallest node, its hub. Then

* each hub is held against its group: pairs whose sizes and parity sketches (a lower bound on the difference, with at
  least two cells an element) allow a link are verified, and the links found make the first classes;
* groups whose nodes are still in several classes are held together, packed in chunks of bounded size: of each pair of
  classes the ``FEW`` pairs with the nearest sketches are verified and the classes joined, then whatever pairs of
  different classes are left. Pairs within a class are never made.

Every candidate is verified on the sets themselves. Nodes and elements are 64-bit hashes; n nodes collide with odds
n*n / 2^65 (three in a hundred for 10^9 different sets).

Shuffles move signatures (two longs), sketches, and the texts and sets of candidates only. Hot signatures, hubs and
classes are pre-aggregated or split by adaptive joins; nothing of the corpus reaches the driver.

Defined cases: a NULL or blank text has an empty set, links with nothing and is a class of its own; repeated rows and
repeated or NULL ids are rows of their own (a class without any id has a NULL ``component_id``); no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowndate.llm.bloom import likely, passes, sent
from knowndate.llm.components import components
from knowndate.llm.frames import written
from knowndate.llm.hashing import K1, K2, K3, U, mix, multipliers, shingle_set, sliced, word_hashes

#: Pairs verified first for two classes of a group, and the bytes of sketches in a chunk of it.
FEW, CHUNK_BYTES = 4, 1 << 17
#: Least cells of a sketch; it has two for each element or more, and is a power of two.
LEAST_CELLS = 512
LEVELS = 5


@dataclass(frozen=True)
class Likeness:
    """Link when ``of * intersection >= at_least * union`` of the ``words``-word shingle sets."""

    words: int = 5
    at_least: int = 80
    of: int = 100

    def most(self, sizes: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes sum to ``sizes``."""
        return (self.of - self.at_least) * sizes // (self.of + self.at_least)

    @property
    def c(self) -> float:
        return (self.of - self.at_least) / (self.of + self.at_least)


@lru_cache(maxsize=8)
def bands(like: Likeness, largest: int) -> list[int]:
    """First size of each band; the last one lies above ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * like.of // like.at_least + 1)
    return edges


@lru_cache(maxsize=4096)
def parts_of(like: Likeness, low: int, high: int) -> tuple[int, int]:
    """Number of parts for smaller sets of ``low`` to ``high`` elements, and how many of them may be empty."""
    k = like.most(high + high * like.of // like.at_least)
    if k == 0:
        return 1, 0
    for spare in range(k + 2):
        n = k + 1 + spare
        mean = n * math.exp(-low / n)  # of empty parts
        if (mean <= 0.02) if spare == 0 else (spare >= mean + 3 * math.sqrt(mean)):
            return n, spare
    return k + 1, 0


def signatures(elements: np.ndarray, like: Likeness) -> np.ndarray:
    """All signatures of one set (sorted distinct hashes)."""
    size = len(elements)
    edges = bands(like, 1 << max(12, size.bit_length()))
    own = int(np.searchsorted(edges, size, side="right")) - 1
    out, seeds = [], multipliers(LEVELS)
    for instance in {own, max(own - 1, 0)}:
        n, spare = parts_of(like, edges[instance], edges[instance + 1] - 1)
        tag = mix(np.array([instance], dtype=U))[0]
        if n == 1:
            out.append(mix(np.array([mix(elements).sum(dtype=U) ^ tag], dtype=U)))
            continue
        for level in range(LEVELS):
            seeded = mix(elements ^ seeds[level])
            part = (seeded % U(n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, seeded = part[order], seeded[order]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            sums = np.add.reduceat(mix(seeded ^ K1), first)
            number = part[first].astype(U)
            empty = n - len(first)
            if level == LEVELS - 1 and empty:
                number = np.concatenate([number, np.setdiff1d(np.arange(n), part[first]).astype(U)])
                sums = np.concatenate([sums, np.zeros(empty, dtype=U)])
            out.append(mix(mix(sums + number * K3) ^ tag ^ (U(level) << U(56))))
            if empty <= spare:
                break
    return np.concatenate(out)


def node_of(elements: np.ndarray) -> int:
    return int(mix(np.array([mix(elements ^ K2).sum(dtype=U) + U(len(elements))], dtype=U)).view(np.int64)[0])


def sketch_of(elements: np.ndarray) -> bytes:
    """Parity of the number of elements in each cell: differs in no more cells than the sets do in elements."""
    cells = max(LEAST_CELLS, 1 << (2 * len(elements) - 1).bit_length() if len(elements) else 0)
    count = np.bincount((mix(elements ^ K1) & U(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """One row per sketch, all with as many cells as the smallest: cells that fall together add their parities."""
    size = min(map(len, sketches))
    out = np.empty((len(sketches), size), dtype=np.uint8)
    for k, sketch in enumerate(sketches):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(sketch, dtype=np.uint8).reshape(-1, size), axis=0)
    return out.view(U)


def sets_of(column: pa.Array, like: Likeness):
    words, at = word_hashes(column, lower=True)
    for k in range(len(column)):
        yield shingle_set(words[at[k] : at[k + 1]], like.words)


def profiled(docs: DataFrame, like: Likeness, id_col: str, text_col: str) -> DataFrame:
    """Written rows (id, text_key, node, n, sketch); an empty set has a NULL node."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches):
            nodes, sizes, sketches = [], [], []
            for elements in sets_of(batch.column(2), like):
                sizes.append(len(elements))
                nodes.append(node_of(elements) if len(elements) else None)
                sketches.append(sketch_of(elements))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(sketches, pa.binary())],
                ["id", "text_key", "node", "n", "sketch"],
            )

    return written(rows.mapInArrow(run, f"id {kind}, text_key long, node long, n long, sketch binary"))


def signed(docs: DataFrame, like: Likeness, text_col: str, bits: Broadcast | None = None) -> DataFrame:
    """(sig, node), of all signatures or of those that a Bloom filter lets through; a task emits each node once."""

    def run(batches):
        seen: set[int] = set()
        for batch in sliced(batches):
            sigs, nodes = [], []
            for elements in sets_of(batch.column(0), like):
                if len(elements) and (node := node_of(elements)) not in seen:
                    seen.add(node)
                    found = signatures(elements, like)
                    sigs.append(found if bits is None else found[passes(bits.value, found)])
                    nodes.append(np.full(len(sigs[-1]), node, dtype=np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], ["sig", "node"]
                )

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "sig long, node long")


def candidate_stars(docs: DataFrame, like: Likeness, text_col: str) -> DataFrame:
    """Written (hub, node): every node that shares a signature with the smallest node of its group."""
    # written, so that adaptive joins can split a signature that many nodes have
    shared = written(signed(docs, like, text_col).groupBy("sig").agg(F.count("*").alias("m")).filter("m > 1").select("sig"))
    members = signed(docs, like, text_col, sent(shared, "sig"))
    members = written(members.join(shared, "sig").distinct())
    hubs = written(members.groupBy("sig").agg(F.min("node").alias("hub")))
    return written(members.join(hubs, "sig").filter("node <> hub").select("hub", "node").distinct())


PACK = "hub long, chunk int, node array<long>, label array<long>, n array<long>, sketch array<binary>"
PAIRS = "a long, b long, label_a long, label_b long, apart long"


def packed(members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups (hub, node) with nodes of several labels, in chunks of bounded size; a node without a label is its own."""
    rows = members.join(nodes.select("node", "n", "sketch"), "node").join(labels, "node", "left")
    rows = written(rows.withColumn("label", F.coalesce("label", "node")))
    size = F.ceil(F.sum(F.length("sketch") + 24) / CHUNK_BYTES).cast("int")
    groups = rows.groupBy("hub").agg(size.alias("chunks"), F.min("label").alias("low"), F.max("label").alias("high"))
    rows = rows.join(groups.filter("low <> high").select("hub", "chunks"), "hub")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    one = F.collect_list(F.struct("node", "label", "n", "sketch"))  # about CHUNK_BYTES
    return written(rows.groupBy("hub", chunk.alias("chunk")).agg(one.alias("r")).select(
        "hub", "chunk", *[F.col(f"r.{c}").alias(c) for c in ("node", "label", "n", "sketch")]
    ))


def close_pairs(left: dict, right: dict, like: Likeness, few: int | None) -> list[np.ndarray]:
    """Columns a, b, label_a, label_b, apart of what sizes and sketches allow between two chunks and their labels.

    Of the pairs of two labels only the ``few`` nearest, if given.
    """
    sketches = folded([*left["sketch"], *right["sketch"]])
    x, y = sketches[: len(left["n"])], sketches[len(left["n"]) :]
    n, m = np.array(left["n"]), np.array(right["n"])
    label, other = np.array(left["label"]), np.array(right["label"])
    node, with_node = np.array(left["node"]), np.array(right["node"])
    found = []
    for k in range(len(x)):
        most = (like.of - like.at_least) * (n[k] + m) // (like.of + like.at_least)
        some = np.flatnonzero((np.abs(n[k] - m) <= most) & (label[k] != other))
        apart = np.bitwise_count(y[some] ^ x[k]).sum(axis=1, dtype=np.int64)
        near = apart <= most[some]
        some, apart = some[near], apart[near]
        found.append(np.stack([np.full(len(some), node[k]), with_node[some], np.full(len(some), label[k]), other[some], apart]))
    pairs = np.concatenate(found, axis=1)
    swap = pairs[0] > pairs[1]
    pairs[:4, swap] = pairs[[1, 0, 3, 2]][:, swap]
    if few is None:
        return list(pairs)
    low, high = np.minimum(pairs[2], pairs[3]), np.maximum(pairs[2], pairs[3])
    order = np.lexsort((pairs[1], pairs[0], pairs[4], high, low))
    low, high = low[order], high[order]
    first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(order) else order
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return list(pairs[:, order[place < few]])


def across(packs: DataFrame, like: Likeness, few: int | None) -> DataFrame:
    """Pairs (a, b) of different labels in one group that may link; of two labels the ``few`` nearest, if given."""
    right = packs.select("hub", *[F.col(c).alias(f"{c}_2") for c in ("chunk", "node", "label", "n", "sketch")])
    both = packs.join(right, "hub").filter("chunk <= chunk_2")
    columns = ("node", "label", "n", "sketch")

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                left, other = ({c: row[c + end] for c in columns} for end in ("", "_2"))
                found = close_pairs(left, other, like, few)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], PAIR_COLUMNS)

    # the chunks of a large group meet in many tasks
    spread = both.repartition(F.xxhash64("hub", "chunk", "chunk_2"))
    pairs = spread.mapInArrow(run, PAIRS).distinct()
    if few is None:
        return pairs.select("a", "b")
    classes = Window.partitionBy(F.least("label_a", "label_b"), F.greatest("label_a", "label_b"))
    place = F.row_number().over(classes.orderBy("apart", "a", "b"))
    return pairs.withColumn("place", place).filter(F.col("place") <= few).select("a", "b")


PAIR_COLUMNS = ["a", "b", "label_a", "label_b", "apart"]


def around_hubs(stars: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """Written pairs (a, b) of a hub and a node of its group that sizes and sketches don't rule out."""
    one = lambda c: nodes.select(F.col("node").alias(c), F.struct("n", "sketch").alias(f"of_{c}"))
    rows = stars.select(F.col("hub").alias("a"), F.col("node").alias("b")).join(one("a"), "a").join(one("b"), "b")

    def run(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = folded([x["sketch"], y["sketch"]])
                most = like.most(x["n"] + y["n"])
                near.append(abs(x["n"] - y["n"]) <= most and int(np.bitwise_count(p ^ q).sum()) <= most)
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    return written(rows.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long"))


def candidate_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, like: Likeness, id_col: str, text_col: str) -> DataFrame:
    """Written (node, elements) for the wanted nodes, from one text of each."""
    one = written(nodes.join(wanted.distinct(), "node").select("id", "text_key"))
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text")
    )
    texts = likely(rows, "text_key", sent(one, "text_key"))
    texts = texts.join(one, texts["id"].eqNullSafe(one["id"]) & (texts["text_key"] == one["text_key"]), "left_semi").select("text")

    def run(batches):
        seen: set[int] = set()
        for batch in sliced(batches):
            found = [e for e in sets_of(batch.column(0), like) if len(e)]
            keys = [node_of(e) for e in found]
            keep = [k for k, node in enumerate(keys) if node not in seen and not seen.add(node)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[k] for k in keep], pa.int64()), pa.array([found[k].tobytes() for k in keep], pa.binary())],
                ["node", "elements"],
            )

    return written(texts.mapInArrow(run, "node long, elements binary").dropDuplicates(["node"]))


def linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, like: Likeness, id_col: str, text_col: str) -> DataFrame:
    """Written pairs (a, b, link): each pair held against the sets themselves (sorted distinct hashes)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    sets = candidate_sets(docs, nodes, wanted, like, id_col, text_col)
    one = lambda c: sets.select(F.col("node").alias(c), F.col("elements").alias(f"set_{c}"))
    rows = pairs.select("a", "b").join(one("b"), "b").join(one("a"), "a").select("a", "b", "set_a", "set_b")

    def run(batches):
        for batch in sliced(batches, 200):
            links = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                links.append(len(np.setxor1d(x, y, assume_unique=True)) <= like.most(len(x) + len(y)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(links, pa.bool_())], ["a", "b", "link"]
            )

    return written(rows.mapInArrow(run, "a long, b long, link boolean"))


def links(docs: DataFrame, profile: DataFrame, like: Likeness, id_col: str, text_col: str) -> DataFrame:
    """(node, label) of the linked nodes, from links that connect whatever links connect, each of them verified."""
    nodes = written(
        profile.filter("node is not null").groupBy("node").agg(
            F.min("n").alias("n"), F.min(F.struct("id", "text_key", "sketch")).alias("one")
        ).select("node", "n", "one.*")
    )
    stars = candidate_stars(docs, like, text_col)
    tried = linked(docs, nodes, around_hubs(stars, nodes, like), like, id_col, text_col)
    members = written(stars.union(stars.select("hub", F.col("hub").alias("node")).distinct()))
    found = tried.filter("link").select("a", "b")
    for few in (FEW, None):
        labels = components(found)
        pairs = across(packed(members, nodes, labels), like, few).distinct()
        pairs = written(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        more = linked(docs, nodes, pairs, like, id_col, text_col)
        tried, found = tried.union(more), found.union(more.filter("link").select("a", "b"))
    return components(found)


def classes(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id of its class)."""
    profile = profiled(docs, like, id_col, text_col)
    labels = links(docs, profile, like, id_col, text_col)
    placed = profile.join(labels, "node", "left").select("id", "n", F.coalesce("label", "node").alias("label"))
    smallest = written(placed.filter("label is not null").groupBy("label").agg(F.min("id").alias("component_id")))
    return placed.join(smallest, "label", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; rows without words all stay."""
    profile = profiled(docs, like, id_col, text_col)
    labels = links(docs, profile, like, id_col, text_col)
    row = lambda c, key: F.xxhash64(F.coalesce(c.cast("string"), F.lit("\0")), key)
    placed = written(
        profile.filter("node is not null").join(labels, "node", "left")
        .select("id", "text_key", F.coalesce("label", "node").alias("label"))
    )
    kept = placed.groupBy("label").agg(F.min(F.struct("id", "text_key")).alias("one"), F.count("*").alias("m"))
    kept = written(kept.select("label", row(F.col("one.id"), F.col("one.text_key")).alias("__row"), "m"))
    crowd = placed.join(kept.filter("m > 1").select("label"), "label", "left_semi")
    bits = sent(crowd.select(row(F.col("id"), F.col("text_key")).alias("__row")), "__row")
    rows = docs.withColumn("__row", row(F.col(id_col), F.xxhash64(text_col)))
    worded = F.coalesce(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    # rows without words, and those of a class of one, stay as they are; the others are held against the chosen ones
    crowded = likely(rows.filter(worded), "__row", bits)
    chosen = crowded.join(kept.select("__row"), "__row", "left_semi").dropDuplicates(["__row"])
    alone = likely(rows.filter(worded), "__row", bits, wanted=False)
    return chosen.unionByName(alone).unionByName(rows.filter(~worded)).select(*docs.columns)
