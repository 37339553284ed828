"""Hard-negative mining with a multiway hyperplane tree (GNAT).

Vectors become integers (``floor(scale * x)``), a score is their integer inner product. One more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, gives all rows one norm; anchors get 0 there. Distances then fall as scores
rise, so a window of scores around an anchor is an annulus of distances, and metric pruning is exact.

1. Tree. Each node has up to ``ways`` split points, chosen far apart from a bounded sample (``sample_rows`` entries with
   the smallest hashes); a row belongs to its nearest one. All rows go down the tree to a leaf. For each split point and
   each sibling subtree the smallest and largest distance over all rows of that subtree are kept.
2. Search. A subtree is left out if, for some split point, the range of its distances cannot meet the annulus
   [inner, outer] around the anchor. First the ``seeds`` leaves whose own split point is nearest to the inner edge are
   read; the k-th score found there moves the outer edge in, and every leaf that still meets the annulus is read. Leaves
   are compared exactly, so results equal those of a full pass.
3. Anchors ask twice: for their positives (same label, no window), then per positive for the best rows of other labels
   whose scores lie in the window.

Equal vectors of one label are one entry with the ``k + 1`` smallest ids, all that an answer can need. A leaf is cut
into cells of about ``cell_rows`` entries by a hash, anchors into chunks of about ``chunk_rows``; both are packed rows of
bounded size, and a join of (chunk, cell) pairs spreads the work over all tasks. Visits are decided inside tasks. Only
the tree (bounded by the sample), its ranges and counts per leaf visit the driver.

On vectors without structure few subtrees can be left out, and the work grows with anchors times rows.

Defined cases: rows with a NULL id, label or vector, or with a NULL or non-finite component take no part, nor do those of
another dimension than the most frequent one; of several rows with one id the smallest (label, vector) counts; equal
scores sort by id; without rows, anchors or positives there are no rows; windows of a positive score below 0 are empty;
scores outside 64 bits are cut to its ends; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowndate.llm.frames import written

#: Ends of the 64-bit range, as the window that lets every score through.
LEAST, MOST = -(2**63), 2**63 - 1


def usable(vectors: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """Written (id, label, vec): one row per id, components as integers."""
    x = F.col("x")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("x"),
    ).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
        & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("x") == (common.d if common else 0))
    vec = F.transform("x", lambda c: F.floor(scale * c))
    one = rows.select("id", "label", vec.alias("vec")).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"))
    return written(one.select("id", "r.label", "r.vec"))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(hash, label, vec, ids): each distinct (label, vector) with its k + 1 smallest ids."""
    keyed = rows.withColumn("hash", F.xxhash64("vec", "label"))
    place = F.row_number().over(Window.partitionBy("hash", "label", "vec").orderBy("id"))
    few = keyed.withColumn("place", place).filter(F.col("place") <= k + 1)
    return few.groupBy("hash", "label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


@dataclass(frozen=True)
class Space:
    """What all rows share: number of components, largest norm, and the type that holds a component."""

    dimension: int
    norm: float
    kind: str
    exact: bool  # whether inner products are exact in doubles

    @classmethod
    def of(cls, dimension: int, largest: int, norm: float) -> Space:
        kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if largest < 2**bits or bits == 63)
        return cls(dimension, norm, kind, dimension * largest * largest < 2**53)

    def read(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype=self.kind).reshape(-1, self.dimension)

    def scores(self, a: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return (a.astype(float) @ x.astype(float).T).astype(np.int64)
        full = a.astype(object) @ x.astype(object).T  # unbounded integers
        return np.clip(full, LEAST, MOST).astype(np.int64)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that gives them all one norm."""
        x = x.astype(float)
        return np.c_[x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))]

    def asked(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x.astype(float), np.zeros(len(x))]

    def radius(self, a: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which rows score ``score`` with the anchors ``a`` (row by row)."""
        squares = (a.astype(float) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(squares + self.norm**2 - 2 * score.astype(float), 0))

    @property
    def slack(self) -> float:
        return 1e-6 * max(self.norm, 1.0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


@dataclass(frozen=True)
class Tree:
    """Node 0 is the root. ``kids``: per split point another node, or ``~leaf``."""

    points: list[np.ndarray] = field(default_factory=list)
    kids: list[list[int]] = field(default_factory=list)
    leaves: int = 1
    low: list[np.ndarray] = field(default_factory=list)  # per node: [split point, subtree]
    high: list[np.ndarray] = field(default_factory=list)

    def paths(self, x: np.ndarray):
        """(node, rows of ``x`` that pass it, their distances to its split points, their nearest one)."""
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            away = distances(x[rows], self.points[node])
            nearest = away.argmin(axis=1)
            yield node, rows, away, nearest
            for j, kid in enumerate(self.kids[node]):
                if kid >= 0 and (some := nearest == j).any():
                    todo.append((kid, rows[some]))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for node, rows, _, nearest in self.paths(x):
            kids = np.array(self.kids[node])[nearest]
            out[rows[kids < 0]] = ~kids[kids < 0]
        return out

    def ranges(self, x: np.ndarray) -> list[tuple[int, int, int, float, float]]:
        """(node, split point, subtree, smallest, largest distance) over the rows ``x``."""
        out = []
        for node, _, away, nearest in self.paths(x):
            for j in np.unique(nearest):
                part = away[nearest == j]
                out += [(node, i, int(j), float(a), float(b)) for i, (a, b) in enumerate(zip(part.min(axis=0), part.max(axis=0)))]
        return out

    def with_ranges(self, found) -> Tree:
        low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        high = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        for node, i, j, a, b in found:
            low[node][i, j], high[node][i, j] = a, b
        return Tree(self.points, self.kids, self.leaves, low, high)

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per (asked, leaf): least and greatest possible distance to its rows, and that to its split point."""
        nearest = np.zeros((len(asked), self.leaves))
        farthest, centre = np.full_like(nearest, np.inf), np.zeros_like(nearest)
        todo = [(0, np.zeros(len(asked)), np.full(len(asked), np.inf))] if self.points else []
        while todo:
            node, least, most = todo.pop()
            away = distances(asked, self.points[node])
            for j, kid in enumerate(self.kids[node]):
                low, high = self.low[node][:, j], self.high[node][:, j]
                near = np.maximum(least, np.maximum(away - high, low - away).max(axis=1))
                far = np.minimum(most, (away + high).min(axis=1))
                if kid < 0:
                    nearest[:, ~kid], farthest[:, ~kid], centre[:, ~kid] = near, far, away[:, j]
                else:
                    todo.append((kid, near, far))
        return nearest, farthest, centre


def far_apart(x: np.ndarray, ways: int, random: np.random.Generator) -> np.ndarray:
    """Up to ``ways`` different rows, each the farthest from those before among ``3 * ways`` random ones."""
    some = x[random.choice(len(x), size=min(3 * ways, len(x)), replace=False)]
    chosen, gap = [0], distances(some, some[:1])[:, 0]
    while len(chosen) < ways and gap.max() > 1e-3:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


def grow(sample: np.ndarray, leaf_rows: int, ways: int) -> Tree:
    """A tree over the sample whose leaves hold about ``leaf_rows`` rows of it at most."""
    random = np.random.default_rng(11)
    points, kids, leaves = [], [], 0
    todo = [(sample, None)]
    while todo:
        x, above = todo.pop()
        split = far_apart(x, min(ways, -(-len(x) // max(leaf_rows // 2, 1))), random) if len(x) > leaf_rows else x[:0]
        nearest = distances(x, split).argmin(axis=1) if len(split) > 1 else None
        if nearest is None:
            mark, leaves = ~leaves, leaves + 1
        else:
            mark = len(points)
            points.append(split), kids.append([0] * len(split))
            todo += [(x[nearest == j], (mark, j)) for j in range(len(split))]
        if above is not None:
            kids[above[0]][above[1]] = mark
    return Tree(points, kids, max(leaves, 1))


CELL = "leaf long, block long, vecs binary, label binary, ids array<array<bigint>>"
CHUNK = "chunk long, anchor binary, label binary, vecs binary"
WINDOWS = "owner binary, tag binary, low binary, high binary"
FOUND = "chunk long, window int, anchor long, tag long, score long, ids array<bigint>"


def packed(table: pa.Table, space: Space) -> bytes:
    return table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(space.kind).tobytes()


def numbers(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", dtype=np.int64)


def cells(rows: DataFrame, blocks: list[int], space: Space) -> DataFrame:
    """Leaves cut into packed cells, entries by their smallest id."""
    block = F.pmod("hash", F.array(*map(F.lit, blocks))[F.col("leaf").cast("int")])

    def pack(table: pa.Table) -> pa.Table:
        first = [i[0] for i in table.column("ids").to_pylist()]
        table = table.take(pa.array(np.argsort(first, kind="stable")))
        return pa.table({
            "leaf": table.column("leaf")[:1], "block": table.column("block")[:1], "vecs": [packed(table, space)],
            "label": [table.column("label").to_numpy().tobytes()], "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
        })

    return rows.withColumn("block", block).groupBy("leaf", "block").applyInArrow(pack, CELL)


def chunks(anchors: DataFrame, chunk_rows: int, tree: Tree, space: Space) -> DataFrame:
    """Anchors (id, label, vec, leaf) in packed chunks; anchors of one leaf or of neighbouring leaves stand together."""
    counts = dict(anchors.groupBy("leaf").count().collect())  # one row per leaf
    first, parts, chunk, held = [0] * tree.leaves, [1] * tree.leaves, 0, 0
    for leaf in range(tree.leaves):
        n = counts.get(leaf, 0)
        if held and held + n > chunk_rows:
            chunk, held = chunk + 1, 0
        first[leaf], parts[leaf] = chunk, max(-(-n // chunk_rows), 1)
        chunk, held = (chunk, held + n) if parts[leaf] == 1 else (chunk + parts[leaf], 0)
    at = F.col("leaf").cast("int")
    number = F.array(*map(F.lit, first))[at] + F.pmod(F.xxhash64("id"), F.array(*map(F.lit, parts))[at])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        return pa.table({
            "chunk": table.column("chunk")[:1], "anchor": [table.column("id").to_numpy().tobytes()],
            "label": [table.column("label").to_numpy().tobytes()], "vecs": [packed(table, space)],
        })

    return anchors.withColumn("chunk", number.cast("long")).groupBy("chunk").applyInArrow(pack, CHUNK)


def each_row(batches):
    """Rows as dictionaries, one at a time: packed rows are large."""
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


def visits(asked: DataFrame, tree: Tree, blocks: list[int], space: Space, seeds: int, first: bool) -> DataFrame:
    """(chunk, leaf, block, who): the cells to read, and the windows of the chunk that need them.

    ``asked`` has a column ``bars``: per window the score that its k-th row has so far, or ``LEAST``. The first pass names
    the seeds of each window, the second one all leaves that its annulus, cut by the bar, meets.
    """

    def run(batches):
        for row in each_row(batches):
            vecs, owner = space.read(row["vecs"]), numbers(row["owner"])
            if not len(owner):
                continue
            low = np.maximum(numbers(row["low"]), numbers(row["bars"]) if row["bars"] else LEAST)
            nearest, farthest, centre = (b[owner] for b in tree.bounds(space.asked(vecs)))
            inner = space.radius(vecs[owner], numbers(row["high"]))
            outer = space.radius(vecs[owner], low)
            meets = (nearest <= outer[:, None] + space.slack) & (farthest >= inner[:, None] - space.slack)
            held = np.array(blocks) > 0
            gap = np.where(meets & held, np.abs(centre - inner[:, None]), np.inf)
            wanted = np.isfinite(gap)
            if first:
                chosen = np.zeros_like(wanted)
                np.put_along_axis(chosen, np.argsort(gap, axis=1, kind="stable")[:, :seeds], True, axis=1)
                wanted &= chosen
            found = [(leaf, np.flatnonzero(wanted[:, leaf]).tolist()) for leaf in np.flatnonzero(wanted.any(axis=0)).tolist()]
            found = [(leaf, b, who) for leaf, who in found for b in range(blocks[leaf])]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * len(found)), *(pa.array(c) for c in list(zip(*found))[:2]),
                     pa.array([f[2] for f in found], pa.list_(pa.int32()))],
                    ["chunk", "leaf", "block", "who"],
                )

    return asked.mapInArrow(run, "chunk long, leaf long, block long, who array<int>")


def read_cells(asked: DataFrame, visited: DataFrame, stored: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """The best ``k + 1`` entries per window and cell, within the window and not below the bar."""

    def run(batches):
        for row in each_row(batches):
            x, names = space.read(row["vecs"]), numbers(row["entry_label"])
            who = np.array(row["who"])
            owner = numbers(row["owner"])[who]
            anchor, label = numbers(row["anchor"]), numbers(row["label"])
            needed, at = np.unique(owner, return_inverse=True)
            score = space.scores(space.read(row["asked_vecs"])[needed], x)[at]
            low = numbers(row["low"])[who]
            if row["bars"]:
                low = np.maximum(low, numbers(row["bars"])[who])
            fits = (score >= low[:, None]) & (score <= numbers(row["high"])[who][:, None])
            fits &= (names[None, :] == label[owner][:, None]) == same
            w, e = np.nonzero(fits)
            if not len(w):
                continue
            order = np.lexsort((e, ~score[w, e], w))  # ~s falls as s rises, without overflow
            w, e = w[order], e[order]
            place = np.arange(len(w)) - np.searchsorted(w, w)
            w, e = w[place <= k], e[place <= k]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(w), row["chunk"])), pa.array(who[w].astype(np.int32)), pa.array(anchor[owner[w]]),
                    pa.array(numbers(row["tag"])[who[w]]), pa.array(score[w, e]), pa.array([row["ids"][i] for i in e], pa.list_(pa.int64())),
                ],
                ["chunk", "window", "anchor", "tag", "score", "ids"],
            )

    entry = stored.select("leaf", "block", "vecs", F.col("label").alias("entry_label"), "ids")
    ask = asked.select("chunk", "anchor", "label", F.col("vecs").alias("asked_vecs"), "owner", "tag", "low", "high", "bars")
    return visited.join(ask, "chunk").join(entry, ["leaf", "block"]).mapInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """(chunk, window, anchor, tag, score, id, rank): the k best rows of each window; an anchor is not its own partner."""
    each = found.select("chunk", "window", "anchor", "tag", "score", F.explode("ids").alias("id")).filter("id <> anchor").distinct()
    place = F.row_number().over(Window.partitionBy("chunk", "window").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", place).filter(F.col("rank") <= k)


def search(asked: DataFrame, stored: DataFrame, tree: Tree, blocks: list[int], space: Space, k: int, same: bool, seeds: int) -> DataFrame:
    """Written ``best`` rows of all windows of the chunks ``asked``."""
    start = asked.withColumn("bars", F.lit(None).cast("binary"))
    early = written(best(read_cells(start, visits(start, tree, blocks, space, seeds, True), stored, space, k, same), k))
    kth = early.filter(F.col("rank") == k).groupBy("chunk").agg(F.collect_list(F.struct("window", "score")).alias("reached"))

    def raise_bars(batches):
        for row in each_row(batches):
            bars = np.full(len(numbers(row["owner"])), LEAST, dtype=np.int64)
            for r in row["reached"] or []:
                bars[r["window"]] = r["score"]
            yield pa.RecordBatch.from_pydict({"chunk": [row["chunk"]], "bars": [bars.tobytes()]})

    # a chunk has a bounded number of windows
    bars = asked.select("chunk", "owner").join(kth, "chunk", "left").mapInArrow(raise_bars, "chunk long, bars binary")
    again = written(asked.join(bars, "chunk"))
    late = read_cells(again, visits(again, tree, blocks, space, seeds, False), stored, space, k, same)
    return written(best(late, k))


def share(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * score / 100), without overflow."""
    return score // 100 * percent + score % 100 * percent // 100


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", sample_rows: int = 16_000, ways: int = 16,
    cell_rows: int = 1024, chunk_rows: int = 256, seeds: int = 3,
) -> DataFrame:
    """Per anchor and positive the best rows of other labels whose score lies in the window.

    ``is_anchor`` is a condition on the column ``id``; ``window`` are percents of the positive's score, both included.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    rows = usable(vectors, id_col, label_col, vec_col, scale)
    distinct = written(entries(rows, max(positives, negatives)))
    largest = F.max(F.array_max(F.transform("vec", lambda c: F.abs(c.cast("double")))))
    square = F.aggregate("vec", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, dimension, largest, norm = distinct.agg(F.count("*"), F.max(F.size("vec")), largest, F.max(square)).first()
    if not n or not dimension:
        return empty
    space = Space.of(dimension, int(largest), float(np.sqrt(norm)))
    sample = np.array([r.vec for r in distinct.orderBy("hash", "label").limit(sample_rows).select("vec").collect()], dtype=np.int64)
    tree = grow(space.lifted(sample), max(cell_rows * len(sample) // n, 8), ways)

    def vecs_of(batch) -> np.ndarray:
        return np.array(batch.column("vec").flatten().to_numpy(zero_copy_only=False)).reshape(len(batch), -1)

    def add_leaf(batches):
        for batch in batches:
            if len(batch):
                yield batch.append_column("leaf", pa.array(tree.leaf_of(space.lifted(vecs_of(batch)))))

    def ranges(batches):
        out: dict[tuple, tuple] = {}
        for batch in batches:
            for node, i, j, a, b in tree.ranges(space.lifted(vecs_of(batch))) if len(batch) else []:
                low, high = out.get((node, i, j), (a, b))
                out[node, i, j] = min(a, low), max(b, high)
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*[(*key, *value) for key, value in out.items()])], ["node", "point", "tree", "low", "high"]
            )

    placed = written(distinct.mapInArrow(add_leaf, "hash long, label long, vec array<bigint>, ids array<bigint>, leaf long"))
    counts = dict(placed.groupBy("leaf").count().collect())  # one row per leaf of the tree
    blocks = [-(-counts.get(leaf, 0) // cell_rows) for leaf in range(tree.leaves)]
    seen = placed.mapInArrow(ranges, "node long, point long, tree long, low double, high double")
    tree = tree.with_ranges(seen.groupBy("node", "point", "tree").agg(F.min("low"), F.max("high")).collect())
    stored = written(cells(placed, [max(b, 1) for b in blocks], space))
    anchors = written(rows.filter(is_anchor).mapInArrow(add_leaf, "id long, label long, vec array<bigint>, leaf long"))
    packs = written(chunks(anchors, chunk_rows, tree, space))

    def all_scores(batches):
        for row in each_row(batches):
            n = len(numbers(row["anchor"]))
            ends = {"owner": np.arange(n), "tag": np.zeros(n, np.int64), "low": np.full(n, LEAST), "high": np.full(n, MOST)}
            yield pa.RecordBatch.from_pydict({**{c: [v] for c, v in row.items()}, **{c: [v.tobytes()] for c, v in ends.items()}})

    asked = written(packs.mapInArrow(all_scores, f"{CHUNK}, {WINDOWS}"))
    near = search(asked, stored, tree, blocks, space, positives, True, seeds)
    pairs = near.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("window", "rank", "id", "score"))).alias("pairs"))

    def annuli(batches):
        for row in each_row(batches):
            pairs = row.pop("pairs")  # at most ``positives`` for each anchor of the chunk
            owner, tag, score = (np.array([p[c] for p in pairs], dtype=np.int64) for c in ("window", "id", "score"))
            low, high = -share(-score, window[0]), share(score, window[1])
            some = low <= high
            ends = {"owner": owner[some], "tag": tag[some], "low": low[some], "high": high[some]}
            yield pa.RecordBatch.from_pydict({**{c: [v] for c, v in row.items()}, **{c: [v.tobytes()] for c, v in ends.items()}})

    asked = written(packs.join(pairs, "chunk").select(*packs.columns, "pairs").mapInArrow(annuli, f"{CHUNK}, {WINDOWS}"))
    hard = search(asked, stored, tree, blocks, space, negatives, False, seeds)
    positive = near.select("chunk", "anchor", F.col("id").alias("tag"), F.col("score").alias("positive_score"))
    return hard.join(positive, ["chunk", "anchor", "tag"]).select(
        F.col("anchor").alias("anchor_id"), F.col("tag").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
