"""Approximate nearest neighbours by stable projections.

Vectors get one more coordinate that makes them all as long as the longest, so that the largest inner product is the
least Euclidean distance. A few Gaussian (2-stable) projections then keep distances up to a chi-square factor: the
squared projected distance is the squared distance times a chi-square variable. A kd-tree over the projections gives
points by projected distance; they are verified on the original vectors until the test holds: a vector as near as the
k-th best found so far would, with probability `trust`, have shown up by now.

The tree's upper levels are fitted on a bounded sample and deal all rows out to cells, each with a tree of its own.
A query first visits its own cell, and then those that the test does not rule out by their bounds. A cell with many
rows (one vector may be very common) is cut into blocks by a hash of the id, and is visited block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

#: Rows of the sample that the cells are fitted on, and rows that a cell should hold.
SAMPLE, CELL_ROWS = 20_000, 8_192

#: Points of a leaf of a cell's own tree; leaves that are verified together.
LEAF, STRIDE = 128, 2


def chi_square(freedom: int, p: float) -> float:
    """The value below which a chi-square variable lies with probability p."""

    def below(x: float) -> float:
        a, z = freedom / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= z / n
            total += term
        return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if z > 0 else 0.0

    low, high = 0.0, 10.0 * freedom + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Space:
    """The projections of vectors over `unit`, the largest component, and the longest one's length then; the same in every process.

    Lengths are of vectors over their largest component, so that no square of a component leaves the range of doubles.
    """

    def __init__(self, width: int, unit: float, longest: float, dims: int, seed: int = 11) -> None:
        self.unit, self.longest = unit, longest
        self.wild = unit > 1e150  # products may leave the range of doubles
        self.axes = np.random.default_rng(seed).standard_normal((width + 1, dims))

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.unit
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return x @ self.axes[:-1] + rest[:, None] * self.axes[-1]

    def scaled(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """The query at the longest one's length, and what takes an inner product with it to that of `points`."""
        own = float(np.abs(q).max())
        q = q / own
        size = self.longest / math.sqrt(float((q * q).sum()))
        return q * size, size / own / self.unit if own * self.unit else math.inf

    def query(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """The query's projection, and its factor for inner products."""
        q, factor = self.scaled(q)
        return q @ self.axes[:-1], factor

    def squared(self, factor: float, score: float) -> float:
        """Squared distance from the scaled query of a vector with this inner product, with room for rounding; infinite if unknown."""
        far = 2 * self.longest**2 - 2 * factor * score
        return max(far, 0.0) + 1e-9 * self.longest**2 if math.isfinite(far) else math.inf

    def products(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        if not self.wild:
            return (x * q).sum(1)
        with np.errstate(all="ignore"):
            got = (x * q).sum(1)
        return np.where(np.isnan(got), -math.inf, got)


def splits(p: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A kd-tree's cuts (axis, value) in heap order: at the median of the widest axis."""
    cuts: list[tuple[int, float]] = []
    level = [p]
    for _ in range(depth):
        below = []
        for part in level:
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            at = float(np.median(part[:, axis])) if len(part) else 0.0
            cuts.append((axis, at))
            right = part[:, axis] > at if len(part) else np.zeros(0, bool)
            below += [part[~right], part[right]]
        level = below
    return cuts


def cell_of(p: np.ndarray, cuts: list[tuple[int, float]], depth: int) -> np.ndarray:
    node = np.zeros(len(p), np.int64)
    axes, at = np.array([a for a, _ in cuts], np.int64), np.array([v for _, v in cuts])
    for _ in range(depth):
        node = 2 * node + 1 + (p[np.arange(len(p)), axes[node]] > at[node])
    return node - (2**depth - 1)


class Tree:
    """A cell block's own kd-tree: vectors in the order of its leaves, and the leaves' bounds in the projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, p: np.ndarray) -> None:
        leaves, todo = [], [np.arange(len(ids))]
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            axis = int(np.argmax(np.ptp(p[part], axis=0)))
            part = part[np.argpartition(p[part, axis], len(part) // 2)]
            todo += [part[: len(part) // 2], part[len(part) // 2 :]]
        order = np.concatenate(leaves)
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order])
        ends = np.cumsum([len(v) for v in leaves]).tolist()
        self.leaves = list(zip([0, *ends[:-1]], ends, strict=True))
        self.low = np.array([p[v].min(0) for v in leaves])
        self.high = np.array([p[v].max(0) for v in leaves])

    def search(self, space: Space, q: np.ndarray, own: int, k: int, factor: float, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids), only such as score `kth` or more; `own` takes no part.

        Leaves come by projected distance and are verified whole: a quick product leaves out what can't be among the k
        best, the others are scored exactly.
        """
        at, to = space.query(q)
        gap = np.maximum(np.maximum(self.low - at, at - self.high), 0)
        gap = (gap * gap).sum(1)
        order = np.argsort(gap, kind="stable").tolist()
        gaps = gap[order].tolist()
        room = 1e-12 * space.longest * space.unit * float(np.abs(q).sum())  # rounding of a product stays below this
        scores, ids = np.zeros(0), np.zeros(0, np.int64)
        bound = factor * space.squared(to, kth) if kth > -math.inf else math.inf
        for i in range(0, len(order), STRIDE):
            if gaps[i] > bound:
                break
            near = []
            for v in order[i : i + STRIDE]:
                start, end = self.leaves[v]
                if space.wild or kth == -math.inf:
                    near.append(np.arange(start, end))
                else:
                    near.append(np.flatnonzero(self.x[start:end] @ q >= kth - room) + start)
            part = np.concatenate(near)
            if not len(part):
                continue
            got = space.products(self.x[part], q)
            fits = (got >= kth) & (self.ids[part] != own)
            if fits.any():
                scores, ids = np.concatenate([scores, got[fits]]), np.concatenate([ids, self.ids[part][fits]])
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
                if len(ids) >= k and scores.min() > kth:
                    kth = float(scores.min())
                    bound = factor * space.squared(to, kth)
        return scores, ids


def vectors(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), width)


def visited(visits: DataFrame, points: DataFrame, space: Space, k: int, factor: float) -> DataFrame:
    """query_id, vec_id, score: what the queries (query_id, x, cell, block, kth) find in the cell blocks that they visit."""
    width = len(space.axes) - 1
    told = points.sparkSession.sparkContext.broadcast(space)
    nothing = F.lit(None)
    rows = points.select("cell", "block", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "x", "p", nothing.cast("double").alias("kth")).unionByName(
        visits.select("cell", "block", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "x", nothing.cast("array<double>").alias("p"), "kth")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, now, held, tree = told.value, None, [], None
        for batch in batches:
            cell, block, kind = (batch[i].to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                part = batch.slice(start, end - start)
                here = (int(cell[start]), int(block[start]))
                if here != now:
                    now, held, tree = here, [], None
                if kind[start] == 0:
                    held.append((part[3].to_numpy(), vectors(part[4], width), vectors(part[5], space.axes.shape[1])))
                    continue
                if not held and tree is None:
                    continue
                if tree is None:
                    tree = Tree(*(np.concatenate(v) for v in zip(*held, strict=True)))
                    held = []
                out = []
                for own, q, kth in zip(part[3].to_numpy(), vectors(part[4], width), part[6].to_pylist(), strict=True):
                    scores, ids = tree.search(space, q, int(own), k, factor, -math.inf if kth is None else kth)
                    out.append((np.full(len(ids), own), ids, scores))
                cols = [np.concatenate(v) for v in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    dealt = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(table: DataFrame, queries: Column, k: int = 20, dims: int = 16, trust: float = 0.95, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where `queries` holds, the k rows found with the largest inner product.

    Rows take part with a vec_id and an embedding of the commonest length without null or non-finite components and other
    than zero. A query's own id takes no part in its result. Equal scores go by vec_id; rows that repeat a vec_id are
    candidates each, and one query: their least vector, component by component. Fewer candidates than k give all of them;
    an empty table gives no rows. Products beyond doubles are infinite, and what is no number counts as minus infinity.
    """
    spark = table.sparkSession
    ok = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"), queries.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ok)
    most = F.array_max(F.transform("x", F.abs))
    sizes = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"), F.max(most).alias("unit")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n, unit = sizes[0]["width"], sizes[0]["n"], sizes[0]["unit"]
    rows = rows.where(F.size("x") == width)
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v / F.lit(unit)) * (v / F.lit(unit)))
    space = Space(width, unit, math.sqrt(rows.agg(F.max(square)).first()[0]), dims)
    depth = max(0, math.ceil(math.log2(max(1, min(n / cell_rows, sample / 8)))))
    drawn = rows.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect() if depth else []
    cuts = splits(space.points(np.array([r["x"] for r in drawn])), depth) if depth else []
    factor = chi_square(dims, trust)
    told = spark.sparkContext.broadcast((space, cuts, depth))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, cuts, depth = told.value
        for batch in batches:
            if batch.num_rows:
                x = vectors(batch[1], width)
                p = space.points(x)
                cell = cell_of(p, cuts, depth)
                home = cell_of(np.array([space.query(q)[0] for q in x]), cuts, depth)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array(cell), pa.array(home)], ["vec_id", "x", "is_query", "p", "cell", "home"])

    placed = stored(rows.mapInArrow(place, "vec_id long, x array<double>, is_query boolean, p array<double>, cell long, home long"), "cells")
    bounds = [f(F.col("p")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), *bounds).collect()}  # at most sample / 4 cells
    blocks = {c: max(1, round(r["n"] / cell_rows)) for c, r in cells.items()}
    ids = np.array(sorted(cells))
    low, high = (np.array([[cells[c][f"{name}{i}"] for i in range(dims)] for c in ids]) for name in ("low", "high"))
    many = F.broadcast(spark.createDataFrame([(int(c), int(b)) for c, b in blocks.items()], "cell long, blocks int"))
    points = placed.join(many, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = placed.where("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("x", "home")).alias("q")).select("query_id", "q.x", "q.home")

    def all_blocks(visits: DataFrame) -> DataFrame:
        return visits.join(many, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    # a query outside all points' bounds may have an empty home cell; the second round then goes everywhere
    first = stored(top(visited(all_blocks(asked.select("query_id", "x", F.col("home").alias("cell"), F.lit(None).cast("double").alias("kth"))), points, space, k, factor)), "first")
    kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    cells_told = spark.sparkContext.broadcast((space, ids, low, high))

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, ids, low, high = cells_told.value
        for batch in batches:
            if not batch.num_rows:
                continue
            take, cell = [], []
            for i, (q, home, kth) in enumerate(zip(vectors(batch[1], width), batch[2].to_pylist(), batch[3].to_pylist(), strict=True)):
                at, to = space.query(q)
                gap = np.maximum(np.maximum(low - at, at - high), 0)
                near = (gap * gap).sum(1) <= (math.inf if kth is None else factor * space.squared(to, kth))
                found = ids[near & (ids != home)]
                take += [i] * len(found)
                cell += found.tolist()
            part = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([part[0], part[1], pa.array(cell, pa.int64()), part[3]], ["query_id", "x", "cell", "kth"])

    visits = asked.join(kth, "query_id", "left").select("query_id", "x", "home", "kth").mapInArrow(onward, "query_id long, x array<double>, cell long, kth double")
    second = visited(all_blocks(visits), points, space, k, factor)
    return top(first.select("query_id", "vec_id", "score").unionByName(second)).select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
