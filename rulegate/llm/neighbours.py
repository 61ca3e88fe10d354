"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are projected to `DIMENSIONS` random Gaussian directions, under which the squared distance of a pair is its
true squared distance times a chi-square variable. A kd-tree over the projections hands out points in order of
projected distance; each is verified on the original vectors. The search stops when a point as near as the
current k-th would have been handed out before with probability `CONFIDENCE`: the squared projected distance
reached, over the squared k-th distance, passes the chi-square quantile.

The tree's upper part, fitted on a bounded sample, cuts all rows into blocks; every row is indexed. A query first
searches the block nearest to it, then, with the distance it has, just those blocks whose box in the projected space the
same test does not rule out; both are found by descending a tree of boxes. Blocks that ties or clusters make too large are cut by hash, and the queries of a
block into slices, so no task holds more than a block and a slice.

Largest inner products are nearest neighbours once every indexed vector is given one more coordinate that brings
it to the largest norm, and a query a zero there: the squared distance is then a constant of the query less twice
the inner product. A row that asks therefore has two projections, one as a vector of the index and one as a query,
and the block it searches first is the one nearest to the latter. Scores are inner products of the original vectors in double precision.

Defined results: vectors that are null, zero, or hold null or non-finite numbers take no part, nor do rows
without an id or with another length than the most common one; a query with fewer candidates gets them all;
ties go to the smaller id; rows that share an id are separate candidates, but never of a query with that id; an
empty table gives an empty result; only the id and the vector are carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rulegate.llm.common import by_value
from rulegate.session import materialize

by_value(__name__)

DIMENSIONS = 8  # even, so that the chi-square distribution has a closed form
CONFIDENCE = 0.97
SAMPLE = 20_000  # rows the block tree is fitted on, at most
BLOCK = 4_096  # rows of a block, on average
SLICE = 8_192  # queries that share a task in a block
LEAF = 64
FAN = 64  # boxes under one box of the next level
ROUNDING = 1e-12  # squared distances below this share of the lengths count as equal, so that all copies are seen
PRODUCTS = 1 << 22  # numbers gathered at once while a block is searched
SEED = 7
NEAREST = 20

FOUND = "query_id long, vec_id long, score double"


def chi_square(x: float, m: int = DIMENSIONS) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, m // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def quantile(p: float, m: int = DIMENSIONS) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, m) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def directions(width: int, m: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, m))


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with the extra coordinate that gives all of them the largest norm."""
    rest = np.maximum(largest * largest - np.einsum("ij,ij->i", vectors, vectors), 0)
    return np.concatenate([vectors, np.sqrt(rest)[:, None]], axis=1)


def split_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, cut, left, right) of a kd-tree with about `leaves` leaves; a leaf is (-1, 0, number, 0)."""
    nodes: list[tuple[int, float, int, int]] = []
    numbered = iter(range(1 << 30))

    def grow(rows: np.ndarray, share: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        if share > 1 and len(rows) > 1:
            spread = np.ptp(points[rows], axis=0)
            dim = int(spread.argmax())
            cut = float(np.median(points[rows, dim]))
            below = points[rows, dim] < cut
            if spread[dim] > 0 and below.any():
                left = grow(rows[below], share // 2)
                nodes[at] = (dim, cut, left, grow(rows[~below], share - share // 2))
                return at
        nodes[at] = (-1, 0.0, next(numbered), 0)
        return at

    grow(np.arange(len(points)), leaves)
    return nodes


def block_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """Leaf number of each point."""
    out = np.zeros(len(points), np.int64)
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, rows = stack.pop()
        dim, cut, left, right = nodes[at]
        if dim < 0:
            out[rows] = left
            continue
        below = points[rows, dim] < cut
        stack.append((left, rows[below]))
        stack.append((right, rows[~below]))
    return out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        gap = np.maximum(low[None, :, k] - points[:, k, None], points[:, k, None] - high[None, :, k])
        out += np.square(np.maximum(gap, 0))
    return out


class Boxes:
    """Boxes of the blocks, under boxes of `FAN` neighbours each, level by level."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.levels = [(low, high)]
        while len(low) > FAN:
            starts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((low, high))
        self.rows = int(np.clip((1 << 20) // len(self.levels[0][0]), 1, 512))  # points asked for at a time

    def distance(self, level: int, points: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Squared distance of each point to its box."""
        low, high = self.levels[level]
        gap = np.maximum(np.maximum(low[box] - points, points - high[box]), 0)
        return np.einsum("nk,nk->n", gap, gap)

    def within(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, box, squared distance) of the boxes no farther from a point than its reach, by row and box."""
        top = len(self.levels) - 1
        row, box = np.divmod(np.arange(len(points) * len(self.levels[top][0])), len(self.levels[top][0]))
        for level in range(top, -1, -1):
            far = self.distance(level, points[row], box)
            near = far <= reach[row]
            row, box, far = row[near], box[near], far[near]
            if level:
                row, box = np.repeat(row, FAN), (box[:, None] * FAN + np.arange(FAN)).ravel()
                there = box < len(self.levels[level - 1][0])
                row, box = row[there], box[there]
        return row, box, far


class Block:
    """kd-tree of one block: leaves of neighbouring points, each a run of rows, with their boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        leaf = block_of(points, split_tree(points, max(1, -(-len(points) // LEAF))))
        # points that a cut cannot part share a leaf; it is dealt into runs of LEAF rows
        order = np.lexsort((ids, leaf))
        first = np.flatnonzero(np.concatenate([[True], np.diff(leaf[order]) != 0]))
        within = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        self.ids, self.vectors = ids[order], vectors[order]
        self.starts = np.flatnonzero(within % LEAF == 0)
        self.ends = np.append(self.starts[1:], len(order))
        self.low = np.minimum.reduceat(points[order], self.starts, axis=0)
        self.high = np.maximum.reduceat(points[order], self.starts, axis=0)

    def search(self, query_ids, queries, points, bound, k: int, limit: float, norms: float) -> tuple[np.ndarray, np.ndarray]:
        """(k best ids, their scores) of each query; `bound`: a squared distance known to be enough, so that what is
        farther need not be found.

        Leaves come by distance of their boxes, for all queries a step at a time; a query leaves when the test
        says so. The queries that reach a leaf in one step share a matrix product, which is only trusted up to its
        rounding: what may enter the k best is scored row by row, so that equal vectors have equal scores."""
        n, width = queries.shape
        far = box_distance(points, self.low, self.high)
        turn = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, turn, axis=1)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        best = np.full((n, k), -np.inf)
        length2 = np.einsum("ij,ij->i", queries, queries)
        own = length2 + norms * norms
        rounding = 4 * width * np.finfo(float).eps * np.sqrt(length2) * norms
        floor = (own - np.maximum(bound, ROUNDING * own)) / 2 - ROUNDING * own  # the score of that distance
        active = np.arange(n)
        for step in range(far.shape[1]):
            # |q|^2 + norms^2 - 2 * score is the squared distance of the query, zero lifted, to a lifted vector
            kth = np.maximum(own[active] - 2 * best[active, -1], ROUNDING * own[active])
            active = active[far[active, step] <= limit * np.minimum(kth, bound[active])]
            if not len(active):
                break
            leaf = turn[active, step]
            asked = active[np.argsort(leaf, kind="stable")]
            reached, first = np.unique(np.sort(leaf), return_index=True)
            rows, members = [], []
            for at, lo, hi in zip(reached, first, np.append(first[1:], len(asked))):
                some, start = asked[lo:hi], self.starts[at]
                rough = queries[some] @ self.vectors[start : self.ends[at]].T
                least = np.maximum(best[some, -1], floor[some]) - rounding[some]
                row, member = np.nonzero(rough >= least[:, None])
                rows.append(some[row])
                members.append(member + start)
            row, member = np.concatenate(rows), np.concatenate(members)
            other = self.ids[member] != query_ids[row]
            row, member = row[other], member[other]
            if len(row):
                pieces = np.split(np.arange(len(row)), np.arange(PRODUCTS // width + 1, len(row), PRODUCTS // width + 1))
                score = np.concatenate([np.einsum("nd,nd->n", queries[row[p]], self.vectors[member[p]]) for p in pieces])
                self._enter(best_id, best, row, self.ids[member], score)
        return best_id, best

    @staticmethod
    def _enter(best_id: np.ndarray, best: np.ndarray, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Let candidates (row, id, score) into the k best of their rows, ties to the smaller id."""
        k, changed = best.shape[1], np.unique(row)
        row = np.concatenate([np.repeat(changed, k), row])
        ids = np.concatenate([best_id[changed].ravel(), ids])
        score = np.concatenate([best[changed].ravel(), score])
        order = np.lexsort((ids, -score, row))
        pick = order[np.searchsorted(row[order], changed)[:, None] + np.arange(k)]
        best_id[changed], best[changed] = ids[pick], score[pick]


def squared_norm(vector: str) -> Column:
    return F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, of the most common length; floats stay floats until they are used."""
    single = rows.select(F.col(vector_col).alias("v")).schema["v"].dataType.simpleString() == "array<float>"
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", number) & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def search(rows: DataFrame, is_query: Column, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, block: int = BLOCK, slice_: int = SLICE, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which `is_query` (over vec_id) holds."""
    spark = rows.sparkSession
    vectors = materialize(usable(rows, id_col, vector_col), "vectors")
    count, norm, width = vectors.agg(F.count("*"), F.max(F.sqrt(squared_norm("v"))), F.max(F.size("v"))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kept = vectors.schema["v"].dataType.simpleString()
    axes = directions(width + 1)
    limit = quantile(confidence)

    def project(v: np.ndarray) -> np.ndarray:
        return lifted(v, norm) @ axes

    def matrix(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)

    # the block tree, from a sample chosen by hash
    share = min(1.0, sample / count)
    draw = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    fitted = vectors.where(draw).select("vec_id", "v").toArrow()
    # sorted by id, so that the same rows give the same tree on every run
    some = matrix(fitted.column("v"))[np.argsort(fitted.column("vec_id").to_numpy(), kind="stable")] if fitted.num_rows else np.zeros((1, width))
    nodes = split_tree(project(some), max(1, -(-count // block)))
    tree = spark.sparkContext.broadcast(nodes)

    def place(batches):
        for batch in batches:
            points = project(matrix(batch.column(1)))
            found = block_of(points, tree.value)
            p = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), DIMENSIONS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, p, pa.array(found)], ["vec_id", "v", "p", "block"])

    placed = vectors.mapInArrow(place, f"vec_id long, v {kept}, p array<double>, block long")
    placed = materialize(placed, "placed")
    # a block that came out too large is cut by hash; `part` is what a task holds
    sizes = placed.groupBy("block").agg(F.count("*").alias("n"))
    placed = placed.join(sizes, "block").withColumn(
        "part", F.col("block") * F.lit(1 << 24) + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.ceil(F.col("n") / (2 * block)).cast("long"))
    ).drop("n", "block")
    axis = [F.get("p", F.lit(i)) for i in range(DIMENSIONS)]
    boxes = placed.groupBy("part").agg(
        F.array(*[F.min(a) for a in axis]).alias("low"), F.array(*[F.max(a) for a in axis]).alias("high")
    ).toArrow()  # one row per block
    boxes = boxes.sort_by("part")  # parts of the tree's neighbouring leaves side by side
    low, high = (np.array(boxes.column(c).to_pylist()) for c in ("low", "high"))
    shared = spark.sparkContext.broadcast((boxes.column("part").to_numpy(), Boxes(low, high)))

    def visit(data: DataFrame, asked: DataFrame) -> DataFrame:
        """asked: (part, query_id, v, p, bound), searched in its part, slice by slice."""
        slices = asked.groupBy("part").agg(F.ceil(F.count("*") / slice_).cast("int").alias("slices"))
        rows = data.join(slices, "part").select(
            "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v", "p", F.lit(0.0).alias("bound")
        )
        queries = asked.join(slices, "part").select(
            "part", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int").alias("slice"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "v", "p", "bound"
        )

        def run(table: pa.Table) -> pa.Table:
            asks = table.column("asks").to_numpy(zero_copy_only=False)
            ids, v = table.column("id").to_numpy(), matrix(table.column("v"))
            p = table.column("p").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
            bound = table.column("bound").to_numpy()
            index = Block(ids[~asks], v[~asks], p[~asks])
            out = []
            together = max(1, PRODUCTS // (DIMENSIONS * len(index.starts)))
            for lo in range(0, int(asks.sum()), together):
                at = np.flatnonzero(asks)[lo : lo + together]
                found, score = index.search(ids[at], v[at], p[at], bound[at], k, limit, norm)
                real = ~np.isneginf(score)
                out.append((np.repeat(ids[at], k)[real.ravel()], found[real], score[real]))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

        return rows.union(queries).groupBy("part", "slice").applyInArrow(run, FOUND)

    def settle(batches):
        """A query's projection (zero in the extra coordinate) and the nearest box; of several, one by its id."""
        parts, index = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, index.rows):
                b = batch.slice(lo, index.rows)
                points = matrix(b.column(1)) @ axes[:width]
                # the box of the leaf it falls into bounds the distance to the nearest one
                guess = np.searchsorted(parts, block_of(points, tree.value) * (1 << 24)).clip(max=len(parts) - 1)
                row, box, far = index.within(points, np.nextafter(index.distance(0, points, guess), np.inf))
                nearest = np.minimum.reduceat(far, np.searchsorted(row, np.arange(len(points))))
                row, box = row[far == nearest[row]], box[far == nearest[row]]
                ties = np.bincount(row, minlength=len(points))
                mixed = (b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                home = box[np.cumsum(ties) - ties + mixed.astype(np.int64) % ties]
                p = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), DIMENSIONS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(parts[home]), *b.columns, p], ["part", "query_id", "v", "p"])

    asking = placed.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    queries = materialize(asking.mapInArrow(settle, f"part long, query_id long, v {kept}, p array<double>"), "neighbours-queries")
    home = materialize(visit(placed, queries.withColumn("bound", F.lit(float("inf")))), "neighbours-home")
    # squared distance of the k-th found under the lifting, infinite while there are fewer
    kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    lengths = squared_norm("v") + F.lit(norm * norm)
    reach = F.when(F.col("n") >= k, F.greatest(lengths - 2 * F.col("least"), lengths * ROUNDING)).otherwise(F.lit(float("inf")))
    bounded = queries.join(kth, "query_id", "left").select("part", "query_id", "v", "p", F.coalesce(reach, F.lit(float("inf"))).alias("bound"))

    def others(batches):
        parts, index = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, index.rows):
                b = batch.slice(lo, index.rows)
                p = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
                row, to, _ = index.within(p, limit * b.column(4).to_numpy())
                away = parts[to] != b.column(0).to_numpy()[row]
                row, to = row[away], to[away]
                if len(row):
                    taken = b.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(parts[to]), *taken.columns[1:]], ["part", "query_id", "v", "p", "bound"])

    away = bounded.mapInArrow(others, f"part long, query_id long, v {kept}, p array<double>, bound double")
    found = home.union(visit(placed, materialize(away, "neighbours-asked")))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
