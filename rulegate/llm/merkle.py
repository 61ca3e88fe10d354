"""Merkle manifest of a table, with a witness for every row, grown by appending.

Rows are leaves; a tree joins every `ARITY` consecutive nodes of a level (the last run may be shorter, even one) into
the hash of their digests until one node is left. Leaves are appended in order. A leaf's witness starts empty and
belongs to the open subtree the leaf is in; each time a run is completed, the witnesses of all leaves below its
members are extended by the digests of the other members, left and right apart, so that folding needs no positions.

The stream of appends is cut into aligned blocks of `ARITY ** LEVELS` leaves, each appended by one task. A block's
root is then just another append: the roots of the blocks of a tree are numbered, cut into blocks and appended in the
same way, until each tree has one root. A row's whole witness is its own, then the one of its block's root, and so on.
However many leaves a tree has, a task holds one block, and rounds grow with the logarithm of the leaves.

A manifest has a tree per source and a tree over the sources' roots, in order of the source (null first).

Defined results: null columns enter as `-`; rows without an id come first in their source; rows of one id are
ordered by their leaf; equal rows are leaves of their own; only the named columns enter or are carried; an empty
table has no leaves and no root. Proofs of a lone leaf in a lone source are the hash of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rulegate.llm.common import by_value
from rulegate.operators.numbering import global_rank
from rulegate.session import materialize

by_value(__name__)

ARITY = 3
LEVELS = 6
ROWS_AT_ONCE = 2_000

SIDES = T.ArrayType(T.StructType([T.StructField("left", T.BinaryType(), False), T.StructField("right", T.BinaryType(), False)]), False)


def leaf(columns: Sequence[Column]) -> Column:
    """Digest (hex) of values: `-` for null, else the length in bytes, a colon and the value as text."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


class Block:
    """One aligned block while its leaves are appended: per level the open run, as (digest, leaves below it)."""

    def __init__(self, arity: int):
        self.arity = arity
        self.open: list[list[tuple[bytes, list[int]]]] = [[]]
        self.left: list[list[bytes]] = []
        self.right: list[list[bytes]] = []

    def append(self, digest: bytes) -> None:
        self.left.append([])
        self.right.append([])
        self.open[0].append((digest, [len(self.left) - 1]))
        level = 0
        while len(self.open[level]) == self.arity:
            self.complete(level)
            level += 1

    def complete(self, level: int) -> None:
        """Join the open run of a level: witnesses below each member are extended by the others."""
        run = self.open[level]
        digests = [d for d, _ in run]
        below: list[int] = []
        for k, (_, leaves) in enumerate(run):
            left, right = b"".join(digests[:k]), b"".join(digests[k + 1 :])
            for x in leaves:
                self.left[x].append(left)
                self.right[x].append(right)
            below += leaves
        if level + 1 == len(self.open):
            self.open.append([])
        self.open[level + 1].append((hashlib.sha256(b"".join(digests).hex().encode()).digest(), below))
        self.open[level] = []

    def finish(self, levels: int) -> bytes:
        """Complete what is open, up to `levels`, and return the root."""
        for level in range(levels):
            if self.open[level]:
                self.complete(level)
        return self.open[levels][0][0]


def levels_of(n: int, arity: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n = -(-n // arity)
        levels += 1
    return levels


def _appended(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """One round: (tree, rank, block, n, witness, root, carry) of numbered nodes (tree, rank, n, digest, carry)."""
    unit = arity**levels
    longs = [T.StructField(c, T.LongType()) for c in ("tree", "rank", "block", "n")]
    schema = T.StructType([*longs, T.StructField("witness", SIDES), T.StructField("root", T.BinaryType()), nodes.schema["carry"]])

    def rows(done: Block, key: tuple, first: int, n: int, carry: pa.Array):
        root = done.finish(levels if n > unit else levels_of(n, arity))
        for lo in range(0, len(done.left), ROWS_AT_ONCE):
            left, right = done.left[lo : lo + ROWS_AT_ONCE], done.right[lo : lo + ROWS_AT_ONCE]
            size, edges = len(left), [0]
            for x in left:
                edges.append(edges[-1] + len(x))
            sides = pa.StructArray.from_arrays([pa.array([d for x in s for d in x], pa.binary()) for s in (left, right)], ["left", "right"])
            ranks = pa.array(range(first + lo, first + lo + size), pa.int64())
            tree, block, count = (pa.array([v] * size, pa.int64()) for v in (*key, n))
            witness = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), sides)
            roots = pa.array([root] * size, pa.binary())
            yield pa.RecordBatch.from_arrays([tree, ranks, block, count, witness, roots, carry.slice(lo, size)], schema.names)

    def task(batches):
        block, key, first, size = None, None, 0, 0
        carried: list[pa.Array] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(4)]
            start = 0
            for k, (tree, mine, rank, n, digest) in enumerate(zip(*columns, batch.column(4))):
                if (tree, mine) != key:
                    if block:
                        carried.append(batch.column(5).slice(start, k - start))
                        yield from rows(block, key, first, size, pa.concat_arrays(carried))
                    start, carried = k, []
                    block, key, first, size = Block(arity), (tree, mine), rank, n
                block.append(digest.as_py())
            carried.append(batch.column(5).slice(start))
        if block:
            yield from rows(block, key, first, size, pa.concat_arrays(carried))

    placed = nodes.select("tree", F.expr(f"rank div {unit}").alias("block"), "rank", "n", "digest", "carry")
    dealt = placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
    return dealt.mapInArrow(task, schema)


def grow(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(tree, rank, witness, root, carry) of every node (tree long, rank from 0 in its tree, n nodes in the tree,
    digest binary, carry of any type); a tree of one node is that node. One round of appends per `levels` levels of
    the largest tree."""
    unit = arity**levels
    grown = materialize(_appended(nodes, arity, levels), "merkle-appends")
    large = grown.where(F.col("n") > unit)
    if large.isEmpty():
        return grown.select("tree", "rank", "witness", "root", "carry")
    # the first row of each block stands for its root
    roots = large.where(F.col("rank") % unit == 0).select(
        "tree", F.col("block").alias("rank"), F.expr(f"(n + {unit - 1}) div {unit}").alias("n"), F.col("root").alias("digest"), F.lit(0).alias("carry")
    )
    above = grow(roots, arity, levels).select(
        F.col("tree").alias("__tree"), F.col("rank").alias("__rank"), F.col("witness").alias("__witness"), F.col("root").alias("__root")
    )
    whole = grown.join(above, (F.col("tree") == F.col("__tree")) & (F.col("block") == F.col("__rank")), "left")
    none = F.array().cast(SIDES.simpleString())
    witness = F.concat("witness", F.coalesce("__witness", none)).alias("witness")
    return whole.select("tree", "rank", witness, F.coalesce("__root", "root").alias("root"), "carry")


def fold(digest: Column, witness: Column) -> Column:
    """Root (hex) that a leaf (hex) and its witness lead to."""
    side = lambda b: F.lower(F.hex(b))
    return F.aggregate(witness, digest, lambda h, w: F.sha2(F.concat(side(w["left"]), h, side(w["right"])), 256))


def proof(witness: Column) -> Column:
    """All sibling digests (hex) of a witness, level by level and left to right, in one text."""
    return F.lower(F.array_join(F.transform(witness, lambda w: F.concat(F.hex(w["left"]), F.hex(w["right"]))), ""))


def manifest(docs: DataFrame, columns: Sequence[str], tree_col: str = "source", id_col: str = "doc_id", tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of `docs`: id, leaf, subroot, root (hex), witness (levels of the own tree, then of the tree of
    trees), and `tampered_leaf`: the leaf with some columns replaced, as a reader of altered data would compute it.

    Rows travel as digests only; texts are read once and never shuffled.
    """
    changed = tampered or {}
    value = {c: F.col(f"`{c}`") for c in columns}
    leaves = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{tree_col}`").cast("string").alias("name"),
        F.unhex(leaf([value[c] for c in columns])).alias("digest"),
        F.unhex(leaf([changed.get(c, value[c]) for c in columns])).alias("other"),
    )
    # equal rows differ by where they lie in the written table, so that a sort can part them
    written = materialize(leaves.withColumn("at", F.monotonically_increasing_id()), "merkle-leaves")
    ranked = global_rank(written, ["name", "id", "digest", "at"], "place")
    trees = materialize(ranked.groupBy("name").agg(F.min("place").alias("start"), F.count("*").alias("n")), "merkle-trees")
    numbers = global_rank(trees.withColumnRenamed("name", "__name"), ["__name"], "tree")
    numbered = ranked.join(numbers, F.col("name").eqNullSafe(F.col("__name"))).select(
        "tree", (F.col("place") - F.col("start")).alias("rank"), "n", "digest", F.struct("id", "digest", "other").alias("carry")
    )
    own = grow(numbered)
    subroots = own.where("rank = 0").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(trees.count()).cast("long").alias("n"), F.col("root").alias("digest"), F.lit(0).alias("carry")
    )
    above = grow(subroots).select(F.col("rank").alias("__number"), F.col("witness").alias("__above"), F.col("root").alias("__top"))
    text = lambda c: F.lower(F.hex(c))
    return own.join(above, F.col("tree") == F.col("__number")).select(
        F.col("carry.id").alias(id_col),
        text("carry.digest").alias("leaf"),
        text("root").alias("subroot"),
        text("__top").alias("root"),
        F.concat("witness", "__above").alias("witness"),
        text("carry.other").alias("tampered_leaf"),
    )
