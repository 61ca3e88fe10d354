"""SimHash near-duplicate groups by a Gray-order hierarchical index.

Fingerprints that differ in at most `distance` bits agree on some group of bands of bits, so the index has one
tree per group of bands; a tree's top nodes are the bit patterns shared under that mask. Inside a top node the
fingerprints are sorted by Gray rank, which puts close ones side by side, and every eight neighbours are
factored into a node of their shared bits, again and again up to one root. A search goes down from the root:
each level adds the differences in the bits that level newly fixes, and a group whose sum exceeds the distance
is dropped whole. A group whose free bits cannot exceed what is left of the distance is accepted whole: all its
members are linked already, so one link stands for them. Only a spanning forest of the links found leaves a
task, never all pairs of a group.

A top node with more than `cell` distinct fingerprints is cut by hash into parts, and each pair of parts is
searched by its own task, so that no task holds more than two parts; exact copies were merged before.

Components come from alternating large-star and small-star steps over the link table; steps are written to the
shared folder, so a lost executor costs one step.

Defined results: a null text is an empty one; documents without words have fingerprint zero and link like any
other; repeated rows and equal texts share a component; rows without an id take part, but a component's id is
the smallest id present (null if none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rulegate.llm.common import by_value
from rulegate.session import materialize

by_value(__name__)

SEED = 42
SHINGLE = 3
DISTANCE = 3
BANDS = 4  # five or six bands (10 or 20 trees) keep top nodes small beyond about a billion documents
CELL = 8_000  # distinct fingerprints in a part of a top node
FANOUT = 8
FRONTIER = 400_000  # (query, node) pairs looked at together
SHINGLES_AT_ONCE = 200_000

# ---- fingerprints -------------------------------------------------------------------------------


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of hashes: the bits set in over half of them; zero for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    starts = (np.cumsum(sizes) - sizes)[full]
    sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    packed = np.packbits(2 * sums > sizes[full, None], axis=1)
    out[full] = packed.view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """`keep` columns and `fp`: 64-bit SimHash of every whole text, a bit set if set in over half of the shingles'
    XXH64. No shuffle; a long text adds up its bit counts block by block."""
    keep = list(keep)

    def task(batches):
        from xxhash import xxh64_intdigest as h

        for batch in batches:
            marks = np.zeros(batch.num_rows, np.uint64)
            hashes: list[int] = []
            sizes: list[int] = []
            rows: list[int] = []

            def flush():
                if rows:
                    marks[rows] = majority(np.array(hashes, np.uint64), np.array(sizes))
                    hashes.clear(), sizes.clear(), rows.clear()

            for row, text in enumerate(batch.column(0)):
                # bytes.lower() folds ASCII letters only, bytes.split() cuts at the six ASCII white spaces
                words = (text.as_py() or "").encode().lower().split()
                if not words:
                    continue
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                n = max(1, len(words) - shingle + 1)
                a, b = starts[:n].tolist(), ends[-n:].tolist()
                if n > SHINGLES_AT_ONCE:
                    counts = np.zeros(64, np.int64)
                    for lo in range(0, n, SHINGLES_AT_ONCE):
                        part = np.array([h(joined[i:j], SEED) for i, j in zip(a[lo : lo + SHINGLES_AT_ONCE], b[lo : lo + SHINGLES_AT_ONCE])], ">u8")
                        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                    marks[row] = np.packbits(2 * counts > n).view(">u8")[0]
                    continue
                if len(hashes) + n > SHINGLES_AT_ONCE:
                    flush()
                hashes.extend([h(joined[i:j], SEED) for i, j in zip(a, b)])
                sizes.append(n)
                rows.append(row)
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(marks.view(np.int64))], [*keep, "fp"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("fp", T.LongType(), False)])
    return docs.select(F.col(text_col).alias("__text"), *keep).mapInArrow(task, schema)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- index ---------------------------------------------------------------------------------------


def band_masks(bands: int = BANDS, distance: int = DISTANCE) -> list[int]:
    """Masks of the groups of bands of which one must be free of differences."""
    edges = [64 * k // bands for k in range(bands + 1)]
    band = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(group) for group in combinations(band, bands - distance)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def link_groups(group: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For rows of several groups (group number ascending): a label per row, equal for rows that chains of
    links within their group connect. Labels are row positions."""
    n = len(fp)
    order = np.lexsort((gray_rank(fp), group))
    g, q = group[order], fp[order]
    # levels[k] = (first child, children, group, mask of shared bits, pattern); level 0 are the rows themselves
    every = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    levels = [(np.arange(n), np.ones(n, np.int64), g, every, q)]
    low, high = q.copy(), q.copy()  # AND and OR of what is below a node
    first_row = np.arange(n)
    rows_of = [first_row]
    while len(levels[-1][2]) > len(np.unique(levels[-1][2])):
        mine = levels[-1][2]
        begins = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        place = np.arange(len(mine)) - np.repeat(begins, np.diff(np.append(begins, len(mine))))
        starts = np.flatnonzero(place % FANOUT == 0)
        low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
        mask = ~(low ^ high)
        levels.append((starts, np.diff(np.append(starts, len(mine))), mine[starts], mask, low & mask))
        rows_of.append(rows_of[-1][starts])
    parent = np.arange(n)

    def union(a: np.ndarray, b: np.ndarray) -> None:
        # hook larger roots under smaller ones and flatten, until all pairs agree
        while len(a):
            ra, rb = parent[a], parent[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up

    roots = levels[-1]
    root_of = np.searchsorted(roots[2], g)
    # members of a node with few free bits are linked by construction
    for k in range(1, len(levels)):
        starts, number, _, mask, _ = levels[k]
        tight = np.flatnonzero(np.bitwise_count(~mask) <= distance)
        if len(tight):
            heads = np.repeat(rows_of[k][tight], number[tight])
            inside = np.concatenate([np.arange(a, a + m) for a, m in zip(starts[tight].tolist(), number[tight].tolist())])
            union(heads, rows_of[k - 1][inside])
    # groups are disjoint, so the depth-first order of (level, pairs) on a stack keeps memory bounded
    for lo in range(0, n, FRONTIER):
        mine = np.arange(lo, min(n, lo + FRONTIER))
        node = root_of[mine]
        gone = np.bitwise_count((q[mine] ^ roots[4][node]) & roots[3][node]).astype(np.int64)
        stack = [(len(levels) - 1, mine, node, gone)]
        while stack:
            level, who, node, gone = stack.pop()
            _, _, _, mask, pattern = levels[level]
            free = np.bitwise_count(~mask[node]).astype(np.int64)
            near = gone <= distance
            # accepted whole: every member is near, and the members are linked among themselves
            whole = near & (gone + free <= distance)
            if whole.any():
                union(who[whole], rows_of[level][node[whole]])
            on = near & ~whole
            # a later row finds earlier ones: subtrees that lie wholly after the row are left to the others
            on &= rows_of[level][node] < who
            if level == 0 or not on.any():
                continue
            who, node, gone = who[on], node[on], gone[on]
            for a in range(0, len(who), FRONTIER // FANOUT):
                w, x, d = who[a : a + FRONTIER // FANOUT], node[a : a + FRONTIER // FANOUT], gone[a : a + FRONTIER // FANOUT]
                number = levels[level][1][x]
                child = np.repeat(levels[level][0][x], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                w, d, above = np.repeat(w, number), np.repeat(d, number), np.repeat(mask[x], number)
                _, _, _, m, p = levels[level - 1]
                d = d + np.bitwise_count((q[w] ^ p[child]) & m[child] & ~above)
                stack.append((level - 1, w, child, d))
    labels = np.empty(n, np.int64)
    labels[order] = order[parent]
    return labels


def links(distinct: DataFrame, bands: int = BANDS, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` whose chains connect all that are within `distance`."""
    if distance >= bands:
        raise ValueError("more bands than differing bits are needed")
    trees = [signed(m) for m in band_masks(bands, distance)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("tree"), F.lit(m).alias("mask")) for k, m in enumerate(trees)]))
    keyed = distinct.select("fp", each.alias("t")).select("fp", F.col("t.tree").alias("tree"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("top"))
    # top nodes with one fingerprint link nothing; large ones are cut into parts and searched pair by pair
    sizes = keyed.groupBy("tree", "top").agg(F.count("*").alias("n")).where("n > 1")
    sized = keyed.join(sizes, ["tree", "top"]).withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    # with several parts, a part meets itself inside each pair already
    pairs = F.when(F.col("parts") == 1, pairs).otherwise(F.filter(pairs, lambda p: p["i"] != p["j"]))
    cells = sized.select("tree", "top", "fp", F.explode(pairs).alias("p")).select("tree", "top", "p.i", "p.j", "fp")

    def task(batches):
        held: list[pa.Table] = []
        rows = 0

        def edges(table: pa.Table):
            key = [table.column(c).to_numpy() for c in ("tree", "top", "i", "j")]
            fp = table.column("fp").to_numpy().view(np.uint64)
            new = np.zeros(len(fp), bool)
            for c in key:
                new[1:] |= c[1:] != c[:-1]
            label = link_groups(np.cumsum(new), fp, distance)
            other = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[other].view(np.int64)), pa.array(fp[label[other]].view(np.int64))], ["a", "b"])

        def last_group(table: pa.Table) -> int:
            """Where the last, maybe unfinished, group begins."""
            new = np.zeros(table.num_rows, bool)
            for c in ("tree", "top", "i", "j"):
                v = table.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            at = np.flatnonzero(new)
            return int(at[-1]) if len(at) else 0

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= 4 * cell:
                table = pa.concat_tables(held)
                cut = last_group(table)
                if cut:
                    yield edges(table.slice(0, cut))
                    held = [table.slice(cut)]
                    rows = table.num_rows - cut
        if rows:
            yield edges(pa.concat_tables(held))

    keys = ["tree", "top", "i", "j"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, "a long, b long").distinct()


# ---- components ------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of the edge table (a, b) is connected to, roots included.

    Large-star and small-star steps in turn until the edges are stars. Minima are aggregations joined back, so
    a hub's edges can be split by the join; every step is a written table.
    """

    def step(e: DataFrame, small: bool) -> DataFrame:
        # e: directed (u, v), meaning v is a neighbour of u
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = both.where("b < a") if small else both
        least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        near = seen if small else seen.where("b > a")
        moved = near.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if small:
            moved = moved.union(least.select("a", F.col("m").alias("b")))
        return moved.where("a != b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    before = state(edges)
    while before[0]:
        edges = materialize(step(step(edges, False), True), "stars")
        after = state(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bands: int = BANDS, cell: int = CELL) -> DataFrame:
    """(id, fp, component_id, root) of every row: the smallest id a chain of links reaches, and the fingerprint
    that names the component."""
    marked = materialize(fingerprints(docs, text_col, [id_col]), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    found = components(links(distinct.select("fp"), bands, DISTANCE, cell))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "root")
    return marked.join(named, "fp").select(id_col, "fp", "component_id", "root")


def one_row_each(marked: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of `marked` (row, id, mark), one per component of `found` (node, root), which holds marks: the one with
    the smallest id, ties by mark; a component without any id keeps one row."""
    rooted = marked.select("id", "mark").join(found.withColumnRenamed("node", "mark"), "mark", "left")
    counted = rooted.groupBy(F.coalesce("root", "mark").alias("root"), "id", "mark").agg(F.count("*").alias("copies"))
    first = counted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "mark", "copies")).alias("f"))
    first = materialize(first.select("root", F.col("f.id").alias("own"), F.col("f.mark").alias("mark"), F.col("f.copies").alias("copies")), "representatives")
    stays = marked.join(first, "mark").where(F.col("id").eqNullSafe(F.col("own")))
    return stays.where("copies = 1").select("row").union(stays.where("copies > 1").dropDuplicates(["root"]).select("row"))


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that represent their component: those with its smallest id.

    Rows are told apart by id and fingerprint: of several rows with the id that stays, the one with the smallest
    fingerprint remains. A component without any id keeps one row."""
    row = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    marked = materialize(fingerprints(row, "text", ["row", "id"]), "near-duplicates").withColumnRenamed("fp", "mark")
    return one_row_each(marked, components(links(marked.select(F.col("mark").alias("fp")).distinct()))).select("row.*")
