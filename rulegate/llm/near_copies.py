"""Near copies by the exact Jaccard similarity of their word shingles.

Two texts are near copies when the sets of their five-word shingles have a Jaccard similarity of at least 4/5; groups
are what chains of near copies connect. Candidates come from two indexes. SimHashes of the shingle sets that differ in
few bits are found by the Gray-order index; but at a similarity of 0.8 two 64-bit SimHashes differ in about ten bits,
and an index over so many bits needs hundreds of trees. The rest comes from MinHash: `BANDS` bands of `ROWS` minima
each, and texts that share a band are in one candidate group. A pair at 0.8 shares none with probability
(1 - 0.8^5)^20, 0.04 %, one at 0.9 with 10^-8; chains lower this further.

Candidate groups only say where to look: inside each, shingle sets are compared in full and what is below the
similarity is not linked. A group of more than `MEMBERS` texts or `SHINGLES` shingles is cut by hash into parts, and
each pair of parts is compared by its own task. Texts with the same set were merged before, so that copies cost nothing.

Defined results: a null text is an empty one; texts without words are copies of each other; a text of fewer than five
words is one shingle; ASCII letters are folded; of a group the row with the smallest id stays, of several such rows one;
a group without any id keeps one row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rulegate.llm import simhash
from rulegate.llm.common import by_value
from rulegate.llm.simhash import components
from rulegate.session import materialize

by_value(__name__)

SEED = 42
SHINGLE = 5
SIMILAR = (4, 5)
BANDS = 20
ROWS = 5
MEMBERS = 1_024  # texts in a part of a candidate group
SHINGLES = 2_000_000
AT_ONCE = 16_384


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as XXH64, in order."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    parts = []
    for lo in range(0, n, AT_ONCE):
        a, b = starts[:n][lo : lo + AT_ONCE].tolist(), ends[-n:][lo : lo + AT_ONCE].tolist()
        parts.append(np.array([h(joined[i:j], SEED) for i, j in zip(a, b)], np.uint64))
    return np.unique(np.concatenate(parts))


def bands(found: np.ndarray, factors: np.ndarray) -> list[int]:
    """One number per band of minima of a set; none for an empty one."""
    from xxhash import xxh64_intdigest as h

    if not len(found):
        return []
    least = np.full(factors.shape[1], np.iinfo(np.uint64).max)
    for lo in range(0, len(found), 1_024):
        least = np.minimum(least, (found[lo : lo + 1_024, None] * factors[0] + factors[1]).min(axis=0))
    return [h(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, ROWS))]


def fingerprint(found: np.ndarray) -> np.uint64:
    """SimHash of a shingle set."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(found), AT_ONCE):
        counts += np.unpackbits(found[lo : lo + AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(found)).view(">u8")[0].astype(np.uint64)


def keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, key, text): rows with a key of their whole text, by which a row is found again."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))


def marks(texts: DataFrame) -> DataFrame:
    """(id, key, mark, fp, bands) of keyed rows: a hash of the shingle set, its SimHash and its bands. Texts stay
    behind."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    factors[0] |= np.uint64(1)

    def task(batches):
        from xxhash import xxh64_intdigest as h

        for batch in batches:
            mark, fp, found = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64), []
            for k, text in enumerate(batch.column(2)):
                own = shingles(text.as_py())
                mark[k] = h(own.tobytes(), SEED)
                fp[k] = fingerprint(own)
                found.append(np.array(bands(own, factors), np.uint64).view(np.int64))
            lists = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(x.view(np.int64)) for x in (mark, fp)], lists], ["id", "key", "mark", "fp", "bands"])

    fields = [*texts.schema.fields[:2], T.StructField("mark", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return texts.mapInArrow(task, T.StructType(fields))


def simhash_links(marked: DataFrame) -> DataFrame:
    """(a, b): links between marks whose SimHashes the Gray-order index connects."""
    sets = marked.where(F.size("bands") > 0).select("mark", "fp").distinct()
    near = components(simhash.links(sets.select("fp").distinct())).withColumnRenamed("node", "fp")
    rooted = sets.join(near, "fp", "left").select("mark", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("mark").alias("b"), F.count("*").alias("n")).where("n > 1").select("root", "b")
    return rooted.join(least, "root").where("mark <> b").select(F.col("mark").alias("a"), "b")


def compare(flat: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets (numbers of `flat`, cut by `size`) whose chains connect all sets that are similar enough."""
    start = np.cumsum(size) - size
    values, flat = np.unique(flat, return_inverse=True)
    label, inside = np.arange(len(size)), np.zeros(len(values), bool)
    p, q = SIMILAR
    pairs = []
    for i in range(1, len(size)):
        inside[flat[start[i] : start[i] + size[i]]] = True
        # the first of each group before the rest: what it connects need not be compared again
        for pool in (np.unique(label[:i]), np.arange(i)):
            pool = pool[(label[pool] != label[i]) & (q * np.minimum(size[pool], size[i]) >= p * np.maximum(size[pool], size[i]))]
            if not len(pool):
                continue
            n = size[pool]
            first = np.cumsum(n) - n
            common = np.add.reduceat(inside[flat[np.repeat(start[pool] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
            for j in pool[(p + q) * common >= p * (n + size[i])].tolist():
                if label[j] != label[i]:
                    pairs.append((i, j))
                    low, high = sorted((label[i], label[j]))
                    label[label == high] = low
        inside[flat[start[i] : start[i] + size[i]]] = False
    return pairs


def links(marked: DataFrame, texts: DataFrame, members: int = MEMBERS, most: int = SHINGLES) -> DataFrame:
    """(a, b): links between marks whose chains connect all candidates that are similar enough. Of the keyed rows,
    one per candidate set is fetched."""
    held = marked.select("mark", F.explode("bands").alias("band")).distinct()
    shared = held.groupBy("band").agg(F.min("mark").alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "b")
    met = held.join(shared, "band").where("mark <> b").select(F.col("mark").alias("a"), "b")
    group = components(met.union(simhash_links(marked)).distinct())

    def task(batches):
        for batch in batches:
            found = pa.array([shingles(t.as_py()).view(np.int64) for t in batch.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], found], ["mark", "root", "s"])

    one = marked.join(group.withColumnRenamed("node", "mark"), "mark").groupBy("mark", "root").agg(F.min(F.struct("key", "id")).alias("one"))
    one = materialize(one.select("mark", "root", F.col("one.key").alias("__key"), F.col("one.id").alias("__id")), "copy-group-members")
    same = (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id"))
    texts = texts.join(one, same).groupBy("mark", "root").agg(F.first("text").alias("text"))
    sets = materialize(texts.mapInArrow(task, "mark long, root long, s array<long>"), "copy-candidates")
    parts = F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum(F.size("s")) / most)).cast("int")
    sized = sets.join(sets.groupBy("root").agg(parts.alias("parts")), "root")
    mine = F.pmod(F.xxhash64("mark"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    # with several parts, a part meets itself inside each pair already
    pairs = F.when(F.col("parts") == 1, pairs).otherwise(F.filter(pairs, lambda x: x["i"] != x["j"]))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("mark")
        mark, s = table.column("mark").to_numpy(), table.column("s").combine_chunks()
        found = compare(s.flatten().to_numpy().view(np.uint64), s.value_lengths().to_numpy().astype(np.int64))
        a, b = (mark[np.array([x[k] for x in found], np.int64)] for k in (0, 1))
        return pa.table({"a": a, "b": b})

    cells = sized.select("root", F.explode(pairs).alias("p"), "mark", "s").select("root", "p.i", "p.j", "mark", "s")
    return cells.groupBy("root", "i", "j").applyInArrow(run, "a long, b long").distinct()


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", members: int = MEMBERS, most: int = SHINGLES) -> DataFrame:
    """The rows of `docs` that represent their group of near copies: those with its smallest id, ties by text.

    Rows are decided on by id and key; whole rows move at most once, when the ones that stay are picked."""
    texts = keyed(docs, text_col, id_col)
    marked = materialize(marks(texts), "copy-marks")
    found = components(links(marked, texts, members, most)).withColumnRenamed("node", "mark")
    rooted = marked.select("id", "key", "mark").join(found, "mark", "left")
    counted = rooted.groupBy(F.coalesce("root", "mark").alias("root"), "id", "key").agg(F.count("*").alias("copies"))
    first = counted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "key", "copies")).alias("f"))
    first = first.select("root", F.col("f.id").alias("__id"), F.col("f.key").alias("__key"), F.col("f.copies").alias("copies"))
    first = materialize(first, "copy-representatives")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    key = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))).alias("key")
    rows = docs.select(row, F.col(f"`{id_col}`").alias("id"), key)
    stays = rows.join(first, (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id")))
    once, several = stays.where("copies = 1"), stays.where("copies > 1").dropDuplicates(["root"])
    return once.select("row.*").union(several.select("row.*"))
