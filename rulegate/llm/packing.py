"""Best-fit packing of token sequences, planned over a histogram of lengths.

How many pieces there are of each length is at most `capacity` numbers, whatever the number of documents.
Best-fit decreasing runs over those counts: a step moves a whole run of equal pieces into a run of equal bins,
so the plan is a list of runs (length, ranks from-to, first bin, offset) whose size depends on the capacity
alone. Pieces then find their slot by a join on length and rank within the length. Ranks are counted per
(length, bucket of the id) and shifted by the counts of the buckets before, so a length that a third of all
pieces share is spread over all buckets.

Defined results: a null text is an empty one and still makes a piece (the end token); repeated ids keep one
slot per row; an empty table gives an empty plan; only the id and the text are carried from the input.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rulegate.llm.bpe import Codec, load_vocabulary, values
from rulegate.llm.common import by_value
from rulegate.session import materialize

by_value(__name__)

CAPACITY = 1024
END = 2
BUCKET_ROWS = 20_000  # pieces that one (length, bucket) group ranks at most on average

PIECES = "piece int, start long, length long, ids_crc32 long"
RUN = "length long, rank_from long, rank_to long, sequence_from long, offset long"


class WordCodec(Codec):
    """The same encoding with the words new to a task merged by a compiled byte-pair merger."""

    def learn(self, words: set[str]) -> None:
        if not hasattr(self, "merge"):
            import tiktoken

            order = [m for m in sorted(range(self.size), key=self.born.__getitem__) if self.born[m] >= 0]
            if order != sorted(order):
                raise ValueError("token ids are not in merge order")
            self.merge = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=self.ids, special_tokens={})._core_bpe.encode_single_piece
        for word in words:
            self.words[word] = len(self.at) - 1
            self.flat.extend(self.merge(word.encode()))
            self.at.append(len(self.flat))


def cuts(length: int, capacity: int) -> range:
    """Starts after the first piece: pieces of `capacity` counted from the end, so only the first is shorter."""
    return range(length % capacity or capacity, length, capacity)


def token_pieces(docs: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id", end: int = END, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: its token ids and the end token, cut to at most `capacity`. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    fields = T._parse_datatype_string(PIECES + (", ids array<int>" if with_ids else "")).fields
    schema = T.StructType([docs.schema[id_col], *fields])

    def task(batches):
        codec = WordCodec(shared.value)
        for batch in batches:
            row = 0
            for flat, sizes in codec.encode(values(batch.column(1))):
                at, out, lists = 0, [[] for _ in range(5)], []
                for size in sizes.tolist():
                    ids = np.append(flat[at : at + size], end).astype("<u4")
                    at += size
                    edges = [0, *cuts(size + 1, capacity), size + 1]
                    for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                        for column, value in zip(out, (row, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                            column.append(value)
                        if with_ids:
                            lists.append(ids[a:b])
                    row += 1
                columns = [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(lists, pa.list_(pa.int32()))] if with_ids else [])], schema.names)

    return docs.select(id_col, text_col).mapInArrow(task, schema)


def plan(counts: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over (length, count): runs (length, rank from, rank to, first sequence, offset)."""
    runs: list[tuple[int, int, int, int, int]] = []
    free: list[int] = []  # spaces that some bin has left, ascending
    bins: dict[int, list[tuple[int, int]]] = {}  # by space left: (first sequence, bins)
    made = 0

    def put(space: int, first: int, number: int) -> None:
        if space and number:
            if space not in bins:
                insort(free, space)
            bins.setdefault(space, []).append((first, number))

    for length, count in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        rank = 0
        while rank < count:
            k = bisect_left(free, length)
            if k == len(free):
                # no bin fits: new ones, each filled as far as this length goes before the next is opened
                each = capacity // length
                full, rest = divmod(count - rank, each)
                for level in range(each):
                    number = full + (level < rest)
                    if number:
                        # the one bin that stays short of a full set is the last
                        runs.append((length, rank, rank + number, made, level * length))
                        rank += number
                put(capacity - each * length, made, full)
                if rest:
                    put(capacity - rest * length, made + full, 1)
                made += full + bool(rest)
                break
            space = free[k]
            first, number = bins[space].pop()
            used = min(number, count - rank)
            if number > used:
                bins[space].append((first + used, number - used))
            if not bins[space]:
                del bins[space]
                free.remove(space)
            runs.append((length, rank, rank + used, first, capacity - space))
            rank += used
            put(space - length, first, used)
    return runs


def ranked(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`rank` within each length, from 0, ordered by bucket and then id and piece."""
    buckets = max(1, -(-pieces.count() // BUCKET_ROWS))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)))
    counts = bucketed.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy(F.col(id_col).asc_nulls_first(), "piece", "ids_crc32")
    return (
        bucketed.withColumn("within", F.row_number().over(within))
        .join(base, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("within") - 1)
        .drop("bucket", "base", "within")
    )


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Give every piece (a table, read several times) its `sequence_id` and `offset`.

    The driver sees the histogram (at most `capacity` rows) and the plan; its runs depend on the capacity, not
    on the number of pieces, so the plan is small enough to broadcast.
    """
    spark = pieces.sparkSession
    counts = [(r["length"], r["count"]) for r in pieces.groupBy("length").count().collect()]
    runs = spark.createDataFrame(plan(counts, capacity), RUN)
    rows, run = ranked(pieces, id_col).alias("p"), runs.alias("r")
    fits = (F.col("p.length") == F.col("r.length")) & (F.col("p.rank") >= F.col("r.rank_from")) & (F.col("p.rank") < F.col("r.rank_to"))
    return rows.join(F.broadcast(run), fits).select(
        *[F.col(f"p.{c}") for c in pieces.columns],
        (F.col("r.sequence_from") + F.col("p.rank") - F.col("r.rank_from")).alias("sequence_id"),
        F.col("r.offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenize, cut and place every document; one row per piece. The pieces are written once and read for
    the histogram and the ranks."""
    pieces = materialize(token_pieces(docs, vocabulary, end=end, capacity=capacity), "pieces")
    return pack(pieces, capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from placed pieces that carry `ids`: one row per sequence, its token
    ids and the ids of the documents in it, in order. A group holds at most `capacity` tokens."""
    placed = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(placed.alias("p")).select(
        "sequence_id",
        F.flatten(F.col("p.ids")).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
    )
