"""Ranked lexical search by Block-Max MaxScore over shards of an inverted index.

An index row is a shard: up to `SHARD_DOCS` documents that one task read one after the other, their ids and lengths,
and an inverted list per term. A list is cut into blocks of `BLOCK` postings, kept as packed bytes; beside the bytes a
block has its last document and its frontier, the pairs (occurrences, length) that no other posting of the block beats
in both. The score of a posting grows with its occurrences and falls with the length of its document, so the best
score on a frontier is the block's exact maximum, whatever the corpus statistics turn out to be. They are sums over
the index and are known before a search.

A search goes through each shard with each query. Bounds of whole lists, sorted, tell which lists are essential: the
longest run of lists whose bounds together stay below the score of the last place is not, as no document found in
those alone can enter. The documents of the essential lists are gathered window by window of the shard; for the other
lists, from the highest bound down, a document is dropped as soon as its score so far, the maximum of its block in
that list and the bounds of the lists below stay under the last place, and only blocks some document still needs are
unpacked. Each (shard, query) leaves a heap of at most `top` documents; the heaps are merged by a ranked aggregation.

Only the lists of terms that queries ask for are built. Queries go in portions of `PORTION_BYTES` of text, so what is
broadcast (the terms, the queries and one number per term) has a bound whatever the number of queries.

Defined results: null and empty texts have no terms, are not counted and are never found; a query without a known
term finds nothing; repeated rows of documents each take a place; equal scores are ordered by id, a null id last;
rows of queries that share an id are queries of their own and ranked apart only if their texts differ; only the named
columns are read; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rulegate.llm.common import by_value
from rulegate.session import materialize

by_value(__name__)

SHARD_DOCS = 16_384
SHARD_POSTINGS = 2_000_000
BLOCK = 128
WINDOW = 4_096  # documents of a shard gathered at once
TOP = 10
PORTION_BYTES = 4 << 20
TEXT_BLOCK = 1 << 20  # bytes of a text taken at once

UNIT = 1_000_000_000  # fixed values of the score
LENGTH_SHARE = 75

INDEX = """shard long, docs long, tokens long, ids array<long>, sizes array<int>, terms array<string>, df array<int>,
last array<int>, at array<int>, width array<tinyint>, tips array<int>, tip_tf array<int>, tip_size array<int>, data binary"""
FOUND = "item_id {id}, text_hash long, doc_id long, score long"


def folding() -> bytes:
    """ASCII letters to lower case, digits and bytes beyond ASCII as they are, the rest to blanks."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def terms_of(text: str | None, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, block by block."""
    raw = (text or "").encode().translate(table)
    at = 0
    while at < len(raw):
        stop = len(raw) if len(raw) - at <= TEXT_BLOCK else raw.find(b" ", at + TEXT_BLOCK)
        stop = len(raw) if stop < 0 else stop
        yield raw[at:stop].split()
        at = stop


# ---- index ---------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[int, bytes]:
    """Width code and bytes of small non-negative numbers: one, two or four bytes each."""
    most = int(values.max())
    code = 0 if most < 1 << 8 else 1 if most < 1 << 16 else 2
    return code, values.astype(("<u1", "<u2", "<u4")[code]).tobytes()


class Shard:
    """Postings of the documents met so far, by number of the document in the shard."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary, self.asked = vocabulary, vocabulary.keys()
        self.ids: list = []
        self.sizes: list[int] = []
        self.parts: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id, counts: Counter) -> None:
        size = counts.total()
        if not size:
            return
        held = self.asked & counts.keys()
        part = np.empty((3, len(held)), np.int64)
        part[0] = [self.vocabulary[t] for t in held]
        part[1] = len(self.ids)
        part[2] = [counts[t] for t in held]
        self.parts.append(part)
        self.postings += len(held)
        self.ids.append(doc_id)
        self.sizes.append(size)

    def row(self, number: int, names: list[str]) -> dict:
        """The shard as an index row."""
        term, doc, tf = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((3, 0), np.int64)
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        sizes = np.array(self.sizes, np.int64)
        held, start, df = np.unique(term, return_index=True, return_counts=True)
        within = np.arange(len(term)) - np.repeat(start, df)
        opens = np.flatnonzero(within % BLOCK == 0)  # first posting of each block
        block = np.cumsum(within % BLOCK == 0) - 1
        stops = np.append(opens[1:], len(term))
        gaps = np.diff(doc, prepend=0)
        gaps[opens] = doc[opens]
        at, width, data = [0], [], []
        for a, b in zip(opens.tolist(), stops.tolist()):
            wide, raw = pack(gaps[a:b])
            wide_tf, raw_tf = pack(tf[a:b])
            width.append(wide * 3 + wide_tf)
            data.append(raw + raw_tf)
            at.append(at[-1] + len(data[-1]))
        # frontier of each block: by falling occurrences, each pair with a shorter document than all before
        size = sizes[doc] if len(doc) else doc
        order = np.lexsort((size, -tf, block))
        b, x, y = block[order], tf[order], size[order]
        # the running minimum per block: blocks later in the order get an offset below all earlier ones
        span = int(sizes.max()) + 1 if len(sizes) else 1
        least = np.minimum.accumulate(y - b * span) if len(b) else y
        tip = np.ones(len(b), bool)
        tip[1:] = (least[1:] < least[:-1]) | (b[1:] != b[:-1])
        return {
            "shard": number, "docs": len(self.ids), "tokens": int(sizes.sum()), "ids": self.ids, "sizes": self.sizes,
            "terms": [names[t] for t in held.tolist()], "df": df.astype(np.int32), "last": doc[stops - 1].astype(np.int32), "at": at,
            "width": np.array(width, np.int8), "tips": np.bincount(b[tip], minlength=len(opens)).astype(np.int32),
            "tip_tf": x[tip].astype(np.int32), "tip_size": y[tip].astype(np.int32), "data": b"".join(data),
        }


def build(docs: DataFrame, terms: list[str], text_col: str = "text", id_col: str = "doc_id", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index (a table, to be written before it is searched) over the given terms. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema(
        [("shard", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
         ("terms", pa.list_(pa.string())), *[(c, pa.list_(pa.int32())) for c in ("df", "last", "at")], ("width", pa.list_(pa.int8())),
         *[(c, pa.list_(pa.int32())) for c in ("tips", "tip_tf", "tip_size")], ("data", pa.binary())]
    )

    def task(batches):
        from pyspark import TaskContext

        names, table = shared.value, folding()
        vocabulary = {t.encode(): k for k, t in enumerate(names)}
        number = TaskContext.get().partitionId() << 32
        shard = Shard(vocabulary)

        def done():
            return pa.RecordBatch.from_pylist([shard.row(number, names)], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                counts: Counter = Counter()
                for words in terms_of(text.as_py(), table):
                    counts.update(words)
                shard.add(doc_id.as_py(), counts)
                if len(shard.ids) >= shard_docs or shard.postings >= SHARD_POSTINGS:
                    yield done()
                    number, shard = number + 1, Shard(vocabulary)
        if shard.ids:
            yield done()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, INDEX)


# ---- search --------------------------------------------------------------------------------------


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def norms(sizes: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """The length number of each document; tokens * documents stay within 64 bits up to 10^17."""
    return 100 - LENGTH_SHARE + LENGTH_SHARE * sizes.astype(np.int64) * documents // tokens


def part(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a posting adds to a score for a weight of one."""
    return UNIT * tf // (1000 * tf + 8 * norm)


class Lists:
    """The inverted lists of one shard, with exact block maxima under the corpus statistics."""

    def __init__(self, row: dict, documents: int, tokens: int):
        self.ids, self.norm = row["ids"], norms(np.array(row["sizes"], np.int64), documents, tokens)
        blocks = -(-np.array(row["df"], np.int64) // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        self.of = {t: k for k, t in enumerate(row["terms"])}
        self.df = np.array(row["df"], np.int64)
        self.last, self.at = np.array(row["last"], np.int64), row["at"]
        self.width, self.data = row["width"], row["data"]
        tips = np.array(row["tips"], np.int64)
        best = part(np.array(row["tip_tf"], np.int64), norms(np.array(row["tip_size"], np.int64), documents, tokens))
        starts = np.cumsum(tips) - tips
        self.most = np.maximum.reduceat(best, starts) if len(starts) else best
        self.bound = np.maximum.reduceat(self.most, self.first[:-1]) if len(blocks) else self.most
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, k: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block of list k and what each adds; unpacked once per shard."""
        found = self.unpacked.get(block)
        if found is None:
            n = min(BLOCK, int(self.df[k]) - (block - int(self.first[k])) * BLOCK)
            code, code_tf = divmod(self.width[block], 3)
            raw, cut = self.data, self.at[block]
            gaps = np.frombuffer(raw, ("<u1", "<u2", "<u4")[code], n, cut)
            tf = np.frombuffer(raw, ("<u1", "<u2", "<u4")[code_tf], n, cut + n * (1, 2, 4)[code])
            docs = np.cumsum(gaps, dtype=np.int64)
            found = self.unpacked[block] = docs, part(tf.astype(np.int64), self.norm[docs])
        return found


class Heap:
    """The best documents of a shard for a query: score falling, then id rising."""

    def __init__(self, top: int, ids: list):
        self.top, self.ids, self.held, self.least = top, ids, [], 1

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        rows = [(-s, self.ids[d] is None, self.ids[d] or 0, d) for d, s in zip(docs.tolist(), scores.tolist())]
        self.held = sorted(self.held + rows)[: self.top]
        if len(self.held) == self.top:
            self.least = max(1, -self.held[-1][0])


def search_shard(lists: Lists, query: list[tuple[int, int]], top: int) -> Heap:
    """Block-Max MaxScore: `query` has (list, weight times repeats), `Heap.least` is what a document must reach."""
    heap = Heap(top, lists.ids)
    query = sorted((x for x in query if x[1]), key=lambda x: x[1] * int(lists.bound[x[0]]))
    bounds = [w * int(lists.bound[k]) for k, w in query]
    below = np.concatenate([[0], np.cumsum(bounds)])  # below[i]: all lists before i together
    essential = 0
    for lo in range(0, len(lists.ids), WINDOW):
        hi = min(lo + WINDOW, len(lists.ids))
        while essential < len(query) and below[essential + 1] < heap.least:
            essential += 1
        if essential == len(query):
            break
        score, seen = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool)
        for k, w in query[essential:]:
            first, stop = lists.first[k], lists.first[k + 1]
            block = first + int(np.searchsorted(lists.last[first:stop], lo))
            while block < stop:
                docs, adds = lists.postings(k, int(block))
                a, b = np.searchsorted(docs, (lo, hi))
                score[docs[a:b] - lo] += w * adds[a:b]
                seen[docs[a:b] - lo] = True
                if b < len(docs) or docs[-1] >= hi - 1:
                    break
                block += 1
        docs = np.flatnonzero(seen)
        score = score[docs]
        for i in range(essential - 1, -1, -1):
            docs, score = _keep(docs, score, score + below[i + 1] >= heap.least)
            if not len(docs):
                break
            k, w = query[i]
            first, stop = lists.first[k], lists.first[k + 1]
            block = first + np.searchsorted(lists.last[first:stop], docs + lo)
            inside = block < stop
            most = np.where(inside, w * lists.most[np.minimum(block, stop - 1)], 0)
            alive = score + most + below[i] >= heap.least
            docs, score, block = docs[alive], score[alive], block[alive]
            for b in np.unique(block[block < stop]).tolist():
                here = np.flatnonzero(block == b)
                held, adds = lists.postings(k, b)
                at = np.minimum(np.searchsorted(held, docs[here] + lo), len(held) - 1)
                score[here] += np.where(held[at] == docs[here] + lo, w * adds[at], 0)
        docs, score = _keep(docs, score, score >= heap.least)
        if len(docs) > top:  # ties with the last place stay, their ids decide
            docs, score = _keep(docs, score, score >= np.partition(score, -top)[-top])
        if len(docs):
            heap.offer(docs + lo, score)
    return heap


def _keep(docs: np.ndarray, score: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return docs[which], score[which]


def heaps(index: DataFrame, asked: list[tuple], statistics: tuple[int, int], weights: dict[str, int], id_type: str, top: int) -> DataFrame:
    """(item_id, text_hash, doc_id, score): at most `top` rows per shard and query. `asked` has (item, hash, terms)."""
    shared = index.sparkSession.sparkContext.broadcast((asked, statistics, weights))
    schema = T._parse_datatype_string(FOUND.format(id=id_type))

    def task(batches):
        queries, (documents, tokens), weigh = shared.value
        for batch in batches:
            for number in range(batch.num_rows):
                row = {name: batch.column(k)[number] for k, name in enumerate(batch.schema.names)}
                plain = {n: v.as_py() for n, v in row.items() if n in ("ids", "terms", "data", "at", "width")}
                plain |= {n: v.values.to_numpy() for n, v in row.items() if n not in plain and n not in ("shard", "docs", "tokens")}
                lists = Lists(plain, documents, tokens)
                out = [[], [], [], []]
                for item, mark, counts in queries:
                    query = [(lists.of[t], weigh[t] * c) for t, c in counts.items() if t in lists.of]
                    for s, _, _, d in search_shard(lists, query, top).held:
                        for column, value in zip(out, (item, mark, lists.ids[d], -s)):
                            column.append(value)
                types = [pa.string() if id_type == "string" else pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], schema.names)

    return index.mapInArrow(task, schema)


def search(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text", top: int = TOP, portion_bytes: int = PORTION_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of every item."""
    spark = docs.sparkSession
    id_type = "string" if dict(items.dtypes)[item_col] == "string" else "long"
    given = items.select(F.col(item_col).cast(id_type).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    given = given.where("text <> ''").withColumn("text_hash", F.xxhash64("text")).distinct()
    total = given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    portions = -(-total // portion_bytes)
    found = [
        _portion(docs, given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == n), text_col, id_col, id_type, top, shard_docs)
        for n in range(portions)
    ]
    if not found:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    merged = found[0]
    for other in found[1:]:
        merged = merged.union(other)
    order = Window.partitionBy("item_id", "text_hash").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _portion(docs: DataFrame, items: DataFrame, text_col: str, id_col: str, id_type: str, top: int, shard_docs: int) -> DataFrame:
    """Heaps of one portion of queries: its lists are built, its statistics summed, its shards searched."""
    table = folding()
    asked = []
    for r in items.collect():  # bounded by the bytes of a portion
        counts: Counter = Counter()
        for words in terms_of(r["text"], table):
            counts.update(w.decode() for w in words)
        asked.append((r["item_id"], r["text_hash"], dict(counts)))
    terms = sorted(set().union(*[c for _, _, c in asked]))
    index = materialize(build(docs, terms, text_col, id_col, shard_docs), "lexical-index")
    documents, tokens = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    pairs = index.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).groupBy("p.terms").agg(F.sum("p.df").alias("df"))
    weights = {r["terms"]: weight(documents, r["df"]) for r in pairs.collect()}  # one row per term of the portion
    return heaps(index, asked, (documents, tokens), weights, id_type, top)
