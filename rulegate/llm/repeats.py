"""Removal of word passages that occur more than once, by FM-indexes and matching statistics.

A window is `WINDOW` consecutive words; each word covered by a window that also starts anywhere else goes. Equal
windows must meet in one shard, and no text may be held against all others, so shards are cut by content: the anchor
of a window is the smallest hash of its `GRAM`-word shingles, the same wherever the window occurs. A segment is a run
of windows that share one anchor occurrence, with the words they cover; each window is in one segment of its text.

1. One narrow pass gives every text its anchors. Anchors that occur once anywhere end here, which is all of a text
   without repeats; only texts with an anchor that is met again move, once per distinct text.
2. Their segments are counted by content before they meet. A segment counted twice is a repeat as a whole; one that
   has its anchor to itself can match nothing else.
3. The other segments are dealt by anchor into shards. A shard concatenates its segments, sorts their suffixes and
   keeps the Burrows-Wheeler transform in a wavelet matrix of packed bits with counts. Each segment is then streamed
   against it: a backward search from an end extends to the left while the interval holds two suffixes or more. A
   length of `WINDOW` or more is reported and settles all ends down to where the match begins; a shorter one settles
   all ends whose window holds the stretch that failed. The ends left are tried in halves.
4. Reported intervals go back to the texts, by segment and text, and every text is cut once.

An anchor with more than `HOT_WORDS` words of distinct segments (a passage that very many texts share, in different
surroundings) does not fit one shard: its segments are cut again with the whole window as its own anchor, where equal
windows fold before they meet. Hashes only deal out work; matches are between words. Texts and segments are known by
their MD5.

Defined results: a null text has no words; texts of fewer words than a window lose none; rows of equal texts are each
other's repeats; rows without an id are texts like others; only the id and the text are read, other columns cannot
clash; an empty table gives an empty result. Memory follows the longest text, not the number of texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulegate.llm.common import by_value
from rulegate.session import materialize

by_value(__name__)

WINDOW = 35
GRAM = 8
SHARD_WORDS = 400_000
HOT_WORDS = 400_000
MEMO_BYTES = 16 << 20
WORD_COST = 170
WORDS_AT_ONCE = 50_000
BATCH_BYTES = 4 << 20
FACTOR, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NO_WORDS = hashlib.sha256(b"").hexdigest()


# ---- words and anchors ---------------------------------------------------------------------------


class Text:
    """Where the words of a text lie; words are maximal runs of bytes that are not ASCII white space."""

    def __init__(self, raw: bytes):
        self.raw = raw
        blank = BLANK[np.frombuffer(raw, np.uint8)]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]

    def __len__(self) -> int:
        return len(self.starts)

    def words(self, a: int, b: int) -> list[bytes]:
        return self.raw[self.starts[a] : self.ends[b - 1]].split() if a < b else []

    def digest(self, runs) -> str:
        """SHA-256 of the words of some runs of words, joined by blanks."""
        sha, first = hashlib.sha256(), True
        for a, b in runs:
            for lo in range(a, b, WORDS_AT_ONCE):
                sha.update((b"" if first else b" ") + b" ".join(self.words(lo, min(b, lo + WORDS_AT_ONCE))))
                first = False
        return sha.hexdigest()


class Hashes:
    """Hashes of words, kept for words met before within a bound of bytes."""

    def __init__(self):
        from xxhash import xxh64_intdigest

        self.hash, self.known, self.held = xxh64_intdigest, {}, 0

    def of(self, text: Text) -> np.ndarray:
        parts = []
        for lo in range(0, len(text), WORDS_AT_ONCE):
            words = text.words(lo, min(len(text), lo + WORDS_AT_ONCE))
            if self.held > MEMO_BYTES:
                self.known, self.held = {}, 0
            known = self.known
            for w in set(words).difference(known):
                known[w] = self.hash(w)
                self.held += WORD_COST + len(w)
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def segments(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first word, last word + 1) of each run of windows with one anchor occurrence."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(FACTOR) + hashes[k : k + len(grams)]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(MIX)
    grams ^= grams >> np.uint64(29)
    seen = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    least = np.concatenate([seen[lo : lo + WORDS_AT_ONCE].argmin(axis=1) for lo in range(0, n, WORDS_AT_ONCE)]) + np.arange(n)
    opens = np.flatnonzero(np.diff(least, prepend=-1))
    stops = np.append(opens[1:], n)
    return grams[least[opens]].view(np.int64), opens, stops + window - 1


# ---- FM-index ------------------------------------------------------------------------------------


class Wavelet:
    """Wavelet matrix: one plane of packed bits per bit of the symbols, with the ones before each 64."""

    def __init__(self, symbols: np.ndarray):
        self.size, self.bits = len(symbols), max(1, int(symbols.max()).bit_length())
        self.planes, self.before, self.zeros = [], [], []
        for shift in range(self.bits - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(bool)
            packed = np.zeros((self.size // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            plane = packed.view("<u8")
            self.planes.append(plane)
            ones = np.bitwise_count(plane).astype(np.int64)
            self.before.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(self.size - int(ones.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions of the sequence end up when they follow the bits of a symbol to the last plane."""
        for k, (plane, before, zeros) in enumerate(zip(self.planes, self.before, self.zeros)):
            word, low = at >> 6, (at & 63).astype(np.uint64)
            ones = before[word] + np.bitwise_count(plane[word] & ((np.uint64(1) << low) - np.uint64(1)))
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + ones, at - ones)
        return at


def suffixes(ranks: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; the sequence ends in a symbol that occurs once."""
    n, width = len(ranks), 1
    ranks = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = ranks[width:] + 1
        key = ranks * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        ranks[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Segments as one sequence, each closed by a separator of its own; words are numbered from 1."""

    def __init__(self, texts: list[bytes]):
        listed = [t.split() for t in texts]
        number = {w: k for k, w in enumerate(set().union(*listed), 1)}
        self.lengths = np.array([len(x) for x in listed], np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.symbols = np.zeros(int((self.lengths + 1).sum()), np.int64)
        inside = np.ones(len(self.symbols), bool)
        separators = self.starts + self.lengths
        inside[separators] = False
        self.symbols[inside] = np.fromiter((number[w] for x in listed for w in x), np.int64, int(self.lengths.sum()))
        del listed
        order = self.symbols + len(texts)
        order[separators] = np.arange(len(texts))
        array = suffixes(order)
        self.wavelet = Wavelet(self.symbols[array - 1])
        symbol = np.arange(len(number) + 1)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(self.symbols, minlength=len(symbol)))[:-1]])
        #: first row of each symbol, less where its zeroth occurrence lands in the wavelet matrix
        self.shift = smaller - self.wavelet.descend(symbol, np.zeros(len(symbol), np.int64))

    def longest(self, text: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Per (text, end): length of the longest stretch that ends there and occurs at least twice."""
        first, last = self.starts[text], self.starts[text] + end
        out = np.zeros(len(text), np.int64)
        alive = np.arange(len(text))
        low, high = np.zeros(len(text), np.int64), np.full(len(text), self.wavelet.size, np.int64)
        while len(alive):
            symbol = self.symbols[last[alive] - out[alive] - 1]
            both = self.wavelet.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            both += np.tile(self.shift[symbol], 2)
            low, high = both[: len(alive)], both[len(alive) :]
            twice = high - low > 1
            alive, low, high = alive[twice], low[twice], high[twice]
            out[alive] += 1
            more = last[alive] - out[alive] > first[alive]
            alive, low, high = alive[more], low[more], high[more]
        return out

    def repeated(self, asked: np.ndarray, window: int) -> np.ndarray:
        """For each place of the sequence, if a window that occurs twice covers it; only of the asked texts."""
        cover = np.zeros(len(self.symbols) + 1, np.int64)
        asked = asked[self.lengths[asked] >= window]
        text, low, high = asked, np.full(len(asked), window), self.lengths[asked]
        while len(text):
            end = (low + high) // 2
            length = self.longest(text, end)
            found = length >= window
            at = self.starts[text] + end
            np.add.at(cover, (at - length)[found], 1)
            np.add.at(cover, at[found], -1)
            left = np.where(found, end - (length - window), end) - 1
            right = np.where(found, end + 1, end + window - length)
            text, low, high = np.concatenate([text, text]), np.concatenate([low, right]), np.concatenate([left, high])
            rest = low <= high
            text, low, high = text[rest], low[rest], high[rest]
        return np.cumsum(cover[:-1]) > 0


# ---- tables --------------------------------------------------------------------------------------


def _read(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, key, n_words, whole, anchors): words, digest of all words and the anchors of every row."""

    def task(batches):
        hashes = Hashes()
        for batch in batches:
            counts, digests, anchors = [], [], []
            for value in batch.column(2):
                text = Text((value.as_py() or "").encode())
                counts.append(len(text))
                digests.append(text.digest([(0, len(text))]))
                anchors.append(segments(hashes.of(text), window, gram)[0])
            columns = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(anchors, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "key", "n_words", "whole", "anchors"])

    fields = f"id {texts.schema['id'].dataType.simpleString()}, key binary, n_words long, whole string, anchors array<long>"
    return texts.mapInArrow(task, fields)


def _cut(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, start, anchor, segment, n, copies, id): the segments of texts (key, text binary, copies, anchors) whose anchors
    are listed; all segments where the list is null."""

    def task(batches):
        hashes = Hashes()
        names = ["key", "start", "anchor", "segment", "n", "copies"]
        types = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        out, size = [[] for _ in names], 0
        for batch in batches:
            for key, raw, copies, wanted in zip(*[batch.column(c) for c in range(4)]):
                text = Text(raw.as_py())
                anchor, first, stop = segments(hashes.of(text), window, gram)
                if wanted.is_valid:
                    held = np.isin(anchor, wanted.values.to_numpy())
                    anchor, first, stop = anchor[held], first[held], stop[held]
                key, copies = key.as_py(), copies.as_py()
                for x, a, b in zip(anchor.tolist(), first.tolist(), stop.tolist()):
                    segment = b" ".join(text.words(a, b))
                    for column, value in zip(out, (key, a, x, segment, b - a, copies)):
                        column.append(value)
                    size += len(segment)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                        out, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    cut = texts.select("key", "text", "copies", "anchors").mapInArrow(task, "key binary, start int, anchor long, segment binary, n int, copies long")
    return cut.withColumn("id", F.unhex(F.md5("segment")))


def _matched(distinct: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(id, from, to): stretches that occur twice in distinct segments (id, anchor, segment, n, copies), shard by
    shard; a segment with copies is there for the others and not asked itself."""
    words = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-words // shard_words))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        index = FMIndex([v.as_py() for v in table.column("segment")])
        copies = table.column("copies").to_numpy()
        covered = index.repeated(np.flatnonzero(copies < 2), window)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
        a, b = edges[::2], edges[1::2]
        owner = np.searchsorted(index.starts, a, "right") - 1
        start = index.starts[owner]
        return pa.table({"id": ids.take(pa.array(owner)), "from": pa.array(a - start, pa.int32()), "to": pa.array(b - start, pa.int32())})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor", F.lit(13)), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "id binary, from int, to int")


def _repeats(cut: DataFrame, window: int, shard_words: int, hot_words: int | None) -> DataFrame:
    """(key, from, to): repeated stretches of the texts without copies that a table of segments was cut from. Without
    `hot_words` no anchor is cut again: each is a whole window."""
    first = [F.first(c).alias(c) for c in ("anchor", "segment", "n")]
    distinct = materialize(cut.groupBy("id").agg(*first, F.sum("copies").alias("copies")), "repeat-segments")
    found = distinct.where("copies > 1").select("id", F.lit(0).alias("from"), F.col("n").alias("to"))
    groups = distinct.groupBy(F.col("anchor").alias("__anchor")).agg(F.count("*").alias("members"), F.sum("n").alias("volume"))
    shared = distinct.join(groups.where("members > 1"), F.col("anchor") == F.col("__anchor"))
    columns = ["id", "anchor", "segment", "n", "copies"]
    if hot_words is not None:
        shared = materialize(shared.select(*columns, (F.col("volume") > hot_words).alias("hot")), "repeat-shared")
        hot = shared.where("hot").select(F.col("id").alias("key"), F.col("segment").alias("text"), "copies", F.lit(None).cast("array<long>").alias("anchors"))
        if not hot.isEmpty():
            again = materialize(_cut(hot, window, window), "repeat-windows")
            found = found.union(_repeats(again, window, shard_words, None).withColumnRenamed("key", "id"))
        shared = shared.where("NOT hot")
    found = found.union(_matched(shared.select(*columns), window, shard_words))
    found = found.select(F.col("id").alias("__id"), "from", "to")
    # what has copies goes as a whole
    back = cut.where("copies = 1").select("key", "start", "id").join(found, F.col("id") == F.col("__id"))
    return back.select("key", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"))


def _kept(texts: DataFrame) -> DataFrame:
    """(key, n_removed, kept) of texts (key, text binary, ranges)."""

    def task(batches):
        for batch in batches:
            removed, kept = [], []
            for raw, ranges in zip(batch.column(1), batch.column(2)):
                text, spans = Text(raw.as_py()), ranges.values
                cover = np.zeros(len(text) + 1, np.int64)
                np.add.at(cover, spans.field("from").to_numpy(), 1)
                np.add.at(cover, spans.field("to").to_numpy(), -1)
                gone = np.cumsum(cover[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
                removed.append(int(gone.sum()))
                kept.append(text.digest(zip(edges[::2].tolist(), edges[1::2].tolist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["key", "n_removed", "kept"])

    return texts.select("key", "text", "ranges").mapInArrow(task, "key binary, n_removed long, kept string")


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row: its words, how many go, and the digest of the others."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    keyed = rows.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    read = materialize(_read(keyed, window, gram), "repeat-anchors")

    repeated = read.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    # a table of its own, so that the join on anchors can part a very common one
    repeated = materialize(repeated.select(F.col("anchor").alias("__anchor")), "repeat-common")
    distinct = read.where(f"n_words >= {window}").groupBy("key").agg(F.count("*").alias("copies"), F.first("anchors").alias("anchors"))
    distinct = materialize(distinct.withColumn("anchors", F.array_distinct("anchors")), "repeat-texts")
    met = distinct.select("key", "copies", F.explode("anchors").alias("anchor")).join(repeated, F.col("anchor") == F.col("__anchor"), "left_semi")
    wanted = met.groupBy(F.col("key").alias("__key")).agg(F.first("copies").alias("copies"), F.collect_set("anchor").alias("anchors"))
    # one row per text, so that copies fold before they move
    long_enough = F.octet_length("text") >= 2 * window - 1
    once = keyed.where(long_enough).groupBy("key").agg(F.first("text").alias("text"))
    texts = once.join(wanted, F.col("key") == F.col("__key")).select("key", F.col("text").cast("binary").alias("text"), "copies", "anchors")
    texts = materialize(texts, "repeat-candidates")

    cut = materialize(_cut(texts, window, gram), "repeat-cut")
    # a text with copies goes as a whole; its segments are there for the others
    spans = _repeats(cut, window, shard_words, hot_words).groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    single = texts.where("copies = 1").select("key", "text").join(spans.withColumnRenamed("key", "__key"), F.col("key") == F.col("__key"))
    whole = distinct.where("copies > 1").select("key", F.lit(None).cast("long").alias("n_removed"), F.lit(NO_WORDS).alias("kept"))
    changed = _kept(single).union(whole).withColumnRenamed("key", "__key")
    return read.join(changed, F.col("key") == F.col("__key"), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(F.col("__key").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce("n_removed", "n_words")).alias("n_removed"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
    )
