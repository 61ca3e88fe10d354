"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to `ORDER` bytes. A byte costs -log2 of its share in the longest
context seen; if it never followed that context, it costs the context's escape and is coded one order lower, down
to a uniform byte (escape method C, no exclusions). Counts are frozen after training, so a byte's cost depends on
the bytes right before it alone: the cost of every context and byte met in training is worked out once, for all
languages side by side, and a text's exact code length is a sum of table entries. The shortest code wins; its
score is the weight of its code among those of all languages, with equal priors.

Texts are read as their lower-case letters with single blanks between words. Training takes the texts of a language
in order of a hash of the id until it has `SAMPLE_BYTES`, of the last one only the beginning that fits; a language
with a letter in any text is learned. Scoring covers every whole text.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text when nothing could
be learned; ties go to the first language by name; rows without a language are not learned from; repeated rows
are predicted alike; only the id and the text are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rulegate.llm.common import by_value

by_value(__name__)

ORDER = 4
SAMPLE_BYTES = 600_000
PLACES = 16  # bits of the hash that texts are added up by
BLOCK = 1 << 20  # bytes scored at once
UNDETERMINED = "und"
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def blanks() -> bytes:
    """ASCII letters and bytes beyond ASCII as they are, the rest to blanks."""
    return bytes(b if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def letters(text: str, table: bytes) -> bytes:
    """What is coded: a blank, then every word with a blank after it."""
    return b" " + b"".join([w + b" " for w in text.lower().encode().translate(table).split()])


def grams(raw: np.ndarray, order: int) -> np.ndarray:
    """For every byte from position `order` on, that byte and the `order` bytes before it as one number."""
    n = len(raw) - order
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(order + 1):
        out <<= np.uint64(8)
        out |= raw[k : k + n] if n > 0 else 0
    return out


def padded(text: str, table: bytes, order: int = ORDER) -> np.ndarray:
    return np.frombuffer(b" " * order + letters(text, table), np.uint8).astype(np.uint64)


class Lookup:
    """Open-addressing table from numbers to rows of values; vectorised, with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * max(len(keys), 1) - 1).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.wrap = size - 1
        self.row = np.full(size, -1, np.int32)
        self.key = np.zeros(size, np.uint64)
        self.values = values
        at, left = self.home(keys), np.arange(len(keys))
        while len(left):
            free = self.row[at] < 0
            self.row[at[free]] = left[free]  # of several, the last one stays
            stays = self.row[at] == left
            self.key[at[stays]] = keys[left[stays]]
            at, left = (at[~stays] + 1) & self.wrap, left[~stays]

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self.home(keys)
        row = self.row[at]
        on = np.flatnonzero((row >= 0) & (self.key[at] != keys))
        place = at[on]
        while len(on):
            place = (place + 1) & self.wrap
            row[on] = self.row[place]
            more = (row[on] >= 0) & (self.key[place] != keys[on])
            on, place = on[more], place[more]
        return row


def train(counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], languages: int) -> list[dict[str, np.ndarray]]:
    """Cost tables by order from (language number, gram, count) columns by order.

    Per order: `grams` and their cost in each language; `contexts` and the cost of their escape."""
    levels = []
    lower_keys, lower_cost = np.zeros(1, np.uint64), np.full((1, languages), 8.0)
    for order, (lang, gram, count) in enumerate(counts):
        keys, of = np.unique(gram, return_inverse=True)
        seen = np.zeros((len(keys), languages))
        np.add.at(seen, (of, lang), count)
        contexts, owner = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, distinct = np.zeros((len(contexts), languages)), np.zeros((len(contexts), languages))
        np.add.at(total, owner, seen)
        np.add.at(distinct, owner, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            direct = -np.log2(seen / (total + distinct)[owner])
        if order:
            below = lower_cost[np.searchsorted(lower_keys, keys & np.uint64((1 << 8 * order) - 1))]
        else:
            below = np.full((len(keys), languages), 8.0)
        cost = np.where(seen > 0, direct, escape[owner] + below)
        levels.append({"grams": keys, "cost": cost.astype(np.float32), "contexts": contexts, "escape": escape.astype(np.float32)})
        lower_keys, lower_cost = keys, cost
    return levels


class Scorer:
    """Code lengths of byte sequences in every language."""

    def __init__(self, levels: list[dict[str, np.ndarray]]):
        self.grams = [Lookup(v["grams"], v["cost"]) for v in levels]
        self.contexts = [Lookup(v["contexts"], v["escape"]) for v in levels]

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each byte (rows) in each language (columns), from its highest-order gram."""
        order = len(self.grams) - 1
        row = self.grams[order].find(gram)
        out = self.grams[order].values[row]
        lost = np.flatnonzero(row < 0)
        out[lost] = 0
        rest = gram[lost]
        while len(lost):
            table = self.contexts[order]
            context = table.find(rest >> np.uint64(8))
            out[lost] += np.where((context >= 0)[:, None], table.values[context], 0)
            order -= 1
            if order < 0:
                out[lost] += 8.0
                break
            rest = rest & np.uint64((1 << 8 * (order + 1)) - 1)
            row = self.grams[order].find(rest)
            hit = row >= 0
            out[lost[hit]] += self.grams[order].values[row[hit]]
            lost, rest = lost[~hit], rest[~hit]
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length of each text in each language."""
        table, order = blanks(), len(self.grams) - 1
        out = np.zeros((len(texts), self.grams[0].values.shape[1]))
        held: list[np.ndarray] = []
        rows: list[int] = []

        def flush():
            if held:
                sizes = np.array([len(h) for h in held])
                cost = self.costs(np.concatenate(held))
                out[rows] += np.add.reduceat(cost, np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
                held.clear(), rows.clear()

        size = 0
        for row, text in enumerate(texts):
            raw = padded(text, table, order)
            for lo in range(0, len(raw) - order, BLOCK):
                part = grams(raw[lo : lo + BLOCK + order], order)
                if size + len(part) > BLOCK:
                    flush()
                    size = 0
                held.append(part)
                rows.append(row)
                size += len(part)
                if lo + BLOCK < len(raw) - order:  # a text's blocks are added up one by one
                    flush()
                    size = 0
        flush()
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[dict[str, np.ndarray]]]:
    """(languages, cost tables) learned from the given rows.

    The sample holds at most `sample_bytes` per language; its contexts are counted on the executors and meet on
    the driver as one row per language, order and gram, so their number is bounded by the sample."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    key = F.coalesce(F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string"))
    draw = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"), F.shiftright(draw, 30 - PLACES).alias("place"))
    # the place at which a language's running sum reaches the bound: texts before it are taken, those at it one by one
    sums = rows.groupBy("lang", "place").agg(F.sum(F.octet_length("text")).alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("place")))
    edge = F.min(F.when(F.col("upto") >= sample_bytes, F.struct("place", (F.col("upto") - F.col("n")).alias("before"))))
    edges = {e["lang"]: e["edge"] or (1 << PLACES, 0) for e in sums.groupBy("lang").agg(edge.alias("edge")).collect()}
    languages = sorted(edges)
    if not languages:
        return [], []
    number, at, before = (
        F.create_map(*[x for k, v in enumerate(values) for x in (F.lit(languages[k]), F.lit(v).cast("long"))])[F.col("lang")]
        for values in (range(len(languages)), [edges[k][0] for k in languages], [edges[k][1] for k in languages])
    )
    whole = rows.where(F.col("place") < at).select(number.cast("int").alias("lang"), "text", F.octet_length("text").cast("long").alias("most"))
    ahead = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    most = F.lit(sample_bytes) - before - F.coalesce(F.sum(F.octet_length("text")).over(ahead), F.lit(0))
    last = rows.where(F.col("place") == at).withColumn("most", most.cast("long")).where("most > 0")
    # no more characters than bytes are left; the bytes are cut below
    last = last.select(number.cast("int").alias("lang"), F.substring("text", F.lit(1), F.col("most").cast("int")).alias("text"), "most")
    sample = whole.union(last)

    def count(batches):
        table = blanks()
        for batch in batches:
            found: dict[tuple[int, int], list[np.ndarray]] = {}
            for lang, text, most in zip(*(c.to_pylist() for c in batch.columns)):
                text = text.encode()[:most].decode(errors="ignore")
                raw = padded(text, table, order)
                for k in range(order + 1):
                    found.setdefault((lang, k), []).append(grams(raw[order - k :], k))
            for (lang, k), parts in found.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                size = len(gram)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, lang, np.int32)), pa.array(np.full(size, k, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "k", "gram", "n"])

    counted = sample.mapInArrow(count, "lang int, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, k, gram, n = (counted.column(c).to_numpy() for c in ("lang", "k", "gram", "n"))
    if not len(k):
        return [], []
    return languages, train([(lang[k == o], gram[k == o].view(np.uint64), n[k == o]) for o in range(order + 1)], len(languages))


def predict(docs: DataFrame, model: tuple[list[str], list[dict[str, np.ndarray]]], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) of every row. No shuffle; the tables, bounded by the training sample, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

    def task(batches):
        languages, levels = shared.value
        scorer = Scorer(levels) if languages else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            named = np.array([languages[0] if languages else UNDETERMINED] * len(texts), object)
            weight = np.zeros(len(texts))
            if languages:
                bits = scorer.lengths([t or "" for t in texts])
                best = bits.argmin(axis=1)
                named = np.array(languages, object)[best]
                weight = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            known = np.array(batch.column(2).to_pylist(), bool)
            named[~known], weight[~known] = UNDETERMINED, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named.tolist(), pa.string()), pa.array(weight)], [id_col, "lang_pred", "score"])

    known = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(id_col, text_col, known.alias("__known")).mapInArrow(task, schema)
