"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word between them, hashed to a fixed
number of weights. FTRL-proximal gives each weight its own rate and an L1 threshold, so that nearly all weights
stay exactly zero; the rest is small enough to broadcast, and a text's score is the sum over the few of its
features that carry weight.

The fit uses at most `SAMPLE` labelled documents, those with the smallest hashes of their ids, and of these as many
as hold `SAMPLE_FEATURES` features together; these bounds are the only ones, and scoring covers every whole text.
Texts are read in blocks, so a long one needs no more memory.

Defined results: a null or empty text scores the bias alone; without any labelled row every score is 0.5 and
`predicted` follows the same rule as elsewhere; labels that are null are no labels, and a document labelled
twice is toxic if any label says so; a document id of several rows is learned from once, by its greatest text;
repeated rows score alike; only the named columns are carried.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rulegate.llm.common import by_value

by_value(__name__)

SAMPLE = 16_000
SAMPLE_FEATURES = 32_000_000
BITS = 20
ALPHA, BETA, L1, L2 = 3.0, 1.0, 3.0, 0.0
EPOCHS = 4
BLOCK = 1 << 19  # bytes of a text taken at once
MEMO_BYTES = 16 << 20
WORD_COST = 170  # bytes an entry of the word memo takes beside its letters

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def folding() -> bytes:
    """ASCII letters to lower case, digits and bytes beyond ASCII as they are, the rest to blanks."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


class Features:
    """Hashed features of texts; keeps the hashes of words it has met."""

    def __init__(self, bits: int = BITS):
        from xxhash import xxh64_intdigest

        self.hash, self.bits, self.table, self.words, self.held = xxh64_intdigest, bits, folding(), {}, 0

    def blocks(self, text: str):
        raw = text.encode().translate(self.table)
        at = 0
        while at < len(raw):
            stop = len(raw) if len(raw) - at <= BLOCK else raw.find(b" ", at + BLOCK)
            stop = len(raw) if stop < 0 else stop
            yield raw[at:stop].split()
            at = stop

    def of(self, text: str):
        """Feature numbers, block by block (not distinct across blocks)."""
        before = np.zeros(0, np.uint64)
        for words in self.blocks(text):
            if self.held > MEMO_BYTES:
                self.words.clear()
                self.held = 0
            known = self.words
            for w in set(words).difference(known):
                known[w] = self.hash(w)
                self.held += WORD_COST + len(w)
            h = np.concatenate([before, np.fromiter(map(known.__getitem__, words), np.uint64, len(words))])
            a, b, c = (np.uint64(m) for m in MULTIPLIERS)
            grams = [h * a, (h[:-1] * b + h[1:]) * a, (h[:-2] * c + h[2:]) * a]
            before = h[-2:]
            yield (np.concatenate(grams) >> np.uint64(64 - self.bits)).astype(np.int32)

    def distinct(self, text: str) -> np.ndarray:
        parts = [np.unique(f) for f in self.of(text)]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2) -> tuple[np.ndarray, float]:
    """Weights and bias after `epochs` passes in the given order; one feature weighs 1 in each text it occurs in."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(at):
        x, s = z[at], n[at]
        return np.where(np.abs(x) <= np.where(at == bias, 0, l1), 0, -(x - np.sign(x) * np.where(at == bias, 0, l1)) / ((beta + np.sqrt(s)) / alpha + l2))

    for _ in range(epochs):
        for row, label in zip(rows, labels):
            at = np.append(row, bias)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            s = n[at]
            z[at] += g - (np.sqrt(s + g * g) - np.sqrt(s)) / alpha * w
            n[at] = s + g * g
    w = weights(np.arange((1 << bits) + 1))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE, sample_features: int = SAMPLE_FEATURES) -> tuple[list[int], list[float], float]:
    """(feature numbers, their weights, bias). `labels` holds only rows that may be learned from.

    Ids are chosen first (at most `sample`, so the choice can be broadcast), rows that share one meet map-side;
    their texts become feature numbers on the executors, and one task fits the bounded sample."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(7))
    chosen = known.withColumn("__order", order).orderBy("__order", id_col).limit(sample)
    rows = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(chosen), id_col)
    rows = rows.groupBy(id_col, "__order", "__label").agg(F.max("__text").alias("__text")).select("__order", "__label", "__text")

    def extract(batches):
        features = Features()
        for batch in batches:
            found = [features.distinct(t.as_py() or "") for t in batch.column(2)]
            edges = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], ["o", "y", "x"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("o", "ascending")])
        x = table.column("x").combine_chunks()
        edges, flat = x.offsets.to_numpy(), x.values.to_numpy()
        weights, bias = ftrl([flat[a:b] for a, b in zip(edges, edges[1:])], table.column("y").to_numpy().astype(float))
        at = np.flatnonzero(weights)
        return pa.table({"at": pa.array(np.append(at, -1), pa.int64()), "weight": np.append(weights[at], bias)})

    extracted = rows.mapInArrow(extract, "o long, y int, x array<int>").withColumn("all", F.lit(0))
    so_far = F.sum(F.size("x")).over(Window.partitionBy("all").orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    bounded = extracted.withColumn("so_far", so_far).where(F.col("so_far") <= sample_features).drop("so_far")
    learned = bounded.groupBy("all").applyInArrow(learn, "at long, weight double").toArrow()
    at, weight = learned.column("at").to_pylist(), learned.column("weight").to_pylist()
    bias = next((w for a, w in zip(at, weight) if a < 0), 0.0)
    pairs = [(a, w) for a, w in zip(at, weight) if a >= 0]
    return [a for a, _ in pairs], [w for _, w in pairs], bias


def score(docs: DataFrame, model: tuple[list[int], list[float], float], text_col: str = "text", keep: Sequence[str] = ("doc_id",), out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """`keep` columns, score and prediction of every row. No shuffle; the model's nonzero weights are broadcast.

    `text_col` may be a field of a kept struct (`row.text`): the text then goes to the worker once, inside it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep, out = list(keep), list(out)
    outer, _, inner = text_col.partition(".")
    inner = inner if outer in keep else ""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out[0], T.DoubleType(), False), T.StructField(out[1], T.IntegerType(), False)])

    def task(batches):
        at, weight, bias = shared.value
        weights = np.zeros(1 << BITS)
        weights[at] = weight
        features = Features()
        for batch in batches:
            texts = batch.column(keep.index(outer)).field(inner) if inner else batch.column(len(keep))
            sums = []
            for text in texts:
                carried = [f[weights[f] != 0] for f in features.of(text.as_py() or "")]
                sums.append(bias + (weights[np.unique(np.concatenate(carried))].sum() if carried else 0.0))
            p = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*keep, *out])

    texts = [] if inner else [F.col(text_col).alias("__text")]
    return docs.select(*keep, *texts).mapInArrow(task, schema)
