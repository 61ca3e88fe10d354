"""Ranked search against a plain scorer over all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rulegate.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def plain_search(docs, items, top=10):
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    n, total = len(held), sum(s for _, _, s in held)
    df = Counter(t for _, c, _ in held for t in c)
    found = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        scores = []
        for d, c, size in held:
            m = 25 + 75 * size * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        found += [(item, r, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(found, key=str)


def made(seed, count):
    random.seed(seed)
    words = [f"w{k}" for k in range(120)] + ["É", "漢字", "The", "a1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(random.choices(words, weights, k=random.choice([1, 3, 20, 200])))) for k in range(count)]
    docs += [(k, docs[5][1]) for k in range(count, count + 30)]  # copies: equal scores
    docs += [(docs[7][0], docs[7][1]), (None, "w3 w4 w5"), (-1, None), (-2, ""), (-3, "?! \t"), (-4, "w1 " * 5_000)]
    items = [(k, ", ".join(random.choices(words, k=random.choice([1, 4, 40])))) for k in range(25)]
    items += [(100, docs[5][1]), (101, "unheard of"), (102, ""), (103, None), (104, "w0 w0 W0 w90")]
    return docs, items


@pytest.mark.parametrize("shard_docs, block, window", [(40, 4, 16), (1_000, 128, 4_096), (7, 1, 3)])
def test_search_equals_plain(spark, monkeypatch, shard_docs, block, window):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "TEXT_BLOCK", 50)
    docs, items = made(shard_docs, 300)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    found = lexical.search(d, i, shard_docs=shard_docs, portion_bytes=1_500)
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(docs, items)


def test_blocks_are_skipped(monkeypatch):
    """A rare term decides; the blocks of a common one are unpacked only where a document still needs them."""
    monkeypatch.setattr(lexical, "WINDOW", 256)
    rows = [(k, "common " + ("rare " if k in (3, 200) else "") + "filler " * (k % 5)) for k in range(6_000)]
    shard = lexical.Shard({b"common": 0, b"rare": 1})
    for k, text in rows:
        shard.add(k, Counter(t.encode() for t in plain_terms(text)))
    row = shard.row(0, ["common", "rare"])
    lists = lexical.Lists({**row, "at": list(row["at"])}, row["docs"], row["tokens"])
    weights = {t: lexical.weight(row["docs"], int(lists.df[k])) for t, k in lists.of.items()}
    heap = lexical.search_shard(lists, [(lists.of[t], max(1, w)) for t, w in weights.items()], 2)
    assert {h[3] for h in heap.held} == {3, 200}
    assert len(lists.unpacked) <= 3 < len(lists.last)


def test_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two word")], "item_id long, text string")
    assert lexical.search(no_docs, items).count() == 0
    assert lexical.search(odd_docs, items.limit(0)).count() == 0
    found = lexical.search(odd_docs, items).collect()
    assert sorted(map(tuple, found), key=str) == plain_search([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [(1, "one two word")])
