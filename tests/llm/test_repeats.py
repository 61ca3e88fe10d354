"""Removal of repeated passages against a plain version over all windows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulegate.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts, window):
    """(n_words, n_removed, digest of the rest) of every text."""
    listed = [WORD.findall(t or "") for t in texts]
    starts = Counter(tuple(w[i : i + window]) for w in listed for i in range(len(w) - window + 1))
    found = []
    for w in listed:
        gone = {p for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        rest = " ".join(x for p, x in enumerate(w) if p not in gone)
        found.append((len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return found


def made(seed, count, vocabulary=40):
    random.seed(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["é", "漢 字"]
    passages = [random.choices(words, k=k) for k in (6, 9, 14, 30, 60)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(random.randint(1, 4)):
            parts += random.choice(passages) if random.random() < 0.5 else random.choices(words, k=random.randint(1, 40))
            if random.random() < 0.2 and parts:
                parts[random.randrange(len(parts))] = "changed"
        texts.append(random.choice([" ", "\n", "\t \n"]).join(parts))
    texts += random.choices(texts, k=count // 5)
    return texts + ["", None, " \n", "a " * 300, "a b " * 40, "a b " * 41, "one", " ".join(passages[2]) + "\v" + " ".join(passages[2])]


def test_fm_index_counts(monkeypatch):
    random.seed(3)
    texts = [" ".join(random.choices("abcd", k=random.randint(5, 30))).encode() for _ in range(40)]
    index = repeats.FMIndex(texts)
    listed = [t.split() for t in texts]
    grams = Counter(tuple(w[i:j]) for w in listed for i in range(len(w)) for j in range(i + 1, len(w) + 1))
    asked = [(t, e) for t, w in enumerate(listed) for e in range(1, len(w) + 1)]
    got = index.longest(np.array([t for t, _ in asked]), np.array([e for _, e in asked]))
    for (t, e), length in zip(asked, got.tolist()):
        wanted = max((k for k in range(e + 1) if not k or grams[tuple(listed[t][e - k : e])] > 1), default=0)
        assert length == wanted


@pytest.mark.parametrize("window, gram, shard_words, hot_words", [(7, 3, 300, 10**9), (7, 3, 10**6, 60), (10, 10, 200, 50), (5, 1, 150, 40)])
def test_removal_equals_plain(spark, monkeypatch, window, gram, shard_words, hot_words):
    monkeypatch.setattr(repeats, "WORDS_AT_ONCE", 9)
    monkeypatch.setattr(repeats, "BATCH_BYTES", 2_000)
    texts = made(window + shard_words, 120)
    rows = [(k if k % 10 else None, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n_words int").repartition(4)
    found = repeats.remove_repeats(docs, window=window, gram=gram, shard_words=shard_words, hot_words=hot_words)
    wanted = Counter((r[0], *p) for r, p in zip(rows, plain(texts, window)))
    assert Counter(map(tuple, found.collect())) == wanted
    assert sum(r[2] for r in wanted) > 100


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    wanted = Counter((r["doc_id"], *p) for r, p in zip(rows, plain([r["text"] for r in rows], repeats.WINDOW)))
    assert Counter(map(tuple, repeats.remove_repeats(odd_docs).collect())) == wanted
    assert repeats.remove_repeats(no_docs).count() == 0


def test_a_passage_in_very_many_texts(spark):
    """One anchor with far more segments than a shard takes: its windows fold before they meet."""
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(k, f"{k}a {k}b {k}c {passage} {k}d {k}e") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = repeats.remove_repeats(docs, shard_words=2_000, hot_words=2_000).collect()
    assert len(found) == 600 and {(r["n_words"], r["n_removed"]) for r in found} == {(55, 50)}
    for r in found:
        k = r["doc_id"]
        assert r["kept_sha256"] == hashlib.sha256(f"{k}a {k}b {k}c {k}d {k}e".encode()).hexdigest()
