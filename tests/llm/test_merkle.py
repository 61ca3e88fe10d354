"""The Merkle manifest against a plain recursive version."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rulegate.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests: list[str], arity: int) -> tuple[str, list[list[str]]]:
    """Root, and per leaf its siblings level by level."""
    proofs = [[] for _ in digests]
    below, level = [[k] for k in range(len(digests))], list(digests)
    while len(level) > 1:
        joined, owners = [], []
        for lo in range(0, len(level), arity):
            run = level[lo : lo + arity]
            for k in range(len(run)):
                for leaf in below[lo + k]:
                    proofs[leaf] += run[:k] + run[k + 1 :]
            joined.append(sha("".join(run)))
            owners.append([x for b in below[lo : lo + arity] for x in b])
        level, below = joined, owners
    return level[0], proofs


def plain_manifest(rows, arity: int) -> Counter:
    first = lambda v: (v is not None, v)
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0], plain_leaf(r)))
    names = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    grown = []
    for name in names:
        leaves = sorted(trees[name], key=lambda x: (first(x[0]) if x[0] is not None else (False, 0), x[1]))
        grown.append((leaves, *plain_tree([h for _, h in leaves], arity)))
    root, above = plain_tree([g[1] for g in grown], arity) if grown else (None, [])
    found = Counter()
    for (leaves, subroot, proofs), outer in zip(grown, above):
        for (doc, leaf), proof in zip(leaves, proofs):
            found[(doc, leaf, subroot, root, "".join(proof + outer))] += 1
    return found


def collected(frame) -> Counter:
    rows = frame.select("*", merkle.proof(F.col("witness")).alias("proof"), merkle.fold(F.col("leaf"), F.col("witness")).alias("folded")).collect()
    assert all(r["folded"] == r["root"] for r in rows)
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in rows)


def test_levels():
    assert [merkle.levels_of(n, 3) for n in (1, 2, 3, 4, 9, 10, 27, 28)] == [0, 1, 1, 2, 2, 3, 3, 4]


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 26, 27, 28, 82])
def test_block_equals_plain_tree(count):
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(count)]
    block = merkle.Block(3)
    for d in digests:
        block.append(d)
    root = block.finish(merkle.levels_of(count, 3))
    wanted, proofs = plain_tree([d.hex() for d in digests], 3)
    assert root.hex() == wanted
    assert [[(a + b).hex() for a, b in zip(x, y)] for x, y in zip(block.left, block.right)] == [
        _by_level(p, k, count) for k, p in enumerate(proofs)
    ]


def _by_level(proof: list[str], k: int, count: int) -> list[str]:
    """Siblings of leaf k, one text per level."""
    out = []
    while count > 1:
        size = min(3, count - k // 3 * 3) - 1
        out.append("".join(proof[:size]))
        proof, k, count = proof[size:], k // 3, -(-count // 3)
    return out


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_plain(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle.grow, "__defaults__", (merkle.ARITY, levels))
    rows = [(k, f"s{k % 7 if k % 3 else 0}", "en", k * 10, f"text {k}\nmore") for k in range(130)]
    rows += [(7, "s0", "en", 1, "again"), (7, "s0", "en", 1, "again"), (None, "s0", None, None, None), (None, None, "é", 2, ""), (1000, None, "x", 5, "漢字")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert collected(merkle.manifest(docs, COLUMNS)) == plain_manifest(rows, 3)


def test_tampering_shows(spark):
    rows = [(k, "a", "en", 1, "x\ny" if k % 3 else "xy") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    changed = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    found = merkle.manifest(docs, COLUMNS, tampered={"text": changed})
    for r in found.select("*", merkle.fold(F.col("tampered_leaf"), F.col("witness")).alias("folded")).collect():
        assert (r["folded"] == r["root"]) == (r["doc_id"] % 3 == 0)


def test_odd_rows(spark, odd_docs, no_docs):
    given = odd_docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "even")).withColumn("n.chars", F.lit(3))
    columns = ["doc_id", "source", "n.chars", "text"]
    rows = [tuple(r) for r in given.select("doc_id", "source", "`n.chars`", "text").collect()]
    assert collected(merkle.manifest(given, columns)) == plain_manifest(rows, 3)
    assert merkle.manifest(no_docs.withColumn("source", F.lit("s")), ["doc_id", "text"]).count() == 0
