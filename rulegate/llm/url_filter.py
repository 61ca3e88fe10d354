"""URL filter: a blocked Bloom filter in front of an exact hash join.

A list holds canonical URL prefixes, each a host (it covers its subdomains) and a path prefix, with a verdict.
A URL asks for every (host suffix, path prefix) that an entry could have; suffixes are taken with the numbers of labels and path
prefixes at the lengths that occur in the list, so a host of very many labels asks no more. Nearly all of these keys are not listed, so each is first tested against the
filter: one 256-bit block per key, found by hash, and one bit in each of the block's eight words. Keys that
pass are joined to the list by their full text, which removes the false positives; the longest entry wins.

Defined results: a null URL, or one without "://", has an empty host and path, fits no entry and gets the
default verdict; any entry of the caller's rules (listed_by "rule") wins over other lists, then the longest, then
"allow" over "block"; an empty list fits nothing; rows with equal or null ids keep one result each;
only the id and the URL are carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # 32-bit words of a block
BITS_PER_KEY = 16
BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 64  # a filter block in a hashed relation, roughly

LIST = "host string, path string, verdict string, listed_by string"


def entries(spark: SparkSession, rules: Sequence[tuple[str, str]], listed_by: str) -> DataFrame:
    """List rows from (canonical prefix such as "example.org/es/", verdict)."""
    rows = []
    for prefix, verdict in rules:
        host, slash, path = prefix.partition("/")
        rows.append((host.lower(), slash + path, verdict, listed_by))
    return spark.createDataFrame(rows, LIST)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, ASCII lower case. Path: then up to "?", "#"."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, shape, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def key_of(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit position per word, from a second hash."""
    seed = F.xxhash64(key, F.lit(1))
    return [F.pmod(F.shiftrightunsigned(seed, 8 * k), F.lit(32)).cast("int") for k in range(WORDS)]


def _words(key: Column) -> list[Column]:
    return [F.get(F.array(*[F.lit(1 << b) for b in range(32)]), bit).cast("long") for bit in _bits(key)]


def bloom(listed: DataFrame, keys: int) -> tuple[DataFrame, int]:
    """Filter blocks (block, w0..w7) of the list's keys; partial aggregation ORs them map-side."""
    blocks = max(1, -(-keys * BITS_PER_KEY // (32 * WORDS)))
    key = F.col("key")
    set_bits = listed.select(_block(key, blocks).alias("block"), *[w.alias(f"w{k}") for k, w in enumerate(_words(key))])
    return set_bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]), blocks


def host_suffixes(host: Column, numbers: Sequence[int]) -> Column:
    """The host and its parent domains that have one of these numbers of labels; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    fitting = F.filter(F.array(*[F.lit(n) for n in numbers]), lambda n: n <= F.size(labels))
    all_of = F.transform(fitting, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.filter(all_of, lambda h: h != ""))


def judge(urls: DataFrame, listed: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """(id, host, path, verdict, entry, listed_by): the longest entry that fits each URL, or the default."""
    listed = listed.withColumn("key", key_of(F.col("host"), F.col("path")))
    stats = listed.agg(
        F.count("*").alias("n"),
        F.collect_set(F.length("path")).alias("lengths"),
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.sum(F.octet_length("key")).alias("bytes"),
    ).first()
    host, path = host_and_path(F.col(url_col))
    split = urls.select(id_col, host.alias("host"), path.alias("path"))
    if not stats["n"]:
        return split.select(id_col, "host", "path", F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("entry"), F.lit(None).cast("string").alias("listed_by"))
    # distinct (host, path) pairs are judged, so that repeated URLs cost one judgement
    pairs = split.select("host", "path").distinct()
    lengths = F.array(*[F.lit(n) for n in sorted(stats["lengths"])])
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    asked = (
        pairs.select("host", "path", F.explode(host_suffixes(F.col("host"), sorted(stats["labels"]))).alias("suffix"))
        .select("host", "path", "suffix", F.explode(fitting).alias("n"))
        .select("host", "path", "suffix", "n", F.concat("suffix", F.substring(F.col("path"), F.lit(1), F.col("n"))).alias("key"))
    )
    filter_, blocks = bloom(listed, stats["n"])
    small = blocks * BLOCK_BYTES <= BROADCAST_BYTES
    probe = asked.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(filter_) if small else filter_, "block")
    for k, word in enumerate(_words(F.col("key"))):
        probe = probe.where(F.col(f"w{k}").bitwiseAND(word) != 0)
    exact = listed.select("key", F.col("host").alias("suffix"), "verdict", "listed_by", F.length("path").alias("n"))
    exact = F.broadcast(exact) if (stats["bytes"] or 0) + 64 * stats["n"] <= BROADCAST_BYTES else exact
    best = F.max_by(
        F.struct("verdict", F.col("key").alias("entry"), "listed_by"),
        F.struct(F.when(F.col("listed_by") == "rule", 1).otherwise(0), F.length("key"), F.length("suffix"), F.when(F.col("verdict") == "allow", 1).otherwise(0)),
    )
    won = (
        probe.select("host", "path", "key", "suffix", "n")
        .join(exact, ["key", "suffix", "n"])
        .groupBy("host", "path")
        .agg(best.alias("best"))
    )
    return split.join(won, ["host", "path"], "left").select(
        id_col,
        "host",
        "path",
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        F.col("best.entry").alias("entry"),
        F.col("best.listed_by").alias("listed_by"),
    )
