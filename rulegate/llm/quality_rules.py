"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row keeps what was measured and one failure bit per
rule; policies are masks over those bits, so a new policy version, or the question "what would dropping rule
r change", needs the ledger only and never the texts again.

Defined results: a null text is an empty one (no words, so `few_words` fails); an empty table gives an empty
ledger; repeated rows give repeated ledger rows; only the named columns of the
input are carried. Windows are compared by 64-bit hashes within one document; with 20,000 words a document, a false
match is expected once in about 10^11 documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rulegate.llm.common import let

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """`fails` is a SQL condition over the measurements; `bit` never changes once rows were written with it."""

    name: str
    bit: int
    fails: str


RULES = [
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "100 * n_dup_lines > 60 * n_lines AND n_dup_lines >= 3"),
    Rule("word_length", 4, "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
    Rule("upper_case", 5, "2 * n_upper > n_letters"),
    Rule("few_letters", 6, "2 * n_letters < word_chars"),
]

BASE = ("few_words", "repeated_windows")

# Policies by version: the rules that reject a document.
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "word_length", "upper_case", "few_letters"),
    3: tuple(r.name for r in RULES),
}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters"]


def mask(names: Sequence[str]) -> int:
    """The bits of the named rules."""
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum({bits[n] for n in names})


def _length_of(text: Column, dropped: str) -> Column:
    return F.length(F.regexp_replace(text, dropped, "")).cast("long")


def _covered(hashes: Column, window: int) -> Column:
    """Words inside windows whose hash occurs again: sort (hash, position), keep equal neighbours, add up the
    words each kept window covers before the next one starts."""

    def neighbours(pairs: Column) -> Column:
        # elements come back 1-based through `get`, which is null outside the array
        twin = F.filter(
            pairs,
            lambda p, k: F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False))
            | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(twin, lambda p: p["i"]))

    def total(starts: Column) -> Column:
        return F.aggregate(
            F.transform(
                starts, lambda s, k: F.least(F.coalesce(F.get(starts, k + 1) - s, F.lit(window)), F.lit(window))
            ),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(pairs, lambda p: let(neighbours(p), total))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of `window` words found twice or more in the array, first one included."""

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - window),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]),
        )

    def count(hashes: Column) -> Column:
        once = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(once, F.lit(0).cast("long")).otherwise(_covered(hashes, window))

    # every word is hashed once; a window hashes the hashes of its words
    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count))
    return F.when(F.size(words) > window, found).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` columns and one row of measurements per document. No shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split("__text", SPACE), "")
    lines = F.filter(F.split("__text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select(*keep, text.alias("__text"))
        .select(*keep, "__text", words.alias("__words"), lines.alias("__lines"))
        .select(
            *keep,
            F.size("__words").cast("long").alias("n_words"),
            F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
            _length_of(F.col("__text"), r"[^#*$%&|<>]+").alias("n_symbols"),
            F.size("__lines").cast("long").alias("n_lines"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            repeat_words(F.col("__words")).alias("n_repeat_words"),
            _length_of(F.col("__text"), r"[^\p{Lu}]+").alias("n_upper"),
            _length_of(F.col("__text"), r"[^\p{L}\p{M}]+").alias("n_letters"),
        )
    )


def ledger(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measurements plus `fail_bits`: bit r is set where rule r fails."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def judge(rows: DataFrame, policies: dict[int, Sequence[str]] = POLICIES, version: int = 2) -> DataFrame:
    """Apply one policy version to ledger rows: `policy`, `kept`."""
    rejected = F.col("fail_bits").bitwiseAND(F.lit(mask(policies[version])).cast("long"))
    return rows.withColumn("policy", F.lit(version)).withColumn("kept", rejected == 0)


def ablation(rows: DataFrame, policies: dict[int, Sequence[str]] = POLICIES, version: int = 2) -> DataFrame:
    """Per rule of a policy: documents and words it rejects, rejects alone, and the policy's total.

    Ledger rows meet in at most 2^rules patterns of failure bits, summed map-side first; everything else is
    bit arithmetic over those patterns. `only_docs` is what dropping the rule would bring back.
    """
    names = list(policies[version])
    policy = mask(names)
    patterns = (
        rows.select(F.col("fail_bits").bitwiseAND(F.lit(policy).cast("long")).alias("bits"), "n_words")
        .groupBy("bits")
        .agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))
    )
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask([n])).cast("long").alias("bit")) for n in names]))
    hit = F.col("r.bit").bitwiseAND(F.col("bits")) != 0
    alone = F.col("bits") == F.col("r.bit")
    return (
        patterns.withColumn("r", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("docs"))), F.lit(0)).alias("rejected_docs"),
            F.coalesce(F.sum(F.when(hit, F.col("words"))), F.lit(0)).alias("rejected_words"),
            F.coalesce(F.sum(F.when(alone, F.col("docs"))), F.lit(0)).alias("only_docs"),
            F.coalesce(F.sum(F.when(alone, F.col("words"))), F.lit(0)).alias("only_words"),
            F.coalesce(F.sum(F.when(F.col("bits") != 0, F.col("docs"))), F.lit(0)).alias("policy_docs"),
        )
    )
