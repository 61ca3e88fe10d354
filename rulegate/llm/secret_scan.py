"""Secret scan with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must contain. The
index holds, per trigram some query asks for, the documents that contain it (one posting per document).
Intersecting postings leaves, per rule, the documents that can match at all; only those are scanned with the
regex. A rule without a mandatory trigram (a run of hex digits) scans every text.

Spans are code-point offsets, end exclusive, of the leftmost non-overlapping matches of each rule.

Defined results: a null text is an empty one; a document without an id cannot be posted, so it is scanned by
every rule; documents that share an id share their postings, which only adds candidates; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rulegate.llm.common import let
from rulegate.session import materialize

BROADCAST_BYTES = 32 * 1024 * 1024


@dataclass(frozen=True)
class SecretRule:
    """`pattern` is read by the Java engine; a match counts if its `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# `[0-9a-f]+` of 24 and more characters is the same set of spans as `[0-9a-f]{24,}`: a match is a whole run.
BASE_RULES = [
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),
]
ADDED_RULES = [
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]
RULES = [*BASE_RULES, *ADDED_RULES]

# For masking, a private key is all of it. From its header on, it goes to the END line if no other line of dashes comes
# before; without one, it is the header, the fields of an encrypted key and the base64 that follows, in which a run
# shorter than 16 counts only as a line of its own. Line breaks may be written as \n, lines may be quoted with `>`.
# Possessive, so that the length of a key costs neither stack nor time.
_GAP = r"(?:[\s>]|\\[nr])*+"
KEY = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-{1,4}+(?!-)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    rf"|(?:{_GAP}(?:Proc-Type:\s*+\d,[A-Z]++|DEK-Info:\s*+[A-Z0-9-]++,[0-9A-Fa-f]++))*+"
    rf"(?:(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)++(?:[\r\n]++[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?![^\r\n]))?+)?+)"
)
SPANS = "array<struct<from:int,order:int,to:int,counts:boolean>>"
STRETCH = 128  # matches that one running sum goes over

MASK_RULES = [*RULES[:-1], SecretRule("private_key", KEY)]

# ---- Boolean trigram queries ------------------------------------------------------------------

ALL = ("all",)  # every document
EXACT_MOST = 64  # strings an expression is expanded to at most


def _both(a: tuple, b: tuple) -> tuple:
    parts = []
    for q in (a, b):
        parts.extend(q[1] if q[0] == "and" else [] if q == ALL else [q])
    parts = list(dict.fromkeys(parts))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(queries: Sequence[tuple]) -> tuple:
    if ALL in queries:
        return ALL
    # a branch that asks for all another branch asks for, and more, adds nothing
    parts = {q: set(q[1]) if q[0] == "and" else {q} for q in queries}
    queries = [q for q in parts if not any(parts[o] < parts[q] for o in parts)]
    return queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _of_strings(strings: set[str]) -> tuple:
    """Trigrams of one of several strings, folded to lower case like the index."""
    found = []
    for s in sorted({s.lower() for s in strings}):
        q = ALL
        for k in range(len(s) - 2):
            q = _both(q, ("tri", s[k : k + 3]))
        found.append(q)
    return _either(found)


def trigram_query(pattern: str) -> tuple:
    """Query any text with a match satisfies: ("tri", t), ("and", ..), ("or", ..) or ALL.

    Walks the pattern's syntax tree. Stretches that expand to a few exact strings are joined with their
    neighbours before trigrams are taken; anything wider ends a stretch.
    """
    from re import _parser

    def exact(op, value) -> set[str] | None:
        """The strings a node can match, if they are few."""
        name = str(op)
        if name == "LITERAL":
            return {chr(value)}
        if name == "IN":
            chars: set[str] = set()
            for kind, v in value:
                if str(kind) == "LITERAL":
                    chars.add(chr(v))
                elif str(kind) == "RANGE" and v[1] - v[0] < EXACT_MOST:
                    chars.update(map(chr, range(v[0], v[1] + 1)))
                else:
                    return None
            return chars if len({c.lower() for c in chars}) <= 8 else None
        if name == "SUBPATTERN":
            return sequence_exact(value[-1])
        if name == "BRANCH":
            each = [sequence_exact(b) for b in value[1]]
            return None if None in each else set().union(*each)
        if name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] <= 3:
            one = sequence_exact(value[2])
            if one is None:
                return None
            found, layer = set(), {""}
            for n in range(value[1] + 1):
                if n >= value[0]:
                    found |= layer
                layer = {a + b for a in layer for b in one}
                if len(layer) > EXACT_MOST:
                    return None
            return found
        return None

    def sequence_exact(nodes) -> set[str] | None:
        strings = {""}
        for op, value in nodes:
            one = exact(op, value)
            strings = None if one is None else {a + b for a in strings for b in one}
            if strings is None or len(strings) > EXACT_MOST:
                return None
        return strings

    def query(nodes) -> tuple:
        out, run = ALL, {""}
        for op, value in nodes:
            one = exact(op, value)
            if one is not None and len(run) * len(one) <= EXACT_MOST:
                run = {a + b for a in run for b in one}
                continue
            out, run = _both(out, _of_strings(run)), {""}
            if one is not None:
                run = one
            elif str(op) == "SUBPATTERN":
                out = _both(out, query(value[-1]))
            elif str(op) == "BRANCH":
                out = _both(out, _either([query(b) for b in value[1]]))
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                out = _both(out, query(value[2]))
        return _both(out, _of_strings(run))

    return query(_parser.parse(pattern))


def trigrams_of(query: tuple) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*[trigrams_of(q) for q in query[1]]) if len(query) > 1 else set()


def _holds(query: tuple, bit: dict[str, int], bits: Column) -> Column:
    if query == ALL:
        return F.lit(True)
    if query[0] == "tri":
        return F.get(bits, F.lit(bit[query[1]] // 63)).bitwiseAND(F.lit(1 << bit[query[1]] % 63).cast("long")) != 0
    parts = [_holds(q, bit, bits) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


# ---- index and scan ---------------------------------------------------------------------------


def postings(docs: DataFrame, trigrams: Sequence[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The inverted index over the given trigrams: one (trigram, id) row per trigram a document contains."""
    low = docs.where(F.col(id_col).isNotNull()).select(id_col, F.lower(text_col).alias("__low"))
    held = F.array_compact(F.array(*[F.when(F.col("__low").contains(t), F.lit(t)) for t in sorted(trigrams)]))
    return low.select(id_col, F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, tuple], trigrams: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """(id, kinds): the rules whose trigram query a document's postings satisfy; documents of no rule are absent.

    The intersection is one aggregation of the postings by document, each posting a bit."""
    bit = {t: k for k, t in enumerate(sorted(trigrams))}
    sets = []
    for w in range(-(-len(bit) // 63)):
        here = [x for t, k in bit.items() if k // 63 == w for x in (F.lit(t), F.lit(1 << k % 63).cast("long"))]
        sets.append(F.bit_or(F.coalesce(F.create_map(*here)[F.col("trigram")], F.lit(0).cast("long"))))
    merged = index.groupBy(id_col).agg(F.array(*sets).alias("bits"))
    kinds = F.filter(F.array(*[F.when(_holds(q, bit, F.col("bits")), F.lit(k)) for k, q in queries.items()]), lambda k: k.isNotNull())
    return merged.select(id_col, kinds.alias("kinds")).where(F.size("kinds") > 0)


def stretches(items: Column) -> Column:
    """A non-empty array cut into arrays of `STRETCH` items: what grows inside one stays small however long it is."""
    last = F.floor((F.size(items) - 1) / STRETCH).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * STRETCH + 1, F.lit(STRETCH)))
    return cut


def rule_spans(text: Column, rule: SecretRule, order: int) -> Column:
    """Spans of a rule in a text: what lies between the matches and the matches themselves give the offsets.

    Offsets are running sums: over stretches of matches first, then inside each stretch."""
    empty = F.array().cast(SPANS)

    def step(a: Column, m: Column) -> Column:
        start = a["at"] + m["gap"]
        span = F.struct(start.alias("from"), F.lit(order).alias("order"), (start + m["own"]).alias("to"), m["counts"].alias("counts"))
        return F.struct((start + m["own"]).alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    def inside(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), empty.alias("spans")), step, lambda a: a["spans"])

    def spans(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, m: n + m["gap"] + m["own"]))
        before = lambda sums, k: F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda n, x: n + x)
        found = let(sums, lambda sums: F.transform(parts, lambda p, k: inside(p, before(sums, k))))
        return F.filter(F.flatten(found), lambda s: s["counts"])

    def matches(found: Column) -> Column:
        gaps = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
        counts = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least
        item = lambda gaps: lambda m, k: F.struct(F.get(gaps, k).alias("gap"), F.length(m).alias("own"), counts(m).alias("counts"))
        return let(gaps, lambda gaps: F.transform(found, item(gaps)))

    return let(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, empty).otherwise(let(matches(found), lambda m: let(stretches(m), spans))),
    )


def scan(docs: DataFrame, rules: Sequence[SecretRule] = RULES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All columns of `docs` plus `secrets` (in place of one of that name): an array of (from, order, to, kind)
    sorted by start, then rule order.

    One pass builds the postings, one scans. Candidates join on the id: broadcast while their measured size is
    small, else by shuffle.
    """
    columns = [c for c in docs.columns if c != "secrets"]
    # the row travels as one struct, so that its columns cannot clash with those of the scan
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q != ALL}
    trigrams = sorted(set().union(*map(trigrams_of, asked.values())))
    spark = docs.sparkSession
    if asked:
        found = materialize(
            candidates(postings(docs, trigrams, "text", "id"), asked, trigrams, "id").withColumnRenamed("id", "found"),
            "secret-candidates",
        )
        size = found.count() * (32 + 16 * len(asked))
        found = F.broadcast(found) if size <= BROADCAST_BYTES else found
        joined = docs.join(found, F.col("id") == F.col("found"), "left")
    else:
        joined = docs.withColumn("kinds", F.array().cast("array<string>"))
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.array().cast(SPANS)
    parts = []
    for order, rule in enumerate(rules):
        can = F.lit(True)
        if rule.kind in asked:
            can = F.col("id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        parts.append(F.when(can, rule_spans(text, rule, order)).otherwise(empty))
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(
        F.sort_array(F.concat(*parts)),
        lambda s: F.struct(s["from"].alias("from"), s["order"].alias("order"), s["to"].alias("to"), F.get(names, s["order"]).alias("kind")),
    )
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], spans.alias("secrets"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"], s["to"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (sorted by start; overlapping ones as one) replaced by `mark`.

    The text is cut at stretches of spans, and each piece is rebuilt from its own parts, joined once."""

    def furthest(part: Column) -> Column:
        return F.array_max(F.transform(part, lambda s: s["to"]))

    def piece(part: Column, start: Column, stop: Column) -> Column:
        def rebuilt(own: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                gap = F.substring(own, a["at"] - start + 1, s["from"] - a["at"])
                more = F.when(s["from"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(gap, F.lit(mark))))
                return F.struct(more.alias("out"), F.greatest(a["at"], s["to"]).alias("at"))

            zero = F.struct(F.array().cast("array<string>").alias("out"), start.alias("at"))
            return F.array_join(F.aggregate(part, zero, step, lambda a: a["out"]), "")

        return let(F.substring(text, start + 1, stop - start), rebuilt)

    def whole(parts: Column) -> Column:
        reach = F.transform(parts, furthest)

        def joined(reach: Column) -> Column:
            until = lambda k: F.coalesce(F.array_max(F.slice(reach, F.lit(1), k)), F.lit(0))
            pieces = F.transform(parts, lambda p, k: piece(p, until(k), until(k + 1)))
            end = F.array_max(reach)
            return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text) - end))

        return let(reach, joined)

    return F.when(F.size(spans) == 0, text).otherwise(let(stretches(spans), whole))
