"""Text expressions shared by the rules: trimming, missing test, quoting, naming."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Unicode white space, null-like words, and the named escapes of quoted text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
MISSING_WORDS = ["", "none", "null", "nan", "na", "n/a"]
NAMED_ESCAPES = {
    "\a": "\\a",
    "\b": "\\b",
    "\f": "\\f",
    "\n": "\\n",
    "\r": "\\r",
    "\t": "\\t",
    "\v": "\\v",
    '"': '\\"',
    "\\": "\\\\",
}
UNSAFE_IN_FILE_NAMES = "/\\\x00"

LONGEST_MISSING_WORD = max(len(w) for w in MISSING_WORDS)
MISSING = "^(?i:" + "|".join(MISSING_WORDS) + r")\z"
NOT_PRINTABLE_ASCII = "[^ -~]"


def trim_cell(c: Column) -> Column:
    """Strip Unicode white space on both ends (Spark's plain `trim` only knows the space)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def lower_text(c: Column) -> Column:
    """Lower-case character by character: no final-sigma rule, dotted capital I becomes a plain i."""
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def may_hold_other_space(c: Column) -> Column:
    """False when the text is printable ASCII, so the plain space is the only white space in it."""
    return c.rlike(NOT_PRINTABLE_ASCII)


def is_missing(c: Column, trimmed: bool = False) -> Column:
    """True for blank text and the null-like words in any case.

    With `trimmed` the caller vouches that `c` has no outer white space.
    """
    text = c if trimmed else trim_cell(c)
    return (F.octet_length(text) <= LONGEST_MISSING_WORD) & text.rlike(MISSING)


def _buckets(texts: Iterable[str]) -> list[list[str]]:
    """Texts dealt by the low bits of their checksums, about one to a bucket."""
    texts = list(texts)
    table: list[list[str]] = [[] for _ in range(1 << max(0, len(texts) - 1).bit_length())]
    for text in texts:
        table[zlib.crc32(text.encode()) & (len(table) - 1)].append(text)
    return table


def _bucket(table: list, kind: str, text: Column) -> Column:
    """The bucket of a text. The table is one literal, read from JSON once, when the plan is made."""
    literal = F.from_json(F.lit(json.dumps(table)), f"array<{kind}>")
    return F.get(literal, F.crc32(text).bitwiseAND(F.lit(len(table) - 1)).cast("int"))


def is_among(text: Column, texts: Iterable[str]) -> Column:
    """Whether a text is one of many: a hash lookup, as quick for thousands as for a few. NULL for NULL."""
    return F.array_contains(_bucket(_buckets(texts), "array<string>", text), text)


def looked_up(text: Column, entries: dict[str, str]) -> Column:
    """What a text is mapped to, NULL when it has no entry; a hash lookup like `is_among`."""
    table = [{text: entries[text] for text in bucket} for bucket in _buckets(entries)]
    return F.try_element_at(_bucket(table, "map<string,string>", text), text)


def quote_text(c: Column) -> Column:
    """Double-quoted rendering with backslash escapes, as used inside error messages."""

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        digits = F.lower(F.hex(code))
        rendered = None
        for raw, named in NAMED_ESCAPES.items():
            rendered = (
                F.when(ch == F.lit(raw), F.lit(named))
                if rendered is None
                else rendered.when(ch == F.lit(raw), F.lit(named))
            )
        return (
            rendered.when(ch.rlike(r"^[\p{L}\p{M}\p{N}\p{P}\p{S} ]"), ch)
            .when((code < 32) | (code == 127), F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
            .when(code < 65536, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
        )

    plain = c.rlike(r"^[ !#-\[\]-~]*\z")
    escaped = F.array_join(F.transform(F.split(c, ""), escape), "")
    return F.when(plain, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(
        F.concat(F.lit('"'), escaped, F.lit('"'))
    )


def snake_case(c: Column) -> Column:
    """Output name of a header: lower case, separators to single underscores."""
    return F.regexp_replace(F.translate(trim_cell(lower_text(c)), " -/.", "____"), "_+", "_")


def file_safe(c: Column) -> Column:
    """Key text usable as a file name."""
    return F.translate(c, UNSAFE_IN_FILE_NAMES, "_" * len(UNSAFE_IN_FILE_NAMES))


def base_name(path: Column) -> Column:
    """Last path component without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*\z", "")


def decode_path(c: Column) -> Column:
    """Readable form of a percent-encoded path (a plus sign stands for itself in paths)."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
