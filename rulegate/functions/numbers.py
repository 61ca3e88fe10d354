"""Text to number, with exactly the accepted spellings of the rule types `float` and `int`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted number spellings. Underscores may only stand between digits (in hexadecimal
# numbers also after the prefix); the look-ahead rejects all others before the digits are read.
INTEGER = r"^[+-]?[0-9]+\z"
DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
SPACED_DECIMAL = (
    r"(?!.*(?:[^0-9]_|_[^0-9]|_\z))[+-]?(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9][0-9_]*)?"
)
HEXADECIMAL = (
    r"(?!.*(?:[^0-9a-fA-FxX]_|_[^0-9a-fA-F]|_\z))[+-]?0[xX](?=_?\.?[0-9a-fA-F])"
    r"[0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?[0-9][0-9_]*"
)
SPECIAL = r"[+-]?(?i:inf|infinity)|(?i:nan)"
NUMBER = rf"^(?:{DECIMAL}|{SPECIAL}|{SPACED_DECIMAL}|{HEXADECIMAL})\z"

TWO_POW_63 = float(2**63)


def to_double(c: Column) -> Column:
    """Double, or NULL for bad syntax. Finite text beyond the double range gives infinity here."""
    return F.when(c.rlike(NUMBER), F.replace(c, F.lit("_")).try_cast("double"))


def without_overflow(f: Column, c: Column) -> Column:
    """The double `f` read from `c`, NULL when it is infinite but spelled with digits."""
    return F.when(~((F.abs(f) == float("inf")) & c.rlike("[0-9]")), f)


def to_long_exact(c: Column) -> Column:
    """Whole-number text that fits 64 bits, else NULL."""
    return F.when(c.rlike(INTEGER), c.try_cast("bigint"))


def double_to_long(f: Column) -> Column:
    """A double without fraction inside the 64-bit range, else NULL."""
    return F.when((f % 1.0 == 0) & (f >= -TWO_POW_63) & (f < TWO_POW_63), f.try_cast("bigint"))


def has_fraction(f: Column) -> Column:
    """True for fractional values, infinities and NaN."""
    return f % 1.0 != 0
