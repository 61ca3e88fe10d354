"""The rule document: loading, checking, naming. Everything here is small driver-side metadata."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

from rulegate.functions.layouts import parse_layout
from rulegate.functions.text import NAMED_ESCAPES, WHITE_SPACE

# Rule types with their column types, and the layouts used when a rule names none.
COLUMN_TYPES = {
    "string": T.StringType(),
    "float": T.DoubleType(),
    "int": T.LongType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
}
DEFAULT_DATE_LAYOUTS = ["2006-01-02", "2006-01-02 15:04:05", "2006-01-02T15:04:05Z07:00"]
DEFAULT_DATETIME_LAYOUTS = [
    "2006-01-02 15:04:05",
    "2006-01-02 15:04:05.999999",
    "2006-01-02T15:04:05",
    "2006-01-02T15:04:05.999999",
    "2006-01-02T15:04:05Z07:00",
    "2006-01-02T15:04:05.999999999Z07:00",
]

PROPERTY_TYPES: dict[str, type | None] = {
    "name": str,
    "parquet_name": str,
    "type": str,
    "required": bool,
    "exclude_if_missing": bool,
    "min_length": int,
    "lower": bool,
    "allowed_values": list,
    "inline_replace": dict,
    "default": None,
    "override": None,
    "non_zero": bool,
    "date_formats": list,
    "datetime_formats": list,
    "check": str,
}


class RuleError(ValueError):
    """The rule document cannot be used."""


@dataclass(frozen=True)
class Rule:
    name: str
    output: str
    type: str
    required: bool = False
    exclude_if_missing: bool = False
    min_length: int = 0
    lower: bool = False
    allowed: tuple[str, ...] = ()
    replace: dict[str, str] = field(default_factory=dict)
    default: str | None = None
    override: str | None = None
    non_zero: bool = False
    layouts: tuple[str, ...] = ()
    check: str | None = None  # Spark SQL predicate over the typed row
    listed: bool = False  # allowed values lie in a table, rows were told whether they are in it

    @property
    def needs_header(self) -> bool:
        """The source column must exist in the input."""
        return self.override is None and (self.required or self.default is not None)


@dataclass(frozen=True)
class Rules:
    fields: tuple[Rule, ...]

    @property
    def schema(self) -> T.StructType:
        """Schema of the typed output; required rules become non-nullable columns."""
        return T.StructType([T.StructField(r.output, COLUMN_TYPES[r.type], not r.required) for r in self.fields])

    def missing_headers(self, header: list[str]) -> list[str]:
        """Rules whose source column is needed but absent from a header."""
        present = {strip(h) for h in header}
        return [r.name for r in self.fields if r.needs_header and r.name not in present]


def strip(text: str) -> str:
    return text.strip(WHITE_SPACE)


def lower(text: str) -> str:
    return text.replace("İ", "i").replace("Σ", "σ").lower()


def quoted(text: str) -> str:
    """Driver-side twin of `quote_text`, for names inside rule errors."""
    out = []
    for ch in text:
        if ch in NAMED_ESCAPES:
            out.append(NAMED_ESCAPES[ch])
        elif ch == " " or unicodedata.category(ch)[0] in "LMNPS":
            out.append(ch)
        elif ord(ch) < 32 or ord(ch) == 127:
            out.append(f"\\x{ord(ch):02x}")
        else:
            out.append(f"\\u{ord(ch):04x}" if ord(ch) < 65536 else f"\\U{ord(ch):08x}")
    return '"' + "".join(out) + '"'


def snake_name(name: str) -> str:
    return re.sub("[ /._-]+", "_", strip(lower(name)))


def literal_text(value: Any) -> str:
    """Text of a JSON `default` or `override`: every number counts as a double in shortest form."""
    if isinstance(value, str):
        return value
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + " ".join(literal_text(v) for v in value) + "]"
    if isinstance(value, dict):
        return "map[" + " ".join(f"{k}:{literal_text(value[k])}" for k in sorted(value)) + "]"
    number = float(value)
    if number == 0:
        return "-0" if str(number).startswith("-") else "0"
    sign, digit_tuple, exp = Decimal(repr(number)).normalize().as_tuple()
    digits = "".join(map(str, digit_tuple))
    return ("-" if sign else "") + _shortest(digits, len(digits) + exp - 1)


def _shortest(digits: str, power: int) -> str:
    """Plain notation for leading exponents -4..5, else scientific with at least two exponent digits."""
    if power < -4 or power >= 6:
        mantissa = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
        return f"{mantissa}e{'-' if power < 0 else '+'}{abs(power):02d}"
    if power < 0:
        return "0." + "0" * (-power - 1) + digits
    whole = digits[: power + 1].ljust(power + 1, "0")
    rest = digits[power + 1 :]
    return whole + ("." + rest if rest else "")


def _typed(properties: dict[str, Any], key: str) -> Any:
    """A property checked against its JSON type; null counts as absent."""
    value = properties.get(key)
    wanted = PROPERTY_TYPES[key]
    if value is None or wanted is None:
        return value
    right = isinstance(value, wanted) and not (wanted is int and isinstance(value, bool))
    entries = value.values() if wanted is dict else value if wanted is list else ()
    if not right or any(not isinstance(e, str) and e is not None for e in entries):
        raise RuleError(f"property {quoted(key)} has the wrong JSON type")
    return value


def _rule(properties: Any) -> Rule:
    if not isinstance(properties, dict):
        raise RuleError("every entry of schema.fields must be an object")
    given = {k.lower(): v for k, v in properties.items()}  # property names match in any case
    p = {key: _typed(given, key) for key in PROPERTY_TYPES}
    name = strip(p["name"] or "")
    kind = lower(strip(p["type"] or ""))
    if not name:
        raise RuleError("field name cannot be empty")
    if kind not in COLUMN_TYPES:
        raise RuleError(f"field {quoted(name)} has unsupported type {quoted(kind)}")
    low = bool(p["lower"])
    fold = lower if low else (lambda text: text)

    replace: dict[str, str] = {}
    for source, target in (p["inline_replace"] or {}).items():
        key = fold(strip(source))
        if not key:
            raise RuleError(f"field {quoted(name)} has empty inline_replace key")
        if key in replace:
            raise RuleError(f"field {quoted(name)} has colliding inline_replace key {quoted(key)}")
        replace[key] = strip(fold(target or ""))

    layouts: list[str] = []
    if kind == "date":
        layouts = p["date_formats"] or DEFAULT_DATE_LAYOUTS
    elif kind == "datetime":
        layouts = p["datetime_formats"] or DEFAULT_DATETIME_LAYOUTS
    for layout in layouts:
        try:
            parse_layout(layout)
        except ValueError as problem:
            raise RuleError(f"field {quoted(name)}: {problem}") from None

    return Rule(
        name=name,
        output=strip(p["parquet_name"] or "") or snake_name(name),
        type=kind,
        required=bool(p["required"]),
        exclude_if_missing=bool(p["exclude_if_missing"]),
        min_length=p["min_length"] or 0,
        lower=low,
        allowed=tuple(dict.fromkeys(fold(strip(v or "")) for v in p["allowed_values"] or [])),
        replace=replace,
        default=None if p["default"] is None else literal_text(p["default"]),
        override=None if p["override"] is None else literal_text(p["override"]),
        non_zero=bool(p["non_zero"]),
        layouts=tuple(layouts),
        check=strip(p["check"] or "") or None,
    )


def parse_rules(document: Any) -> Rules:
    """Check a parsed rule document and prepare it; raises RuleError before any job starts."""
    if not isinstance(document, dict):
        raise RuleError("the rule document must be a JSON object")
    entries = next((v for k, v in document.items() if k.lower() == "fields"), None)
    if not entries:
        raise RuleError("schema.fields cannot be empty")
    rules: list[Rule] = []
    names: set[str] = set()
    outputs: set[str] = set()
    for properties in entries:
        rule = _rule(properties)
        if rule.name in names:
            raise RuleError(f"duplicate schema field name: {rule.name}")
        if rule.output in outputs:
            raise RuleError(f"duplicate parquet_name: {rule.output}")
        names.add(rule.name)
        outputs.add(rule.output)
        rules.append(rule)
    return Rules(tuple(rules))


def load_rules(path: str) -> Rules:
    """Read a rule document from a JSON file on the driver."""
    try:
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
    except (OSError, ValueError) as problem:
        raise RuleError(f"failed loading schema: {problem}") from problem
    return read_rules(text)


def read_rules(text: str) -> Rules:
    """The rules of a JSON document."""
    try:
        document = json.loads(text)
    except ValueError as problem:
        raise RuleError(f"failed loading schema: {problem}") from problem
    try:
        return parse_rules(document)
    except RuleError as problem:
        raise RuleError(f"invalid schema: {problem}") from None
