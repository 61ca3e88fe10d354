"""A plain model of one cell's evaluation, for random comparison only."""

from __future__ import annotations

import math
import re
from datetime import datetime

MISSING = {"", "none", "null", "nan", "na", "n/a"}
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def number(text):
    if re.fullmatch(r"[+-]?(inf|infinity)", text, re.I) or re.fullmatch("nan", text, re.I):
        return float(text)
    digits = r"[0-9](?:_?[0-9])*"
    if not re.fullmatch(rf"[+-]?(?:{digits}(?:\.(?:{digits})?)?|\.{digits})(?:[eE][+-]?{digits})?", text):
        return None
    value = float(text.replace("_", ""))
    return None if math.isinf(value) else value


def evaluate(rule: dict, cell: str):
    """(value, None) or (None, message); `rule` is a rule without layouts."""
    text = cell.strip(SPACE)
    if text.lower() in MISSING:
        if rule.get("exclude_if_missing"):
            return None, "missing value excluded by rule"
        if "default" in rule:
            text = rule["default"]
        elif rule.get("required"):
            return None, "value is required"
        else:
            return None, None
    if rule["type"] == "string":
        text = text.lower() if rule.get("lower") else text
        if len(text.encode()) < rule.get("min_length", 0):
            return None, f"min_length={rule['min_length']} violated"
        if rule.get("allowed_values") and text not in rule["allowed_values"]:
            return None, f'value "{text}" not in allowed_values'
        return text, None
    if rule["type"] == "float":
        value = number(text)
        return (value, None) if value is not None else (None, f'invalid float: "{text}"')
    if rule["type"] == "int":
        if re.fullmatch(r"[+-]?[0-9]+", text) and -(2**63) <= int(text) < 2**63:
            value = int(text)
        else:
            real = number(text)
            if real is None:
                return None, f'invalid int: "{text}"'
            if math.isnan(real) or math.isinf(real) or real % 1 != 0:
                return None, f'invalid int (fractional): "{text}"'
            if not -(2**63) <= real < 2**63:
                return None, f'invalid int: "{text}"'
            value = int(real)
        return (None, "must be non-zero") if rule.get("non_zero") and value == 0 else (value, None)
    match = re.fullmatch(r"(\d{4}-\d\d-\d\d)(?: +(\d{1,2}):(\d\d):(\d\d)(?:[.,]\d+)?)?", text, re.A)
    try:
        day = datetime.strptime(match[1], "%Y-%m-%d").date()
        if match[2] and not (int(match[2]) < 24 and int(match[3]) < 60 and int(match[4]) < 60):
            raise ValueError
        return day, None
    except (TypeError, ValueError):
        return None, f'invalid date: "{text}"'
