"""Replacements and allowed values that lie in tables, for sets too large for a rule document.

A rule document is a literal of the plan, so its value sets pass through the driver. Tables do not: cells meet their
replacements and allowed values by joins, which Spark shuffles when a table is large.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from rulegate.functions.checks import known_column, present_text, raw_text
from rulegate.functions.text import lower_text, trim_cell
from rulegate.rules import RuleError, Rules, quoted
from rulegate.session import materialize, small_side

ROW_BYTES = 400


@dataclass(frozen=True)
class ValueTables:
    """`replace`: two columns, a text and what takes its place. `allowed`: one column; without rows nothing is allowed.

    Entries are trimmed, and lower-cased for a rule with `lower`, like those of a rule document.
    """

    replace: DataFrame | None = None
    allowed: DataFrame | None = None


def look_up(
    df: DataFrame, rules: Rules, cells: dict[str, Column], tables: dict[str, ValueTables]
) -> tuple[DataFrame, Rules, dict[str, Column]]:
    """Rows with their cells replaced and, as `__known<i>`, whether a value is allowed; the rules and cells to check
    them by."""
    unknown = tables.keys() - {r.name for r in rules.fields}
    if unknown:
        raise RuleError(f"value tables for an unknown field {quoted(min(unknown))}")
    fields, found = list(rules.fields), dict(cells)
    for i, rule in enumerate(rules.fields):
        given = tables.get(rule.name)
        if given is None:
            continue
        if (given.replace is not None and rule.replace) or (given.allowed is not None and rule.allowed):
            raise RuleError(f"field {quoted(rule.name)} has values in its rule and in a table")
        if rule.override is not None:
            raise RuleError(f"field {quoted(rule.name)} has an override and value tables")
        raw = raw_text(rule, cells.get(rule.name, F.lit("")), F.lit(True))
        df = df.withColumn(f"__cell{i}", raw)
        if given.replace is not None:
            df = _replaced(df, f"__cell{i}", rule, given.replace)
        rule = replace(rule, replace={})
        found[rule.name] = F.col(f"__cell{i}")
        if given.allowed is not None and rule.type == "string":
            present = present_text(fields[i], F.col(f"__cell{i}"))
            df = _known(df, lower_text(present) if rule.lower else present, known_column(i), rule.lower, given.allowed)
            rule = replace(rule, listed=True)
        fields[i] = rule
    return df, Rules(tuple(fields)), found


def _replaced(df: DataFrame, cell: str, rule, table: DataFrame) -> DataFrame:
    fold = lower_text if rule.lower else (lambda text: text)
    source, target = (F.col(f"`{c}`").cast("string") for c in table.columns[:2])
    entries = table.select(
        F.coalesce(fold(trim_cell(source)), F.lit("")).alias("__key"),
        trim_cell(fold(F.coalesce(target, F.lit("")))).alias("__target"),
    )
    entries = materialize(entries, "replacements")
    keys = entries.groupBy("__key").agg(F.count("*").alias("n"))
    wrong = keys.where("n > 1 OR __key = ''").first()
    if wrong is not None:
        problem = "empty inline_replace key" if not wrong["__key"] else f"colliding inline_replace key {quoted(wrong['__key'])}"
        raise RuleError(f"field {quoted(rule.name)} has {problem}")
    joined = df.join(_side(entries), fold(F.col(cell)) == F.col("__key"), "left")
    return joined.withColumn(cell, F.coalesce("__target", cell)).drop("__key", "__target")


def _known(df: DataFrame, value: Column, name: str, low: bool, table: DataFrame) -> DataFrame:
    text = F.coalesce(trim_cell(F.col(f"`{table.columns[0]}`").cast("string")), F.lit(""))
    entries = materialize(table.select((lower_text(text) if low else text).alias("__entry")).distinct(), "allowed-values")
    joined = df.withColumn("__value", value).join(_side(entries), F.col("__value") == F.col("__entry"), "left")
    return joined.withColumn(name, F.col("__value").isNull() | F.col("__entry").isNotNull()).drop("__value", "__entry")


def _side(entries: DataFrame) -> DataFrame:
    """Broadcast only if its rows are few; a compressed table says too little about its size in memory."""
    number = entries.count()
    side = small_side(entries, number, ROW_BYTES)
    return entries.hint("merge") if side is entries else side
