"""The gate: rows every rule accepts become typed rows, the others go to quarantine."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from rulegate.functions import checks
from rulegate.operators.value_tables import ValueTables, look_up
from rulegate.rules import RuleError, Rules, quoted, strip


class HeaderError(ValueError):
    """A column the rules need is not in the input."""


@dataclass(frozen=True)
class Validation:
    """Checked rows; `valid`, `invalid` and the aggregates are lazy views of the same plan."""

    rules: Rules
    checked: DataFrame
    keep: tuple[str, ...]

    def valid(self, *keep: str) -> DataFrame:
        """Typed columns in rule order, after the kept columns asked for."""
        return self.checked.filter("__ok").select(*keep, *checks.typed_columns(self.rules))

    def invalid(self, *keep: str) -> DataFrame:
        """Kept columns (all by default) and `__errors` of the rejected rows."""
        errors = checks.rendered_errors(self.rules).alias("__errors")
        return self.checked.filter("NOT __ok").select(*(keep or map(verbatim, self.keep)), errors)

    def staged(self, *keep: str, rejected_only: tuple[str, ...] = ()) -> DataFrame:
        """Both sides in one frame, for a scratch table that feeds several outputs.

        Kept columns, `__ok`, the typed columns as struct `row`, and for rejected rows `__errors` and the
        columns of `rejected_only`.
        """
        ok = F.col("__ok")
        values = [checks.value(self.rules, i).alias(r.output) for i, r in enumerate(self.rules.fields)]
        return self.checked.select(
            *keep,
            "__ok",
            F.when(ok, F.struct(*values)).alias("row"),
            F.when(~ok, checks.rendered_errors(self.rules)).alias("__errors"),
            *[F.when(~ok, F.col(c)).alias(c) for c in rejected_only],
        )

    def error_rows(self, *keep: str) -> DataFrame:
        """One row per error: kept columns, `field`, `msg`."""
        entries = F.inline(checks.listed_errors(self.rules))
        return self.checked.filter("NOT __ok").select(*keep, entries).filter("msg IS NOT NULL")

    def error_profile(self) -> DataFrame:
        """How often each field and message occurs; counted before the shuffle."""
        return self.error_rows().groupBy("field", "msg").agg(F.count("*").alias("n"))

    def stats(self, *by: str) -> DataFrame:
        """Total, valid and invalid rows, per group when columns are named."""
        return self.checked.groupBy(*by).agg(*counts())


def counts() -> list[Column]:
    ok = F.col("__ok")
    return [
        F.count("*").alias("total_rows"),
        F.count_if(ok).alias("valid_rows"),
        F.count_if(~ok).alias("invalid_rows"),
    ]


def header_cells(df: DataFrame) -> dict[str, Column]:
    """Trimmed column names of a frame; the last of several equal names wins."""
    return {strip(name): F.col(verbatim(name)) for name in df.columns}


def verbatim(name: str) -> str:
    """A column name as Spark takes it literally, dots and backticks included."""
    return f"`{name.replace('`', '``')}`"


def validate(
    df: DataFrame,
    rules: Rules,
    keep: list[str] | None = None,
    cells: dict[str, Column] | None = None,
    observation: Observation | None = None,
    tables: dict[str, ValueTables] | None = None,
) -> Validation:
    """Check every row of a frame of text columns against the rules.

    `keep` names columns that travel along (all by default). `cells` overrides how source columns are
    found. A predicate that cannot be used (RuleError) or a needed column that is absent (HeaderError) is
    reported before any job runs. `observation` receives total_rows, valid_rows and invalid_rows from the first
    action over the result. `tables` has value sets by rule name that are too large for a rule document; the result's
    `rules` are those to read its columns by.
    """
    if not rules.fields:
        raise RuleError("schema.fields cannot be empty")
    checks.check_predicates(df.sparkSession, rules)
    found = header_cells(df) if cells is None else cells
    absent = rules.missing_headers(list(found))
    if absent:
        raise HeaderError(header_message(absent[0]))
    kept = list(df.columns) if keep is None else list(keep)
    if tables:
        df, rules, found = look_up(df, rules, found, tables)
    checked = checks.with_checks(df, rules, found, [verbatim(k) for k in kept])
    # The counters make Spark keep row filters above the checks, so each check runs once per row.
    watch = observation or f"rulegate-{uuid.uuid4().hex}"
    return Validation(rules, checked.observe(watch, *counts()), tuple(kept))


def header_message(name: str) -> str:
    return f"required schema field {quoted(name)} not found in CSV header"
