"""Rules as column expressions: per rule one typed value, per row one verdict, messages on demand.

The work is laid out as a few consecutive projections, each adding one step for all rules: trimmed
text, text after the missing test, parse results, typed value, verdict. Spark keeps them apart wherever
a result is used twice, so no cell is matched or cast more than once. Messages are built from what the
steps leave behind, and only for rejected rows.
"""

from __future__ import annotations

import datetime
import uuid
from bisect import bisect_right
from functools import lru_cache, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulegate.functions import numbers
from rulegate.functions.layouts import readers
from rulegate.functions.text import is_among, is_missing, looked_up, lower_text, may_hold_other_space, quote_text, trim_cell
from rulegate.rules import COLUMN_TYPES, Rule, RuleError, Rules, quoted

CELL_TEXT = "cell_text"  # what predicates call the texts behind the typed values
ROW = "__row"


# Bytes of generated code, measured: a rule by its type, a lookup, one pattern of a date or datetime, and the handling of
# what a cast cannot read in place (zones, month names)
CODE_BYTES = {"string": 550, "int": 1250, "float": 900, "date": 0, "datetime": 0}
LOOKUP_BYTES, READER_BYTES, EXTRAS_BYTES = 650, 900, 2900
GROUP_BYTES = 5500


def code_bytes(rule: Rule) -> int:
    """About how much generated code a rule is."""
    lookups = bool(rule.replace) + bool(rule.allowed)
    patterns = sum(READER_BYTES + EXTRAS_BYTES * bool(r.extras) for r in rule_readers(rule))
    return CODE_BYTES[rule.type] + LOOKUP_BYTES * lookups + patterns


@lru_cache(maxsize=256)
def _group_starts(weights: tuple[int, ...], most: int) -> tuple[int, ...]:
    starts, inside = [], 0
    for i, weight in enumerate(weights):
        if not starts or i - starts[-1] == most or inside + weight > GROUP_BYTES:
            starts.append(i)
            inside = 0
        inside += weight
    return tuple(starts)


def group_starts(rules: Rules) -> tuple[int, ...]:
    """Where each group of rules begins that is checked in a stretch of generated code of its own.

    The code of one stretch has to stay below the method size the JVM compiles (8,000 bytes); beyond it
    rows are interpreted, several times slower. A datetime with zones is several times the code of a text, so groups
    are cut by code and not by number alone. Every earlier group adds code for carrying its results, so wide documents
    get smaller groups. A lookup is about as much code as a rule.
    """
    count = len(rules.fields) + sum(bool(r.replace) + bool(r.allowed) for r in rules.fields)
    return _group_starts(tuple(map(code_bytes, rules.fields)), 4 if count <= 20 else 3 if count <= 33 else 2)


def group_of(rules: Rules, i: int) -> int:
    """The group rule `i` is in."""
    return bisect_right(group_starts(rules), i) - 1


def raw_text(rule: Rule, cell: Column, other_space: Column) -> Column:
    """Override, else trimmed cell, else blank; then whole-value replacement."""
    if rule.override is not None:
        raw = F.lit(rule.override)
    else:
        raw = F.coalesce(F.when(other_space, trim_cell(cell)).otherwise(F.trim(cell)), F.lit(""))
    if not rule.replace:
        return raw
    return F.coalesce(looked_up(lower_text(raw) if rule.lower else raw, rule.replace), raw)


def present_text(rule: Rule, raw: Column) -> Column:
    """Text to parse: the default for a missing cell unless the rule excludes the row, else NULL."""
    missing = is_missing(raw, trimmed=rule.override is None)
    usable_default = rule.default is not None and not rule.exclude_if_missing
    return F.when(missing, F.lit(rule.default if usable_default else None)).otherwise(raw)


def rule_readers(rule: Rule):
    return readers(rule.layouts, rule.type == "date") if rule.type in ("date", "datetime") else []


def first_parse(rule: Rule, text: Column) -> list[Column]:
    """Parse results kept as columns because value and verdict both look at them."""
    if rule.type == "int":
        return [numbers.to_long_exact(text)]
    if rule.type == "float":
        return [numbers.to_double(text)]
    return [r.rewrite(text) for r in rule_readers(rule)[:1]]


def second_parse(rule: Rule, text: Column, first: list[Column]) -> list[Column]:
    """Parse results only needed where the first one says so."""
    if rule.type == "int":
        return [F.when(first[0].isNull(), numbers.to_double(text))]
    leading, *others = rule_readers(rule) or [None]
    return [
        F.when(first[0] == text, r.rewrite(text)) if leading.excludes(r) else r.rewrite(text) for r in others
    ]


def typed_value(rule: Rule, text: Column, first: list[Column], second: list[Column]) -> Column:
    if rule.type == "string":
        return lower_text(text) if rule.lower else text
    if rule.type == "float":
        return numbers.without_overflow(first[0], text)
    if rule.type == "int":
        return F.coalesce(first[0], numbers.double_to_long(second[0]))
    return F.coalesce(*[r.value(c, text) for r, c in zip(rule_readers(rule), first + second)])


def conditions(rule: Rule, text: Column, value: Column, second: list[Column], known: Column | None = None) -> list[tuple]:
    """What can be wrong with a cell, in order: condition, message start, quoted text or None, message end.

    Every condition is true or false, never NULL. `known` tells for a `listed` rule whether the value is allowed.
    """
    found: list[tuple] = []
    if rule.exclude_if_missing:
        found.append((text.isNull(), "missing value excluded by rule", None, ""))
    elif rule.required and rule.default is None:
        found.append((text.isNull(), "value is required", None, ""))
    if rule.type == "string":
        if rule.min_length > 0:
            short = F.coalesce(F.octet_length(value) < rule.min_length, F.lit(False))
            found.append((short, f"min_length={rule.min_length} violated", None, ""))
        if rule.allowed:
            known = F.coalesce(is_among(value, rule.allowed), F.lit(True))
        if known is not None:
            found.append((~known, "value ", value, " not in allowed_values"))
        return found
    unreadable = value.isNull() & text.isNotNull()
    if rule.type == "int":
        real = numbers.without_overflow(second[0], text)
        fraction = F.coalesce(numbers.has_fraction(real), F.lit(False))
        found.append((unreadable & fraction, "invalid int (fractional): ", text, ""))
    found.append((unreadable, f"invalid {rule.type}: ", text, ""))
    if rule.non_zero and rule.type == "int":
        found.append((F.coalesce(value, F.lit(1)) == 0, "must be non-zero", None, ""))
    return found


def is_wrong(rule: Rule, text: Column, value: Column, known: Column | None = None) -> Column:
    """Whether any condition of a rule is broken: the cheap verdict every row gets."""
    if rule.type != "string" and (rule.exclude_if_missing or (rule.required and rule.default is None)):
        verdict = value.isNull()  # unreadable or missing
    else:
        verdict = None
        for condition, *_ in conditions(rule, text, value, [F.lit(0.0)], known):
            verdict = condition if verdict is None else verdict | condition
    if rule.non_zero and rule.type == "int":
        verdict = verdict | (F.coalesce(value, F.lit(1)) == 0)
    return F.lit(False) if verdict is None else verdict


def first_error(
    rule: Rule, text: Column, value: Column, second: list[Column], refused: Column | None = None, known: Column | None = None
) -> Column:
    """Parts of the first broken condition's message, NULL when the cell is fine.

    `refused` tells whether the rule's predicate is false; it speaks last.
    """
    chain = F.when(F.lit(False), _parts(rule, "", None, ""))
    for condition, start, shown, end in conditions(rule, text, value, second, known):
        chain = chain.when(condition, _parts(rule, start, shown, end))
    return chain if refused is None else chain.when(refused, _parts(rule, f"check failed: {rule.check}", None, ""))


def _parts(rule: Rule, start: str, shown: Column | None, end: str) -> Column:
    text = F.lit(None).cast("string") if shown is None else shown
    return F.struct(
        F.lit(rule.name).alias("field"), F.lit(start).alias("start"), text.alias("text"), F.lit(end).alias("end")
    )


def known_column(i: int) -> str:
    """Column that tells whether the value of a listed rule is in its table."""
    return f"__known{i}"


def value(rules: Rules, i: int) -> Column:
    """Typed value of rule `i` in a checked frame."""
    return F.col(f"__got{group_of(rules, i)}")[f"value{i}"]


def why(rules: Rules, i: int, part: str) -> Column:
    """What the messages of rule `i` need: its `text`, `real`, the double behind an `int`, or `known` of a listed rule."""
    return F.col(f"__why{group_of(rules, i)}")[f"{part}{i}"]


def with_checks(df: DataFrame, rules: Rules, cells: dict[str, Column], keep: list[str]) -> DataFrame:
    """`keep` columns of `df`, the verdict `__ok`, and per group of rules `__got` (typed values) and
    `__why` (what messages need), read through `value` and `why`; with predicates `__refused` as well.

    `cells` maps trimmed header names to columns of `df`; rules without an entry see a blank cell.
    """
    sources = {
        i: cells[r.name] for i, r in enumerate(rules.fields) if r.override is None and r.name in cells
    }
    listed = {i: F.col(known_column(i)) for i, r in enumerate(rules.fields) if r.listed}
    packed = [*[c.alias(f"cell{i}") for i, c in sources.items()], *[c.alias(f"known{i}") for i, c in listed.items()]]
    packed = F.struct(*packed) if packed else F.struct(F.lit(""))
    every_cell = F.concat_ws("", *[F.col("__cells")[f"cell{i}"] for i in sources])
    frame = df.select(*keep, packed.alias("__cells"))
    frame = frame.select("*", may_hold_other_space(every_cell).alias("__other_space"), F.lit(True).alias("__ok"))

    done: list[str] = []
    numbered = list(enumerate(rules.fields))
    starts = group_starts(rules)
    for position, (start, end) in enumerate(zip(starts, [*starts[1:], len(numbered)])):
        if start:
            frame = _stretch_end(frame)
        waiting = ["__cells", "__other_space"] if end < len(numbered) else []
        group = numbered[start:end]
        frame = _check_group(frame, position, group, set(sources), [*keep, *done], waiting)
        done += [f"__got{position}", f"__why{position}"]
    if any(r.check for r in rules.fields):
        frame = _with_predicates(_stretch_end(frame), rules, [*keep, *done])
    return frame


def _stretch_end(frame: DataFrame) -> DataFrame:
    """A counter between two steps makes Spark generate code for each of them by itself."""
    return frame.observe(f"rulegate-group-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def predicate_scope(rules: Rules, values: list[Column], texts: list[Column]) -> list[Column]:
    """The columns a predicate may name: typed values by output name, and their texts in `cell_text`.

    A text is the cell after trimming, replacement and default, before its cast; NULL when missing.
    """
    names = [r.output for r in rules.fields]
    shown = F.struct(*[t.alias(n) for t, n in zip(texts, names)]).alias(CELL_TEXT)
    return [*[v.alias(n) for v, n in zip(values, names)], shown]


def check_predicates(spark: SparkSession, rules: Rules) -> None:
    """Raise RuleError for a predicate Spark cannot use on rows; analysis only, no job.

    It has to parse, name only columns of its scope, be a boolean of one row (no aggregate, window, generator or
    subquery) and give the same answer every time.
    """
    with_check = [r for r in rules.fields if r.check]
    taken = [r.output for r in rules.fields if r.output.lower() in (CELL_TEXT, ROW)]
    if with_check and taken:
        raise RuleError(f"output name {quoted(taken[0])} is reserved where rules have a check")
    if not with_check:
        return
    unknown = [F.lit(None).cast(COLUMN_TYPES[r.type]) for r in rules.fields]
    texts = [F.lit(None).cast("string") for _ in rules.fields]
    scope = spark.range(0).select(*predicate_scope(rules, unknown, texts))
    for rule in with_check:
        try:
            plan = scope.filter(F.expr(rule.check))._jdf.queryExecution().analyzed()
        except AnalysisException as problem:
            reason = str(problem).strip().partition("\n")[0].partition(" SQLSTATE")[0]
            raise RuleError(f"field {quoted(rule.name)} has an unusable check: {reason}") from None
        for wrong, reason in (
            (not plan.deterministic(), "it is not deterministic"),
            (not plan.subqueriesAll().isEmpty(), "it holds a subquery"),
        ):
            if wrong:
                raise RuleError(f"field {quoted(rule.name)} has an unusable check: {reason}")


def _with_predicates(frame: DataFrame, rules: Rules, carried: list[str]) -> DataFrame:
    """Add `__refused`, one boolean per predicate (an unknown answer passes), and update `__ok`.

    Everything else travels in one struct meanwhile, so a predicate sees nothing but its scope.
    """
    numbered = range(len(rules.fields))
    scope = predicate_scope(rules, [value(rules, i) for i in numbered], [why(rules, i, "text") for i in numbered])
    scoped = frame.select(F.struct(*carried, "__ok").alias(ROW), *scope)
    refused = {i: ~F.coalesce(F.expr(r.check), F.lit(True)) for i, r in enumerate(rules.fields) if r.check}
    judged = scoped.select(f"{ROW}.*", F.struct(*[c.alias(f"check{i}") for i, c in refused.items()]).alias("__refused"))
    passes = [~F.col("__refused")[f"check{i}"] for i in refused]
    return judged.withColumn("__ok", reduce(lambda a, b: a & b, [F.col("__ok"), *passes]))


def _check_group(
    frame: DataFrame,
    position: int,
    group: list[tuple[int, Rule]],
    with_cell: set[int],
    carried: list[str],
    waiting: list[str],
) -> DataFrame:
    """All steps for a few rules; adds their `__got` and `__why` and updates `__ok`."""
    blank = F.lit("")
    passing = [*carried, *waiting, "__ok"]

    def columns(names: list[str]) -> list[Column]:
        return [F.col(name) for name in names]

    def text(i: int) -> Column:
        return F.col(f"text{i}")

    firsts, seconds = {}, {}
    for i, rule in group:
        moments = len(rule_readers(rule))
        first = 1 if moments or rule.type in ("int", "float") else 0
        second = 1 if rule.type == "int" else max(moments - 1, 0)
        firsts[i] = [f"__first{i}_{n}" for n in range(first)]
        seconds[i] = [f"__second{i}_{n}" for n in range(second)]
    known = [f"known{i}" for i, r in group if r.listed]
    texts = [*[f"text{i}" for i, _ in group], *known]
    whole = [i for i, r in group if r.type == "int"]

    frame = frame.select(
        *passing,
        *[
            raw_text(r, F.col("__cells")[f"cell{i}"] if i in with_cell else blank, F.col("__other_space")).alias(
                f"raw{i}"
            )
            for i, r in group
        ],
        *[F.col("__cells")[name].alias(name) for name in known],
    )
    frame = frame.select(*passing, *known, *[present_text(r, F.col(f"raw{i}")).alias(f"text{i}") for i, r in group])
    first_columns = [
        c.alias(name) for i, r in group for name, c in zip(firsts[i], first_parse(r, text(i)))
    ]
    frame = frame.select(*passing, *texts, *first_columns)
    if any(seconds.values()):
        second_columns = [
            c.alias(name)
            for i, r in group
            for name, c in zip(seconds[i], second_parse(r, text(i), columns(firsts[i])))
        ]
        frame = frame.select(*passing, *texts, *[n for i, _ in group for n in firsts[i]], *second_columns)
    value_columns = [
        typed_value(r, text(i), columns(firsts[i]), columns(seconds[i])).alias(f"value{i}") for i, r in group
    ]
    frame = frame.select(*passing, *texts, *[n for i in whole for n in seconds[i]], *value_columns)
    verdicts = [~is_wrong(r, text(i), F.col(f"value{i}"), F.col(f"known{i}") if r.listed else None) for i, r in group]
    reals = [F.col(seconds[i][0]).alias(f"real{i}") for i in whole]
    return frame.select(
        *carried,
        *waiting,
        F.struct(*[f"value{i}" for i, _ in group]).alias(f"__got{position}"),
        F.struct(*texts, *reals).alias(f"__why{position}"),
        reduce(lambda a, b: a & b, [F.col("__ok"), *verdicts]).alias("__ok"),
    )


def first_errors(rules: Rules) -> Column:
    """Array with one entry per rule, NULL where it is fine, from the columns `with_checks` leaves."""
    entries = [
        first_error(
            r,
            why(rules, i, "text"),
            value(rules, i),
            [why(rules, i, "real")] if r.type == "int" else [],
            F.col("__refused")[f"check{i}"] if r.check else None,
            why(rules, i, "known") if r.listed else None,
        )
        for i, r in enumerate(rules.fields)
    ]
    return F.array(*entries)


def message(entry: Column) -> Column:
    return F.concat(entry["start"], F.coalesce(quote_text(entry["text"]), F.lit("")), entry["end"])


def rendered_errors(rules: Rules) -> Column:
    """All messages of a row as one text, in rule order."""
    texts = F.transform(first_errors(rules), lambda e: F.concat(e["field"], F.lit(": "), message(e)))
    return F.array_join(texts, " | ")


def listed_errors(rules: Rules) -> Column:
    """Messages of a row as an array of (field, msg) in rule order, with NULL for rules that are fine."""
    return F.transform(
        first_errors(rules),
        lambda e: F.when(e.isNotNull(), F.struct(e["field"].alias("field"), message(e).alias("msg"))),
    )


def not_null(rule: Rule, value: Column) -> Column:
    """Tell Spark that a value of a required rule is never NULL; the literal itself is never used."""
    epoch = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
    unused = {"string": "", "float": 0.0, "int": 0, "date": epoch.date(), "datetime": epoch}[rule.type]
    return F.coalesce(value, F.lit(unused).cast(COLUMN_TYPES[rule.type]))


def typed_columns(rules: Rules) -> list[Column]:
    """Output columns of accepted rows: required rules non-nullable, all others nullable.

    The condition is always true here; it keeps a column with a default nullable, as declared.
    """
    values = [(r, value(rules, i)) for i, r in enumerate(rules.fields)]
    return [(not_null(r, v) if r.required else F.when(F.col("__ok"), v)).alias(r.output) for r, v in values]
