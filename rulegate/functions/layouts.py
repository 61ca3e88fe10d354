"""Date and datetime layouts, written as the reference moment `2006-01-02 15:04:05 -0700`.

A layout becomes one anchored pattern at compile time. A matching cell is rewritten by a single
`regexp_replace` into the spelling Spark's own cast understands; the cast then rejects impossible
calendar days. Layouts of one rule that list year, month and day in the same order share one pattern,
so the usual date cell costs one pattern match however many layouts the rule names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# The layout vocabulary with the accepted text of each element. `(?![0-9])` makes the
# one-digit forms apply only when no second digit follows.
MONTHS = (
    "january february march april may june july august september october november december".split()
)
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
TWO_DIGIT_MONTH = "0[1-9]|1[0-2]"
TWO_DIGIT_DAY = "0[1-9]|[12][0-9]|3[01]"
TWO_DIGIT_SIXTY = "[0-5][0-9]"
OFFSET_HOUR, OFFSET_SIXTY = "(?:[01][0-9]|2[0-4])", "(?:[0-5][0-9]|60)"
ONE_DIGIT = "(?![0-9])"
ANY_FRACTION = r"(?:[.,]([0-9]{1,6}+)[0-9]*+)?+"

ELEMENTS: dict[str, tuple[str, str]] = {
    "2006": ("year", "([0-9]{4})"),
    "06": ("short_year", "([0-9]{2})"),
    "January": ("month_name", f"(?i:({'|'.join(MONTHS)}))"),
    "Jan": ("month_name", f"(?i:({'|'.join(m[:3] for m in MONTHS)}))"),
    "01": ("month", f"({TWO_DIGIT_MONTH})"),
    "1": ("month", f"({TWO_DIGIT_MONTH}|[1-9]{ONE_DIGIT})"),
    "Monday": ("", f"(?i:{'|'.join(DAYS)})"),
    "Mon": ("", f"(?i:{'|'.join(d[:3] for d in DAYS)})"),
    "02": ("day", f"({TWO_DIGIT_DAY})"),
    "_2": ("day", f" ?({TWO_DIGIT_DAY}|[1-9]{ONE_DIGIT})"),
    "2": ("day", f"({TWO_DIGIT_DAY}|[1-9]{ONE_DIGIT})"),
    "15": ("hour", f"([01][0-9]|2[0-3]|[0-9]{ONE_DIGIT})"),
    "03": ("hour", "(0[0-9]|1[0-2])"),
    "3": ("hour", f"(0[0-9]|1[0-2]|[0-9]{ONE_DIGIT})"),
    "04": ("minute", f"({TWO_DIGIT_SIXTY})"),
    "4": ("minute", f"({TWO_DIGIT_SIXTY}|[0-9]{ONE_DIGIT})"),
    "05": ("second", f"({TWO_DIGIT_SIXTY})"),
    "5": ("second", f"({TWO_DIGIT_SIXTY}|[0-9]{ONE_DIGIT})"),
    "PM": ("half_day", "(AM|PM)"),
    "pm": ("half_day", "(am|pm)"),
}
ZONES = {
    "07:00:00": f"{OFFSET_HOUR}:{OFFSET_SIXTY}:{OFFSET_SIXTY}",
    "070000": f"{OFFSET_HOUR}{OFFSET_SIXTY}{OFFSET_SIXTY}",
    "07:00": f"{OFFSET_HOUR}:{OFFSET_SIXTY}",
    "0700": f"{OFFSET_HOUR}{OFFSET_SIXTY}",
    "07": OFFSET_HOUR,
}
for _text, _offset in ZONES.items():
    ELEMENTS["-" + _text] = ("zone", f"([+-]{_offset})")
    ELEMENTS["Z" + _text] = ("zone", f"(Z|[+-]{_offset})")
UNSUPPORTED = ["MST", "002", "__2"]

# Spelling of the layout elements, longest first where one begins another.
VOCABULARY = re.compile(
    "|".join(
        [
            r"January|Jan(?![a-z])|Monday|Mon(?![a-z])|MST|002|0[1-6]|15|2006|__2|_2(?!006)|PM|pm",
            "|".join(f"[-Z]{z}" for z in ZONES),
            r"[.,](?:0+|9+)(?![0-9])|[1-5]",
        ]
    )
)

MARK = "\x01"  # opens every rewritten cell
EXTRAS = ["zone", "half_day", "month_name", "short_year"]
TEXT_END = 2**31 - 1


@dataclass(frozen=True)
class Layout:
    pattern: str
    groups: tuple[str, ...]  # what each capture group holds, in order

    @property
    def order(self) -> tuple[str, ...]:
        """Calendar elements in the order they are written."""
        return tuple(g for g in self.groups if g in ("year", "short_year", "month", "month_name", "day"))

    @property
    def numeric(self) -> bool:
        return not {"short_year", "month_name", "half_day"} & set(self.groups)


def _literal(text: str) -> str:
    """Pattern for fixed text: a run of blanks stands for one or more blanks."""
    return re.sub(r"( +)|([^A-Za-z0-9 ])", lambda m: " +" if m[1] else "\\" + m[2], text)


def parse_layout(layout: str) -> Layout:
    """Translate one layout; raises ValueError for elements that are not supported."""
    pattern, groups, position = "", [], 0
    found = list(VOCABULARY.finditer(layout))
    for i, token in enumerate(found):
        text = token.group()
        pattern += _literal(layout[position : token.start()])
        position = token.end()
        if text in UNSUPPORTED:
            raise ValueError(f"unsupported element {text} in layout {layout}")
        if text[0] in ".,":
            digits = len(text) - 1
            if text[1] == "9":
                pattern += ANY_FRACTION
            else:
                pattern += rf"[.,]([0-9]{{{min(digits, 6)}}})" + f"[0-9]{{{max(digits - 6, 0)}}}"
            groups.append("fraction")
            continue
        kind, accepted = ELEMENTS[text]
        pattern += accepted
        if kind:
            groups.append(kind)
        next_is_fraction = i + 1 < len(found) and found[i + 1].group()[0] in ".,"
        if kind == "second" and not next_is_fraction:
            pattern += ANY_FRACTION  # a fraction may follow the seconds even if the layout has none
            groups.append("fraction")
    pattern += _literal(layout[position:])
    repeated = [g for g in groups if groups.count(g) > 1]
    if repeated or {"short_year", "year"} <= set(groups) or {"month_name", "month"} <= set(groups):
        raise ValueError(f"layout {layout} names the same element twice")
    return Layout(pattern, tuple(groups))


def _can_share(a: Layout, b: Layout, date_only: bool) -> bool:
    """Same calendar order, and for a datetime the same clock elements (a fraction may be absent)."""
    clock = date_only or set(a.groups) - {"fraction"} == set(b.groups) - {"fraction"}
    return a.numeric and b.numeric and a.order == b.order and "year" in a.order and clock


def _bundles(layouts: tuple[str, ...], date_only: bool) -> list[list[Layout]]:
    """Neighbouring layouts that can share one pattern."""
    bundles: list[list[Layout]] = []
    for parsed in dict.fromkeys(parse_layout(text) for text in layouts):
        if bundles and _can_share(bundles[-1][0], parsed, date_only):
            bundles[-1].append(parsed)
        else:
            bundles.append([parsed])
    return bundles


@dataclass(frozen=True)
class Reader:
    """One pattern match per cell (`rewrite`), then native casts on its outcome (`value`)."""

    pattern: str
    slots: dict[str, str]  # element -> replacement text naming its capture groups
    order: tuple[str, ...]  # calendar elements, empty when a two-digit year or a name is involved
    date_only: bool

    def excludes(self, other: Reader) -> bool:
        """No text matches both readers with different calendar days."""
        return bool(self.order) and self.order == other.order

    @property
    def extras(self) -> list[str]:
        """Elements Spark's cast cannot read in place; they travel behind the moment."""
        wanted = ["month_name", "short_year"] if self.date_only else EXTRAS
        return [e for e in wanted if e in self.slots]

    def rewrite(self, c: Column) -> Column:
        s = self.slots
        moment = f"{s.get('year', '0000')}-{s.get('month', '01')}-{s.get('day', '01')}"
        if not self.date_only:
            moment += f" {s.get('hour', '00')}:{s.get('minute', '00')}:{s.get('second', '00')}"
            moment += f".{s.get('fraction', '')}Z"
        return F.regexp_replace(c, self.pattern, MARK + "|".join([moment] + [s[e] for e in self.extras]))

    def value(self, rewritten: Column, original: Column) -> Column:
        """DATE or TIMESTAMP, NULL when the cell did not match or the day does not exist."""
        text = F.substring(rewritten, 2, TEXT_END)

        def extra(element: str) -> Column:
            return F.split_part(text, F.lit("|"), F.lit(self.extras.index(element) + 2))

        moment = F.split_part(text, F.lit("|"), F.lit(1)) if self.extras else text
        if "month_name" in self.slots:
            month = _month_number(extra("month_name"))
            moment = F.concat(F.substring(moment, 1, 5), month, F.substring(moment, 8, TEXT_END))
        if "short_year" in self.slots:
            year = extra("short_year")
            century = F.when(year >= "69", F.lit("19")).otherwise(F.lit("20"))
            moment = F.concat(century, year, F.substring(moment, 5, TEXT_END))
        matched = rewritten != original
        if self.date_only:
            return F.when(matched, moment.try_cast("date"))
        result = moment.try_cast("timestamp")
        shift = None
        if "half_day" in self.slots:
            half, hour = F.lower(extra("half_day")), F.hour(result)
            shift = (
                F.when((half == "pm") & (hour < 12), 43200)
                .when((half == "am") & (hour == 12), -43200)
                .otherwise(0)
            )
        if "zone" in self.slots:
            zone = _zone_seconds(extra("zone"))
            shift = -zone if shift is None else shift - zone
        if shift is not None:
            result = F.timestamp_micros(F.unix_micros(result) + shift.cast("bigint") * 1000000)
        return F.when(matched, result)


def _zone_seconds(zone: Column) -> Column:
    """Seconds east of UTC; `Z` and an absent zone are zero."""
    digits = F.rpad(F.replace(F.substring(zone, 2, 8), F.lit(":")), 6, "0")
    hours, minutes, seconds = (F.substring(digits, at, 2).try_cast("int") for at in (1, 3, 5))
    total = hours * 3600 + minutes * 60 + seconds
    return F.when(F.length(zone) <= 1, 0).when(zone.startswith("-"), -total).otherwise(total)


def _month_number(name: Column) -> Column:
    short = F.lower(F.substring(name, 1, 3))
    index = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short)
    return F.lpad(index.cast("string"), 2, "0")


def readers(layouts: tuple[str, ...], date_only: bool) -> list[Reader]:
    """Readers to try in order for the layouts of one rule."""
    result = []
    for bundle in _bundles(layouts, date_only):
        slots: dict[str, str] = {}
        offset = 0
        for layout in bundle:
            for i, element in enumerate(layout.groups, start=offset + 1):
                # groups of the alternatives that did not match are empty, so listing them all picks one
                slots[element] = slots.get(element, "") + f"${i}"
            offset += len(layout.groups)
        pattern = "^(?:" + "|".join(layout.pattern for layout in bundle) + r")\z"
        fixed = bundle[0].numeric and "year" in bundle[0].order
        result.append(Reader(pattern, slots, bundle[0].order if fixed else (), date_only))
    return result
