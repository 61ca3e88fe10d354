"""Evaluation of cells: golden cases, layouts, quoting, and random cells against the model."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rulegate.functions import checks
from rulegate.functions.text import is_among, is_missing, looked_up, lower_text, quote_text, snake_case, trim_cell
from rulegate.operators.validate import HeaderError, validate
from rulegate.plans.workflows import validate_directory
from rulegate.rules import RuleError, parse_rules
from tests.model import evaluate

# Parcels as a scanner at a gate reports them; `scanner` is not in the file
HEADER = ["Parcel No", "due", "lane", "pieces", "remark", "scanned", "weight kg"]
DOCUMENT = {
    "fields": [
        {"name": "Parcel No", "type": "string", "required": True, "min_length": 4},
        {"name": "weight kg", "parquet_name": "weight", "type": "float", "required": True},
        {"name": "pieces", "type": "int", "non_zero": True, "default": 1},
        {"name": "scanned", "type": "datetime", "required": True},
        {"name": "due", "type": "date", "date_formats": ["02.01.2006"]},
        {
            "name": "lane",
            "type": "string",
            "lower": True,
            "exclude_if_missing": True,
            "inline_replace": {"xp": "express", "std": "standard"},
            "allowed_values": ["express", "standard"],
        },
        {"name": "scanner", "type": "string", "override": "gate-7"},
        {"name": "remark", "type": "string", "default": "None given", "lower": True},
    ]
}
ROWS = [
    "PX10,24.12.2023,XP,3,Fragile,2023-12-20 08:15:00,2.5",
    "P1,2023-12-24,slow,0,,yesterday,",
    "PX12, ,n/a,,null,2023-12-21T09:00:00+01:00,1e1",
    "PX13",
    "PX14,,std,,,2023-12-21T09:00:00+01:00,.75",
    "PX15,31.02.2024,express,7.0,x,2023-12-22 10:00:00.5,3",
    "PX16,01.03.2024,Standard,1e2,x,2023-12-22 10:00:00.5,+3",
]
ERRORS = {
    "P1": "Parcel No: min_length=4 violated | weight kg: value is required | pieces: must be non-zero | "
    'scanned: invalid datetime: "yesterday" | due: invalid date: "2023-12-24" | lane: value "slow" not in allowed_values',
    "PX12": "lane: missing value excluded by rule",
    "PX13": "weight kg: value is required | scanned: value is required | lane: missing value excluded by rule",
    "PX15": 'due: invalid date: "31.02.2024"',
}


def text_frame(spark, header, rows):
    return spark.createDataFrame([tuple((r + [None] * len(header))[: len(header)]) for r in rows], ", ".join(f"`{h}` string" for h in header))


def one(spark, rule, texts):
    """Value or message of every text under one rule."""
    rules = parse_rules({"fields": [{"name": "x", **rule}]})
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    checked = validate(frame, rules, keep=["i"]).checked
    value = checks.value(rules, 0)
    shown = {"date": value.cast("string"), "datetime": F.unix_micros(value) if rule["type"] == "datetime" else value}
    rows = checked.select(
        "i", "__ok", shown.get(rule["type"], value).alias("v"), checks.listed_errors(rules)[0]["msg"].alias("m")
    ).collect()
    return [(r.m if not r["__ok"] else r.v) for r in sorted(rows, key=lambda r: r.i)]


def test_golden_rows(spark):
    gate = validate(text_frame(spark, HEADER, [r.split(",") for r in ROWS]), parse_rules(DOCUMENT))
    assert {r["Parcel No"]: r["__errors"] for r in gate.invalid().collect()} == ERRORS
    valid = {r.parcel_no: r for r in gate.valid().collect()}
    assert valid["PX10"].asDict() == {
        "parcel_no": "PX10", "weight": 2.5, "pieces": 3, "scanned": dt.datetime(2023, 12, 20, 8, 15),
        "due": dt.date(2023, 12, 24), "lane": "express", "scanner": "gate-7", "remark": "fragile",
    }
    assert valid["PX14"].due is None and valid["PX14"].pieces == 1 and valid["PX14"].weight == 0.75
    assert valid["PX14"].scanned == dt.datetime(2023, 12, 21, 8) and valid["PX14"].remark == "none given"
    assert valid["PX16"].pieces == 100 and valid["PX16"].lane == "standard"
    assert valid["PX16"].scanned == dt.datetime(2023, 12, 22, 10, 0, 0, 500000)
    assert gate.stats().first().asDict() == {"total_rows": 7, "valid_rows": 3, "invalid_rows": 4}
    profile = {(r.field, r.msg): r.n for r in gate.error_profile().collect()}
    assert profile[("lane", "missing value excluded by rule")] == 2 and sum(profile.values()) == 11


def test_nullability(spark):
    gate = validate(text_frame(spark, HEADER, []), parse_rules(DOCUMENT))
    required = [f.name for f in gate.valid().schema if not f.nullable]
    assert required == ["parcel_no", "weight", "scanned"]


INF = float("inf")
NUMBERS = {
    "5.0": (5.0, 5), "+5": (5.0, 5), "1e3": (1000.0, 1000), "2.5": (2.5, 'invalid int (fractional): "2.5"'),
    ".5": (0.5, 'invalid int (fractional): ".5"'), "5.": (5.0, 5), "1d": ('invalid float: "1d"', 'invalid int: "1d"'),
    "12.5.1": ('invalid float: "12.5.1"', 'invalid int: "12.5.1"'), "1e400": ('invalid float: "1e400"', 'invalid int: "1e400"'),
    "inf": (INF, 'invalid int (fractional): "inf"'), "-Infinity": (-INF, 'invalid int (fractional): "-Infinity"'),
    "infinit": ('invalid float: "infinit"', 'invalid int: "infinit"'), "+nan": ('invalid float: "+nan"', 'invalid int: "+nan"'),
    "9007199254740993.0": (9007199254740992.0, 9007199254740992), "9223372036854775807": (9223372036854775807.0, 2**63 - 1),
    "9223372036854775808": (9223372036854775808.0, 'invalid int: "9223372036854775808"'),
    "-9223372036854775808": (-9223372036854775808.0, -(2**63)), "0x1.8p1": (3.0, 3), "0x10": ('invalid float: "0x10"', 'invalid int: "0x10"'),
    "1_000": (1000.0, 1000), "1__0": ('invalid float: "1__0"', 'invalid int: "1__0"'), "_1": ('invalid float: "_1"', 'invalid int: "_1"'),
    "1_": ('invalid float: "1_"', 'invalid int: "1_"'), "1_.5": ('invalid float: "1_.5"', 'invalid int: "1_.5"'),
    "0x_1p0": (1.0, 1), "1e1_0": (1e10, 10**10), "-0.0": (-0.0, 0), "00012": (12.0, 12), "1 2": ('invalid float: "1 2"', 'invalid int: "1 2"'),
    "\x015": ('invalid float: "\\x015"', 'invalid int: "\\x015"'), "٣": ('invalid float: "٣"', 'invalid int: "٣"'),
    " N/A ": (None, None), "NULL": (None, None), "\u3000": (None, None),
}


def test_numbers(spark):
    assert one(spark, {"type": "float"}, list(NUMBERS)) == [f for f, _ in NUMBERS.values()]
    assert one(spark, {"type": "int"}, list(NUMBERS)) == [i for _, i in NUMBERS.values()]
    assert one(spark, {"type": "int", "non_zero": True}, ["0", "0.0", "-0", "1"]) == ["must be non-zero"] * 3 + [1]
    assert one(spark, {"type": "float", "non_zero": True}, ["0"]) == [0.0]
    assert math.isnan(one(spark, {"type": "float", "default": "nan"}, [""])[0])
    long_digits = "1" * 20000
    assert one(spark, {"type": "int"}, [long_digits]) == [f'invalid int: "{long_digits}"']


def micros(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp()) * 1000000


def test_default_layouts(spark):
    texts = [
        "2024-02-29", "2024-02-29 23:59:59", "2024-02-29T23:30:00-05:00", "2024-02-29T01:02:03.1234569Z", "2023-02-29",
        "2024-2-9", "2024-01-01 24:00:00", "2024-01-01 9:05:07,5", "2024-01-01   09:05:07", "2024-01-01 09:05:60",
        "2024-01-01T00:00:00+24:60", "2024-01-01T00:00:00+25:00", "\x012024-01-01",
    ]
    dates = one(spark, {"type": "date"}, texts)
    bad = [f'invalid date: "{t}"' for t in texts]
    assert dates == [
        "2024-02-29", "2024-02-29", "2024-02-29", "2024-02-29", bad[4], bad[5], bad[6], "2024-01-01", "2024-01-01", bad[9],
        "2024-01-01", bad[11], 'invalid date: "\\x012024-01-01"',
    ]
    times = one(spark, {"type": "datetime"}, texts)
    bad = [f'invalid datetime: "{t}"' for t in texts]
    assert times == [
        bad[0], micros(2024, 2, 29, 23, 59, 59), micros(2024, 3, 1, 4, 30), micros(2024, 2, 29, 1, 2, 3) + 123456, bad[4],
        bad[5], bad[6], micros(2024, 1, 1, 9, 5, 7) + 500000, micros(2024, 1, 1, 9, 5, 7), bad[9],
        micros(2024, 1, 1) - 25 * 3600 * 1000000, bad[11], 'invalid datetime: "\\x012024-01-01"',
    ]


@pytest.mark.parametrize(
    "layouts, text, expected",
    [
        (["02/01/2006"], "31/12/2024", (2024, 12, 31)),
        (["2/1/06"], "3/4/69", (1969, 4, 3)),
        (["2/1/06"], "3/4/68", (2068, 4, 3)),
        (["Jan 2, 2006 3:04PM"], "feb 29, 2024 12:05AM", (2024, 2, 29, 0, 5)),
        (["January 2 2006 3:04 pm"], "MARCH 1 2024 1:05 pm", (2024, 3, 1, 13, 5)),
        (["Mon, 02 Jan 2006 15:04:05 -0700"], "Tue, 05 Mar 2024 10:00:00 +0530", (2024, 3, 5, 4, 30)),
        (["20060102150405"], "20240305101112", (2024, 3, 5, 10, 11, 12)),
        (["2006-01-02 15:04:05.000"], "2024-03-05 10:11:12.000", (2024, 3, 5, 10, 11, 12)),
        (["2006-01-02 15:04:05.000"], "2024-03-05 10:11:12.00", None),
        (["2006-01-02", "2006-02-01"], "2024-31-12", (2024, 12, 31)),
        (["06-01-02", "02-01-06"], "05-04-31", (2031, 4, 5)),
        (["2006.01.02"], "2024x01x02", None),
        (["1504 2006-01-02"], "904 2024-01-02", None),
        (["2006-01-02Z07"], "2024-01-02-03", (2024, 1, 2, 3)),
    ],
)
def test_layouts(spark, layouts, text, expected):
    found = one(spark, {"type": "datetime", "datetime_formats": layouts}, [text])[0]
    assert found == (micros(*expected) if expected else f'invalid datetime: "{text}"')


def test_text_rules(spark):
    assert one(spark, {"type": "string", "min_length": 2}, ["é", "e"]) == ["é", "min_length=2 violated"]
    assert one(spark, {"type": "string", "min_length": 3}, ["é"]) == ["min_length=3 violated"]
    rule = {"type": "string", "lower": True, "inline_replace": {" Pend ": " OPEN ", "gone": "n/a"}, "default": "Dflt"}
    assert one(spark, rule, ["PEND", "Gone", "ΑΣ", "İ", None]) == ["open", "dflt", "ας".replace("ς", "σ"), "i", "dflt"]
    rule = {"type": "string", "required": True, "override": " x "}
    assert one(spark, rule, ["a"]) == [" x "]
    assert one(spark, {"type": "int", "default": "x"}, ["", "1"]) == ['invalid int: "x"', 1]
    assert one(spark, {"type": "string", "required": True, "override": " none "}, ["a"]) == ["value is required"]


def test_large_replacement_map(spark):
    """Many replacements go through a join and give what the map literal gives."""
    entries = {f"from {n}": f" to {n} " for n in range(200)}
    texts = [f" FROM {n} " for n in range(210)] + [None, "n/a"]
    expected = [f"to {n}" for n in range(200)] + [f"from {n}" for n in range(200, 210)] + ["none given"] * 2
    rule = {"type": "string", "lower": True, "inline_replace": entries, "default": "None given"}
    assert one(spark, rule, texts) == expected


@pytest.mark.parametrize("count", [1, 2, 7, 5_000])
def test_lookups_at_any_size(spark, count):
    texts = [f'v"{n}\\ é漢🙂' for n in range(count)]
    rows = spark.createDataFrame([(t,) for t in [*texts[:50], "v", "", None, texts[-1], texts[-1].upper()]], "t string")
    found = rows.select("t", is_among(F.col("t"), texts).alias("known"), looked_up(F.col("t"), {t: f"{t}!" for t in texts}).alias("to")).collect()
    for t, known, to in found:
        assert known == (None if t is None else t in texts) and to == (f"{t}!" if t in texts else None)


def test_header_check(spark):
    frame = spark.createDataFrame([("1",)], "a string")
    rules = parse_rules({"fields": [{"name": "b", "type": "int", "default": 1}]})
    with pytest.raises(HeaderError, match='required schema field "b" not found in CSV header'):
        validate(frame, rules)
    optional = parse_rules({"fields": [{"name": "b", "type": "int"}, {"name": "c", "type": "int", "exclude_if_missing": True}]})
    assert validate(frame, optional).invalid("a").first()["__errors"] == "c: missing value excluded by rule"


def test_text_functions(spark):
    samples = {
        'a"b\\c': '"a\\"b\\\\c"', "x\n\t\r\a\b\f\v\x00\x7f": '"x\\n\\t\\r\\a\\b\\f\\v\\x00\\x7f"', "é😀中": '"é😀中"',
        "\u200b\u00a0\ufeff\U000e0001": '"\\u200b\\u00a0\\ufeff\\U000e0001"', "": '""', " ": '" "',
    }
    frame = spark.createDataFrame([(k,) for k in samples], "t string")
    assert {r.t: r.q for r in frame.select("t", quote_text(F.col("t")).alias("q")).collect()} == samples
    words = spark.createDataFrame([("  NaN\u2003",), ("nano",), ("N/a",), ("\x85",), ("none.",)], "t string")
    assert [r[0] for r in words.select(is_missing(F.col("t"))).collect()] == [True, False, True, True, False]
    names = spark.createDataFrame([(" A - B/C.d ",)], "t string")
    assert names.select(snake_case(F.col("t")), trim_cell(F.col("t")), lower_text(F.col("t"))).first() == (
        "a_b_c_d", "A - B/C.d", " a - b/c.d ",
    )


def random_cell(rng):
    pieces = ["", " ", "1", "0", "-", "+", ".", "e", "5", "_", "inf", "nan", "N/A", "none", "a", "É", "ok", "2024-02-29", "2023-02-30",
              "2024-01-0", " 10:00:00", "\t", "\u3000", "99999999999999999999"]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 4)))


@pytest.mark.parametrize(
    "rule",
    [
        {"type": "float"},
        {"type": "int", "required": True, "non_zero": True},
        {"type": "string", "lower": True, "min_length": 2, "exclude_if_missing": True},
        {"type": "string", "allowed_values": ["ok", "1", "a"], "default": "ok"},
        {"type": "date", "required": True, "date_formats": ["2006-01-02", "2006-01-02 15:04:05"]},
    ],
    ids=lambda r: r["type"],
)
def test_random_cells(spark, rule):
    rng = random.Random(str(rule))
    cells = [random_cell(rng) for _ in range(1500)]
    for cell, found in zip(cells, one(spark, rule, cells)):
        value, message = evaluate(rule, cell)
        if message is None:
            expected = str(value) if rule["type"] == "date" and value else value
        else:
            expected = message.replace("\t", "\\t").replace("\u3000", "\\u3000")
        same = found == expected or (isinstance(found, float) and math.isnan(found) and math.isnan(expected))
        assert same, (rule, cell, found, expected)


def plan(frame):
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def test_plan_has_no_python_and_no_shuffle(spark):
    gate = validate(text_frame(spark, HEADER, []), parse_rules(DOCUMENT))
    for side in (gate.valid(), gate.invalid(), gate.error_rows("remark")):
        text = plan(side)
        assert "EvalPython" not in text and "MapIn" not in text and "Exchange" not in text and "Window" not in text


def test_generated_code_stays_compilable(spark):
    """Every generated method stays below the size the JVM compiles, here for 32 rules."""
    import re

    wide = [{**f, "name": f"{f['name']}{n}", "parquet_name": f"c{n}_{i}"} for n in range(4) for i, f in enumerate(DOCUMENT["fields"])]
    header = [f["name"] for f in wide]
    source = spark.range(1).select(*[F.col("id").cast("string").alias(h) for h in header])
    frame = validate(source, parse_rules({"fields": wide}), keep=[]).valid()
    text = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000, sizes


def test_groups_are_cut_by_code(spark):
    """Datetimes are several times the code of a text: with four rules in a group their code was not compiled."""
    import re

    from catalog.inputs import EVENT_RULES

    moments = {"fields": [{"name": f"at{n}", "type": "datetime", "required": n % 2 == 0} for n in range(8)]}
    for document in (EVENT_RULES, moments):
        rules = parse_rules(document)
        starts = checks.group_starts(rules)
        assert starts[0] == 0 and list(starts) == sorted(set(starts)) and len(starts) > len(rules.fields) // 4
        names = [r.name for r in rules.fields]
        cells = F.struct(*[F.col("id").cast("string").alias(f"c{i}") for i in range(len(names))])
        source = spark.range(1).select(F.col("id").cast("string").alias("key_file"), cells.alias("cells"))
        at = {name: F.col(f"cells.c{i}") for i, name in enumerate(names)}
        frame = validate(source, rules, keep=["key_file", "cells"], cells=at).staged("key_file", rejected_only=("cells",))
        text = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
        assert sizes and max(sizes) < 8000, sizes


# -- predicates ------------------------------------------------------------------------------------

SHIPMENTS = {
    "fields": [
        {"name": "no", "type": "int", "required": True, "check": "no BETWEEN 1 AND 99"},
        {"name": "sent", "type": "date", "check": "sent <= due"},
        {"name": "due", "type": "date"},
        {"name": "net", "type": "float", "check": "net <= gross AND cell_text.net NOT LIKE '%e%'"},
        {"name": "gross", "type": "float"},
        {"name": "un stable", "parquet_name": "un.stable", "type": "string", "check": "`un.stable` <> 'no' OR gross > 1"},
    ]
}


def test_predicates_judge_the_typed_row(spark):
    rows = [
        ("1", "2024-01-02", "2024-01-03", "1", "2", "yes"),
        ("100", "2024-01-04", "2024-01-03", "3", "2", "no"),  # several fail, in rule order
        ("x", "2024-01-04", "soon", "1e0", "0.5", "no"),  # a message of the cell comes before the predicate's
        ("5", None, "2024-01-03", "1", None, None),  # unknown answers pass
        ("0", "", "", "", "", ""),
    ]
    frame = text_frame(spark, ["no", "sent", "due", "net", "gross", "un stable"], [list(r) for r in rows])
    frame = frame.withColumn("a.b", F.monotonically_increasing_id()).withColumn("net kept", F.lit("k"))
    gate = validate(frame, parse_rules(SHIPMENTS), keep=["a.b", "net kept", "no"])
    assert [r.no for r in gate.valid("net kept").orderBy("no").collect()] == [1, 5]
    assert gate.valid().schema == parse_rules(SHIPMENTS).schema
    found = {r["no"]: r["__errors"] for r in gate.invalid("no").collect()}
    assert found == {
        "100": "no: check failed: no BETWEEN 1 AND 99 | sent: check failed: sent <= due | "
        "net: check failed: net <= gross AND cell_text.net NOT LIKE '%e%'",
        "x": 'no: invalid int: "x" | due: invalid date: "soon" | '
        "net: check failed: net <= gross AND cell_text.net NOT LIKE '%e%' | un stable: check failed: `un.stable` <> 'no' OR gross > 1",
        "0": "no: check failed: no BETWEEN 1 AND 99",
    }
    assert gate.stats().first().asDict() == {"total_rows": 5, "valid_rows": 2, "invalid_rows": 3}
    assert gate.error_profile().where("field = 'no'").agg(F.sum("n")).first()[0] == 3
    staged = gate.staged("no")
    assert staged.where("__ok").count() == 2 and staged.where("__errors IS NOT NULL").count() == 3
    assert validate(frame.limit(0), parse_rules(SHIPMENTS)).invalid().count() == 0


def test_predicates_over_many_groups_of_rules(spark):
    names = [f"f{i}" for i in range(30)]
    document = [{"name": n, "type": "int", "check": f"{n} >= f{max(i - 1, 0)}"} for i, n in enumerate(names)]
    rows = [[str(i) for i in range(30)], [str(50 if i in (4, 20) else i) for i in range(30)]]
    gate = validate(text_frame(spark, names, rows), parse_rules({"fields": document}), keep=[])
    assert gate.valid().count() == 1
    assert gate.invalid().first()[0] == "f5: check failed: f5 >= f4 | f21: check failed: f21 >= f20"


@pytest.mark.parametrize(
    "check, reason",
    [
        ("a >", "PARSE_SYNTAX_ERROR"),
        ("b = 1", "UNRESOLVED_COLUMN"),
        ("__ok", "UNRESOLVED_COLUMN"),
        ("a + 1", "DATATYPE_MISMATCH"),
        ("a = date'2024-01-01'", "DATATYPE_MISMATCH"),
        ("sum(a) > 1", "INVALID_WHERE_CONDITION|MISSING_GROUP_BY|aggregate"),
        ("row_number() OVER (ORDER BY a) = 1", "INVALID_WHERE_CONDITION|window"),
        ("explode(array(true))", "GENERATOR|generator"),
        ("rand() < 0.5", "it is not deterministic"),
        ("a IN (SELECT 1)", "it holds a subquery"),
    ],
)
def test_unusable_predicates_end_before_any_job(spark, check, reason):
    rules = parse_rules({"fields": [{"name": "a", "type": "int", "check": check}]})
    with pytest.raises(RuleError, match=f'field "a" has an unusable check: .*({reason})'):
        validate(text_frame(spark, ["a"], [["1"]]), rules)


def test_names_reserved_by_predicates(spark):
    for name in ("cell_text", "__ROW"):
        rules = parse_rules({"fields": [{"name": "a", "parquet_name": name, "type": "int", "check": "true"}]})
        with pytest.raises(RuleError, match="is reserved"):
            checks.check_predicates(spark, rules)
    with pytest.raises(RuleError, match='property "check" has the wrong JSON type'):
        parse_rules({"fields": [{"name": "a", "type": "int", "check": ["x"]}]})
    assert parse_rules({"fields": [{"name": "a", "type": "int", "check": "  "}]}).fields[0].check is None


def test_job_with_an_unusable_predicate_writes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("a\n1\n-1\n")
    document = tmp_path / "rules.json"
    document.write_text('{"fields": [{"name": "a", "type": "int", "check": "nowhere > 1"}]}')
    places = [str(tmp_path / "good"), str(tmp_path / "bad")]
    with pytest.raises(RuleError, match="unusable check"):
        validate_directory(spark, str(tmp_path / "in"), str(document), *places)
    assert not (tmp_path / "good").exists() and not (tmp_path / "bad").exists()
    document.write_text('{"fields": [{"name": "a", "type": "int", "check": "a > 0"}]}')
    validate_directory(spark, str(tmp_path / "in"), str(document), *places)
    assert [r.a for r in spark.read.parquet(f"{places[0]}/source_file=a").collect()] == [1]
    assert "a: check failed: a > 0" in "".join(p.read_text() for p in (tmp_path / "bad").rglob("part-*"))
