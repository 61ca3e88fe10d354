"""Rule documents: naming, literal text, error texts."""

import json

import pytest

from rulegate.rules import RuleError, literal_text, load_rules, parse_rules, snake_name


def fields(*rules):
    return parse_rules({"fields": list(rules)})


@pytest.mark.parametrize(
    "document, message",
    [
        ({}, "schema.fields cannot be empty"),
        ({"fields": []}, "schema.fields cannot be empty"),
        ({"fields": [{"name": "  ", "type": "int"}]}, "field name cannot be empty"),
        ({"fields": [{"name": "A", "type": "int"}, {"name": " A ", "type": "int"}]}, "duplicate schema field name: A"),
        ({"fields": [{"name": "A B", "type": "int"}, {"name": "a-b", "type": "int"}]}, "duplicate parquet_name: a_b"),
        ({"fields": [{"name": "X", "type": "decimal"}]}, 'field "X" has unsupported type "decimal"'),
        (
            {"fields": [{"name": "X", "type": "string", "inline_replace": {"  ": "a"}}]},
            'field "X" has empty inline_replace key',
        ),
        (
            {"fields": [{"name": "X", "type": "string", "lower": True, "inline_replace": {"a": "1", "A": "2"}}]},
            'field "X" has colliding inline_replace key "a"',
        ),
        ({"fields": [{"name": "X", "type": "int", "required": "yes"}]}, 'property "required" has the wrong JSON type'),
        ({"fields": [{"name": "X", "type": "int", "min_length": True}]}, 'property "min_length" has the wrong JSON type'),
        ({"fields": [{"name": "X", "type": "date", "date_formats": ["2006 MST"]}]}, "unsupported element MST"),
    ],
)
def test_bad_documents(document, message):
    with pytest.raises(RuleError, match=message.replace("[", r"\[").replace("(", r"\(")):
        parse_rules(document)


def test_names():
    assert snake_name("Member Number") == "member_number"
    assert snake_name("A - B/C.d") == "a_b_c_d"
    rules = fields({"name": " Member Number ", "type": " INT "}, {"name": "x", "parquet_name": " y ", "type": "string"})
    assert [(r.name, r.output, r.type) for r in rules.fields] == [("Member Number", "member_number", "int"), ("x", "y", "string")]


@pytest.mark.parametrize(
    "value, text",
    [
        (0.0, "0"), (-0.0, "-0"), (5, "5"), (2.5, "2.5"), (1000000, "1e+06"), (100000, "100000"), (123456789, "1.23456789e+08"),
        (0.0001, "0.0001"), (0.00001, "1e-05"), (-1.25, "-1.25"), (1e21, "1e+21"), (True, "true"), (False, "false"),
        (" kept ", " kept "), (["a", 1], "[a 1]"), ({"b": 1, "a": None}, "map[a:<nil> b:1]"),
    ],
)
def test_literal_text(value, text):
    assert literal_text(value) == text


def test_property_names_in_any_case_and_null_is_absent():
    rule = fields({"Name": "a", "TYPE": "string", "Required": True, "default": None, "allowed_values": None}).fields[0]
    assert rule.required and rule.default is None and rule.allowed == ()


def test_schema():
    rules = fields(
        {"name": "a", "type": "string", "required": True},
        {"name": "b", "type": "float"},
        {"name": "c", "type": "int"},
        {"name": "d", "type": "date"},
        {"name": "e", "type": "datetime", "required": True},
    )
    assert rules.schema.simpleString() == "struct<a:string,b:double,c:bigint,d:date,e:timestamp>"
    assert [f.nullable for f in rules.schema] == [False, True, True, True, False]


def test_load(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"fields": [{"name": "a", "type": "int"}]}))
    assert load_rules(str(path)).fields[0].name == "a"
    path.write_text("{")
    with pytest.raises(RuleError, match="failed loading schema"):
        load_rules(str(path))
    path.write_text("{}")
    with pytest.raises(RuleError, match="invalid schema: schema.fields cannot be empty"):
        load_rules(str(path))
