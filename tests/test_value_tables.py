"""Value sets in tables give what the same sets in a rule document give, without passing through the driver."""

from __future__ import annotations

import pytest

from rulegate.operators import value_tables
from rulegate.operators.validate import validate
from rulegate.operators.value_tables import ValueTables
from rulegate.rules import RuleError, parse_rules

REPLACE = {" Ab ": "Cd", "ef": " N/A ", "x": "ab"}
ALLOWED = ["cd", " AB ", "gh"]
CELLS = ["ab", " AB", "cd", "ef", "x", "gh", " gh", "no", None, "", "nan"]


def outcome(gate):
    valid = [(r.n, r.a, r.b, None) for r in gate.valid("n").collect()]
    return sorted(valid + [(r.n, None, None, r["__errors"]) for r in gate.invalid("n").collect()])


@pytest.mark.parametrize("limit", [None, 0])  # broadcast, then shuffled
@pytest.mark.parametrize("lower", [True, False])
def test_tables_equal_inline_sets(spark, monkeypatch, lower, limit):
    if limit is not None:
        monkeypatch.setattr(value_tables, "small_side", lambda df, rows, row_bytes: df)
    rows = spark.createDataFrame(list(enumerate(CELLS)), "n int, a string").selectExpr("n", "a", "a AS b")
    rule = {"name": "a", "type": "string", "lower": lower, "default": "no"}
    other = {"name": "b", "type": "string", "allowed_values": ["ab", "gh"]}
    inline = parse_rules({"fields": [{**rule, "inline_replace": REPLACE, "allowed_values": ALLOWED}, other]})
    sets = ValueTables(
        spark.createDataFrame(list(REPLACE.items()), "source string, target string"),
        spark.createDataFrame([(v,) for v in [*ALLOWED, ALLOWED[0]]], "value string"),
    )
    by_table = validate(rows, parse_rules({"fields": [rule, other]}), tables={"a": sets})
    assert outcome(by_table) == outcome(validate(rows, inline))


@pytest.mark.parametrize("entries, message", [([("a", "b"), (" A", "c")], "colliding"), ([(" ", "b")], "empty"), ([(None, "b")], "empty")])
def test_bad_tables(spark, entries, message):
    rules = parse_rules({"fields": [{"name": "a", "type": "string", "lower": True}]})
    table = spark.createDataFrame(entries, "source string, target string")
    with pytest.raises(RuleError, match=message):
        validate(spark.createDataFrame([("a",)], "a string"), rules, tables={"a": ValueTables(table)})


def test_nothing_of_the_size_of_the_table_is_collected(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    from catalog.spark_queries import QUERIES

    names = spark.range(500).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name")
    names.write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("rows went to the driver"))
    checked = QUERIES["rule_many_values"](spark, str(tmp_path))
    monkeypatch.undo()
    assert checked.where("value LIKE 'replaced%'").count() == 50
