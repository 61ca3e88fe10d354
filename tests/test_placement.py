"""Rows dealt to tasks by plan, and error files written in one job whatever their headers."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from rulegate.operators import placement
from rulegate.operators.numbering import running_total
from rulegate.operators.placement import placed_rows, task_plan
from rulegate.operators.sinks import csv_line
from rulegate.plans.workflows import DirectoryError, split_csv, validate_directory
from rulegate.rules import parse_rules
from tests.test_csv_files import RULES, write


def test_running_total(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), (F.col("id") % 13).alias("w")).repartition(6)
    found = running_total(rows, ["v"], "w", "before").orderBy("v").collect()
    total = 0
    for r in found:
        assert r["before"] == total
        total += r["w"]


def test_small_keys_are_whole_and_large_ones_cut_in_order(spark):
    rows = [(f"k{k:02d}", "p", b, 30) for k in range(20) for b in range(3)] + [("k05x", "p", b, 100) for b in range(12)]
    frame = spark.createDataFrame(rows, "key string, path string, block bigint, bytes bigint")
    plan = task_plan(frame, "key", [F.col("path"), F.col("block")], 300).orderBy("key", "block").collect()
    tasks = {}
    for r in plan:
        tasks.setdefault(r.key, []).append(r.task)
    assert all(len(set(v)) == 1 for k, v in tasks.items() if k != "k05x")
    assert tasks["k05x"] == sorted(tasks["k05x"]) and len(set(tasks["k05x"])) >= 4
    assert [t for k in sorted(tasks) for t in tasks[k]] == sorted(t for v in tasks.values() for t in v)


def test_hot_key_of_a_split(spark, tmp_path, monkeypatch):
    """A key with a third of the rows has several parts in input order; no other key is cut."""
    monkeypatch.setattr(placement, "TASK_BYTES", 4_000)
    monkeypatch.setattr(placement, "LEAST_BYTES", 1_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = [f"{'hot' if n % 3 else f'k{n % 40}'},{n}" for n in range(6_000)]
        source = write(tmp_path, {"in.csv": "k,n\n" + "\n".join(lines) + "\n"}) + "/in.csv"
        summary = split_csv(spark, source, f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (summary.total_rows, summary.output_files) == (6_000, 41)
    parts = {}
    for path in sorted(glob.glob(f"{tmp_path}/out/key_file=*/part-*")):
        with open(path, newline="") as handle:
            parts.setdefault(path.split("/")[-2], []).append(list(csv.reader(handle)))
    assert all(len(v) == 1 for k, v in parts.items() if k != "key_file=hot") and len(parts["key_file=hot"]) > 3
    for key, found in parts.items():
        assert all(rows[0] == ["k", "n"] for rows in found)
        numbers = [int(r[1]) for rows in found for r in rows[1:]]
        assert numbers == sorted(numbers) and len(numbers) == sum(f"key_file={x.split(',')[0]}" == key for x in lines)


def test_placed_rows_of_nothing(spark):
    rows = spark.createDataFrame([], "k string, path string, block bigint")
    found, plan, tasks = placed_rows(rows, rows.withColumn("bytes", F.lit(1)), "k", ["path", "block"], [F.col("path"), F.col("block")])
    assert (found.count(), plan.count(), tasks) == (0, 0, 1)


def test_csv_line(spark):
    cells = ["a", None, "", 'q"q', "c,d", "two\nlines", " s ", "\r"]
    line = spark.range(1).select(csv_line([F.lit(7)], F.array(*[F.lit(c) for c in cells]))).first()[0]
    assert next(csv.reader([line], strict=True)) is not None
    import io

    assert list(csv.reader(io.StringIO(line, newline="")))[0] == ["7", *[c or "" for c in cells]]


def test_parts_of_one_source_with_different_headers(spark, tmp_path):
    files = {
        "a.csv/part-0": "id,q\n1,x\n2,2\n",
        "a.csv/part-1": "q,id,id\ny,0,3\n4,0,4\n",
        "b.csv": 'id,q,"no, te"\n5,z,"t ""u"""\n6,z\n',
        "c.csv": "id,q\n7,7\n",
    }
    folder = write(tmp_path / "in", files)
    result = validate_directory(spark, folder, RULES, f"{tmp_path}/ok", f"{tmp_path}/bad", write_empty_error=True)
    assert (result.summary.total_rows, result.summary.invalid_rows) == (7, 4)
    found = {}
    for path in glob.glob(f"{tmp_path}/bad/source_file=*/part-*"):
        with open(path, newline="") as handle:
            found.setdefault(path.split("=")[1].split("/")[0], []).append(list(csv.reader(handle)))
    lead = ["__row_number", "__errors"]
    assert sorted(found["a"]) == sorted([
        [[*lead, "id", "q"], ["2", 'q: invalid int: "x"', "1", "x"]],
        [[*lead, "q", "id", "id"], ["4", 'q: invalid int: "y"', "y", "0", "3"]],
    ])
    assert found["b"] == [[[*lead, "id", "q", "no, te"], ["2", 'q: invalid int: "z"', "5", "z", 't "u"'], ["3", 'q: invalid int: "z"', "6", "z", ""]]]
    assert found["c"] == [[[*lead, "id", "q"]]]


@pytest.mark.parametrize("files", [{"a.csv": "id,z\n1,2\n"}, {"a.csv": "id,z\n1,2\n", "b.csv": ""}, {"a.csv": 'id,q\n1"2,3\n'}, {"a.csv": ""}])
def test_folder_without_a_sound_file(spark, tmp_path, files):
    folder = write(tmp_path / "in", files)
    with pytest.raises(DirectoryError) as caught:
        validate_directory(spark, folder, RULES, f"{tmp_path}/ok", f"{tmp_path}/bad", write_empty_error=True)
    summary = caught.value.result.summary
    assert (summary.files, summary.failed_files, summary.total_rows) == (len(files), len(files), 0)
    assert spark.read.parquet(f"{tmp_path}/ok/_sources").count() == 0


def test_a_failed_validation_leaves_old_outputs(spark, tmp_path, monkeypatch):
    folder = write(tmp_path / "in", {"a.csv": "id,q\n1,2\n"})
    validate_directory(spark, folder, RULES, f"{tmp_path}/ok", f"{tmp_path}/bad")
    monkeypatch.setattr("rulegate.plans.workflows._write_directory_errors", lambda *a: 1 / 0)
    write(tmp_path / "in", {"b.csv": "id,q\n3,4\n"})
    with pytest.raises(ZeroDivisionError):
        validate_directory(spark, folder, RULES, f"{tmp_path}/ok", f"{tmp_path}/bad")
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 1 and not glob.glob(f"{tmp_path}/*staging*")


def test_rules_without_columns_of_the_folder(spark, tmp_path):
    """Optional columns that no file has are NULL; they are no reason to fail."""
    rules = parse_rules({"fields": [{"name": "id", "type": "int"}, {"name": "gone", "type": "string"}]})
    folder = write(tmp_path / "in", {"a.csv": "id,z\n1,2\n"})
    validate_directory(spark, folder, rules, f"{tmp_path}/ok", f"{tmp_path}/bad")
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{tmp_path}/ok").collect()] == [(1, None)]
