"""Inputs that differ between scans, odd file names, very wide records, and runs on top of earlier ones."""

import os

import pytest
from pyspark.sql import functions as F

from rulegate import session
from rulegate.operators.batch import batch_directory
from rulegate.plans.workflows import DirectoryError, auto, validate_csv, validate_directory
from rulegate.rules import parse_rules
from rulegate.sources.csv_files import first_cells, read_csv_file
from rulegate.streaming.gate import gate_batch
from rulegate.sources.csv_files import read_lines

RULES = parse_rules({"fields": [{"name": "k", "type": "string"}, {"name": "n", "type": "int", "required": True}]})


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


@pytest.fixture
def parallelism(spark):
    """Sets how many splits later scans aim for."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")}

    def put(n):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_do_not_depend_on_later_scans(spark, tmp_path, parallelism, parts):
    lines = [f"a,{i if i % 10 else 'x'}" for i in range(1, 3001)]
    size = -(-len(lines) // parts)
    files = {f"in.csv/part-{p:05d}.csv": "k,n\n" + "\n".join(lines[p * size : (p + 1) * size]) + "\n" for p in range(parts)}
    source = write(tmp_path, files) + "/in.csv"
    parallelism(2)
    files = read_csv_file(spark, source)
    rows, cells = files.table(RULES)
    files.blocks
    parallelism(13)
    found = files.with_row_numbers(rows.select("path", "block", "id", cells["n"].alias("n"))).collect()
    assert sorted((r["__row_number"], r["n"]) for r in found) == [(i + 1, line[2:]) for i, line in enumerate(lines, 1)]


def test_parts_are_ordered_by_number(spark, tmp_path):
    source = write(tmp_path, {f"in.csv/part-{n}.csv": f"k,n\na,{v}\na,{v + 1}\n" for n, v in ((99999, 1), (100000, 3), (100001, 5))}) + "/in.csv"
    files = read_csv_file(spark, source)
    rows, cells = files.table(RULES)
    found = files.with_row_numbers(rows.select("path", "block", "id", cells["n"].cast("int").alias("n"))).collect()
    assert sorted((r["__row_number"], r["n"]) for r in found) == [(i + 1, i) for i in range(1, 7)]
    out = {f"{name}_dir": str(tmp_path / name) for name in ("split", "success", "error", "batch_export")}
    auto(spark, source, RULES, **out)
    assert [r["n"] for r in spark.read.parquet(out["batch_export_dir"]).collect()] == list(range(1, 7))


def test_surplus_cells_are_cut(spark, tmp_path):
    assert spark.range(1).select(first_cells(F.lit('"a,""b",c,"d,e",f'), 3)).first()[0] == '"a,""b",c,"d,e"'
    wide = "k,n\n" + "a,1" + ",x" * 30_000 + "\n" + '"a,b",2' + ',"y,z"' * 25_000 + "\n"
    source = write(tmp_path, {"in.csv": wide}) + "/in.csv"
    stats = validate_csv(spark, source, RULES, str(tmp_path / "ok"), str(tmp_path / "bad")).stats
    assert (stats.total_rows, stats.valid_rows) == (2, 2)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "ok/in.parquet")).collect()} == {("a", 1), ("a,b", 2)}


def test_no_file_of_a_folder_is_passed_over(spark, tmp_path):
    good, lacking, torn = "k,n\na,1\nb,x\n", "k\na\n", 'k,n\nb"a,1\n'
    folder = write(tmp_path / "in", {"a.csv": good, "_b.csv": good, ".c.CSV": good, "empty.csv": "", "lacking.csv": lacking, "torn.csv": torn})
    with pytest.raises(DirectoryError, match="5 failed") as error:
        validate_directory(spark, folder, RULES, str(tmp_path / "ok"), str(tmp_path / "bad"))
    summary = error.value.result.summary
    assert (summary.files, summary.failed_files, summary.total_rows, summary.valid_rows) == (6, 5, 2, 1)
    assert [tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [("a", 1)]
    with pytest.raises(Exception, match="names starting with"):
        validate_csv(spark, f"{folder}/_b.csv", RULES, str(tmp_path / "ok2"), str(tmp_path / "bad2"))


def test_one_meaning_of_clear(spark, tmp_path):
    source = write(tmp_path, {"in.csv": "k,n\na,1\nb,2\nc,x\n"}) + "/in.csv"
    out = {f"{name}_dir": str(tmp_path / name) for name in ("split", "success", "error", "batch_export")}

    def rows():
        typed, batches = spark.read.parquet(out["success_dir"]), spark.read.parquet(out["batch_export_dir"])
        errors = spark.read.option("header", True).csv(out["error_dir"])
        return typed.count(), errors.count(), batches.count(), {r[0] for r in batches.select("validation_batch").distinct().collect()}

    auto(spark, source, RULES, batch_size=2, **out)
    assert rows() == (2, 1, 2, {1})
    auto(spark, source, RULES, batch_size=2, clear=False, **out)
    assert rows()[:3] == (4, 2, 4) and len(rows()[3]) == 2
    auto(spark, source, RULES, batch_size=2, **out)
    assert rows() == (2, 1, 2, {1})


def test_auto_without_rejected_rows(spark, tmp_path):
    source = write(tmp_path, {"in.csv": "k,n\na,1\n"}) + "/in.csv"
    out = {f"{name}_dir": str(tmp_path / name) for name in ("split", "success", "error", "batch_export")}
    auto(spark, source, RULES, **out)
    assert not (tmp_path / "error").exists()
    auto(spark, source, RULES, write_empty_error=True, **out)
    assert spark.read.option("header", True).csv(out["error_dir"]).columns[:3] == ["source_file", "__row_number", "__errors"]


@pytest.mark.parametrize("names", [("source_file", "n"), ("Validation_Batch", "n"), ("a", "A")])
def test_clashing_names_are_refused(spark, names):
    rules = parse_rules({"fields": [{"name": f"f{i}", "parquet_name": n, "type": "string"} for i, n in enumerate(names)]})
    with pytest.raises(ValueError, match="clashes"):
        auto(spark, "/nowhere/in.csv", rules)


def test_micro_batch_counts_within_physical_files(spark, tmp_path):
    source = write(tmp_path, {f"in.csv/part-{p}.csv": "k,n\na,x\n" for p in range(2)}) + "/in.csv"
    out = [str(tmp_path / name) for name in ("good", "quarantine", "failed", "counts")]
    gate_batch(read_lines(spark, source), RULES, *out)
    found = spark.read.parquet(out[1]).select("file", "__row_number").collect()
    assert [r["__row_number"] for r in found] == [2, 2] and len({r["file"] for r in found}) == 2


def test_scratch_tables_go_with_the_job(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda spark: f"{tmp_path}/scratch")
    folder = write(tmp_path / "in", {"a.csv": "k,n\na,1\nb,z\n"})
    auto(spark, f"{folder}/a.csv", RULES, *(f"{tmp_path}/{n}" for n in ("split", "ok", "bad")), batch_export_dir=f"{tmp_path}/export")
    validate_csv(spark, f"{folder}/a.csv", RULES, f"{tmp_path}/ok1", f"{tmp_path}/bad1")
    with pytest.raises(FileNotFoundError):
        batch_directory(spark, str(tmp_path / "in"), f"{tmp_path}/x")
    assert os.listdir(tmp_path / "scratch") == []
    assert spark.read.parquet(f"{tmp_path}/export").count() == 1
