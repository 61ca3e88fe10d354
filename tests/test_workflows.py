"""The jobs end to end on small files: outputs, summaries, errors."""

import csv
import glob
import json
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rulegate.operators.batch import BatchError, assign_batches, batch_directory
from rulegate.operators.numbering import global_rank, number_within
from rulegate.operators.sinks import csv_names
from rulegate.plans.workflows import (
    DirectoryError,
    FileError,
    auto,
    result_frame,
    split_csv,
    validate_csv,
    validate_directory,
)
from rulegate.rules import RuleError, parse_rules
from rulegate.sources.csv_files import read_csv_directory
from rulegate.streaming.gate import stream_gate, stream_summary
from tests.test_checks import DOCUMENT, ERRORS, HEADER, ROWS
from tests.test_csv_files import FILES, RULES, write


def read_parts(folder):
    """Rows of all CSV parts below a folder, by parent folder; the header comes first."""
    found = {}
    for path in sorted(glob.glob(f"{folder}/**/part-*", recursive=True)):
        with open(path, newline="") as handle:
            rows = list(csv.reader(handle))
        parent = path.split("/")[-2]
        found.setdefault(parent, [rows[0]]).extend(rows[1:])
    return found


def test_validate_file(spark, tmp_path):
    source = write(tmp_path, {"in.csv": ",".join(HEADER) + "\n" + "\n".join(ROWS) + ",EXTRA,MORE\n"}) + "/in.csv"
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps(DOCUMENT))
    result = validate_csv(spark, source, str(rules), f"{tmp_path}/ok", f"{tmp_path}/bad")
    assert (result.stats.total_rows, result.stats.valid_rows, result.stats.invalid_rows) == (7, 3, 4)
    assert result.parquet_path.endswith("/ok/in.parquet") and result.error_csv_path.endswith("/bad/in_error.csv")
    errors = read_parts(result.error_csv_path)["in_error.csv"]
    assert errors[0] == ["__row_number", "__errors", *HEADER]
    numbers = {"P1": "3", "PX12": "4", "PX13": "5", "PX15": "7"}
    assert [(r[0], r[1], r[2]) for r in errors[1:]] == [(numbers[k], ERRORS[k], k) for k in ERRORS]
    assert errors[2][3] == " " and len(errors[3]) == 2 + len(HEADER)
    footer = pq.ParquetFile(glob.glob(result.parquet_path + "/part*")[0])
    assert footer.metadata.row_group(0).column(0).compression == "SNAPPY"
    assert [f.name for f in footer.schema_arrow if not f.nullable] == ["parcel_no", "weight", "scanned"]
    types = {f.name: str(f.type) for f in footer.schema_arrow}
    assert types["due"] == "date32[day]" and types["scanned"] == "timestamp[us, tz=UTC]"


def test_rules_from_where_spark_reads(spark, tmp_path):
    source = write(tmp_path, {"in.csv": "id,q\n1,2\n"}) + "/in.csv"
    (tmp_path / "rules.json").write_text(json.dumps({"fields": [{"name": "id", "type": "int"}]}, indent=1))
    out = f"{tmp_path}/ok", f"{tmp_path}/bad"
    assert validate_csv(spark, source, f"file://{tmp_path}/rules.json", *out).stats.valid_rows == 1
    (tmp_path / "torn.json").write_text("{")
    for name in ("torn.json", "none.json"):
        with pytest.raises(RuleError, match="failed loading schema"):
            validate_csv(spark, source, f"file://{tmp_path}/{name}", *out)


def test_one_large_file_is_no_hot_key(spark, tmp_path, monkeypatch):
    """Files with different headers, too many to broadcast: rows find their header by split, not by file."""
    monkeypatch.setattr("rulegate.session.BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        large = "id,q\n" + "".join(f"{n},{n}\n" for n in range(3_000))
        folder = write(tmp_path / "in", {"a.csv": large, "b.csv": "q,id\n5,6\n", "c.csv": "id,z\n1,1\n", "d.csv": 'id,q\n7,"8"\n9,"x\ny"\n'})
        files = read_csv_directory(spark, folder)
        rows, cells = files.table(RULES)
        found = rows.select(cells["id"].alias("id"), cells["q"].alias("q"))
        plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        assert sorted(map(tuple, found.collect()))[:2] == [("0", "0"), ("1", "1")] and found.count() == 3_003
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes"):
            spark.conf.unset(key)
    moves = re.findall(r"Exchange\s*\nInput \[\d+\]: \[([^\n]*)\]\nArguments: hashpartitioning\(([^)]*)\)", plan)
    rows_moved = [keys for columns, keys in moves if re.search(r"\b(record|cells)#", columns)]
    assert rows_moved and all("path#" in keys and "block#" in keys for keys in rows_moved)


def test_empty_error_policy(spark, tmp_path):
    folder = write(tmp_path, {"x.csv": "id,q\n1,2\n", "y.csv": "id,q\n1,z\n"})
    ok, bad = f"{tmp_path}/ok", f"{tmp_path}/bad"
    validate_csv(spark, f"{folder}/y.csv", RULES, ok, bad)
    assert glob.glob(f"{bad}/y_error.csv/part*")
    (tmp_path / "y.csv").write_text("id,q\n1,2\n")
    validate_csv(spark, f"{folder}/y.csv", RULES, ok, bad)
    assert not glob.glob(f"{bad}/y_error.csv")  # a stale error file goes away
    validate_csv(spark, f"{folder}/x.csv", RULES, ok, bad, write_empty_error=True)
    assert read_parts(f"{bad}/x_error.csv") == {"x_error.csv": [["__row_number", "__errors", "id", "q"]]}
    with pytest.raises(FileError, match="read header: EOF"):
        validate_csv(spark, write(tmp_path, {"e.csv": ""}) + "/e.csv", RULES, ok, bad)
    with pytest.raises(FileError, match='required schema field "q" not found'):
        validate_csv(spark, write(tmp_path, {"n.csv": "id\n1\n"}) + "/n.csv", RULES, ok, bad)


def test_directory_then_batch(spark, tmp_path):
    folder = write(tmp_path / "in", FILES)
    ok, bad, export = (f"{tmp_path}/{n}" for n in ("ok", "bad", "export"))
    with pytest.raises(DirectoryError, match=r"directory validation completed with 5 failed file\(s\)") as caught:
        validate_directory(spark, folder, RULES, ok, bad, write_empty_error=True)
    summary = caught.value.result.summary
    assert (summary.files, summary.failed_files, summary.total_rows, summary.valid_rows, summary.invalid_rows) == (
        10, 5, 165, 162, 3,
    )
    errors = read_parts(bad)
    assert errors["source_file=a"][1:] == [["3", 'q: invalid int: "x"', "2", "x"]]
    assert errors["source_file=e"][0] == ["__row_number", "__errors", "id", " q ", "q"] or errors["source_file=e"][0][-1] == "q"
    assert errors["source_file=d"] == [["__row_number", "__errors", "id", "q"]]
    # d has no rows at all and still counts as a batch input
    done = batch_directory(spark, ok, export, 2)
    assert (done.input_files, done.batches, done.total_rows) == (5, 3, 162)
    counts = {r.validation_batch: r["count"] for r in spark.read.parquet(export).groupBy("validation_batch").count().collect()}
    assert counts == {1: 100, 2: 2, 3: 60}
    footer = pq.ParquetFile(glob.glob(f"{export}/*/part*")[0]).schema_arrow
    assert [f.name for f in footer if not f.nullable] == ["id", "q"]


def test_split_and_validate_again(spark, tmp_path):
    text = 'k,v\nk1,1\n k1 ,"x, ""y"""\n,3\nn/a,4\na/b,5\na_b,6\n\n""\n'
    source = write(tmp_path, {"s.csv": text}) + "/s.csv"
    out = f"{tmp_path}/split"
    for _ in range(2):  # the second run replaces the first
        summary = split_csv(spark, source, out)
    assert (summary.total_rows, summary.split_rows, summary.missing_key_rows, summary.output_files) == (7, 5, 2, 3)
    parts = read_parts(out)
    assert parts == {
        "key_file=k1": [["k", "v"], ["k1", "1"], [" k1 ", 'x, "y"']],
        "key_file=n_a": [["k", "v"], ["n/a", "4"]],
        "key_file=a_b": [["k", "v"], ["a/b", "5"], ["a_b", "6"]],
        "key_file=missing_keys": [["k", "v"], ["", "3"], ["", ""]],
    }
    rules = parse_rules({"fields": [{"name": "k", "type": "string"}, {"name": "v", "type": "int", "required": True}]})
    result = validate_directory(spark, out, rules, f"{tmp_path}/ok", f"{tmp_path}/bad")
    assert (result.summary.files, result.summary.invalid_rows) == (4, 2)
    errors = read_parts(f"{tmp_path}/bad")
    assert errors["source_file=k1"][1] == ["3", 'v: invalid int: "x, \\"y\\""', " k1 ", 'x, "y"']
    with pytest.raises(FileError, match='primary key "zz" not found in CSV header'):
        split_csv(spark, source, out, key="zz")
    blank = write(tmp_path, {"b.csv": " ,v\n1,2\n"}) + "/b.csv"
    with pytest.raises(FileError, match="first header column is blank"):
        split_csv(spark, blank, out)


AUTO_ROWS = [f"{key},{row}" for key, row in zip(["a", "b", "a", "", "c", "b", "n/a"], ROWS)]


@pytest.mark.parametrize("folders", [False, True])
def test_auto(spark, tmp_path, folders):
    text = "key," + ",".join(HEADER) + "\n" + "\n".join(AUTO_ROWS) + "\n"
    source = write(tmp_path, {"main.csv": text}) + "/main.csv"
    rules = parse_rules(DOCUMENT)
    result = auto(spark, source, rules, batch_size=2, folder_per_key=folders, write_split=folders, write_empty_error=folders)
    assert result.split_primary_key == "key"
    assert (result.split_summary.missing_key_rows, result.split_summary.output_files) == (1, 4)
    summary = result.validation.summary
    assert (summary.files, summary.total_rows, summary.valid_rows, summary.invalid_rows) == (5, 7, 3, 4)
    batch = result.batch_summary
    assert (batch.input_files, batch.batches, batch.total_rows) == (5, 3, 3)
    rows = spark.read.parquet(f"{tmp_path}/batch_export").select("parcel_no", "validation_batch").collect()
    # name order: a, b, c, missing_keys, n_a
    assert sorted(map(tuple, rows)) == [("PX10", 1), ("PX14", 2), ("PX16", 3)]
    errors = read_parts(f"{tmp_path}/errors")
    if folders:
        assert {k: sorted(r[0] for r in v[1:]) for k, v in errors.items()} == {
            "source_file=a": ["3"], "source_file=b": ["2", "3"], "source_file=c": [], "source_file=missing_keys": ["2"],
            "source_file=n_a": [],
        }
        assert len(read_parts(f"{tmp_path}/split")) == 5
        again = batch_directory(spark, f"{tmp_path}/success", f"{tmp_path}/again", 2)
        assert (again.input_files, again.batches, again.total_rows) == (5, 3, 3)
    else:
        body = [r[:2] for r in errors["errors"] if r[0] != "source_file"]
        assert sorted(body) == [["a", "3"], ["b", "2"], ["b", "3"], ["missing_keys", "2"]]
    document = json.loads(result_frame(spark, result).first().result)
    assert document["validation"]["summary"]["valid_rows"] == 3
    with pytest.raises(ValueError, match="batch_export_dir must differ from batch_dir"):
        auto(spark, source, rules, batch_export_dir=f"{tmp_path}/success")


def test_auto_stops_when_a_column_is_missing(spark, tmp_path):
    source = write(tmp_path, {"main.csv": "k,id\na,1\nb,2\n"}) + "/main.csv"
    with pytest.raises(DirectoryError, match=r"completed with 2 failed file\(s\)"):
        auto(spark, source, RULES)


def test_batch_conflicts(spark, tmp_path):
    spark.range(2).coalesce(1).write.parquet(f"{tmp_path}/in/a.parquet")
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/in/a-b.parquet")
    spark.range(4).coalesce(1).selectExpr("cast(id as string) id").write.parquet(f"{tmp_path}/in/b.parquet")
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/in/c.parquet")
    with pytest.raises(BatchError, match=r"write batch 2: schema mismatch for .*c.parquet"):
        batch_directory(spark, f"{tmp_path}/in", f"{tmp_path}/out", 2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5  # batch 1 is there
    one_each = batch_directory(spark, f"{tmp_path}/in", f"{tmp_path}/each", 0)
    assert (one_each.batches, one_each.batch_size, one_each.total_rows) == (4, 1, 14)
    with pytest.raises(ValueError, match="must differ from batch input"):
        batch_directory(spark, f"{tmp_path}/in", f"{tmp_path}/in/", 2)
    with pytest.raises(FileNotFoundError, match="no parquet files found"):
        batch_directory(spark, str(tmp_path), f"{tmp_path}/x", 2)


def test_batch_order(spark):
    names = spark.createDataFrame([("a.parquet",), ("a-b.parquet",), ("b.parquet",)], "file string")
    found = {r.file: r.batch_no for r in assign_batches(names, 2).collect()}
    assert found == {"a-b.parquet": 1, "a.parquet": 1, "b.parquet": 2}


def test_hot_key_numbering(spark):
    """A key holding a third of the rows is numbered in chunks, with the same result as one window."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    numbered = number_within(rows, "k", [F.floor(F.col("id") / 100)], ["id"], first=2)
    seen = {}
    for r in sorted(numbered.collect(), key=lambda r: r.id):
        seen[r.k] = seen.get(r.k, 1) + 1
        assert r["__row_number"] == seen[r.k]
    assert seen["hot"] == 1001


def test_numbering_with_known_counts(spark):
    """Known counts give the same numbers, and the rows are read once instead of twice."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    rows = rows.withColumn("stretch", F.floor(F.col("id") / 100))
    counts = rows.groupBy("k", "stretch").agg(F.count("*").alias("n")).localCheckpoint()
    plain = number_within(rows, "k", [F.col("stretch")], ["id"], first=2)
    known = number_within(rows, "k", [F.col("stretch")], ["id"], first=2, counts=counts)
    assert known.columns == plain.columns and known.exceptAll(plain).isEmpty() and known.count() == 3000
    text = known._sc._jvm.PythonSQLUtils.explainString(known._jdf.queryExecution(), "simple")
    assert text.count("Range (0, 3000") == 1


def test_auto_numbers_over_parts_and_splits(spark, tmp_path):
    """Rows of a key are numbered in input order over parts and their splits, and no path is shuffled with them."""
    names = ["part-99999.csv", "part-100000.csv", "part-100001.csv"]
    keys, parts = [f"k{n % 7}" if n % 3 else "hot" for n in range(900)], {}
    for p, name in enumerate(names):
        lines = [f"{keys[n]},{n}" if n % 2 else f"{keys[n]},x{n}" for n in range(300 * p, 300 * p + 300)]
        parts[name] = "key,id\n" + "\n".join(lines) + "\n"
    write(tmp_path / "main.csv", parts)
    rules = parse_rules({"fields": [{"name": "id", "type": "int", "required": True}]})
    split_bytes, shuffled = spark.conf.get("spark.sql.files.maxPartitionBytes"), []

    def spied(df, key, chunk, order, first=1, counts=None):
        shuffled.extend(df.columns)
        return number_within(df, key, chunk, order, first, counts)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("rulegate.plans.workflows.number_within", spied)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        try:
            result = auto(spark, f"{tmp_path}/main.csv", rules, batch_size=2)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    assert "path" not in shuffled and "split_start" in shuffled
    expected, seen = [], {}
    for n, key in enumerate(keys):
        seen[key] = seen.get(key, 1) + 1
        if n % 2 == 0:
            expected.append([key, str(seen[key]), f"x{n}"])
    body = [[r[0], r[1], r[-1]] for r in read_parts(f"{tmp_path}/errors")["errors"] if r[0] != "source_file"]
    assert sorted(body) == sorted(expected)
    assert (result.validation.summary.total_rows, result.batch_summary.total_rows) == (900, 450)


def test_global_rank(spark):
    ranked = global_rank(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), ["v"], "r")
    assert all(r.v == r.r for r in ranked.collect())


def test_header_names():
    assert csv_names(["a", "A", "b", ""], []) == ["a_2", "A", "b", ""]
    assert csv_names(["__errors"], ["__row_number", "__errors"]) == ["__errors_2"]


def test_stream_equals_directory(spark, tmp_path):
    folder = write(tmp_path / "in", FILES)
    outs = [f"{tmp_path}/{n}" for n in ("good", "quarantine", "failed", "checkpoint")]
    for _ in range(2):  # nothing new the second time
        stream_gate(spark, folder, RULES, *outs, files_per_batch=4).awaitTermination()
    with pytest.raises(DirectoryError):
        validate_directory(spark, folder, RULES, f"{tmp_path}/ok", f"{tmp_path}/bad")
    columns = ["id", "q", "note"]
    good = sorted(map(str, spark.read.parquet(outs[0]).select(*columns).collect()))
    assert good == sorted(map(str, spark.read.parquet(f"{tmp_path}/ok").select(*columns).collect())) and len(good) == 162
    rejected = {(r.file.rsplit("/", 1)[1], r["__row_number"]) for r in spark.read.parquet(outs[1]).collect()}
    assert rejected == {("a.csv", 3), ("b b+c%20.csv", 3), ("e.CSV", 3)}
    assert {r.file.rsplit("/", 1)[1] for r in spark.read.parquet(outs[2]).collect()} == {"c.csv", "g.csv", "i.csv", "j.csv"}
    summary = stream_summary(spark, outs[0], outs[2]).first()
    assert (summary.files, summary.failed_files, summary.total_rows, summary.valid_rows, summary.invalid_rows) == (9, 4, 165, 162, 3)


def test_stream_goes_on_after_a_batch_of_failed_files(spark, tmp_path):
    outs = [f"{tmp_path}/{n}" for n in ("good", "quarantine", "failed", "checkpoint")]
    for step, files in enumerate(({"a.csv": "id,z\n1,2\n"}, {"b.csv": "id,q\n1,2\n3,x\n"}, {"c.csv": 'id,q\n1"2,3\n', "d.csv": "id,q\n4,5\n"})):
        write(tmp_path / "in", files)
        stream_gate(spark, f"{tmp_path}/in", RULES, *outs, files_per_batch=1).awaitTermination()
        if not step:
            assert [r.failure for r in spark.read.parquet(outs[2]).collect()] == ['required schema field "q" not found in CSV header']
    assert tuple(stream_summary(spark, outs[0], outs[2]).first()) == (4, 2, 3, 2, 1)
    assert spark.read.parquet(outs[0]).count() == 2
