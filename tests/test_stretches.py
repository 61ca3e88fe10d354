"""Folders with more files than one scan reads: listed, read and batched a stretch at a time."""

import os

from pyspark.sql import functions as F

from rulegate.operators import batch
from rulegate.operators.batch import batch_directory
from rulegate.plans.workflows import split_csv, validate_directory
from rulegate.rules import parse_rules
from rulegate.sources import csv_files, inventory
from rulegate.sources.csv_files import read_csv_directory
from rulegate.sources.inventory import gathered, inside, matching

KEYS = ["a*b", "c{d}", "e[f]", "g?h", "i}j", "k%2Al", "m n", "u7"]
RULES = {"fields": [{"name": "k", "type": "string"}, {"name": "n", "type": "int", "required": True}, {"name": "t", "type": "string"}]}


def put(folder, name, text):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def rows_of(files):
    return sorted(tuple(r) for r in files.with_row_numbers(files.records()).select("file", "__row_number", "record").collect())


def test_paths_come_in_stretches(spark, tmp_path, monkeypatch):
    for name in ("k=a/x.csv", "k=a/_y.csv", "k=b/x.csv", "k=c/x.txt", "k=d", "k=e/x.csv"):
        put(tmp_path, name, "1")
    whole = list(matching(spark, f"{tmp_path}/k=*"))
    monkeypatch.setattr(inventory, "STRETCH", 2)
    found = matching(spark, f"{tmp_path}/k=*")
    assert found.number == 5 and [len(part) for part in found] == [2, 2, 1] and [sum(found, [])] == whole
    below = inside(spark, whole[0], "*.csv")
    assert sorted(p.removeprefix(f"file:{tmp_path}/") for part in below for p in part) == ["k=a/_y.csv", "k=a/x.csv", "k=b/x.csv", "k=e/x.csv"]
    assert list(matching(spark, f"{tmp_path}/nothing*")) == []


def test_a_folder_of_many_files_is_not_one_scan(spark, tmp_path, monkeypatch):
    put(tmp_path, "a.csv", "k,n\na,1\n\na,2\n")
    put(tmp_path, "b.csv", 'k,n\n"b\n\nb",1\nb,2\n')
    put(tmp_path, "c.csv", 'k,n\nc"c,1\n')
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "key_file=d/part-0.csv", "k,n\nd,1\n")
    put(tmp_path, "key_file=d/part-1.csv", "k,n\nd,2\n\nd,3\n")
    put(tmp_path, "key_file=e%2Af/part-0.csv", "k,n\ne,1\n")
    once = read_csv_directory(spark, str(tmp_path))
    expected = rows_of(once), sorted(map(tuple, once.files.select("file", "header", "failure").collect()), key=str)
    monkeypatch.setattr(inventory, "STRETCH", 2)
    seen, read = [], csv_files.read_lines
    monkeypatch.setattr(csv_files, "read_lines", lambda *args: seen.append(len(read(*args).inputFiles())) or read(*args))
    several = read_csv_directory(spark, str(tmp_path))
    assert several.numbered.count() == 16 and len(seen) == 3 and max(seen) <= 3
    assert (rows_of(several), sorted(map(tuple, several.files.select("file", "header", "failure").collect()), key=str)) == expected
    assert several.numbered.count() == several.numbered.select("id").distinct().count()


def test_split_validated_and_read_back(spark, tmp_path, monkeypatch):
    lines = [f"{k},{n if n != 1 else 'x'},t{n}" for n in range(3) for k in KEYS]
    put(tmp_path, "in.csv", "\n".join(["k,n,t", *lines, ""]))
    monkeypatch.setattr(inventory, "STRETCH", 3)
    split_csv(spark, f"{tmp_path}/in.csv", f"{tmp_path}/split")

    def read(spark, paths):
        shape = "k string, n string, t string, key_file string"
        return spark.read.schema(shape).options(header=True, basePath=f"{tmp_path}/split").csv(paths)

    rows = gathered({f"{tmp_path}/split": matching(spark, f"{tmp_path}/split/key_file=*")}, read, "rows")
    assert len({r.key_file for r in rows.collect()}) == len(KEYS)
    assert sorted(f"{r.k},{r.n},{r.t}" for r in rows.collect()) == sorted(lines)
    result = validate_directory(spark, f"{tmp_path}/split", parse_rules(RULES), f"{tmp_path}/ok", f"{tmp_path}/bad")
    assert (result.summary.files, result.summary.total_rows, result.summary.invalid_rows) == (len(KEYS), len(lines), len(KEYS))
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 2 * len(KEYS)


def test_batches_are_written_some_files_at_a_time(spark, tmp_path, monkeypatch):
    rows = spark.range(60).select("id", F.concat(F.lit("s"), (F.col("id") % 10).cast("string")).alias("source_file"))
    rows.repartition(2).write.partitionBy("source_file").parquet(f"{tmp_path}/in")
    monkeypatch.setattr(inventory, "STRETCH", 3)
    monkeypatch.setattr(batch, "FILES_AT_ONCE", 5)
    seen, write = [], batch._write_piece
    monkeypatch.setattr(batch, "_write_piece", lambda part, *rest: seen.append(part.count()) or write(part, *rest))
    parts = sum(f.endswith(".parquet") for _, _, names in os.walk(tmp_path / "in") for f in names)
    for small in (0, batch.SMALL_FILE):  # counted from footers, and from kept rows
        monkeypatch.setattr(batch, "SMALL_FILE", small)
        seen.clear()
        summary = batch_directory(spark, f"{tmp_path}/in", f"{tmp_path}/out", 2)
        assert (summary.input_files, summary.batches, summary.total_rows) == (10, 5, 60)
        assert sum(seen) == parts and len(seen) > 1 and max(seen) < parts
        out = spark.read.parquet(f"{tmp_path}/out").groupBy("validation_batch").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        found = {r.validation_batch: r.ids for r in out.collect()}
        assert found == {b: sorted(i for i in range(60) if i % 10 // 2 == b - 1) for b in range(1, 6)}
