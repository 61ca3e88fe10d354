"""Batches of folders with files that cannot be read, several schemas, and runs that fail."""

import os

import pytest

from rulegate.operators import batch
from rulegate.operators.batch import BatchError, batch_directory, batch_runs
from rulegate.session import Publication
from rulegate.sources.inventory import entries, files_and_parts
from rulegate.sources.parquet_files import Footers, list_parquet, schemas


def files_in(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc"))


def put(spark, folder, name, rows, kind="bigint"):
    """One file (or a folder of parts) of `rows` ids."""
    spark.range(rows).coalesce(1).selectExpr(f"cast(id as {kind}) id").write.parquet(f"{folder}/{name}")


def flat(folder, name):
    """Turn a folder of one part into a file of that name."""
    part = next(f for f in os.listdir(folder / name) if f.startswith("part-"))
    os.rename(folder / name / part, folder / "moved")
    for f in os.listdir(folder / name):
        os.remove(folder / name / f)
    os.rmdir(folder / name)
    os.rename(folder / "moved", folder / name)


def test_entries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rulegate.sources.inventory.STRETCH", 2)
    for name in ("a.csv", "_b.csv", ".c.csv", "d e; isDirectory=true.csv"):
        (tmp_path / name).write_text("x" * len(name))
    (tmp_path / "empty.csv").write_text("")
    for part in ("f.csv/part-0", "f.csv/_SUCCESS", "g.csv/_only", "h.csv/part-0"):
        (tmp_path / part).parent.mkdir(exist_ok=True)
        (tmp_path / part).write_text("" if part == "h.csv/part-0" else "x")
    found = {r.path.rsplit("/", 1)[1]: (r.folder, r.length) for r in entries(spark, f"{tmp_path}/*.csv").collect()}
    plain = ["a.csv", "_b.csv", ".c.csv", "d e; isDirectory=true.csv"]
    assert found == {n: (False, len(n)) for n in plain} | {"empty.csv": (False, 0)} | {n: (True, None) for n in ("f.csv", "g.csv", "h.csv")}
    seen = {r.path[len(f"file:{tmp_path}/"):]: (r.length, r.hidden) for r in files_and_parts(spark, f"{tmp_path}/*.csv").collect()}
    assert seen == {n: (len(n), n[0] in "_.") for n in plain} | {"empty.csv": (0, False), "f.csv/part-0": (1, False), "g.csv": (0, False), "h.csv": (0, False)}
    assert entries(spark, f"{tmp_path}/nothing*").count() == 0


def test_no_file_is_passed_over(spark, tmp_path):
    folder = tmp_path / "in"
    for name in ("a.parquet", "_b.parquet", "c.parquet"):
        put(spark, folder, name, 2)
        flat(folder, name)
    put(spark, folder, "d.PARQUET", 5)
    (folder / "e.parquet").write_text("")
    (folder / "f.parquet").write_text("this is something else entirely")
    listed = {r.file: r.problem for r in list_parquet(spark, str(folder)).collect()}
    assert listed == {"a.parquet": None, "_b.parquet": "names starting with _ or . cannot be read", "c.parquet": None, "d.PARQUET": None, "e.parquet": "not a Parquet file", "f.parquet": None}
    with pytest.raises(BatchError, match=r"write batch 1: names starting with _ or . cannot be read: .*/_b.parquet"):
        batch_directory(spark, str(folder), f"{tmp_path}/out", 1)
    found = {r[0]: r[1] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("validation_batch").count().collect()}
    assert found == {2: 2, 3: 2, 4: 5}  # _b is 1, e is 5, f is 6
    for name in ("_b.parquet", "e.parquet"):
        os.remove(folder / name)
    with pytest.raises(BatchError, match=r"write batch 2: not a Parquet file: .*/f.parquet"):
        batch_directory(spark, str(folder), f"{tmp_path}/out", 2)


def test_several_schemas_in_one_folder(spark, tmp_path):
    folder = tmp_path / "in"
    kinds = ["bigint", "bigint", "string", "string", "bigint", "bigint", "string", "double"]
    for n, kind in enumerate(kinds):
        put(spark, folder, f"f{n}.parquet", n + 1, kind)
        flat(folder, f"f{n}.parquet")
    files = list_parquet(spark, str(folder))
    plan = batch.assign_batches(files.select("file"), 2)
    files = files.join(plan, "file").join(schemas(files), "path")
    runs = batch_runs(files, batch.batch_problems(files))
    assert sorted(map(tuple, runs.values())) == [(("f0.parquet", "f1.parquet"), ("f4.parquet", "f5.parquet")), (("f2.parquet", "f3.parquet"),)]
    with pytest.raises(BatchError, match="write batch 4: schema mismatch for .*f7.parquet"):
        batch_directory(spark, str(folder), f"{tmp_path}/out", 2)
    counts = {name: spark.read.parquet(f"{tmp_path}/out/{name}").count() for name in os.listdir(tmp_path / "out") if "=" in name}
    assert counts == {"validation_batch=1": 3, "validation_batch=2": 7, "validation_batch=3": 11}
    assert spark.read.parquet(f"{tmp_path}/out/validation_batch=2").dtypes == [("id", "string")]


def test_a_failed_run_leaves_the_export_as_it_was(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    put(spark, folder, "a.parquet", 3)
    batch_directory(spark, str(folder), f"{tmp_path}/out", 2)
    before = files_in(tmp_path / "out")
    put(spark, folder, "b.parquet", 4)
    monkeypatch.setattr(batch, "written_rows", lambda spark, path: 1)
    with pytest.raises(BatchError, match="1 rows written, 7 rows in the input files"):
        batch_directory(spark, str(folder), f"{tmp_path}/out", 2)
    assert files_in(tmp_path / "out") == before and sorted(os.listdir(tmp_path)) == ["in", "out"]
    monkeypatch.undo()
    batch_directory(spark, str(folder), f"{tmp_path}/out", 2, clear=False)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10 and set(before) <= set(files_in(tmp_path / "out"))
    batch_directory(spark, str(folder), f"{tmp_path}/out", 2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7 and sorted(os.listdir(tmp_path)) == ["in", "out"]


def test_publication_is_undone_when_a_move_fails(spark, tmp_path, monkeypatch):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old").write_text("1")
    moves = []

    def fail_second(spark, source, target):
        moves.append(target)
        if len(moves) == 2:
            raise OSError("no")
        os.rename(source, target)

    monkeypatch.setattr("rulegate.session.rename", fail_second)
    with pytest.raises(OSError):
        with Publication(spark) as publication:
            spark.range(1).write.parquet(publication.staged(f"{tmp_path}/out"))
    assert files_in(tmp_path) == ["out/old"]


def test_empty_files_only(spark, tmp_path):
    folder = tmp_path / "in"
    put(spark, folder, "a.parquet", 0)
    done = batch_directory(spark, str(folder), f"{tmp_path}/out", 2)
    assert (done.input_files, done.batches, done.total_rows) == (1, 1, 0)
    assert not (tmp_path / "out").exists()


def test_entries_of_many_files(spark, tmp_path, monkeypatch):
    """Many entries are not printed one by one: sizes come from a scan, what Spark passes over from the file system."""
    monkeypatch.setattr("rulegate.sources.inventory.FEW", 0)
    test_entries(spark, tmp_path, monkeypatch)


def test_footers_are_taken_over_together(spark, tmp_path, monkeypatch):
    put(spark, tmp_path, "a.parquet", 3)
    put(spark, tmp_path, "b.parquet", 3, "string")
    spark.range(2).selectExpr("id AS `x}, metadata: {y`", "id AS c").write.parquet(f"{tmp_path}/c.parquet")
    listed = list_parquet(spark, str(tmp_path))
    footers = Footers(spark)
    one_by_one = {r.path: footers.fingerprint(r.path) for r in listed.collect()}
    monkeypatch.setattr(Footers, "fingerprint", lambda self, path: pytest.fail(f"{path} was read by itself"))
    assert {r.path: r.fingerprint for r in schemas(listed).collect()} == one_by_one


def test_a_large_batch_is_cut_by_the_memory_of_its_rows(spark, tmp_path, monkeypatch):
    """Rows that compress to nothing still take memory to sort."""
    monkeypatch.setattr("rulegate.operators.placement.TASK_BYTES", 2_000_000)
    spark.range(100_000).selectExpr("shiftright(id, 10) AS id").coalesce(1).write.parquet(f"{tmp_path}/in/a.parquet")
    put(spark, tmp_path / "in", "b.parquet", 5)
    batch_directory(spark, f"{tmp_path}/in", f"{tmp_path}/out", 2)
    parts = sorted(f for f in files_in(tmp_path / "out") if f.endswith(".parquet"))
    found = [[r.id for r in spark.read.parquet(f"{tmp_path}/out/{p}").collect()] for p in parts]
    assert len(parts) >= 4 and max(map(len, found)) < 40_000
    assert [i for part in found for i in part] == [i >> 10 for i in range(100_000)] + list(range(5))
