"""CSV source: record numbers, headers, quoting, failed files. Tiny splits exercise the block logic."""

import random

import pytest
from pyspark.sql import functions as F

from rulegate.operators.validate import validate
from rulegate.rules import parse_rules
from rulegate.sources.csv_files import read_csv_directory, read_csv_file

RULES = parse_rules(
    {
        "fields": [
            {"name": "id", "type": "int", "required": True},
            {"name": "q", "type": "int", "required": True},
            {"name": "note", "type": "string"},
        ]
    }
)


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return str(folder)


FILES = {
    "a.csv": "id,q\n1,5\n\n2,x\r\n" + "".join(f"{i},{i}\n" for i in range(3, 100)),
    "b b+c%20.csv": "q,id\n5,1\nx,2\n7,3",
    "c.csv": "id,z\n1,5\n",
    "d.csv": "id,q\n",
    "e.CSV": 'id, q ,q\n1,3,4\n   \n"9",,"8"\n',
    "f.txt": "id,q\n",
    "g.csv": 'id,q\n1,2\n6,bare"q\n7,8\n',
    "h.csv": 'id,q,note\n1,2,"multi\r\nline ""x"", y\n\nend"\n'
    + "".join(f'{i},{i},"a\nb"\n' for i in range(2, 60))
    + "\n99,5,plain\n",
    "i.csv": 'id,q\n1,2\n2,"open\n' + "x\n" * 100,
    "j.csv": '"id,q\n1,2\n',
    "empty.csv": "\n\n",
    "sub/z.csv": "id,q\n1,2\n",
}


def test_directory(spark, tmp_path, tiny_splits):
    files = read_csv_directory(spark, write(tmp_path, FILES))
    failed = {r.file: r.failure for r in files.failures(RULES).collect()}
    assert failed == {
        "c.csv": 'required schema field "q" not found in CSV header',
        "empty.csv": "read header: EOF",
        "g.csv": "read row 3: malformed quotes",
        "i.csv": "read row 3: malformed quotes",
        "j.csv": "read header: malformed quotes",
    }
    rows, cells = files.table(RULES)
    gate = validate(rows, RULES, keep=["path", "block", "id"], cells=cells)
    bad = files.with_row_numbers(gate.invalid()).select("file", "__row_number", "__errors").collect()
    assert sorted(map(tuple, bad)) == [
        ("a.csv", 3, 'q: invalid int: "x"'),
        ("b b+c%20.csv", 3, 'q: invalid int: "x"'),
        ("e.CSV", 3, "id: value is required | q: value is required"),
    ]
    numbered = files.with_row_numbers(gate.checked).groupBy("file").agg(
        F.count("*"), F.min("__row_number"), F.max("__row_number"), F.count_distinct("__row_number")
    )
    assert {r[0]: tuple(r)[1:] for r in numbered.collect()} == {
        "a.csv": (99, 2, 100, 99),
        "b b+c%20.csv": (3, 2, 4, 3),
        "e.CSV": (3, 2, 4, 3),
        "h.csv": (60, 2, 61, 60),
    }
    notes = {r.note for r in gate.valid().collect()}
    assert notes == {None, 'multi\nline "x", y\n\nend', "a\nb", "plain"}


def test_single_header_needs_no_join(spark, tmp_path):
    files = read_csv_directory(spark, write(tmp_path, {"a.csv": "id,q\n1,2\n", "b.csv": "id,q\n3,4\n"}))
    rows, cells = files.table(RULES)
    frame = validate(rows, RULES, keep=[], cells=cells).valid()
    text = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    assert "Join" not in text and "Exchange" not in text and "Python" not in text
    assert sorted(map(tuple, frame.collect())) == [(1, 2, None), (3, 4, None)]


def test_numbers_need_no_window_over_rows(spark, tmp_path):
    files = read_csv_file(spark, write(tmp_path, {"a.csv": "id,q\n1,2\n"}) + "/a.csv")
    rows, _ = files.table(RULES)
    text = spark._jvm.PythonSQLUtils.explainString(files.with_row_numbers(rows)._jdf.queryExecution(), "formatted")
    assert "Window" not in text and "SortMergeJoin" not in text


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no csv files found in directory"):
        read_csv_directory(spark, write(tmp_path, {"f.txt": "x"}))


def test_random_text_against_a_reader(spark, tmp_path, tiny_splits):
    """Random records, written with minimal quoting, come back cell by cell with their numbers."""
    rng = random.Random(7)
    pieces = ["a", "1", ",", '"', "\n", " ", "é", "", "\\", "'"]
    for multi_line in (False, True):
        alphabet = pieces if multi_line else [p for p in pieces if p != "\n"]
        records = []
        for _ in range(300):
            cells = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(3)]
            records.append(cells if any(cells) else ["x", "", ""])

        def cell_text(cell):
            return '"' + cell.replace('"', '""') + '"' if any(ch in cell for ch in ',"\n') else cell

        text = "id,q,note\n" + "".join(",".join(map(cell_text, r)) + "\n" for r in records)
        name = f"multi{multi_line}.csv"
        files = read_csv_file(spark, write(tmp_path, {name: text}) + f"/{name}")
        assert files.has_glued == any("\n" in c for r in records for c in r)
        rules = parse_rules({"fields": [{"name": n, "type": "string"} for n in ("id", "q", "note")]})
        rows, cells = files.table(rules)
        found = files.with_row_numbers(rows).select(
            "__row_number", *[F.coalesce(cells[n], F.lit("")).alias(n) for n in ("id", "q", "note")]
        )
        assert sorted(map(tuple, found.collect())) == [(i + 2, *r) for i, r in enumerate(records)]
