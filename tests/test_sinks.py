"""Outputs with a folder per value."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rulegate.operators.sinks import write_csv, write_lines, write_typed


@pytest.mark.parametrize("kind", ["parquet", "csv", "text"])
def test_folders_per_value_have_no_checksum_files(spark, tmp_path, kind):
    rows = spark.range(40).select((F.col("id") % 4).cast("string").alias("k"), F.col("id").cast("string").alias("value"))
    out = str(tmp_path / kind)
    if kind == "parquet":
        write_typed(rows, out, "k")
    elif kind == "csv":
        write_csv(rows, out, ["value"], [F.col("value")], partition="k")
    else:
        write_lines(rows.withColumn("task", F.lit(0)), 1, [F.col("value")], out, "k")
    assert len(list((tmp_path / kind).glob("k=*"))) == 4
    assert not list((tmp_path / kind).rglob("*.crc"))
    found = spark.read.schema("value string, k string").format(kind).option("header", kind == "csv").load(out)
    assert sorted(map(tuple, found.collect())) == sorted((r["value"], r["k"]) for r in rows.collect())
