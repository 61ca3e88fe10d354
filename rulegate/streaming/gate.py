"""The gate as a stream: CSV files that arrive in a folder, checked in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rulegate.operators.sinks import write_typed
from rulegate.plans.workflows import as_rules, checked_rows, directory_summary, file_stats, rejected_rows
from rulegate.rules import Rules
from rulegate.session import materialize, pin
from rulegate.sources.csv_files import CSV_GLOB, CsvFiles, located
from rulegate.sources.parquet_files import SOURCES_TABLE

EPOCH = "epoch"
COUNTS = "file string, total_rows bigint, valid_rows bigint, invalid_rows bigint"


def stream_gate(
    spark: SparkSession,
    input_dir: str,
    rules: Rules | str,
    good_dir: str,
    quarantine_dir: str,
    failed_dir: str,
    checkpoint_dir: str,
    files_per_batch: int = 1000,
    available_now: bool = True,
) -> StreamingQuery:
    """Check arriving CSV files; the unit is one physical file, whichever micro-batch it comes in.

    Row numbers count within that file and a malformed one fails alone; parts are not folded into logical
    files, as they may arrive in different batches. Empty files and names that start with _ or . hold no
    lines for Spark's source and leave no trace. Typed rows, rejected rows (file, __row_number, __errors, cells),
    failed files (path, file, failure) and the counts of every sound file (in `_sources` below the typed rows) are
    Parquet tables partitioned by micro-batch. A batch that runs again after a failure replaces its own folders, so
    nothing is written or counted twice. `stream_summary` adds the counts up.
    """
    pin(spark)
    checked_rules = as_rules(spark, rules)
    lines = (
        spark.readStream.option("lineSep", "\n")
        .option("pathGlobFilter", CSV_GLOB)
        .option("maxFilesPerTrigger", files_per_batch)
        .text(input_dir)
    )

    def write(batch: DataFrame, epoch: int) -> None:
        folders = (good_dir, quarantine_dir, failed_dir, f"{good_dir}/{SOURCES_TABLE}")
        gate_batch(batch, checked_rules, *[f"{d}/{EPOCH}={epoch}" for d in folders])

    stream = located(lines).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def gate_batch(lines: DataFrame, rules: Rules, good: str, quarantine: str, failed: str, counts: str) -> None:
    """One micro-batch: the same steps as the folder job, on the lines of the new files."""
    files = CsvFiles(lines, by_path=True)
    if files.line_blocks.isEmpty():
        return
    staged = checked_rows(files, rules)
    write_typed(staged.filter("__ok").select("row.*"), good)
    rejected = materialize(files.with_row_numbers(rejected_rows(staged)), "rejected")
    every = F.array(*[F.col(f"cells.c{i}") for i in range(files.width)])
    write_typed(rejected.select("file", "__row_number", "__errors", every.alias("cells")), quarantine)
    failures = materialize(files.failures(rules), "failed-files")
    write_typed(failures, failed)
    write_typed(file_stats(files, rejected).join(failures, "file", "left_anti"), counts)


def stream_summary(spark: SparkSession, good_dir: str, failed_dir: str) -> DataFrame:
    """What the folder job reports, over all micro-batches so far: one row with files, failed_files, total_rows,
    valid_rows and invalid_rows."""
    sound = spark.read.schema(COUNTS).parquet(f"{good_dir}/{SOURCES_TABLE}")
    return directory_summary(sound, spark.read.schema("file string").parquet(failed_dir))
