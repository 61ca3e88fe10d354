"""Compaction: consecutive groups of files become numbered batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from rulegate.operators.numbering import global_rank, running_total
from rulegate.operators.placement import task_size
from rulegate.operators.sinks import write_typed
from rulegate.rules import quoted
from rulegate.session import Publication, absolute, dealt, escaped, job, materialize, small_side
from rulegate.sources.inventory import matching, spot
from rulegate.sources.parquet_files import NO_PARQUET, Footers, list_parquet, row_counts, schemas

BATCH_FOLDER = "validation_batch"
ROW_OVERHEAD = 64  # memory of a row in a sort besides its columns
SPREAD = 4  # generous: how much larger a file's rows are in memory than compressed
ROW_BYTES = 400
RUNS_AT_ONCE = 200  # stretches of batches one scan picks out of the folder
FILES_AT_ONCE = 20_000  # files one scan reads: the driver holds about two kilobytes for each
SMALL_FILE = 1024 * 1024  # opening such a file costs more than keeping its rows


class BatchError(RuntimeError):
    """Some batch could not be written."""


@dataclass(frozen=True)
class BatchSummary:
    input_files: int
    batches: int
    batch_size: int
    total_rows: int
    output_dir: str


def assign_batches(files: DataFrame, batch_size: int) -> DataFrame:
    """file, file_rank (from 0), batch_no (from 1): groups of `batch_size` files in name order.

    `files` needs one row per logical file. Names are compared byte by byte, extension included.
    """
    ranked = global_rank(files.select("file"), ["file"], "file_rank")
    number = F.floor(F.col("file_rank") / max(batch_size, 1)) + 1
    return ranked.withColumn("batch_no", number.cast("bigint"))


def schema_conflicts(schemas: DataFrame) -> DataFrame:
    """batch_no, file_rank, path of files whose schema differs from the first file of their batch.

    `schemas` has batch_no, file_rank, path, fingerprint.
    """
    order = F.struct("file_rank", "path")
    first = schemas.groupBy("batch_no").agg(F.min_by("fingerprint", order).alias("expected"))
    joined = schemas.join(first, "batch_no")
    return joined.filter("fingerprint <> expected").select("batch_no", "file_rank", "path")


def write_batches(rows: DataFrame, order: list[str], path: str, mode: str = "overwrite", tasks: int | None = None) -> None:
    """Write rows with `batch_no`, one folder per batch, sorted by `order`.

    The column `__part` spreads a large batch over several tasks and files; a small batch has one part. With `tasks`
    it is the task itself, one of so many.
    """
    placed = rows.withColumnRenamed("batch_no", BATCH_FOLDER)
    rows_of_tasks = placed.repartitionById(tasks, "__part") if tasks else dealt(placed, BATCH_FOLDER, "__part")
    sorted_rows = rows_of_tasks.sortWithinPartitions(BATCH_FOLDER, "__part", *order)
    write_typed(sorted_rows.drop("__part", *order), path, BATCH_FOLDER, mode)


def written_rows(spark: SparkSession, path: str) -> int:
    """Rows of an export folder, counted from its footers by Spark, a stretch of folders at a time."""
    scan = spark.read.schema(f"{BATCH_FOLDER} string").option("basePath", path)
    folders = matching(spark, f"{escaped(path.rstrip('/'))}/{BATCH_FOLDER}=*")
    return sum(scan.parquet(*[escaped(p) for p in some]).count() for some in folders)


@job
def batch_directory(
    spark: SparkSession, input_dir: str, output_dir: str, batch_size: int = 1000, clear: bool = True
) -> BatchSummary:
    """Merge the Parquet files of a folder, `batch_size` files per batch.

    Files of one batch must share a schema; a batch with a stray or unreadable file is left out, the others are
    written, and the first problem is raised at the end. Batches are written beside the export folder, their rows
    are checked against the rows of the input files, and only then do they take its place (or, with `clear=False`,
    join what is there). A run that fails before that leaves the export folder as it was.
    """
    if not input_dir.strip():
        raise ValueError("missing batch input directory")
    if not output_dir.strip():
        raise ValueError("missing batch export directory")
    if absolute(spark, input_dir) == absolute(spark, output_dir):
        raise ValueError("batch export directory must differ from batch input directory")
    size = max(batch_size, 1)
    listed = list_parquet(spark, input_dir)
    assigned = materialize(assign_batches(listed.select("file").distinct(), size), "batches")
    totals = assigned.agg(F.count("*").alias("files"), F.max("batch_no").alias("batches")).first()
    files = listed.join(small_side(assigned, totals.files, ROW_BYTES), "file").join(schemas(listed), "path", "left")
    torn = F.when(F.col("path").isNotNull() & F.col("fingerprint").isNull(), F.lit(NO_PARQUET))
    files = materialize(files.withColumn("problem", F.coalesce("problem", torn)), "batch-files")
    problems = materialize(batch_problems(files), "batch-problems")

    with Publication(spark, keep=not clear) as publication:
        staged, expected = publication.staged(output_dir), 0
        for fingerprint, runs in batch_runs(files, problems).items():
            for start in range(0, len(runs), RUNS_AT_ONCE):
                expected += _write_runs(files, fingerprint, runs[start : start + RUNS_AT_ONCE], staged)
        arrived = written_rows(spark, staged)
        if arrived != expected:
            raise BatchError(f"batch phase failed: {arrived} rows written, {expected} rows in the input files")
        if not expected and (not clear or not problems.isEmpty()):
            publication.withdraw(output_dir)  # nothing to add, or nothing sound to put in place of what is there
    found = problems.orderBy("batch_no", "file_rank", "path").first()
    if found is not None:
        raise BatchError(f"batch phase failed: write batch {found.batch_no}: {found.reason} {quoted(found.spot)}")
    return BatchSummary(totals.files, totals.batches, size, expected, output_dir)


def batch_problems(files: DataFrame) -> DataFrame:
    """batch_no, file_rank, path, spot, reason of files their batch cannot be written with."""
    columns = ["batch_no", "file_rank", "path", spot(F.col("path")).alias("spot")]
    unreadable = files.where("problem IS NOT NULL").select(*columns, F.concat(F.col("problem"), F.lit(":")).alias("reason"))
    stray = schema_conflicts(files.where("fingerprint IS NOT NULL"))
    return unreadable.unionByName(stray.select(*columns, F.lit("schema mismatch for").alias("reason")))


def batch_runs(files: DataFrame, problems: DataFrame) -> dict[str, list]:
    """Per schema, the runs of consecutive sound batches that have it: first and last file name of each run.

    A folder whose files are all alike has one run, so this is as long as there are breaks between batches.
    """
    broken = problems.select("batch_no").distinct()
    sound = files.where("fingerprint IS NOT NULL").join(broken, "batch_no", "left_anti")
    batches = sound.groupBy("batch_no").agg(
        F.first("fingerprint").alias("fingerprint"), F.min("file").alias("first"), F.max("file").alias("last")
    )
    inside = Window.partitionBy("fingerprint").orderBy("batch_no")
    run = F.col("batch_no") - F.row_number().over(inside)
    runs = batches.withColumn("run", run).groupBy("fingerprint", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last")
    )
    found: dict[str, list] = {}
    for r in runs.orderBy("fingerprint", "first").collect():
        found.setdefault(r.fingerprint, []).append((r.first, r["last"]))
    return found


def _write_runs(files: DataFrame, fingerprint: str, runs: list, target: str) -> int:
    """Write the batches of some runs of one schema and return the rows their files say they have."""
    picked = F.lit(False)
    for first, last in runs:
        picked = picked | F.col("file").between(first, last)
    part = files.where(F.col("fingerprint") == fingerprint).where(picked)
    spark, one = files.sparkSession, part.orderBy("path").select("path").first().path
    schema, required = spark.read.parquet(escaped(one)).schema, Footers(spark).required(one)
    if part.count() <= FILES_AT_ONCE:
        return _write_piece(part, schema, required, target)
    cut = materialize(pieces(part, FILES_AT_ONCE), "batch-pieces")
    last = cut.agg(F.max("piece")).first()[0]
    return sum(_write_piece(cut.where(F.col("piece") == n), schema, required, target) for n in range(last + 1))


def pieces(files: DataFrame, size: int) -> DataFrame:
    """Add `piece` (from 0): whole batches, in order, of about `size` files together."""
    counts = files.groupBy("batch_no").agg(F.count("*").alias("__files"))
    placed = running_total(counts, ["batch_no"], "__files", "__files_before")
    return files.join(placed.select("batch_no", F.floor(F.col("__files_before") / size).cast("int").alias("piece")), "batch_no")


def _write_piece(part: DataFrame, schema: StructType, required: list[str], target: str) -> int:
    """Write the batches of some files of one schema.

    One scan that opens no other file serves the counts, which end at the footers, and the rows; the rows of small files
    are kept, so that those are opened once. Rows are dealt to tasks by the memory a sort of them takes, as rows
    and sizes of their files tell: compressed bytes alone say little about it.
    """
    spark = part.sparkSession
    listed = part.select("path", "length").collect()
    if not listed:
        return 0
    scan = spark.read.schema(schema).parquet(*[escaped(r.path) for r in listed])
    rows = scan.select(
        *[F.col(f"`{f.name}`") for f in schema.fields],
        F.col("_metadata.file_path").alias("__scanned"),
        F.col("_metadata.row_index").alias("__row"),
    )
    if sum(r.length for r in listed) < SMALL_FILE * len(listed):
        rows = materialize(rows, "batch-rows")
        counts = row_counts(rows, F.col("__scanned"))
    else:
        counts = row_counts(scan)
    counted = part.withColumn("spot", spot(F.col("path"))).join(counts, "spot")
    counted = counted.select(F.col("scanned").alias("__scanned"), "batch_no", "file_rank", "path", "length", "num_rows")
    counted = materialize(counted.withColumn("memory", sort_memory(len(schema.fields))), "batch-counts")
    number, expected, memory = counted.agg(F.count("*"), F.coalesce(F.sum("num_rows"), F.lit(0)), F.sum("memory")).first()
    if not number:
        return 0
    size = task_size(memory, spark.sparkContext.defaultParallelism)
    plan = materialize(batch_plan(counted), "batch-plan")
    rows = rows.select(*[_required(f.name, f.dataType, required) for f in schema.fields], "__scanned", "__row")
    placed = rows.join(small_side(plan, number, ROW_BYTES), "__scanned")
    inside = F.col("__memory_before") + F.col("__row") * F.col("__row_memory")
    offset = F.col("__batch_start") + F.when(F.col("__batch_memory") > size, inside).otherwise(0)
    placed = placed.withColumn("__part", F.floor(offset / size).cast("int")).withColumn("__position", F.col("__rows_before") + F.col("__row"))
    used = ["__scanned", "__row", "__memory_before", "__row_memory", "__rows_before", "__batch_start", "__batch_memory"]
    write_batches(placed.drop(*used), ["__position"], target, "append", -(-memory // size))
    return expected


def sort_memory(columns: int) -> Column:
    """Bytes that sorting the rows of a file takes, a guess on the safe side."""
    return F.col("num_rows") * (ROW_OVERHEAD + 8 * columns) + F.col("length") * SPREAD


def batch_plan(counted: DataFrame) -> DataFrame:
    """Per file its batch, the rows and memory of the batch's files before it, and the batch's place among all batches."""
    totals = counted.groupBy("batch_no").agg(F.sum("memory").alias("__batch_memory"))
    totals = running_total(totals, ["batch_no"], "__batch_memory", "__batch_start")
    earlier = Window.partitionBy("batch_no").orderBy("file_rank", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select(
        "__scanned",
        "batch_no",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{name}_before") for c, name in (("num_rows", "rows"), ("memory", "memory"))],
        (F.col("memory") / F.col("num_rows")).alias("__row_memory"),
    )
    return placed.join(totals, "batch_no")


def _required(name: str, data_type, required: list[str]) -> Column:
    """Keep a column non-nullable when the files declare it so (it holds no NULL then)."""
    column = F.col(f"`{name}`")
    if name not in required:
        return column
    zero = F.lit("" if data_type.simpleString() == "string" else 0)
    stand_in = {"date": F.lit("1970-01-01"), "timestamp": F.lit("1970-01-01 00:00:00")}
    return F.coalesce(column, stand_in.get(data_type.simpleString(), zero).cast(data_type)).alias(name)
