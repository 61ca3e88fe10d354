"""The jobs a user calls: split, validate a file or a folder, batch, and all of it in one run."""

from __future__ import annotations

import json
import os.path
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rulegate.functions.checks import check_predicates, not_null
from rulegate.functions.text import decode_path, trim_cell
from rulegate.operators.batch import (
    BATCH_FOLDER,
    BatchSummary,
    assign_batches,
    batch_directory,
    write_batches,
)
from rulegate.operators.numbering import number_within
from rulegate.operators.placement import placed_rows
from rulegate.operators.sinks import ERROR_COLUMNS, csv_line, folders, write_csv, write_lines, write_typed
from rulegate.operators.split import (
    MISSING_KEYS_FILE,
    key_stretches,
    rows_of_stretches,
    split_summary,
    with_key_file,
)
from rulegate.operators.validate import validate
from rulegate.rules import RuleError, Rules, load_rules, quoted, read_rules, strip
from rulegate.session import Publication, absolute, glob, job, materialize, pin, remove, small_side
from rulegate.sources.csv_files import (
    ROW_BYTES,
    CsvFiles,
    logical_name,
    parsed_cells,
    part_order,
    read_csv_directory,
    read_csv_file,
)
from rulegate.sources.parquet_files import SOURCES_TABLE

SOURCE = "source_file"
STRETCH = ["path", "block"]  # one input split
WORK_COLUMNS = ("key_file", "file_rank", "batch_no", "__row_number", "__part", "__ok")
TASK_ROWS = 2_000_000  # rows of a batch that end up in one output part of the one-pass run


class FileError(RuntimeError):
    """An input file cannot be processed."""


class DirectoryError(RuntimeError):
    """Some files of a folder failed; `result` describes the rest, which was written."""

    def __init__(self, message: str, result: DirectoryResult):
        super().__init__(message)
        self.result = result


@dataclass(frozen=True)
class Stats:
    total_rows: int
    valid_rows: int
    invalid_rows: int


@dataclass(frozen=True)
class ValidationResult:
    input_path: str
    parquet_path: str
    error_csv_path: str
    stats: Stats


@dataclass(frozen=True)
class DirectorySummary:
    files: int
    failed_files: int
    total_rows: int
    valid_rows: int
    invalid_rows: int


@dataclass(frozen=True)
class DirectoryResult:
    input_dir: str
    file_count: int
    summary: DirectorySummary
    success_dir: str
    error_dir: str


@dataclass(frozen=True)
class SplitSummary:
    total_rows: int
    split_rows: int
    missing_key_rows: int
    output_files: int


@dataclass(frozen=True)
class AutoResult:
    main_input_csv: str
    schema_path: str
    split_primary_key: str
    split_summary: SplitSummary
    validation: DirectoryResult
    batch_summary: BatchSummary


def result_frame(spark: SparkSession, result) -> DataFrame:
    """One row with the JSON document of a result."""
    return spark.createDataFrame([(json.dumps(asdict(result)),)], "result string")


def as_rules(spark: SparkSession, rules: Rules | str) -> Rules:
    """Rules whose predicates Spark can use, from rules or the path of a rule document."""
    found = rules if isinstance(rules, Rules) else _rules_at(spark, rules)
    check_predicates(spark, found)
    return found


def _rules_at(spark: SparkSession, path: str) -> Rules:
    """A rule document on this machine, or wherever Spark reads from."""
    if os.path.exists(path):
        return load_rules(path)
    try:
        document = spark.read.text(path, wholetext=True).first()
    except AnalysisException as problem:
        raise RuleError(f"failed loading schema: {problem}") from problem
    return read_rules(document.value if document else "")


def check_names(rules: Rules, reserved: tuple[str, ...] = ()) -> None:
    """Refuse, before any job, output names that Spark would take for one another or for the engine's own."""
    taken = {name.lower(): name for name in reserved}
    for rule in rules.fields:
        if rule.output.lower() in taken:
            raise ValueError(f"output name {quoted(rule.output)} clashes with {quoted(taken[rule.output.lower()])}")
        taken[rule.output.lower()] = rule.output


def output_paths(input_path: str, success_dir: str, error_dir: str) -> tuple[str, str]:
    base = os.path.splitext(os.path.basename(input_path.rstrip("/")))[0]
    return f"{success_dir.rstrip('/')}/{base}.parquet", f"{error_dir.rstrip('/')}/{base}_error.csv"


def file_header(files: CsvFiles) -> list[str]:
    """Header of a single input; raises when the input has none or breaks the quoting rules."""
    failed = files.files.filter("failure IS NOT NULL").select("failure").first()
    if failed is not None:
        raise FileError(f"processing failed: {failed.failure}")
    header = files.only_header
    if header is None:
        raise FileError("processing failed: read header: EOF")
    return header


BLANK_KEY = "failed detecting split primary key: first header column is blank"


def detect_key(header: list[str]) -> str:
    """The first header column is the split key."""
    key = strip(header[0])
    if not key:
        raise FileError(BLANK_KEY)
    return key


def split_keys(files: CsvFiles) -> DataFrame:
    """The same for every file of a folder: path, file, split_key (NULL where there is none), failure."""
    key = trim_cell(F.get("header_cells", F.lit(0)))
    return files.headers().select(
        "path",
        "file",
        F.nullif(key, F.lit("")).alias("split_key"),
        F.coalesce("failure", F.when(key == "", F.lit(BLANK_KEY))).alias("failure"),
    )


def key_position(header: list[str], key: str) -> int:
    """Position of the split key: the first of equal names."""
    names = [strip(h) for h in header]
    if strip(key) not in names:
        raise FileError(f"split failed: primary key {quoted(strip(key))} not found in CSV header")
    return names.index(strip(key))


def original_cells(width: int) -> list[Column]:
    return [F.col(f"cells.c{i}") for i in range(width)]


# -- split ---------------------------------------------------------------------------------------


@job
def split_csv(
    spark: SparkSession,
    input_csv: str,
    output_dir: str,
    key: str | None = None,
    missing_file: str = MISSING_KEYS_FILE,
    mode: str = "overwrite",
) -> SplitSummary:
    """Write one `key_file=<key>` folder of CSV parts per key value.

    One pass counts what each input split holds of each key, the second one writes: rows go to the task their key
    and split were given by plan, so a key of any size spreads over as many tasks as it needs, a smaller one has one
    part, and the parts of a key are in input order. The folders appear when all are written.
    """
    files = read_csv_file(spark, input_csv)
    header = file_header(files)
    position = key_position(header, detect_key(header) if not key or not key.strip() else key)
    keyed = _keyed_records(files, position, missing_file or MISSING_KEYS_FILE)
    stretches = materialize(key_stretches(keyed, STRETCH, F.octet_length("record").cast("bigint")), "key-stretches")
    with Publication(spark, keep=mode == "append") as publication:
        _write_split(keyed, stretches, header, publication.staged(output_dir))
    return SplitSummary(**split_summary(rows_of_stretches(stretches)).first().asDict())


def _write_split(keyed: DataFrame, stretches: DataFrame, header: list[str], path: str) -> None:
    sizes = stretches.select("key_file", *STRETCH, "bytes")
    rows, _, tasks = placed_rows(keyed, sizes, "key_file", STRETCH, part_order())
    order = [F.col("key_file"), *part_order(), F.col("id")]
    ordered = rows.repartitionById(tasks, "task").sortWithinPartitions(*order)
    write_csv(ordered, path, header, original_cells(len(header)), partition="key_file", mode="append")


def _keyed_records(files: CsvFiles, position: int, missing_file: str) -> DataFrame:
    """Parsed records with their key file: path, block, id, record, cells, has_key, key_file."""
    records = files.records().withColumn("cells", parsed_cells(F.col("record"), files.width))
    return with_key_file(records, F.col(f"cells.c{position}"), missing_file)


# -- validate ------------------------------------------------------------------------------------


@job
def validate_csv(
    spark: SparkSession,
    input_csv: str,
    rules: Rules | str,
    success_dir: str,
    error_dir: str,
    write_empty_error: bool = False,
) -> ValidationResult:
    """Validate one CSV: `<base>.parquet` with the typed rows, `<base>_error.csv` with the others.

    Rows are checked once into a scratch table that feeds both outputs; they appear together.
    """
    pin(spark)
    rules = as_rules(spark, rules)
    check_names(rules)
    files = read_csv_file(spark, input_csv)
    header = file_header(files)
    failed = files.failures(rules).first()
    if failed is not None:
        raise FileError(f"processing failed: {failed.failure}")
    staged = checked_rows(files, rules)
    stats = Stats(*staged.agg(F.count("*"), F.count_if("__ok"), F.count_if(~F.col("__ok"))).first())
    parquet_path, error_path = output_paths(input_csv, success_dir, error_dir)
    with Publication(spark) as publication:
        write_typed(staged.filter("__ok").select(*_row_columns(rules)), publication.staged(parquet_path))
        errors = publication.staged(error_path)
        if stats.invalid_rows or write_empty_error:
            numbered = files.with_row_numbers(rejected_rows(staged))
            write_csv(numbered, errors, header, original_cells(len(header)), extra=ERROR_COLUMNS)
    return ValidationResult(input_csv, parquet_path, error_path, stats)


def checked_rows(files: CsvFiles, rules: Rules) -> DataFrame:
    """All rows of the sound files, checked once: path, block, id, __ok, `row` or `__errors` and `cells`."""
    table, cells = files.table(rules)
    gate = validate(table, rules, keep=["path", "block", "id", "cells"], cells=cells)
    return materialize(gate.staged("path", "block", "id", rejected_only=("cells",)), "checked", partition="__ok")


def rejected_rows(staged: DataFrame) -> DataFrame:
    return staged.filter("NOT __ok").drop("row", "__ok")


@job
def validate_directory(
    spark: SparkSession,
    input_dir: str,
    rules: Rules | str,
    success_dir: str,
    error_dir: str,
    write_empty_error: bool = False,
) -> DirectoryResult:
    """Validate all CSVs of a folder in one job; outputs are folders `source_file=<base>`.

    Files that cannot be read or lack a needed column are left out; the rest is written before
    DirectoryError reports them. Per-file counts go to `_sources` next to the typed rows. Rows are checked once, and
    all outputs appear together.
    """
    pin(spark)
    rules = as_rules(spark, rules)
    check_names(rules, (SOURCE,))
    files = read_csv_directory(spark, input_dir)
    staged = checked_rows(files, rules)
    bad = materialize(files.with_row_numbers(rejected_rows(staged)), "rejected")
    failed = materialize(files.failures(rules).select("file").distinct(), "failed-files")
    per_file = file_stats(files, bad).join(failed, "file", "left_anti").withColumn("file", base_of(F.col("file")))
    per_file = materialize(per_file, "file-stats")
    source = base_of(logical_name(decode_path(F.col("path")))).alias(SOURCE)
    with Publication(spark) as publication:
        typed = publication.staged(success_dir)
        write_typed(staged.filter("__ok").select(*_row_columns(rules), source), typed, SOURCE)
        per_file.write.mode("overwrite").parquet(f"{typed}/{SOURCES_TABLE}")
        clean = per_file.filter("invalid_rows = 0").select(F.col("file").alias(SOURCE)) if write_empty_error else None
        _write_directory_errors(files, bad.withColumn(SOURCE, base_of(F.col("file"))), clean, publication.staged(error_dir))

    summary = DirectorySummary(**directory_summary(per_file, failed).first().asDict())
    result = DirectoryResult(input_dir, summary.files, summary, success_dir, error_dir)
    if summary.failed_files:
        raise DirectoryError(
            f"directory validation completed with {summary.failed_files} failed file(s)", result
        )
    return result


def base_of(name: Column) -> Column:
    """A file's name without its extension."""
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def file_stats(files: CsvFiles, rejected: DataFrame) -> DataFrame:
    """file, total, valid and invalid rows: totals come from the block counts, not from another scan."""
    totals = files.blocks.groupBy("file").agg(F.sum(F.col("n") - F.col("headers")).alias("total_rows"))
    wrong = rejected.groupBy("file").agg(F.count("*").alias("invalid_rows"))
    invalid = F.coalesce("invalid_rows", F.lit(0).cast("bigint"))
    return totals.join(wrong, "file", "left").select(
        "file", "total_rows", (F.col("total_rows") - invalid).alias("valid_rows"), invalid.alias("invalid_rows")
    )


def directory_summary(per_file: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: files, failed_files and the row sums of the files that did not fail."""
    zero, counts = F.lit(0).cast("bigint"), ("total_rows", "valid_rows", "invalid_rows")
    sound = per_file.select(zero.alias("failed_files"), *counts)
    every = sound.unionByName(failed.select(F.lit(1).cast("bigint").alias("failed_files"), *[zero.alias(c) for c in counts]))
    return every.agg(
        F.count("*").alias("files"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("failed_files", *counts)],
    )


def _write_directory_errors(files: CsvFiles, bad: DataFrame, clean: DataFrame | None, path: str) -> None:
    """Error files of all sources in one write, whatever their headers, each part with the header of its rows.

    Lines are rendered here, so that a part is not bound to the columns of the others. A part is known by plan:
    source and header (parts of one input file may differ in theirs) have tasks of their own, and each of those gets
    the header line first. `clean` names sources without rejected rows that still get a header.
    """
    headers = files.headers().filter("header_cells IS NOT NULL").select("path", base_of(F.col("file")).alias(SOURCE), "header_cells")
    per_source = Window.partitionBy(SOURCE).orderBy("header_cells")
    headers = materialize(headers.withColumn("variant", F.dense_rank().over(per_source) - 1), "headers")
    variants = (headers.agg(F.max("variant")).first()[0] or 0) + 1
    key = F.concat_ws("\u0001", SOURCE, F.col("variant").cast("string")).alias("key")
    shapes = headers.select("path", "header_cells", "variant")
    rows = bad.join(files.per_split(shapes), STRETCH).withColumn("key", key)
    cells = F.slice(F.array(*original_cells(files.width)), 1, F.size("header_cells"))
    line = csv_line([F.col(c) for c in ERROR_COLUMNS], cells)
    rows = rows.select("key", SOURCE, "variant", "path", "block", "id", line.alias("value"))
    sizes = rows.groupBy("key", *STRETCH).agg(F.sum(F.octet_length("value").cast("bigint")).alias("bytes"))
    placed, plan, tasks = placed_rows(rows, materialize(sizes, "error-stretches"), "key", STRETCH, part_order())

    titles = headers.select(SOURCE, "variant", "header_cells", key).distinct()
    parts = plan.select(F.col("key").alias("__key"), "task").distinct()
    titles_of_parts = titles.join(parts, F.col("key") == F.col("__key"))
    if clean is not None:
        idle = titles.where("variant = 0").join(clean, SOURCE, "left_semi")
        titles_of_parts = titles_of_parts.select(SOURCE, "variant", "header_cells", "task").unionByName(
            idle.select(SOURCE, "variant", "header_cells", F.pmod(F.xxhash64(SOURCE), F.lit(tasks)).cast("int").alias("task"))
        )
    title = csv_line([F.lit(c) for c in ERROR_COLUMNS], F.col("header_cells")).alias("value")
    place = (F.col("variant") * tasks + F.col("task")).cast("int").alias("task")
    nothing = [F.lit(None).cast("string").alias("path"), *[F.lit(None).cast("bigint").alias(c) for c in ("block", "id")]]
    lines = titles_of_parts.select(SOURCE, place, F.lit(0).alias("kind"), *nothing, title).unionByName(
        placed.select(SOURCE, place, F.lit(1).alias("kind"), "path", "block", "id", "value")
    )
    write_lines(lines, int(variants) * tasks, [F.col("kind"), *part_order(), F.col("id")], path, SOURCE)


def write_header_only(sources: DataFrame, error_dir: str) -> None:
    """Error files without rows: `sources` has the source and its header record."""
    line = F.concat(F.lit(",".join(ERROR_COLUMNS) + ","), F.col("header")).alias("value")
    folders(sources.select(line, SOURCE).write.mode("append"), SOURCE).text(error_dir)


# -- auto ----------------------------------------------------------------------------------------


@job
def auto(
    spark: SparkSession,
    input_csv: str,
    rules: Rules | str,
    split_dir: str | None = None,
    success_dir: str | None = None,
    error_dir: str | None = None,
    batch_dir: str | None = None,
    batch_export_dir: str | None = None,
    key: str | None = None,
    missing_file: str = MISSING_KEYS_FILE,
    batch_size: int = 1000,
    write_empty_error: bool = False,
    clear: bool = True,
    write_split: bool = False,
    folder_per_key: bool = False,
) -> AutoResult:
    """Split by key, validate every key file, batch the typed rows: one pass from scan to checked rows.

    The key files exist as a column, not as files: `success_dir` and `error_dir` hold one table each, with
    the key file in `source_file` and rows of a key side by side. `folder_per_key` writes a folder per
    key file instead, `write_split` also the split CSVs; both cost a file per key. The checked rows are
    kept once as a scratch table that feeds all outputs. `clear=False` adds to all outputs of earlier runs;
    new batches are numbered after the ones that are there.
    """
    pin(spark)
    schema_path = rules if isinstance(rules, str) else ""
    rules = as_rules(spark, rules)
    check_names(rules, (SOURCE, BATCH_FOLDER, *WORK_COLUMNS))
    home = os.path.dirname(input_csv.rstrip("/"))
    split_dir = split_dir or f"{home}/split"
    success_dir = success_dir or f"{home}/success"
    error_dir = error_dir or f"{home}/errors"
    export_dir = batch_export_dir or f"{home}/batch_export"
    if absolute(spark, batch_dir or success_dir) == absolute(spark, export_dir):
        raise ValueError("batch_export_dir must differ from batch_dir")
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    if clear:
        for old in (split_dir, success_dir, error_dir, export_dir):
            remove(spark, old)

    files = read_csv_file(spark, input_csv)
    header = file_header(files)
    chosen = strip(key) if key and key.strip() else detect_key(header)
    position = key_position(header, chosen)
    keyed = _keyed_records(files, position, missing_file)
    # a lone blank cell is a blank line once it is split into its own file, and is skipped there
    kept = F.lit(True) if len(header) > 1 else F.coalesce("cells.c0", F.lit("")) != ""
    rows_in = files.with_split_start(keyed.drop("record"))
    # one pass counts what each input split holds of each key, for the key files and for the row numbers in them
    counts = materialize(
        rows_in.groupBy("key_file", "split_start").agg(
            F.count("*").alias("rows"), F.count_if(~F.col("has_key")).alias("blank"), F.count_if(kept).alias("n")
        ),
        "key-counts",
    )
    listed = rows_of_stretches(counts.select("key_file", F.col("rows").alias("n"), "blank"))
    per_key = materialize(listed, "key-files")
    split = SplitSummary(**split_summary(per_key).first().asDict())
    if write_split:
        stretches = materialize(key_stretches(keyed, STRETCH, F.octet_length("record").cast("bigint")), "key-stretches")
        _write_split(keyed, stretches, header, split_dir)

    key_count = per_key.count()
    absent = rules.missing_headers(header)
    if absent:  # the header is the same in every key file, so all of them fail
        summary = DirectorySummary(key_count, key_count, 0, 0, 0)
        result = DirectoryResult(split_dir, key_count, summary, success_dir, error_dir)
        raise DirectoryError(f"directory validation completed with {key_count} failed file(s)", result)

    staged = staged_rows(rows_in.filter(kept), counts, rules, header)
    mode = "overwrite" if clear else "append"
    stats = materialize(key_file_stats(staged, per_key), "key-stats")
    sums = directory_summary(stats, stats.limit(0)).first()
    summary = DirectorySummary(**sums.asDict())
    bad = staged.filter("NOT __ok").withColumnRenamed("key_file", SOURCE)
    cells, folder = original_cells(len(header)), SOURCE if folder_per_key else None
    if folder:
        write_csv(bad, error_dir, header, cells, ERROR_COLUMNS, folder, mode)
    elif summary.invalid_rows or write_empty_error:
        # without rejected rows this is a header and nothing else, written on request
        write_csv(bad, error_dir, header, cells, [SOURCE, *ERROR_COLUMNS], mode=mode)
    typed = staged.filter("__ok").select("key_file", "__row_number", *_row_columns(rules))
    write_typed(typed.drop("__row_number").withColumnRenamed("key_file", SOURCE), success_dir, folder, mode)
    stats.write.mode(mode).parquet(f"{success_dir.rstrip('/')}/{SOURCES_TABLE}")
    if write_empty_error and folder:
        record = files.files.select("header").first().header
        clean = stats.filter("invalid_rows = 0").select(F.col("file").alias(SOURCE), F.lit(record).alias("header"))
        write_header_only(clean, error_dir)
    validation = DirectoryResult(split_dir, key_count, summary, success_dir, error_dir)

    if batch_dir and absolute(spark, batch_dir) != absolute(spark, success_dir):
        batch = batch_directory(spark, batch_dir, export_dir, batch_size, clear=clear)
    else:
        batches = materialize(key_batches(stats, batch_size), "key-batches")
        rows = batched_rows(typed, batches, key_count)
        # batches kept from earlier runs keep their numbers
        kept = 0 if clear else last_batch(spark, export_dir)
        rows = rows.withColumn("batch_no", F.col("batch_no") + kept)
        write_batches(rows, ["file_rank", "__row_number"], export_dir, mode)
        count = batches.agg(F.max("batch_no")).first()[0] or 0
        batch = BatchSummary(key_count, count, batch_size, summary.valid_rows, export_dir)
    return AutoResult(input_csv, schema_path, chosen, split, validation, batch)


def last_batch(spark: SparkSession, export_dir: str) -> int:
    """The largest batch number a folder holds, 0 without any."""
    names = glob(spark, f"{export_dir.rstrip('/')}/{BATCH_FOLDER}=*")
    return max((int(n.rsplit("=", 1)[1]) for n in names), default=0)


def staged_rows(keyed: DataFrame, counts: DataFrame, rules: Rules, header: list[str]) -> DataFrame:
    """Checked rows numbered inside their key file, written once as a scratch table.

    `counts` has the rows `n` of each key_file and split_start. Columns: key_file, __row_number, __ok, `row` (typed
    columns) or `__errors` and `cells`.
    """
    at = {strip(name): F.col(f"cells.c{i}") for i, name in enumerate(header)}
    numbered = number_within(keyed, "key_file", [F.col("split_start")], ["id"], first=2, counts=counts)
    gate = validate(numbered, rules, keep=["key_file", "__row_number", "cells"], cells=at)
    staged = gate.staged("key_file", "__row_number", rejected_only=["cells"])
    return materialize(staged, "staged", partition="__ok")


def key_file_stats(staged: DataFrame, per_key: DataFrame) -> DataFrame:
    """file, total, valid and invalid rows of every key file, also of those without staged rows."""
    counted = staged.groupBy("key_file").agg(
        F.count("*").alias("total_rows"), F.count_if("__ok").alias("valid_rows")
    )
    zero = F.lit(0).cast("bigint")
    total, valid = F.coalesce("total_rows", zero), F.coalesce("valid_rows", zero)
    return per_key.select(F.col("key_file")).join(counted, "key_file", "left").select(
        F.col("key_file").alias("file"),
        total.alias("total_rows"),
        valid.alias("valid_rows"),
        (total - valid).alias("invalid_rows"),
    )


def key_batches(stats: DataFrame, batch_size: int) -> DataFrame:
    """file_rank, batch_no, rows_before (valid rows of the same batch in earlier files) per key file."""
    names = stats.select(F.concat("file", F.lit(".parquet")).alias("file"))
    ranked = assign_batches(names, batch_size).withColumn("key_file", F.expr("left(file, length(file) - 8)"))
    counts = stats.select(F.col("file").alias("key_file"), "valid_rows")
    earlier = Window.partitionBy("batch_no").orderBy("file_rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("valid_rows").over(earlier), F.lit(0))
    return ranked.join(counts, "key_file").select(
        "key_file", "file_rank", "batch_no", before.alias("rows_before"), "valid_rows"
    )


def batched_rows(typed: DataFrame, batches: DataFrame, key_count: int) -> DataFrame:
    """Typed rows with their batch and the output part: every part holds about TASK_ROWS rows."""
    joined = typed.join(small_side(batches.drop("valid_rows"), key_count, ROW_BYTES), "key_file")
    part = F.floor((F.col("rows_before") + F.col("__row_number")) / TASK_ROWS)
    return joined.withColumn("__part", part).drop("rows_before", "key_file")


def _row_columns(rules: Rules) -> list[Column]:
    """Typed columns of a staged row; required ones non-nullable again (a scratch table forgets it)."""
    values = [(r, F.col("row")[r.output]) for r in rules.fields]
    return [(not_null(r, v) if r.required else v).alias(r.output) for r, v in values]
