"""Writing typed rows, error files and key files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, functions as F

# Row group size and the CSV dialect of the outputs.
ROW_GROUP_BYTES = 128 * 1024 * 1024
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
ERROR_COLUMNS = ["__row_number", "__errors"]

# For outputs with a folder per value. Without Hadoop's native library a local file system starts a process for every
# folder, file and checksum file it creates; the raw one leaves out the checksum files. Others ignore these options.
FOLDER_OPTIONS = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def folders(writer: DataFrameWriter, partition: str | None) -> DataFrameWriter:
    """The same writer, with one folder per value of `partition` when given."""
    return writer.options(**FOLDER_OPTIONS).partitionBy(partition) if partition else writer


def write_typed(df: DataFrame, path: str, partition: str | None = None, mode: str = "overwrite") -> None:
    """Snappy Parquet, one folder per value of `partition` when given."""
    writer = df.write.mode(mode).option("compression", "snappy").option("parquet.block.size", ROW_GROUP_BYTES)
    folders(writer, partition).parquet(path)


def csv_names(header: list[str], taken: list[str]) -> list[str]:
    """Column names for a header. Spark cannot write equal names (case aside): the last one keeps its
    spelling, as the rules read the last one, and earlier ones get a number."""
    seen = {t.lower() for t in taken}
    names: list[str] = []
    for cell in reversed(header):
        name, n = cell, 1
        while name.lower() in seen:
            n += 1
            name = f"{cell}_{n}"
        seen.add(name.lower())
        names.append(name)
    return names[::-1]


def write_csv(
    df: DataFrame,
    path: str,
    header: list[str],
    cells: list[Column],
    extra: list[str] = (),
    partition: str | None = None,
    mode: str = "overwrite",
) -> None:
    """CSV with a header in every part: `extra` columns, then the original cells (blank for NULL)."""
    leading = [F.col(c) for c in extra]
    names = csv_names(header, [*extra, *([partition] if partition else [])])
    body = [F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cells, names)]
    tail = [F.col(partition)] if partition else []
    writer = df.select(*leading, *body, *tail).write.mode(mode).options(**CSV_OPTIONS)
    folders(writer, partition).csv(path)


def csv_cell(cell: Column) -> Column:
    """A cell as CSV text: quoted when it holds a comma, a quote or a line break; blank for NULL."""
    text = F.coalesce(cell, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def csv_line(leading: list[Column], cells: Column) -> Column:
    """One CSV record: leading columns, then the cells of an array."""
    first = [csv_cell(c.cast("string")) for c in leading]
    return F.concat_ws(",", *first, F.transform(cells, csv_cell))


def write_lines(lines: DataFrame, tasks: int, order: list[Column], path: str, partition: str) -> None:
    """Write `value` lines in one job: rows with `task` go to that task, sorted by `partition` and `order`."""
    placed = lines.repartitionById(tasks, "task").sortWithinPartitions(partition, *order)
    folders(placed.select("value", partition).write, partition).option("lineSep", "\n").text(path)
