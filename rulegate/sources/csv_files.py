"""CSV files as a table of records: exact record numbers, per-file headers, whole-file failure.

The files are read as text lines, so every file stays splittable. The lines are scanned once, of a folder with many
files a stretch of files at a time, and written to scratch storage with their file, split and an id; everything else
reads that table, so record numbers and headers cannot depend on how another scan would be split. One narrow pass over it builds
a `blocks` table (one row per input split): record counts, the first record and the first malformed one.
Record numbers follow from it by a running sum over blocks, never over rows. Files whose quoted cells
span lines take a second route that glues their lines; all other files never pay for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rulegate.functions.text import decode_path, trim_cell
from rulegate.operators.validate import header_message
from rulegate.rules import Rules, strip
from rulegate.session import materialize, small_side
from rulegate.sources import inventory
from rulegate.sources.inventory import Paths, files_and_parts, gathered, matching, spot

CSV_GLOB = "*.[cC][sS][vV]"
KEY_FOLDER = "key_file="  # folders written by the split job: one logical file each
SPLIT = ["path", "block"]
GLUED_RANGE = 100_000  # records of a file with multi-line cells that count as one split
ROW_BYTES = 400  # generous size of one blocks row (path text plus counters)
FEW_FILES = 100  # header lines of up to so many files are dropped by a list of ids instead of a join

MALFORMED = r'[^,"]"|"[^,"]'


def record_text(line: Column) -> Column:
    """A line without the carriage return of a CR LF ending."""
    return F.when(line.endswith("\r"), F.substring(line, 1, F.length(line) - 1)).otherwise(line)


def quote_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"')))


def broken_quotes(line: Column) -> Column:
    """True for text with an even number of quotes that breaks the quoting rules.

    Each quoted stretch shrinks to one quote character; what is left of a sound record has quotes only
    next to commas and the ends.
    """
    return line.contains('"') & F.regexp_replace(line, '"[^"]*"', '"').rlike(MALFORMED)


def first_cells(record: Column, width: int) -> Column:
    """A record cut after its first `width` cells, so that no record is wider than the parser expects.

    Fewer commas than that cannot hold more cells; without quotes a comma always ends a cell.
    """
    commas = F.length(record) - F.length(F.replace(record, F.lit(","), F.lit("")))
    cell = '[^,"]*+(?:"[^"]*+"[^,"]*+)*+'
    quoted = F.regexp_extract(record, f"^{cell}(?:,{cell}){{0,{width - 1}}}+", 0)
    cut = F.when(record.contains('"'), quoted).otherwise(F.substring_index(record, ",", width))
    return F.when(commas >= width, cut).otherwise(record)


def parsed_cells(record: Column, width: int) -> Column:
    """Struct c0..cN of the cells of a record; NULL where the record is too short, surplus cells cut."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(first_cells(record, width), schema, {"escape": '"', "maxColumns": str(width + 1)})


def width_bound(record: Column) -> Column:
    """At least the number of cells of a record (exact when no cell holds a comma)."""
    return F.size(F.split(record, ","))


def logical_name(path: Column) -> Column:
    """Name of the file a part belongs to: `<name>.csv` files, folders of that name, split folders."""
    parent = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    split_folder = F.concat(
        decode_path(F.substring(parent, len(KEY_FOLDER) + 1, 2**31 - 1)), F.lit(".csv")
    )
    own = F.substring_index(path, "/", -1)
    return (
        F.when(parent.startswith(KEY_FOLDER), split_folder)
        .when(F.lower(parent).endswith(".csv"), parent)
        .otherwise(own)
    )


def part_order() -> list[Column]:
    """Input order of the parts and splits of a logical file: `part-99999` comes before `part-100000`."""
    return [F.length("path"), F.col("path"), F.col("block")]


def csv_paths(spark: SparkSession, directory: str) -> dict[str, Paths]:
    """What a directory holds for the CSV jobs: `*.csv` in any case and split folders, not recursive."""
    folder = directory.rstrip("/")
    found = {pattern: matching(spark, pattern) for pattern in (f"{folder}/{CSV_GLOB}", f"{folder}/{KEY_FOLDER}*")}
    return {pattern: paths for pattern, paths in found.items() if paths.number}


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Text lines with their file and split."""
    return located(spark.read.option("lineSep", "\n").text(list(paths)))


def located(lines: DataFrame) -> DataFrame:
    """Add file and split position to a text source (batch or one streaming micro-batch).

    The two functions read the position of the running task; the `_metadata` column would copy it into
    every row.
    """
    return lines.select(
        F.input_file_name().alias("path"),
        F.input_file_block_start().alias("block"),
        record_text(F.col("value")).alias("record"),
    )


def read_csv_directory(spark: SparkSession, directory: str) -> CsvFiles:
    paths = csv_paths(spark, directory)
    if not paths:
        raise FileNotFoundError(f"no csv files found in directory: {directory}")
    # parts of split folders always hold a header; only plain files can be empty and need the listing
    plain = [p for p in paths if not p.endswith(f"{KEY_FOLDER}*")]
    listing = list_files(spark, plain[0]) if plain else None
    if sum(found.number for found in paths.values()) > inventory.STRETCH:
        return CsvFiles(None, listing, places=paths)
    return CsvFiles(read_lines(spark, *paths), listing)


def read_csv_file(spark: SparkSession, path: str) -> CsvFiles:
    return CsvFiles(read_lines(spark, path), list_files(spark, path))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """listed, hidden: every input file, also empty ones and those Spark passes over by their names.

    Folders of parts count by their parts that hold something; one without any is listed itself.
    """
    return files_and_parts(spark, pattern).select(F.col("path").alias("listed"), "hidden")


@dataclass(frozen=True)
class CsvFiles:
    """Records of a set of CSV files; the small tables behind it live in scratch storage."""

    lines: DataFrame | None
    listing: DataFrame | None = None
    by_path: bool = False  # every physical file stands for itself, parts are not folded into one file
    places: dict[str, Paths] | None = None  # instead of `lines`: files too many for one scan

    def _name(self, path: Column) -> Column:
        return path if self.by_path else logical_name(path)

    # -- one narrow pass over the lines ---------------------------------------------------------

    @cached_property
    def numbered(self) -> DataFrame:
        """Lines that hold text, with an id that grows inside each split; the one scan of the input."""
        text = F.col("record") != ""
        if self.places is None:
            return materialize(self.lines.filter(text).withColumn("id", F.monotonically_increasing_id()), "csv-lines")
        return self._gathered(text, "csv-lines")

    def _gathered(self, kept: Column, label: str) -> DataFrame:
        """Lines of many files with an id that grows inside each split; a scratch table."""
        return gathered(self.places, lambda spark, some: read_lines(spark, *some).filter(kept), label, ids=True)

    @cached_property
    def line_blocks(self) -> DataFrame:
        """Per split: line count, first id, odd-quote lines, first malformed line.

        Only fixed-width results, so Spark aggregates by hash while it reads and sorts nothing.
        """
        record = F.col("record")
        odd = record.contains('"') & (quote_count(record) % 2 == 1)
        summary = self.numbered.groupBy("path", "block").agg(
            F.min("id").alias("first_id"),
            F.count("*").alias("n"),
            F.count_if(odd).alias("odd_lines"),
            F.min(F.when(broken_quotes(record), F.col("id"))).alias("bad_id"),
        )
        return materialize(summary, "csv-line-blocks")

    @cached_property
    def split_count(self) -> int:
        return self.line_blocks.count()

    @cached_property
    def first_lines(self) -> DataFrame:
        """path, record: the first line with text of every file."""
        of_file = Window.partitionBy("path").orderBy("block")
        first = self.line_blocks.withColumn("at", F.row_number().over(of_file)).filter("at = 1")
        ids = first.select(F.col("first_id").alias("id"))
        # the first text of a file is in its first split unless that is blank: later splits are not even read
        last = first.agg(F.max("block")).first()[0]
        lines = self.numbered.filter(F.col("block") <= F.lit(last)).select("path", "id", "record")
        found = lines.join(small_side(ids, self.split_count, 16), "id", "left_semi")
        return materialize(found.select("path", "record"), "csv-first-lines")

    # -- files whose quoted cells span lines ----------------------------------------------------

    @cached_property
    def has_glued(self) -> bool:
        return not self.line_blocks.filter("odd_lines > 0").isEmpty()

    def glued_paths(self) -> DataFrame:
        """Files with a line that opens or closes a quoted cell of several lines."""
        paths = self.line_blocks.filter("odd_lines > 0").select("path").distinct()
        return small_side(paths, self.split_count, ROW_BYTES)

    def per_split(self, facts: DataFrame) -> DataFrame:
        """Facts about files (by path) as facts about their splits (path, block): rows that look them up meet by
        split, so one very large file is no hot key."""
        splits = self.line_blocks.select("path", "block")
        if self.has_glued:
            splits = splits.unionByName(self.blocks.select("path", "block")).distinct()
        return small_side(splits.join(facts, "path"), self.split_count, ROW_BYTES)

    @cached_property
    def quoted_lines(self) -> DataFrame:
        """Lines of those files with their record number and quoting state."""
        lines = self.lines if self.places is None else self._gathered(F.lit(True), "csv-all-lines")
        lines = lines.join(self.glued_paths(), "path", "left_semi")
        return number_quoted_lines(lines, self.split_count)

    @cached_property
    def quote_failures(self) -> DataFrame:
        """First unreadable record of those files: broken quotes, or quotes still open at the end."""
        last = F.max_by("ends_inside", F.struct("block", "id"))
        open_record = F.max(F.col("record_no"))
        bad = F.coalesce(F.min(F.when(F.col("broken"), F.col("record_no"))), F.when(last, open_record))
        found = self.quoted_lines.groupBy("path").agg(bad.alias("bad_id")).filter("bad_id IS NOT NULL")
        return materialize(found, "csv-quote-failures")

    @cached_property
    def glued(self) -> DataFrame:
        """Records of those files that are sound: path, id (header is 0), record."""
        sound = self.quoted_lines.join(
            small_side(self.quote_failures.select("path"), self.split_count, ROW_BYTES), "path", "left_anti"
        )
        return materialize(glue_records(sound), "csv-glued")

    # -- small tables ---------------------------------------------------------------------------

    @cached_property
    def blocks(self) -> DataFrame:
        """Per split of every file: ids, counts and the number of data records before it."""
        plain = self.line_blocks.drop("odd_lines")
        if self.has_glued:
            zero = F.lit(0).cast("bigint")
            glued = self.glued.groupBy("path", glued_range(F.col("id")).alias("block")).agg(
                F.min("id").alias("first_id"),
                F.count("*").alias("n"),
                F.lit(None).cast("bigint").alias("bad_id"),
            )
            failed = self.quote_failures.select(
                "path",
                zero.alias("block"),
                zero.alias("first_id"),
                zero.alias("n"),
                "bad_id",
            )
            plain = plain.join(self.glued_paths(), "path", "left_anti").unionByName(glued).unionByName(failed)
        of_file = Window.partitionBy("path").orderBy("block")
        of_name = Window.partitionBy("file").orderBy(*part_order())
        before = of_name.rowsBetween(Window.unboundedPreceding, -1)
        table = (
            plain.withColumn("file", self._name(decode_path(F.col("path"))))
            .withColumn("headers", F.when(F.row_number().over(of_file) == 1, 1).otherwise(0))
            .withColumn("before", F.coalesce(F.sum(F.col("n") - F.col("headers")).over(before), F.lit(0)))
        )
        return materialize(table, "csv-blocks")

    @cached_property
    def files(self) -> DataFrame:
        """One row per physical file: header record, id of the header, why the file is unreadable."""
        row = F.col("before") + F.col("bad_id") - F.col("first_id") + 2 - F.col("headers")
        first = F.col("headers") == 1
        seen = self.blocks.groupBy("path", "file").agg(
            F.max(F.when(first, F.col("first_id"))).alias("header_id"),
            F.min(row).alias("bad_row"),
        )
        headers = self.first_lines
        if self.has_glued:
            whole = self.glued.filter("id = 0").select("path", "record")
            headers = headers.join(self.glued_paths(), "path", "left_anti").unionByName(whole)
        seen = seen.join(headers.withColumnRenamed("record", "header"), "path", "left")
        failure = F.when(F.col("bad_row") == 1, F.lit("read header: malformed quotes")).when(
            F.col("bad_row").isNotNull(),
            F.concat(F.lit("read row "), F.col("bad_row"), F.lit(": malformed quotes")),
        )
        table = seen.select("path", "file", "header", "header_id", failure.alias("failure"))
        if self.listing is not None:
            # files without a single record only show up in the listing, whose paths are spelled plainly
            listed = self.listing.select(spot(F.col("listed")).alias("spot"), "hidden")
            known = table.select(spot(decode_path(F.col("path"))).alias("spot"))
            empty = listed.join(known, "spot", "left_anti").select(
                F.col("spot").alias("path"),
                self._name(F.col("spot")).alias("file"),
                F.lit(None).cast("string").alias("header"),
                F.lit(None).cast("bigint").alias("header_id"),
                F.when(F.col("hidden"), F.lit("read header: names starting with _ or . cannot be read"))
                .otherwise(F.lit("read header: EOF"))
                .alias("failure"),
            )
            table = table.unionByName(empty)
        return materialize(table, "csv-files")

    @cached_property
    def file_count(self) -> int:
        return self.files.count()

    @cached_property
    def width(self) -> int:
        """Cells to parse per record: no header is wider."""
        return self.files.agg(F.max(width_bound(F.col("header")))).first()[0] or 1

    @cached_property
    def only_header(self) -> list[str] | None:
        """Cells of the header when all readable files have the same one, else None."""
        found = self.headers().filter("header_cells IS NOT NULL").select("header_cells").distinct().limit(2).collect()
        return list(found[0].header_cells) if len(found) == 1 else None

    @cached_property
    def all_readable(self) -> bool:
        return self.files.filter("failure IS NOT NULL").isEmpty()

    def headers(self) -> DataFrame:
        """path, file, header_cells (untrimmed, exact width), failure; one row per physical file."""
        cells = F.array(*[F.col(f"__h.c{i}") for i in range(self.width)])
        # an absent cell and a blank one parse alike: count the commas outside quotes
        outside = F.regexp_replace(F.col("header"), '"[^"]*"', "")
        exact = F.slice(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), 1, width_bound(outside))
        return (
            self.files.withColumn("__h", parsed_cells(F.col("header"), self.width))
            .withColumn("header_cells", F.when(F.col("failure").isNull(), exact))
            .select("path", "file", "header_cells", "failure")
        )

    def positions(self, rules: Rules) -> DataFrame:
        """Per physical file and rule: index of the rule's column (the last of equal names) or NULL."""
        trimmed = F.reverse(F.transform("header_cells", trim_cell))
        frame = self.headers().withColumn("__names", trimmed)
        for i, rule in enumerate(rules.fields):
            at = F.array_position("__names", F.lit(rule.name))
            frame = frame.withColumn(f"__at{i}", F.when(at > 0, F.size("__names") - at.cast("int")))
        absent = [
            F.when(F.col(f"__at{i}").isNull(), F.lit(header_message(r.name)))
            for i, r in enumerate(rules.fields)
            if r.needs_header
        ]
        reason = F.coalesce("failure", *absent)
        # parts of one logical file fail together
        whole = F.max(reason).over(Window.partitionBy("file"))
        return frame.withColumn("failure", whole).drop("__names")

    # -- records --------------------------------------------------------------------------------

    def records(self) -> DataFrame:
        """Data records (headers dropped): path, block, id, record. Order inside a file: block, id."""
        first_ids = self.files.filter("header_id IS NOT NULL").select("path", F.col("header_id").alias("id"))
        if not self.has_glued:
            return self._without(self.numbered, first_ids)
        plain = self.numbered.join(self.per_split(self.glued_paths()), SPLIT, "left_anti")
        plain_firsts = first_ids.join(self.glued_paths(), "path", "left_anti")
        glued = self.glued.filter("id > 0").select("path", glued_range(F.col("id")).alias("block"), "record", "id")
        return self._without(plain, plain_firsts).unionByName(glued)

    def _without(self, lines: DataFrame, first_ids: DataFrame) -> DataFrame:
        """Drop the header lines; ids are unique over all splits, so comparing numbers is enough."""
        if self.file_count <= FEW_FILES:
            ids = [r.id for r in first_ids.select("id").collect()]
            return lines.filter(~F.col("id").isin(ids)) if ids else lines
        return lines.join(small_side(first_ids.select("id"), self.file_count, 16), "id", "left_anti")

    def table(self, rules: Rules) -> tuple[DataFrame, dict[str, Column]]:
        """Records of the files that pass the header check, and where each rule finds its cell.

        Columns: path, block, id, `cells` (struct). With one header for all files the positions are
        constants; otherwise they come from a join with the per-file positions.
        """
        records, same = self.records(), self.only_header
        positions = None
        if same is None or not self.all_readable or rules.missing_headers(same):
            positions = materialize(self.positions(rules), "csv-positions")
            failed = positions.filter("failure IS NOT NULL").select("path")
            if not failed.isEmpty():
                records = records.join(self.per_split(failed), SPLIT, "left_anti")
        parsed = records.withColumn("cells", parsed_cells(F.col("record"), self.width)).drop("record")
        if same is not None and rules.missing_headers(same):
            # every readable file has this header, so none is sound: nothing to check, all in `failures`
            return parsed.filter(F.lit(False)), {r.name: F.lit(None).cast("string") for r in rules.fields}
        if same is not None:
            return parsed, {strip(name): F.col(f"cells.c{i}") for i, name in enumerate(same)}
        names = [f"__at{i}" for i in range(len(rules.fields))]
        spots = positions.filter("failure IS NULL").select("path", *names)
        located_rows = parsed.join(self.per_split(spots), SPLIT)
        every = F.array(*[F.col(f"cells.c{i}") for i in range(self.width)])
        return located_rows, {
            r.name: F.get(every, F.col(f"__at{i}")) for i, r in enumerate(rules.fields)
        }

    def with_row_numbers(self, records: DataFrame) -> DataFrame:
        """Add `file` and `__row_number` (header is 1) to rows that still carry path, block and id."""
        offsets = self.blocks.select("path", "block", "file", "first_id", "before", "headers")
        joined = records.join(small_side(offsets, self.split_count, ROW_BYTES), ["path", "block"], "left")
        lost = F.raise_error(F.concat(F.lit("no split found for a record of "), F.col("path"))).cast("bigint")
        number = F.coalesce("before", lost) + F.col("id") - F.col("first_id") + 2 - F.col("headers")
        return joined.withColumn("__row_number", number).drop("first_id", "before", "headers")

    def with_split_start(self, records: DataFrame) -> DataFrame:
        """`split_start` in place of path and block: the data records of their logical file before their split. One
        number that orders the splits of a file, so rows need not be shuffled and sorted with the text of their path."""
        starts = self.blocks.select(*SPLIT, F.col("before").cast("bigint").alias("split_start"))
        return records.join(small_side(starts, self.split_count, ROW_BYTES), SPLIT).drop(*SPLIT)

    def failures(self, rules: Rules) -> DataFrame:
        """Files that cannot be processed: path, file, failure."""
        return self.positions(rules).filter("failure IS NOT NULL").select("path", "file", "failure")


def glued_range(record_no: Column) -> Column:
    return F.floor(record_no / GLUED_RANGE)


def number_quoted_lines(lines: DataFrame, splits: int) -> DataFrame:
    """Record number (header is 0) and quoting state of every line; kept as a scratch table.

    A line opens inside quotes when an odd number of quotes precedes it in its file. Lines are ordered
    inside one input split only, a window of bounded size; totals per split carry the state across.
    """
    in_split = Window.partitionBy("path", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    marked = lines if "id" in lines.columns else lines.withColumn("id", F.monotonically_increasing_id())
    counted = materialize(
        marked.withColumn("quotes", quote_count(F.col("record"))),
        "csv-counted-lines",
    )
    opening = (
        counted.groupBy("path", "block")
        .agg(F.sum("quotes").alias("quotes"))
        .select("path", "block", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("quotes_before"))
    )
    opens, ends = F.col("opens_inside"), F.col("ends_inside")
    completed = F.concat(
        F.when(opens, F.lit('"')).otherwise(F.lit("")),
        F.col("record"),
        F.when(ends, F.lit('"')).otherwise(F.lit("")),
    )
    lined = materialize(
        counted.join(small_side(opening, splits, ROW_BYTES), ["path", "block"])
        .withColumn("quotes_after", F.sum("quotes").over(in_split) + F.col("quotes_before"))
        .withColumn("opens_inside", (F.col("quotes_after") - F.col("quotes")) % 2 == 1)
        .withColumn("ends_inside", F.col("quotes_after") % 2 == 1)
        .withColumn("starts", F.when(opens | (F.col("record") == ""), 0).otherwise(1))
        .withColumn("started", F.sum("starts").over(in_split))
        .filter(opens | (F.col("record") != ""))
        .withColumn("broken", broken_quotes(completed))
        .select("path", "block", "id", "record", "opens_inside", "ends_inside", "broken", "starts", "started"),
        "csv-quoted-lines",
    )
    offsets = (
        lined.groupBy("path", "block")
        .agg(F.sum("starts").alias("starts"))
        .select("path", "block", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("starts_before"))
    )
    return (
        lined.join(small_side(offsets, splits, ROW_BYTES), ["path", "block"])
        .withColumn("record_no", F.col("starts_before") + F.col("started") - 1)
        .drop("starts", "started", "starts_before")
    )


def glue_records(lines: DataFrame) -> DataFrame:
    """One row per record; only the lines of multi-line records are brought together."""
    inside = F.col("opens_inside") | F.col("ends_inside")
    single = lines.filter(~inside).select("path", F.col("record_no").alias("id"), "record")
    several = (
        lines.filter(inside)
        .groupBy("path", F.col("record_no").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("block", "id", "record"))).alias("parts"))
        .select("path", "id", F.array_join("parts.record", "\n").alias("record"))
    )
    return single.unionByName(several)
