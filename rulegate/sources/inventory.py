"""What lies in a folder: one row per entry, whatever its name or size.

Spark's file sources pass over names that start with _ or . and over empty files, so a job that has to account
for every file asks the file system itself. Its answer, the paths, is taken over a stretch at a time as one text,
which is split into rows by Spark. Files Spark reads have their sizes from a scan that opens none of them; only what
is left, folders and the files it passes over, is asked for one by one. How a file system prints whole entries is of
no use: a local one starts a process per entry to learn its permissions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulegate.session import escaped, file_system, hadoop_path, materialize, scratch_path

HIDDEN = ("_", ".")  # Spark's readers pass over such names
STRETCH = 20_000  # entries taken over, and files read, at once
SCHEMA = "path string, folder boolean, length bigint"
FEW = 64  # entries asked for one by one, instead of by a scan
BETWEEN = "\u0000"


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def is_hidden(path: Column) -> Column:
    return name_of(path).rlike("^[_.]")


def spot(path: Column) -> Column:
    """Path without scheme, the common spelling of listed and scanned files."""
    return F.regexp_replace(path, "^[a-zA-Z0-9]+:/+", "/")


class Paths:
    """Paths of some entries a file system found: how many there are, and a stretch of them at a time.

    A file system answers with an object of about half a kilobyte per entry. It is let go when the paths are taken
    over as text; text of more than a stretch waits in scratch storage.
    """

    def __init__(self, spark: SparkSession, found):
        self.spark, self.number, self.text, self.table = spark, len(found) if found else 0, "", None
        if not self.number:
            return
        listed = spark._jvm.scala.Predef.genericWrapArray(spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))
        if self.number <= STRETCH:
            self.text = listed.mkString(BETWEEN)
            return
        self.size, self.table = STRETCH, scratch_path(spark, "names")
        for start in range(0, self.number, self.size):
            row = (start, listed.slice(start, start + self.size).mkString(BETWEEN))
            spark.createDataFrame([row], "start int, text string").coalesce(1).write.mode("append").parquet(self.table)

    def __iter__(self) -> Iterator[list[str]]:
        if self.text:
            yield self.text.split(BETWEEN)
        if self.table:
            kept = self.spark.read.schema("start int, text string").parquet(self.table)
            for start in range(0, self.number, self.size):
                yield kept.where(F.col("start") == start).first().text.split(BETWEEN)


def matching(spark: SparkSession, pattern: str) -> Paths:
    """What matches a glob, in the order of the names."""
    path = hadoop_path(spark, pattern)
    return Paths(spark, file_system(spark, path).globStatus(path))


def inside(spark: SparkSession, folders: list[str], kind: str) -> Paths:
    """What lies in some folders and has a name like the glob `kind`; a plain file among them stands for itself."""
    jvm = spark._jvm
    strings = jvm.org.apache.hadoop.util.StringUtils
    places = strings.stringToPath(strings.getStrings(BETWEEN.join(folders), BETWEEN))
    fs = file_system(spark, hadoop_path(spark, folders[0]))
    return Paths(spark, fs.listStatus(places, jvm.org.apache.hadoop.fs.GlobFilter(kind)))


def gathered(places: dict[str, Paths], read: Callable[[SparkSession, list[str]], DataFrame], label: str, ids: bool = False) -> DataFrame:
    """Rows that `read` makes of a list of paths, for all places: what is read at once when they are few, with its paths.

    The driver holds about two kilobytes for every file one scan reads. More than a stretch of them are therefore read
    a stretch at a time into a scratch table. `ids` adds an `id` there that grows inside each input split.
    """
    spark = next(iter(places.values())).spark
    if sum(p.number for p in places.values()) <= STRETCH:
        return read(spark, list(places))
    tasks_before, table = 0, scratch_path(spark, label)
    for found in places.values():
        for paths in found:
            rows = read(spark, [escaped(p) for p in paths])
            if ids:
                tasks = rows.rdd.getNumPartitions()
                rows = rows.withColumn("id", F.monotonically_increasing_id() + F.lit(tasks_before << 33))
                tasks_before += tasks
            rows.write.mode("append").parquet(table)
    return spark.read.schema(rows.schema).parquet(table)


def entries(spark: SparkSession, *patterns: str) -> DataFrame:
    """path, folder, length (NULL for folders) of everything that matches one of the globs; a scratch table."""
    table = _empty(spark)
    for pattern in patterns:
        for paths in matching(spark, pattern):
            _sized(spark, paths, table)
    return spark.read.schema(SCHEMA).parquet(table)


def entries_inside(spark: SparkSession, folders: Iterable[list[str]], kind: str) -> DataFrame:
    """The same of what lies in folders, given a stretch at a time, and has a name like the glob `kind`."""
    table = _empty(spark)
    for some in folders:
        plain = set(some)
        for paths in inside(spark, some, kind):
            _sized(spark, [p for p in paths if p not in plain], table)
    return spark.read.schema(SCHEMA).parquet(table)


def stretches(rows: Iterator, size: int) -> Iterator[list]:
    while part := list(islice(rows, size)):
        yield part


def _empty(spark: SparkSession) -> str:
    table = scratch_path(spark, "inventory")
    spark.createDataFrame([], SCHEMA).write.parquet(table)
    return table


def _sized(spark: SparkSession, paths: list[str], table: str) -> None:
    """Add the entries of a stretch of paths: sizes of many by a scan, the rest one by one."""
    if len(paths) > FEW:
        lines = spark.createDataFrame([(BETWEEN.join(paths),)], "text string").select(F.explode(F.split("text", BETWEEN)).alias("path"))
        binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([escaped(p) for p in paths])
        known = materialize(lines.join(binary.select("path", "length"), "path", "left"), "sizes")
        known.where("length IS NOT NULL").select("path", F.lit(False).alias("folder"), "length").write.mode("append").parquet(table)
        paths = [r.path for r in known.where("length IS NULL").select("path").collect()]
    if paths:
        _asked(spark, paths, table)


def _asked(spark: SparkSession, paths: list[str], table: str) -> None:
    """Entries of some paths, one by one."""
    fs = file_system(spark, hadoop_path(spark, paths[0]))
    states = [(p, fs.getFileStatus(hadoop_path(spark, p))) for p in paths]
    rows = [(p, s.isDirectory(), None if s.isDirectory() else s.getLen()) for p, s in states]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(table)


def files_and_parts(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length, hidden: files that match a glob, and of matching folders the parts that hold something.

    A folder without any such part is listed itself, with length 0. Parts with hidden names are Spark's own.
    """
    top = entries(spark, pattern)
    folders = stretches((r.path for r in top.where("folder").select("path").toLocalIterator()), STRETCH)
    below = entries_inside(spark, folders, "*").where("NOT folder AND length > 0").where(~is_hidden(F.col("path")))
    parts = below.select("path", "length", F.lit(False).alias("hidden"))
    hidden = is_hidden(F.col("path")).alias("hidden")
    plain = top.where("NOT folder").select("path", "length", hidden)
    holding = below.select(parent_of(F.col("path")).alias("__path")).distinct()
    bare = top.where("folder").join(holding, F.col("path") == F.col("__path"), "left_anti")
    return plain.unionByName(parts).unionByName(bare.select("path", F.lit(0).cast("bigint").alias("length"), hidden))
