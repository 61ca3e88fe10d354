"""Parquet files of a folder: inventory, schemas and row counts, without reading rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulegate.functions.text import decode_path
from rulegate.session import glob, matches, materialize, scratch_path
from rulegate.sources.inventory import BETWEEN, entries_inside, files_and_parts, is_hidden, matching, spot, stretches

PARQUET_GLOB = "*.[pP][aA][rR][qQ][uU][eE][tT]"
SOURCE_FOLDER = "source_file="  # folders written by the directory jobs: one logical file each
SOURCES_TABLE = "_sources"  # per-file counts next to them; Spark skips the name when reading rows
STRETCH = 10_000  # footers that become one part of the schema table
AT_ONCE = 16  # footers read side by side
TOGETHER = 500  # footers taken over as one text

UNREADABLE_NAME = "names starting with _ or . cannot be read"
NO_PARQUET = "not a Parquet file"

SCHEMA_START = "ParquetMetaData{FileMetaData{schema: "  # how the Parquet reader prints a footer
SCHEMA_END = "}\n, metadata: {"


def logical_parquet_name(path: Column) -> Column:
    parent = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    source = F.concat(
        decode_path(F.substring(parent, len(SOURCE_FOLDER) + 1, 2**31 - 1)), F.lit(".parquet")
    )
    return (
        F.when(parent.startswith(SOURCE_FOLDER), source)
        .when(F.lower(parent).endswith(".parquet"), parent)
        .otherwise(F.substring_index(path, "/", -1))
    )


def parquet_paths(spark: SparkSession, directory: str) -> list[str]:
    """Globs of what Spark can read of a folder."""
    folder = directory.rstrip("/")
    patterns = (f"{folder}/{PARQUET_GLOB}", f"{folder}/{SOURCE_FOLDER}*")
    return [p for p in patterns if matches(spark, p)]


def list_parquet(spark: SparkSession, directory: str) -> DataFrame:
    """path, length, file, problem: every Parquet file of a folder, not recursive, whatever its name or size.

    A logical file is a `.parquet` file, a folder of that name or a `source_file=` folder. Logical files known only
    from the `_sources` table (no accepted rows) have no path. `problem` says why a file cannot be read.
    """
    folder = directory.rstrip("/")
    plain = files_and_parts(spark, f"{folder}/{PARQUET_GLOB}")
    # parts of a folder are Parquet files by their names; a bare folder is listed itself
    problem = F.when(F.col("hidden"), F.lit(UNREADABLE_NAME)).when(F.col("length") == 0, F.lit(NO_PARQUET))
    plain = plain.where(F.lower("path").endswith(".parquet")).select("path", "length", problem.alias("problem"))
    parts = entries_inside(spark, matching(spark, f"{folder}/{SOURCE_FOLDER}*"), PARQUET_GLOB)
    parts = parts.where("NOT folder").where(~is_hidden(F.col("path")))
    parts = parts.select("path", "length", F.when(F.col("length") == 0, F.lit(NO_PARQUET)).alias("problem"))
    listed = plain.unionByName(parts).select("path", "length", logical_parquet_name(F.col("path")).alias("file"), "problem")
    known = glob(spark, f"{folder}/{SOURCES_TABLE}")
    if known:
        names = spark.read.parquet(known[0]).select(F.concat("file", F.lit(".parquet")).alias("file"))
        names = names.join(listed.select("file").distinct(), "file", "left_anti")
        none = F.lit(None).cast("string")
        listed = listed.unionByName(names.select(none.alias("path"), F.lit(0).cast("bigint").alias("length"), "file", none.alias("problem")))
    listed = materialize(listed, "parquet-files")
    if not known and listed.isEmpty():
        raise FileNotFoundError(f"no parquet files found in directory: {directory}")
    return listed


class Footers:
    """Reads footers through the JVM's Parquet reader: whatever file system Spark reaches, it reaches."""

    def __init__(self, spark: SparkSession):
        self.jvm = jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.read = jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter
        self.schema_only = jvm.org.apache.parquet.format.converter.ParquetMetadataConverter.SKIP_ROW_GROUPS

    def schema(self, path: str):
        return self.read(self.conf, self.path(path), self.schema_only).getFileMetaData().getSchema()

    def fingerprint(self, path: str) -> str | None:
        """Text of a file's schema below its name; None when the file has no sound footer."""
        try:
            return self.schema(path).toString().split("\n", 1)[1]
        except Exception as error:
            if "is not a Parquet file" in str(error) or "expected magic" in str(error):
                return None
            raise

    def fingerprints(self, paths: list[str]) -> list[str | None]:
        """The same for some paths: read side by side and taken over as one text, not call by call."""
        try:
            text = self._all(paths)
        except Exception:  # a file without a sound footer among them
            return [self.fingerprint(p) for p in paths]
        starts, found = [], -1
        for path in paths:
            found = text.find(f"Footer{{{path}, {SCHEMA_START}", found + 1)
            starts.append(found)
        if min(starts) < 0:
            return [self.fingerprint(p) for p in paths]
        parts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
        return [self._within(part) or self.fingerprint(path) for part, path in zip(parts, paths)]

    def _all(self, paths: list[str]) -> str:
        jvm, conf = self.jvm, self.jvm.org.apache.hadoop.conf.Configuration(self.conf)
        conf.setInt("parquet.metadata.read.parallelism", AT_ONCE)
        strings = jvm.org.apache.hadoop.util.StringUtils
        places = strings.stringToPath(strings.getStrings(BETWEEN.join(paths), BETWEEN))
        found = places[0].getFileSystem(conf).listStatus(places)
        listed = jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.scala.Predef.genericWrapArray(found).toSeq())
        return jvm.org.apache.parquet.hadoop.ParquetFileReader.readAllFootersInParallel(conf, listed, True).toString()

    @staticmethod
    def _within(part: str) -> str | None:
        """The schema below its name in the text of one footer; None where names in it look like its end."""
        schema, *rest = part.partition(SCHEMA_START)[2].split(SCHEMA_END)
        return schema.split("\n", 1)[1] + "}\n" if len(rest) == 1 and "\n" in schema else None

    def required(self, path: str) -> list[str]:
        """Columns a file declares as never NULL."""
        return [f.getName() for f in self.schema(path).getFields() if f.getRepetition().toString() == "REQUIRED"]


def schemas(listed: DataFrame) -> DataFrame:
    """path, fingerprint (NULL: no Parquet file) of the readable files of a listing; a scratch table.

    Footers are metadata like the listing and are read next to it, some at once; what the driver holds is one
    stretch of paths.
    """
    spark = listed.sparkSession
    footers, table, shape = Footers(spark), scratch_path(spark, "schemas"), "path string, fingerprint string"
    spark.createDataFrame([], shape).write.parquet(table)
    paths = listed.where("path IS NOT NULL AND problem IS NULL").select("path").toLocalIterator()
    for part in stretches((r.path for r in paths), STRETCH):
        found = [f for some in stretches(iter(part), TOGETHER) for f in footers.fingerprints(some)]
        spark.createDataFrame(list(zip(part, found)), shape).coalesce(1).write.mode("append").parquet(table)
    return spark.read.schema(shape).parquet(table)


def row_counts(scan: DataFrame, path: Column | None = None) -> DataFrame:
    """scanned (the path as scans spell it), spot, num_rows of every file with rows of a scan.

    No column is read, so the scan ends at the footers; rows that are kept with the `path` of their file are counted by it.
    """
    path = F.col("_metadata.file_path") if path is None else path
    counted = scan.select(path.alias("scanned")).groupBy("scanned").agg(F.count("*").alias("num_rows"))
    return counted.withColumn("spot", spot(decode_path(F.col("scanned"))))


def required_columns(spark: SparkSession, path: str) -> list[str]:
    """Columns a table's files declare as never NULL, seen in one of them."""
    one = spark.read.parquet(path).select("_metadata.file_path").first()
    return Footers(spark).required(one.file_path)
