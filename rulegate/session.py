"""Session settings the engine relies on, scratch tables and file-system helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

# Values the typed output needs to be the same on every cluster.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}

# Spark lists many folders with up to this many tasks, each of which unpacks the whole Hadoop configuration first.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_DEFAULT = "10000"
# Listings are kept on the driver, up to this many bytes, though every folder is read by one scan or has changed since.
LISTINGS_KEPT = "spark.sql.hive.filesourcePartitionFileCacheSize"
LISTINGS_KEPT_DEFAULT = str(250 * 1024 * 1024)

# A side of a join is broadcast only when its measured size stays under this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024

_local_scratch: str | None = None
_job_folder: ContextVar[str | None] = ContextVar("job_folder", default=None)


def pin(spark: SparkSession) -> SparkSession:
    """Set the two session options the typed output depends on; list folders with tasks for all cores and no more, and
    keep no listings, unless the session says otherwise."""
    for key, value in PINNED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get(LISTING_TASKS, LISTING_DEFAULT) == LISTING_DEFAULT:
        spark.conf.set(LISTING_TASKS, str(4 * spark.sparkContext.defaultParallelism))
    if spark.conf.get(LISTINGS_KEPT, LISTINGS_KEPT_DEFAULT) == LISTINGS_KEPT_DEFAULT:
        spark.conf.set(LISTINGS_KEPT, "0")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir`, or a temp folder on a local master."""
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":  # a local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="rulegate-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_job_folder.get() or scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def job(run):
    """Decorator of a job (spark, ...) whose results are all written: its scratch tables lie in one folder, which
    is removed when it ends or fails. A job inside a job shares the outer one's folder."""

    @wraps(run)
    def wrapped(spark: SparkSession, *args, **kwargs):
        if _job_folder.get():
            return run(spark, *args, **kwargs)
        folder = scratch_path(pin(spark), "job")
        token = _job_folder.set(folder)
        try:
            return run(spark, *args, **kwargs)
        finally:
            _job_folder.reset(token)
            remove(spark, folder)

    return wrapped


def materialize(df: DataFrame, label: str, partition: str | None = None) -> DataFrame:
    """Write `df` as a scratch table and read it back: cuts lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, label)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint when the measured size allows it; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by columns to tasks for all cores, for outputs of many files: those cost time by the file, while
    adaptive execution would merge tasks by their bytes. A number given here it leaves alone."""
    spark = df.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, 2 * spark.sparkContext.defaultParallelism), *by)


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def absolute(spark: SparkSession, path: str) -> str:
    """Fully qualified form of a path, the way the file system spells it."""
    p = hadoop_path(spark, path)
    fs = file_system(spark, p)
    return fs.makeQualified(p).toString().rstrip("/")


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Names matching a glob, sorted; metadata only."""
    p = hadoop_path(spark, pattern)
    fs = file_system(spark, p)
    found = fs.globStatus(p)
    return sorted(s.getPath().toString() for s in found) if found else []


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether anything matches a glob; no names are taken over."""
    p = hadoop_path(spark, pattern)
    return bool(len(file_system(spark, p).globStatus(p) or []))


def escaped(path: str) -> str:
    """A path as a glob that only matches itself."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)


def remove(spark: SparkSession, path: str) -> None:
    """Drop a previous output."""
    p = hadoop_path(spark, path)
    fs = file_system(spark, p)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a file or folder to a name that is free."""
    p, to = hadoop_path(spark, source), hadoop_path(spark, target)
    fs = file_system(spark, p)
    fs.mkdirs(to.getParent())
    if fs.exists(to) or not fs.rename(p, to):
        raise OSError(f"cannot move {source} to {target}")


class Publication:
    """Outputs that appear together: written to folders beside their targets, then moved.

    `staged(target)` is where to write. Leaving the block well moves every output to its target: in place of what is
    there, or with `keep` beside it. Leaving it with an error removes what was written, and the targets stay as they
    were.
    """

    def __init__(self, spark: SparkSession, keep: bool = False):
        self.spark, self.keep, self.places = spark, keep, {}

    def staged(self, target: str) -> str:
        target = target.rstrip("/")
        if target not in self.places:
            folder, _, name = target.rpartition("/")
            self.places[target] = f"{folder}/{name}.staging-{uuid.uuid4().hex}"
        return self.places[target]

    def withdraw(self, target: str) -> None:
        """Leave a target as it is."""
        remove(self.spark, self.places.pop(target.rstrip("/")))

    def __enter__(self) -> Publication:
        return self

    def __exit__(self, kind, error, trace) -> None:
        try:
            if kind is None:
                for target, staged in self.places.items():
                    self._publish(target, staged)
        finally:
            for staged in self.places.values():
                remove(self.spark, staged)

    def _publish(self, target: str, staged: str) -> None:
        if self.keep and exists(self.spark, target):
            self._add(target, staged)
            return
        old = f"{staged}-old"
        if exists(self.spark, target):
            rename(self.spark, target, old)
        if exists(self.spark, staged):
            try:
                rename(self.spark, staged, target)
            except Exception:
                if exists(self.spark, old):
                    rename(self.spark, old, target)
                raise
        remove(self.spark, old)

    def _add(self, target: str, staged: str) -> None:
        """Move new parts beside old ones, folder by folder; part names never repeat."""
        for path in glob(self.spark, f"{escaped(staged)}/*"):
            name = path.rsplit("/", 1)[1]
            place = f"{target}/{name}"
            if not exists(self.spark, place):
                rename(self.spark, path, place)
            elif name != "_SUCCESS":
                self._add(place, path)


def exists(spark: SparkSession, path: str) -> bool:
    p = hadoop_path(spark, path)
    return file_system(spark, p).exists(p)
