"""Row numbers that stay exact without ever ordering all rows, or one big group, in a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulegate.session import scratch_path


def number_within(
    df: DataFrame, key: str, chunk: list[Column], order: list[str], first: int = 1, counts: DataFrame | None = None
) -> DataFrame:
    """Add `__row_number`, counting from `first` inside every `key`, by `chunk` and then `order`.

    `chunk` names stretches of bounded size in order, such as input splits; a window never holds more than
    one stretch of a key, whatever the size of the key. One shuffle of the rows, on key and chunk; the
    totals of the stretches stay small. `counts` (key, the columns `chunk` reads, n) has the rows of each stretch when
    they are known; otherwise `df` is read once more to count them.
    """
    names = [f"__chunk{i}" for i in range(len(chunk))]
    marked = df.withColumns(dict(zip(names, chunk)))
    local = F.row_number().over(Window.partitionBy(key, *names).orderBy(*order))
    before = Window.partitionBy(key).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    if counts is None:
        sizes = marked.groupBy(key, *names).agg(F.count("*").alias("__n"))
    else:
        sizes = counts.select(key, *[c.alias(name) for name, c in zip(names, chunk)], F.col("n").alias("__n"))
    offsets = sizes.select(key, *names, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = marked.withColumn("__local", local).join(offsets, [key, *names])
    number = F.col("__local") + F.col("__before") + (first - 1)
    return numbered.withColumn("__row_number", number.cast("bigint")).drop("__local", "__before", *names)


def _sorted_parts(df: DataFrame, by: list[str], weight: Column) -> tuple[DataFrame, DataFrame]:
    """Rows sorted into scratch files, with `__part` and `__index` in it, and `__before`: the weight of the parts
    before each part."""
    spark = df.sparkSession
    path = scratch_path(spark, "ranked")
    df.orderBy(*by).write.parquet(path)
    parts = spark.read.schema(df.schema).parquet(path)
    placed = parts.select(
        "*", F.col("_metadata.file_name").alias("__part"), F.col("_metadata.row_index").alias("__index")
    )
    # one row per part file, so this window is as small as the number of write tasks
    in_order = Window.orderBy(F.length("__part"), "__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.sum(weight).alias("__n"))
    return placed, sizes.select("__part", F.coalesce(F.sum("__n").over(in_order), F.lit(0)).alias("__before"))


def global_rank(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """Add `out`, the position of each row in the total order `by`, from 0.

    The sorted rows go to scratch storage; a row's rank is its index in its part file plus the rows of
    the part files before it.
    """
    placed, offsets = _sorted_parts(df, by, F.lit(1))
    joined = placed.join(F.broadcast(offsets), "__part")
    return joined.withColumn(out, F.col("__before") + F.col("__index")).drop("__part", "__index", "__before")


def running_total(df: DataFrame, by: list[str], weight: str, out: str) -> DataFrame:
    """Add `out`, the sum of `weight` over all rows before in the total order `by`.

    Sums run inside one part file of the sorted rows, a part's share of all rows, and start from the sums of the
    parts before it.
    """
    placed, offsets = _sorted_parts(df, by, F.col(weight))
    within = Window.partitionBy("__part").orderBy("__index").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(weight).over(within), F.lit(0))
    joined = placed.withColumn("__inside", inside).join(F.broadcast(offsets), "__part")
    return joined.withColumn(out, F.col("__before") + F.col("__inside")).drop("__part", "__index", "__before", "__inside")
