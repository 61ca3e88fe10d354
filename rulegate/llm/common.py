"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def by_value(name: str) -> None:
    """Ship the functions of module `name` to executors by value: workers need not be able to import this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row, however often the body (or a lambda in it) uses it."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id's decimal text falls into `fold`; rows without an id are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
