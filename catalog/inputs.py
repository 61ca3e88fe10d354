"""Dirty text tables derived from the clean test tables, the same in Spark SQL and DuckDB SQL.

Every derivation covers the whole table. Text never comes from a double (engines print those
differently): amounts are whole cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Spark and DuckDB spellings of the same thing
SPARK = {"S": "STRING", "day": "date_format({}, 'yyyy-MM-dd')", "clock": "date_format({}, 'yyyy-MM-dd HH:mm:ss')"}
DUCKDB = {"S": "VARCHAR", "day": "strftime({}, '%Y-%m-%d')", "clock": "strftime({}, '%Y-%m-%d %H:%M:%S')"}


def raw_orders(d: dict[str, str]) -> str:
    s, day = d["S"], d["day"].format("o_orderdate")
    return f"""
SELECT o_orderkey,
  CASE WHEN o_orderkey % 97 = 0 THEN 'N/A' ELSE concat(' ', CAST(o_orderkey AS {s})) END AS order_code,
  CASE WHEN o_orderkey % 11 = 0 THEN '2023-02-29' WHEN o_orderkey % 13 = 0 THEN ''
       WHEN o_orderkey % 5 = 0 THEN concat({day}, ' 23:59:59') ELSE {day} END AS order_day,
  CASE WHEN o_orderkey % 7 = 0 THEN concat({day}, 'T10:00:00+05:30') WHEN o_orderkey % 17 = 0 THEN 'null'
       WHEN o_orderkey % 101 = 0 THEN concat({day}, ' 24:00:00')
       ELSE concat({day}, ' 09:05:07.25') END AS placed_at,
  CASE WHEN o_orderstatus = 'P' THEN 'Pend' WHEN o_orderkey % 17 = 0 THEN 'null' ELSE o_orderstatus END AS state,
  CASE WHEN o_orderkey % 19 = 0 THEN '1e3' WHEN o_orderkey % 23 = 0 THEN '0' WHEN o_orderkey % 29 = 0 THEN '2.5'
       WHEN o_orderkey % 31 = 0 THEN 'abc' ELSE CAST(o_custkey AS {s}) END AS customer_no,
  CASE WHEN o_orderkey % 37 = 0 THEN '1d' WHEN o_orderkey % 41 = 0 THEN '1e400'
       WHEN o_orderkey % 43 = 0 THEN '12.5.1' WHEN o_orderkey % 47 = 0 THEN ' 1.25e2 '
       WHEN o_orderkey % 53 = 0 THEN '' ELSE CAST(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS {s}) END AS price,
  o_orderpriority AS priority
FROM orders"""


def raw_events(d: dict[str, str]) -> str:
    s, clock = d["S"], d["clock"].format("ts")
    return f"""
SELECT CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 53 = 0 THEN 'n/a' WHEN event_id % 59 = 0 THEN 'a/b'
            WHEN event_id % 61 = 0 THEN 'a_b' WHEN event_id % 71 = 0 THEN concat(' u', CAST(user_id AS {s}), ' ')
            ELSE concat('u', CAST(user_id AS {s})) END AS user_key,
  CAST(event_id AS {s}) AS event_id,
  CASE WHEN event_id % 31 = 0 THEN 'yes, "really"' ELSE {clock} END AS happened_at,
  CASE WHEN event_id % 7 = 0 THEN upper(event_type) ELSE event_type END AS kind,
  CASE WHEN event_id % 37 = 0 THEN 'abc' WHEN event_id % 41 = 0 THEN ''
       ELSE CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) AS {s}) END AS amount
FROM events"""


def raw_lineitem(d: dict[str, str]) -> str:
    s = d["S"]
    return f"""
SELECT CAST(l_orderkey AS {s}) AS l_orderkey, CAST(l_partkey AS {s}) AS l_partkey,
  CAST(l_suppkey AS {s}) AS l_suppkey, CAST(l_linenumber AS {s}) AS l_linenumber,
  CASE WHEN l_partkey % 83 = 0 THEN '1.5' ELSE CAST(CAST(l_quantity AS BIGINT) AS {s}) END AS l_quantity,
  CASE WHEN l_partkey % 89 = 0 THEN '12.5.1'
       ELSE CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS {s}) END AS l_extendedprice,
  CAST(CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS {s}) AS l_discount,
  CAST(CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS {s}) AS l_tax,
  CASE WHEN l_suppkey % 13 = 0 THEN 'Returned' ELSE l_returnflag END AS l_returnflag,
  l_linestatus, {d["clock"].format("l_shipdate")} AS l_shipdate
FROM lineitem"""


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; one with fewer splits than cores is dealt out to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def derived(spark: SparkSession, sf_dir: str, make, source: str) -> DataFrame:
    return spark.sql(make(SPARK).replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))


# The columns of `orders`, in their order, as the raw text of a feed
ORDER_RULES = {
    "fields": [
        {"name": "order_code", "type": "string", "required": True},
        {"name": "customer_no", "type": "int", "required": True, "non_zero": True},
        {
            "name": "state",
            "type": "string",
            "required": True,
            "lower": True,
            "inline_replace": {"Pend": "Pending"},
            "allowed_values": ["O", "pending"],
        },
        {"name": "price", "type": "float", "default": 0.0},
        {"name": "order_day", "type": "date", "required": True, "date_formats": ["2006-01-02", "2006-01-02 15:04:05"]},
        {
            "name": "placed_at",
            "type": "datetime",
            "datetime_formats": ["2006-01-02 15:04:05", "2006-01-02T15:04:05", "2006-01-02T15:04:05Z07:00"],
        },
        {"name": "priority", "parquet_name": "order_priority", "type": "string", "lower": True},
        {"name": "origin", "type": "string", "required": True, "override": "orders"},
    ]
}

EVENT_RULES = {
    "fields": [
        {"name": "event_id", "type": "int", "required": True},
        {"name": "user_key", "type": "string"},
        {"name": "happened_at", "type": "datetime", "required": True},
        {"name": "kind", "type": "string", "required": True, "lower": True},
        {"name": "amount", "type": "float", "default": -1},
    ]
}

LINEITEM_RULES = {
    "fields": [
        {"name": "l_orderkey", "type": "int", "required": True, "non_zero": True},
        {"name": "l_partkey", "type": "int", "required": True},
        {"name": "l_suppkey", "type": "int", "required": True},
        {"name": "l_linenumber", "type": "int", "required": True},
        {"name": "l_quantity", "type": "int", "required": True},
        {"name": "l_extendedprice", "type": "float", "required": True},
        {"name": "l_discount", "type": "float"},
        {"name": "l_tax", "type": "float"},
        {
            "name": "l_returnflag",
            "type": "string",
            "required": True,
            "lower": True,
            "allowed_values": ["a", "n", "r"],
        },
        {"name": "l_linestatus", "type": "string", "required": True},
        {"name": "l_shipdate", "type": "datetime", "required": True},
    ]
}
