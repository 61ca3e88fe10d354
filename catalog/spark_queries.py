"""One query per capability, on the test tables: what `__spark_entry__.queries()` hands out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog.inputs import (
    EVENT_RULES,
    LINEITEM_RULES,
    ORDER_RULES,
    derived,
    raw_events,
    raw_lineitem,
    raw_orders,
    table,
)
from rulegate.functions import checks
from rulegate.functions.text import file_safe, is_missing, snake_case
from rulegate.operators.batch import BATCH_FOLDER, BatchError, assign_batches, batch_directory, schema_conflicts
from rulegate.operators.numbering import number_within
from rulegate.operators.sinks import CSV_OPTIONS, ERROR_COLUMNS, write_typed
from rulegate.operators.split import rows_per_key_file, split_summary, with_key_file
from rulegate.operators.validate import Validation, validate
from rulegate.operators.value_tables import ValueTables
from rulegate.plans import workflows
from rulegate.rules import Rules, parse_rules
from rulegate.session import dealt, file_system, glob, hadoop_path, pin, rename, scratch_path
from rulegate.sources.csv_files import KEY_FOLDER, read_csv_directory, read_csv_file
from rulegate.sources.inventory import gathered, matching, spot
from rulegate.sources.parquet_files import SOURCE_FOLDER, SOURCES_TABLE, list_parquet, parquet_paths, required_columns, row_counts, schemas
from rulegate.streaming import gate as streaming

QUERIES = {}
BATCH_SIZE = 10


def query(function):
    QUERIES[function.__name__] = lambda spark, sf_dir: function(pin(spark), sf_dir)
    return function


def order_gate(spark: SparkSession, sf_dir: str) -> Validation:
    return validate(derived(spark, sf_dir, raw_orders, "orders"), parse_rules(ORDER_RULES))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived(spark, sf_dir, raw_events, "events")
    return with_key_file(raw, F.col("user_key"))


def event_gate(spark: SparkSession, sf_dir: str) -> Validation:
    return validate(event_rows(spark, sf_dir), parse_rules(EVENT_RULES))


def portable(df: DataFrame) -> DataFrame:
    """Dates as text and moments as epoch microseconds, comparable across engines."""
    shown = {"date": lambda c: c.cast("string"), "timestamp": F.unix_micros}
    columns = [shown.get(t, lambda c: c)(F.col(n)).alias(n) for n, t in df.dtypes]
    return df.select(*columns)


def one_rule(
    spark: SparkSession, sf_dir: str, rule: dict, source: str = "orders", tables: dict[str, ValueTables] | None = None
) -> DataFrame:
    """Key, typed value and errors for every row of a table under a single rule."""
    raw = derived(spark, sf_dir, raw_orders, "orders") if source == "orders" else table(spark, sf_dir, source)
    key = {"orders": "o_orderkey", "documents": "doc_id", "customer": "c_custkey"}[source]
    gate = validate(raw, parse_rules({"fields": [rule]}), keep=[key], tables=tables)
    checked, rules = gate.checked, gate.rules
    return checked.select(
        key,
        F.when(F.col("__ok"), checks.value(rules, 0)).alias("value"),
        F.when(~F.col("__ok"), checks.rendered_errors(rules)).alias("errors"),
    )


# -- the gate --------------------------------------------------------------------------------------


@query
def validate_orders_valid(spark, sf_dir):
    return portable(order_gate(spark, sf_dir).valid("o_orderkey"))


@query
def validate_orders_invalid(spark, sf_dir):
    return order_gate(spark, sf_dir).invalid()


@query
def validate_lineitem_valid(spark, sf_dir):
    raw = derived(spark, sf_dir, raw_lineitem, "lineitem")
    return portable(validate(raw, parse_rules(LINEITEM_RULES), keep=[]).valid())


@query
def validate_file_stats(spark, sf_dir):
    return event_gate(spark, sf_dir).stats("key_file")


@query
def error_profile(spark, sf_dir):
    return order_gate(spark, sf_dir).error_profile()


@query
def row_errors(spark, sf_dir):
    return order_gate(spark, sf_dir).invalid("o_orderkey")


# -- single rules ----------------------------------------------------------------------------------


@query
def rule_missing(spark, sf_dir):
    raw = derived(spark, sf_dir, raw_orders, "orders")
    names = ["order_code", "order_day", "placed_at", "state", "price"]
    return raw.select("o_orderkey", *[is_missing(F.col(n)).alias(f"{n}_missing") for n in names])


@query
def rule_required(spark, sf_dir):
    return one_rule(spark, sf_dir, {"name": "state", "type": "string", "required": True})


@query
def rule_exclude_if_missing(spark, sf_dir):
    rule = {"name": "state", "type": "string", "exclude_if_missing": True, "default": "never used"}
    return one_rule(spark, sf_dir, rule)


@query
def rule_default(spark, sf_dir):
    return one_rule(spark, sf_dir, {"name": "order_code", "type": "int", "required": True, "default": 1000000.0})


@query
def rule_optional_null(spark, sf_dir):
    return one_rule(spark, sf_dir, {"name": "order_day", "type": "string"})


@query
def rule_override(spark, sf_dir):
    return one_rule(spark, sf_dir, {"name": "not in the table", "type": "float", "override": 2.5})


@query
def rule_trim(spark, sf_dir):
    rules = parse_rules({"fields": [{"name": "text", "type": "string"}]})
    edges = F.concat(F.lit("　 \t "), F.col("text"), F.lit(" \u0085\r\n "))
    padded = table(spark, sf_dir, "documents").select("doc_id", edges.alias("text"))
    return validate(padded, rules, keep=["doc_id"]).valid("doc_id").withColumnRenamed("text", "value")


@query
def rule_lower(spark, sf_dir):
    return one_rule(spark, sf_dir, {"name": "text", "type": "string", "lower": True}, "documents")


@query
def rule_inline_replace(spark, sf_dir):
    rule = {"name": "state", "type": "string", "inline_replace": {"Pend": "open", "F": " N/A "}, "default": "gone"}
    return one_rule(spark, sf_dir, rule)


@query
def rule_min_length(spark, sf_dir):
    rules = parse_rules({"fields": [{"name": "text", "type": "string", "min_length": 400}]})
    gate = validate(table(spark, sf_dir, "documents"), rules, keep=["doc_id"])
    return gate.invalid()


@query
def rule_allowed_values(spark, sf_dir):
    segments = ["building", "machinery", "HOUSEHOLD"]
    rule = {"name": "c_mktsegment", "type": "string", "lower": True, "allowed_values": segments}
    return one_rule(spark, sf_dir, rule, "customer")


@query
def rule_non_zero(spark, sf_dir):
    return one_rule(spark, sf_dir, {"name": "customer_no", "type": "int", "non_zero": True})


@query
def cast_float(spark, sf_dir):
    return one_rule(spark, sf_dir, {"name": "price", "type": "float"})


@query
def cast_int(spark, sf_dir):
    return one_rule(spark, sf_dir, {"name": "customer_no", "type": "int"})


@query
def cast_date(spark, sf_dir):
    return portable(one_rule(spark, sf_dir, {"name": "order_day", "type": "date"}))


@query
def cast_datetime(spark, sf_dir):
    return portable(one_rule(spark, sf_dir, {"name": "placed_at", "type": "datetime"}))


@query
def snake_case_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat_ws(" - ", F.initcap("p_name"), "p_type", "p_brand")
    return part.select("p_partkey", snake_case(F.concat(name, F.lit("/x.Y"))).alias("column_name"))


@query
def output_names(spark, sf_dir):
    keyed = event_rows(spark, sf_dir)
    return (
        keyed.filter("has_key")
        .groupBy(file_safe(F.trim("user_key")).alias("key_file"))
        .agg(F.count("*").alias("n"))
        .select(
            F.concat("key_file", F.lit(".parquet")).alias("typed_name"),
            F.concat("key_file", F.lit("_error.csv")).alias("error_name"),
            "n",
        )
    )


# -- CSV source ------------------------------------------------------------------------------------


def csv_of(df: DataFrame, name: str, order: str) -> str:
    """Write a table as CSV parts in key order; the folder counts as one file `<name>.csv`."""
    path = f"{scratch_path(df.sparkSession, 'input')}/{name}.csv"
    df.orderBy(F.col(order).cast("bigint")).write.options(**CSV_OPTIONS).csv(path)
    return path


def csv_lines(rows: DataFrame) -> str:
    """Write `value` lines (columns key_file, position, value) as one CSV file per key file."""
    path = scratch_path(rows.sparkSession, "lines")
    placed = rows.repartition("key_file").sortWithinPartitions("key_file", "position")
    placed.select("value", "key_file").write.partitionBy("key_file").text(path)
    return path


def with_headers(lines: DataFrame, header: Column) -> DataFrame:
    headers = lines.select("key_file").distinct().select(
        "key_file", F.lit(-1).cast("bigint").alias("position"), header.alias("value")
    )
    return lines.unionByName(headers)


@query
def scan_csv_roundtrip(spark, sf_dir):
    raw = derived(spark, sf_dir, raw_events, "events")
    text_rules = parse_rules({"fields": [{"name": c, "type": "string"} for c in raw.columns]})
    files = read_csv_file(spark, csv_of(raw, "events", "event_id"))
    rows, cells = files.table(text_rules)
    return rows.select(*[F.coalesce(cells[c], F.lit("")).alias(c) for c in raw.columns])


@query
def scan_multiline(spark, sf_dir):
    """Whole texts as cells: quoted, with line breaks and quotes inside, numbered by record and not by line."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "text")
    files = read_csv_file(spark, csv_of(docs, "documents", "doc_id"))
    rows, cells = files.table(parse_rules({"fields": [{"name": c, "type": "string"} for c in docs.columns]}))
    return files.with_row_numbers(rows).select(
        cells["doc_id"].cast("bigint").alias("doc_id"),
        F.col("__row_number").alias("row_number"),
        F.md5(F.coalesce(cells["text"], F.lit(""))).alias("text_md5"),
    )


@query
def row_ordinals(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string"))
    files = read_csv_file(spark, csv_of(keys, "orders", "o_orderkey"))
    rows, cells = files.table(parse_rules({"fields": [{"name": "o_orderkey", "type": "int"}]}))
    return files.with_row_numbers(rows).select(
        cells["o_orderkey"].cast("bigint").alias("o_orderkey"), F.col("__row_number").alias("row_number")
    )


@query
def header_resolve(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    flipped = key % 2 == 1
    cells = F.when(flipped, F.concat_ws(",", "o_custkey", F.lit("old"), key)).otherwise(
        F.concat_ws(",", key, "o_custkey")
    )
    lines = orders.select(
        F.when(flipped, "flipped").otherwise("plain").alias("key_file"), key.alias("position"), cells.alias("value")
    )
    header = F.when(F.col("key_file") == "flipped", " cust ,id,id").otherwise("id,cust")
    files = read_csv_directory(spark, csv_lines(with_headers(lines, header)))
    rules = parse_rules({"fields": [{"name": "id", "type": "int"}, {"name": "cust", "type": "int"}]})
    rows, found = files.table(rules)
    return validate(rows, rules, keep=[], cells=found).valid()


@query
def header_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lines = orders.select(
        F.col("o_orderpriority").alias("key_file"),
        F.col("o_orderkey").alias("position"),
        F.concat_ws(",", "o_orderkey", "o_custkey").alias("value"),
    )
    header = F.when(F.col("key_file") < "3", "id,cust").otherwise("id,customer")
    files = read_csv_directory(spark, csv_lines(with_headers(lines, header)))
    rules = parse_rules({"fields": [{"name": "id", "type": "int"}, {"name": "cust", "type": "int", "default": 1}]})
    return files.failures(rules).select("file", "failure")


@query
def ragged_align(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    value = (
        F.when(key % 3 == 0, key.cast("string"))
        .when(key % 3 == 1, F.concat_ws(",", key, "o_custkey"))
        .when(key % 101 == 0, F.concat_ws(",", key, "o_custkey", "o_orderstatus", F.repeat(F.lit("x,"), 30_000)))
        .otherwise(F.concat_ws(",", key, "o_custkey", "o_orderstatus", F.lit("extra"), F.lit('"mo,re"')))
    )
    spread = F.concat(F.lit("part"), (key % 64).cast("string"))
    lines = orders.select(spread.alias("key_file"), key.alias("position"), value.alias("value"))
    files = read_csv_directory(spark, csv_lines(with_headers(lines, F.lit("id,cust,status"))))
    rules = parse_rules({"fields": [{"name": n, "type": "string"} for n in ("id", "cust", "status")]})
    rows, cells = files.table(rules)
    return rows.select(
        cells["id"].cast("bigint").alias("id"),
        *[F.coalesce(cells[n], F.lit("")).alias(n) for n in ("cust", "status")],
    )


@query
def malformed_files(spark, sf_dir):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    orders = table(spark, sf_dir, "orders")
    note = F.when((status == "P") & (key % 5 == 0), F.concat(F.lit('bare"'), status)).otherwise(
        F.concat(F.lit('"quoted, ""'), status, F.lit('"""'))
    )
    lines = orders.select(
        F.concat_ws("-", F.lit("status"), status).alias("key_file"),
        key.alias("position"),
        F.concat_ws(",", key, note).alias("value"),
    )
    files = read_csv_directory(spark, csv_lines(with_headers(lines, F.lit("id,note"))))
    rows = files.blocks.groupBy("file").agg(F.sum(F.col("n") - F.col("headers")).alias("rows"))
    found = files.files.select("file", "failure").join(rows, "file")
    return found.select("file", "failure", F.when(F.col("failure").isNull(), F.col("rows")).alias("rows"))


@query
def detect_key(spark, sf_dir):
    raw = derived(spark, sf_dir, raw_events, "events")
    files = read_csv_file(spark, csv_of(raw, "events", "event_id"))
    return files.headers().groupBy(F.trim(F.get("header_cells", F.lit(0))).alias("split_key")).agg(
        F.count_distinct("file").alias("files")
    )


@query
def detect_key_files(spark, sf_dir):
    """Split keys of a folder in which every file has a header of its own, some without a usable first cell."""
    orders = table(spark, sf_dir, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    lines = orders.select(
        F.concat_ws("-", first, "o_orderstatus").alias("key_file"), F.col("o_orderkey").alias("position"), F.concat_ws(",", "o_orderkey", "o_custkey").alias("value")
    )
    header = (
        F.when(F.col("key_file").startswith("1"), " ,id")
        .when(F.col("key_file").startswith("2"), F.concat(F.lit('" key, of ""'), F.col("key_file"), F.lit('"" ",id')))
        .when(F.col("key_file").startswith("3"), 'ba"d,id')
        .otherwise(F.concat(F.lit("\u2003key "), F.col("key_file"), F.lit(" ,id")))
    )
    found = workflows.split_keys(read_csv_directory(spark, csv_lines(with_headers(lines, header))))
    return found.select("file", "split_key", "failure")


# -- split -----------------------------------------------------------------------------------------


@query
def split_rows_per_key(spark, sf_dir):
    return rows_per_key_file(event_rows(spark, sf_dir)).select("key_file", "total_rows")


@query
def split_missing_rows(spark, sf_dir):
    return event_rows(spark, sf_dir).filter("NOT has_key").drop("has_key")


@query
def split_counts(spark, sf_dir):
    return split_summary(rows_per_key_file(event_rows(spark, sf_dir)))


@query
def row_number_per_key(spark, sf_dir):
    rows = event_rows(spark, sf_dir).withColumn("n", F.col("event_id").cast("bigint"))
    numbered = number_within(rows, "key_file", [F.floor(F.col("n") / 1_000)], ["n"], first=2)
    return numbered.select("event_id", "key_file", F.col("__row_number").alias("row_number"))


@query
def split_by_key(spark, sf_dir):
    raw = derived(spark, sf_dir, raw_events, "events")
    source = csv_of(raw, "events", "event_id")
    out = scratch_path(spark, "split")
    workflows.split_csv(spark, source, out)
    shape = ", ".join(f"{c} string" for c in [*raw.columns, "key_file"])

    def read(spark, paths):
        return spark.read.schema(shape).options(header=True, escape='"', basePath=out).csv(paths)

    return gathered({out: matching(spark, f"{out}/{KEY_FOLDER}*")}, read, "split-rows").select(
        "key_file", *[F.coalesce(c, F.lit("")).alias(c) for c in raw.columns]
    )


# -- folder jobs and batches -----------------------------------------------------------------------


def event_split(spark: SparkSession, sf_dir: str) -> str:
    raw = derived(spark, sf_dir, raw_events, "events")
    out = scratch_path(spark, "split")
    workflows.split_csv(spark, csv_of(raw, "events", "event_id"), out)
    return out


def event_rules() -> Rules:
    return parse_rules(EVENT_RULES)


@query
def validate_dir_stats(spark, sf_dir):
    out = scratch_path(spark, "folder")
    result = workflows.validate_directory(spark, event_split(spark, sf_dir), event_rules(), f"{out}/ok", f"{out}/bad")
    document = workflows.result_frame(spark, result)
    names = ["files", "failed_files", "total_rows", "valid_rows", "invalid_rows"]
    return document.select(
        *[F.get_json_object("result", f"$.summary.{n}").cast("bigint").alias(n) for n in names]
    )


@query
def empty_error_policy(spark, sf_dir):
    out = scratch_path(spark, "folder")
    split = event_split(spark, sf_dir)
    workflows.validate_directory(spark, split, event_rules(), f"{out}/ok", f"{out}/bad", write_empty_error=True)

    def read(spark, paths):
        return spark.read.schema("value string, source_file string").option("basePath", f"{out}/bad").text(paths)

    lines = gathered({f"{out}/bad": matching(spark, f"{out}/bad/{SOURCE_FOLDER}*")}, read, "error-lines")
    data = F.count_if(~F.col("value").startswith("__row_number"))
    return lines.groupBy("source_file").agg(data.alias("error_rows"))


@query
def only_failed_files(spark, sf_dir):
    """A folder in which no file is sound still ends with a report."""
    orders = table(spark, sf_dir, "orders")
    lines = orders.select(
        F.left("o_orderpriority", F.lit(1)).alias("key_file"),
        F.col("o_orderkey").alias("position"),
        F.concat_ws(",", "o_orderkey", F.when(F.left("o_orderpriority", F.lit(1)) == "5", F.lit('a"b')).otherwise("o_custkey")).alias("value"),
    )
    folder = csv_lines(with_headers(lines, F.lit("id,customer")))
    rules = parse_rules({"fields": [{"name": "id", "type": "int"}, {"name": "cust", "type": "int", "required": True}]})
    out = scratch_path(spark, "failed")
    try:
        result = workflows.validate_directory(spark, folder, rules, f"{out}/ok", f"{out}/bad")
    except workflows.DirectoryError as error:
        result = error.result
    document = workflows.result_frame(spark, result)
    names = ["files", "failed_files", "total_rows", "valid_rows", "invalid_rows"]
    summary = document.select(*[F.get_json_object("result", f"$.summary.{n}").cast("bigint").alias(n) for n in names])
    failures = read_csv_directory(spark, folder).failures(rules).select("file", "failure")
    return failures.join(F.broadcast(summary))


@query
def dir_many_headers(spark, sf_dir):
    """Error files of a folder in which every file has a header of its own, read back."""
    key = F.concat(F.lit("f"), F.lpad((F.col("o_custkey") % 50).cast("string"), 2, "0"))
    cust = F.when(F.col("o_orderstatus") == "P", F.lit("not a number")).otherwise(F.col("o_custkey").cast("string"))
    lines = table(spark, sf_dir, "orders").select(
        key.alias("key_file"), F.col("o_orderkey").alias("position"), F.concat_ws(",", "o_orderkey", cust, F.lit('"a, ""b"""')).alias("value")
    )
    folder = csv_lines(with_headers(lines, F.concat(F.lit('id,cust,"x, '), F.col("key_file"), F.lit('"'))))
    rules = parse_rules({"fields": [{"name": "id", "type": "int"}, {"name": "cust", "type": "int"}]})
    out = scratch_path(spark, "headers")
    workflows.validate_directory(spark, folder, rules, f"{out}/ok", f"{out}/bad", write_empty_error=True)
    read = spark.read.schema("value string, source_file string").text(f"{out}/bad")
    title = F.col("value").startswith("__row_number")
    titles = read.filter(title).groupBy("source_file").agg(F.max("value").alias("title"), F.count_distinct("value").alias("titles"))
    cells = F.from_csv("value", "number bigint, errors string, id bigint, cust string, extra string", {"escape": '"'}).alias("c")
    rows = read.filter(~title).select("source_file", cells).select("source_file", "c.*")
    return rows.join(titles, "source_file").select("source_file", "title", "titles", "number", "errors", "id", "cust", "extra")


@query
def batch_assign(spark, sf_dir):
    names = event_rows(spark, sf_dir).select(F.concat("key_file", F.lit(".parquet")).alias("file")).distinct()
    return assign_batches(names, BATCH_SIZE).select("file", "batch_no")


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "batches")
    gate = event_gate(spark, sf_dir)
    typed = gate.valid("key_file").withColumnRenamed("key_file", workflows.SOURCE)
    write_typed(dealt(typed, workflows.SOURCE), f"{out}/ok", workflows.SOURCE)
    gate.stats("key_file").withColumnRenamed("key_file", "file").write.parquet(f"{out}/ok/{SOURCES_TABLE}")
    batch_directory(spark, f"{out}/ok", f"{out}/export", BATCH_SIZE)
    def read(spark, paths):
        rows = spark.read.option("basePath", f"{out}/export").parquet(*paths)
        return rows.withColumn(BATCH_FOLDER, F.col(BATCH_FOLDER).cast("bigint"))

    return gathered({f"{out}/export": matching(spark, f"{out}/export/{BATCH_FOLDER}=*")}, read, "batched-rows")


@query
def batch_compact(spark, sf_dir):
    return portable(event_batches(spark, sf_dir))


@query
def batch_summary(spark, sf_dir):
    return event_batches(spark, sf_dir).groupBy(BATCH_FOLDER).agg(
        F.count("*").alias("total_rows"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    )


@query
def schema_compat(spark, sf_dir):
    out = scratch_path(spark, "schemas")
    group = F.concat(F.lit("g"), F.lpad((F.col("o_custkey") % 16).cast("string"), 2, "0"))
    orders = table(spark, sf_dir, "orders").withColumn(workflows.SOURCE, group)
    odd = F.col(workflows.SOURCE).isin("g03", "g08", "g09")
    columns = ["o_orderkey", workflows.SOURCE]
    write_typed(orders.filter(~odd).select(*columns), out, workflows.SOURCE)
    as_text = orders.filter(odd).withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    write_typed(as_text.select(*columns), out, workflows.SOURCE, mode="append")
    listed = list_parquet(spark, out)
    numbered = listed.join(assign_batches(listed.select("file").distinct(), 4), "file")
    conflicts = schema_conflicts(schemas(listed).join(numbered, "path"))
    return conflicts.join(listed, "path").select("batch_no", "file").distinct()


def odd_folder(spark: SparkSession, rows: DataFrame, suffix: str, hidden: str) -> str:
    """Files `<name><suffix>` of the rows of each `name`, those of one name with hidden file names, and an empty file."""
    out, folder = scratch_path(spark, "odd"), scratch_path(spark, "folder")
    writer = rows.write.partitionBy("name")
    writer.option("header", True).csv(out) if suffix == ".csv" else writer.parquet(out)
    for place in glob(spark, f"{out}/name=*"):
        name = place.rsplit("=", 1)[1]
        if name != hidden:
            rename(spark, place, f"{folder}/{name}{suffix}")
            continue
        for number, part in enumerate(glob(spark, f"{place}/part-*")):
            rename(spark, part, f"{folder}/_{name}-{number}{suffix}")
    empty = hadoop_path(spark, f"{folder}/empty{suffix}")
    file_system(spark, empty).create(empty).close()
    return folder


@query
def folder_inventory(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.left("o_orderpriority", F.lit(1))).alias("name"), "o_orderkey")
    read = read_csv_directory(spark, odd_folder(spark, orders, ".csv", "p3"))
    rows = read.blocks.groupBy("file").agg(F.sum(F.col("n") - F.col("headers")).alias("rows"))
    csv = read.files.join(rows, "file", "left").select(F.lit("csv").alias("kind"), "file", "rows", "failure")
    folder = odd_folder(spark, orders, ".parquet", "p3")
    counts = row_counts(spark.read.schema("o_orderkey bigint").parquet(*parquet_paths(spark, folder)))
    listed = list_parquet(spark, folder).withColumn("spot", spot(F.col("path"))).join(counts, "spot", "left")
    listed = listed.groupBy("file", F.col("problem").alias("failure")).agg(F.sum("num_rows").alias("rows"))
    parquet = listed.select(F.lit("parquet").alias("kind"), "file", "rows", "failure")
    name = F.regexp_replace("file", r"^(_p.)-.*$", "$1")
    return csv.unionByName(parquet).select("kind", F.regexp_extract(name, "^[^.]*", 0).alias("name"), "rows", "failure").distinct()


@query
def batch_twice(spark, sf_dir):
    """A second run over files of which some do not fit: what is on disk afterwards."""
    group = F.concat(F.lit("g"), F.lpad((F.col("o_custkey") % 16).cast("string"), 2, "0"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", group.alias(workflows.SOURCE))
    out = scratch_path(spark, "twice")
    write_typed(orders, f"{out}/in", workflows.SOURCE)
    batch_directory(spark, f"{out}/in", f"{out}/export", 4)
    late = orders.filter(F.col(workflows.SOURCE) > "g09").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    write_typed(late, f"{out}/in", workflows.SOURCE, "append")
    odd = orders.filter(F.col(workflows.SOURCE) < "g04").withColumn("o_orderkey", -F.col("o_orderkey"))
    write_typed(odd, f"{out}/in", workflows.SOURCE, "append")
    try:
        batch_directory(spark, f"{out}/in", f"{out}/export", 4)
        stopped = "no"
    except BatchError as error:
        stopped = str(error).split(": ")[1]
    left = glob(spark, f"{out}/*staging*")
    rows = spark.read.parquet(f"{out}/export").groupBy(BATCH_FOLDER).agg(F.count("*").alias("total_rows"), F.sum("o_orderkey").alias("key_sum"))
    return rows.select(
        F.col(BATCH_FOLDER).cast("bigint").alias(BATCH_FOLDER), "total_rows", "key_sum", F.lit(stopped).alias("stopped"), F.lit(len(left)).alias("left_behind")
    )


# -- sinks -----------------------------------------------------------------------------------------


@query
def parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "typed")
    write_typed(order_gate(spark, sf_dir).valid("o_orderkey"), path)
    return portable(spark.read.parquet(path))


@query
def error_csv_roundtrip(spark, sf_dir):
    raw = derived(spark, sf_dir, raw_events, "events")
    source, out = csv_of(raw, "events", "event_id"), scratch_path(spark, "gate")
    result = workflows.validate_csv(spark, source, event_rules(), f"{out}/ok", f"{out}/bad")
    names = [*ERROR_COLUMNS, *raw.columns]
    text = spark.read.schema(", ".join(f"{c} string" for c in names)).option("header", True).option("escape", '"')
    rows = text.csv(result.error_csv_path)
    return rows.select(
        F.col("__row_number").cast("bigint").alias("__row_number"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in names[1:]],
    )


@query
def rules_to_schema(spark, sf_dir):
    path = scratch_path(spark, "typed")
    rules = parse_rules(ORDER_RULES)
    write_typed(order_gate(spark, sf_dir).valid(), path)
    required = required_columns(spark, path)
    typed = spark.read.parquet(path)
    counted = typed.agg(*[F.count(c).alias(c) for c in typed.columns])
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(f.name in required).alias("required"),
            F.col(f.name).alias("non_null"),
        )
        for i, f in enumerate(typed.select(*[r.output for r in rules.fields]).schema.fields)
    ]
    return counted.select(F.inline(F.array(*entries)))


# -- everything in one run -------------------------------------------------------------------------


def run_auto(spark: SparkSession, sf_dir: str) -> tuple[workflows.AutoResult, str]:
    raw = derived(spark, sf_dir, raw_events, "events")
    source, out = csv_of(raw, "events", "event_id"), scratch_path(spark, "auto")
    folders = {f"{name}_dir": f"{out}/{name}" for name in ("split", "success", "error", "batch_export")}
    return workflows.auto(spark, source, event_rules(), batch_size=BATCH_SIZE, **folders), out


@query
def auto_pipeline(spark, sf_dir):
    _, out = run_auto(spark, sf_dir)
    rows = spark.read.parquet(f"{out}/batch_export")
    return portable(rows.withColumn(BATCH_FOLDER, F.col(BATCH_FOLDER).cast("bigint")))


@query
def auto_summary(spark, sf_dir):
    result, out = run_auto(spark, sf_dir)
    document = workflows.result_frame(spark, result)
    paths = {
        "split_rows": "split_summary.split_rows",
        "missing_key_rows": "split_summary.missing_key_rows",
        "output_files": "split_summary.output_files",
        "files": "validation.summary.files",
        "total_rows": "validation.summary.total_rows",
        "valid_rows": "validation.summary.valid_rows",
        "invalid_rows": "validation.summary.invalid_rows",
        "batches": "batch_summary.batches",
        "batched_rows": "batch_summary.total_rows",
    }
    return document.select(
        F.get_json_object("result", "$.split_primary_key").alias("split_key"),
        *[F.get_json_object("result", f"$.{p}").cast("bigint").alias(n) for n, p in paths.items()],
    )


@query
def auto_errors(spark, sf_dir):
    _, out = run_auto(spark, sf_dir)
    names = [workflows.SOURCE, *ERROR_COLUMNS, "user_key", "event_id", "happened_at", "kind", "amount"]
    text = spark.read.schema(", ".join(f"{c} string" for c in names)).option("header", True).option("escape", '"')
    return text.csv(f"{out}/error").select(
        workflows.SOURCE,
        F.col("__row_number").cast("bigint").alias("__row_number"),
        "__errors",
        F.col("event_id").cast("bigint").alias("event_id"),
    )


@query
def stream_gate(spark, sf_dir):
    raw = derived(spark, sf_dir, raw_events, "events")
    out = scratch_path(spark, "stream")
    folders = [f"{out}/{n}" for n in ("good", "quarantine", "failed", "checkpoint")]
    streaming.stream_gate(spark, csv_of(raw, "events", "event_id"), event_rules(), *folders).awaitTermination()
    return portable(spark.read.parquet(folders[0]).drop("epoch"))


def stream_of_odd_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """A stream over files of orders, some of which fail or hold bad rows, a few files per micro-batch."""
    key = F.concat(F.lit("f"), F.lpad((F.col("o_custkey") % 20).cast("string"), 2, "0"))
    cust = F.when(F.col("o_orderkey") % 9 == 0, F.lit("none")).when(F.col("o_orderstatus") == "P", F.lit("x")).otherwise(F.col("o_custkey").cast("string"))
    lines = table(spark, sf_dir, "orders").select(
        key.alias("key_file"), F.col("o_orderkey").alias("position"), F.concat_ws(",", "o_orderkey", cust).alias("value")
    )
    header = F.when(F.col("key_file") > "f16", "id,customer").otherwise("id,cust")
    source, out = csv_lines(with_headers(lines, header)), scratch_path(spark, "stream")
    for n, place in enumerate(glob(spark, f"{source}/key_file=*")):
        for part, path in enumerate(glob(spark, f"{place}/part-*")):  # one each: a key's lines are written by one task
            rename(spark, path, f"{out}/in/{place.rsplit('=', 1)[1]}{'' if part == 0 else f'-{part}'}.csv")
    rules = parse_rules({"fields": [{"name": "id", "type": "int"}, {"name": "cust", "type": "int", "required": True}]})
    folders = [f"{out}/{n}" for n in ("good", "quarantine", "failed", "checkpoint")]
    streaming.stream_gate(spark, f"{out}/in", rules, *folders, files_per_batch=7).awaitTermination()
    return folders


@query
def stream_quarantine(spark, sf_dir):
    rows = spark.read.parquet(stream_of_odd_files(spark, sf_dir)[1])
    name = F.regexp_extract("file", r"([^/]*)\.csv$", 1)
    return rows.select(name.alias("name"), F.col("__row_number").alias("row_number"), F.col("__errors").alias("errors"), F.col("cells")[0].cast("bigint").alias("id"))


@query
def stream_totals(spark, sf_dir):
    good, _, failed, _ = stream_of_odd_files(spark, sf_dir)
    return streaming.stream_summary(spark, good, failed)


@query
def rule_many_values(spark, sf_dir):
    """As many replacements and allowed values as there are customers, so they come as tables."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    replaced = customers.where(key % 5 == 0).groupBy("c_name").agg(F.concat(F.lit("replaced "), F.max(key)))
    allowed = customers.where(key % 7 != 0).select("c_name")
    allowed = allowed.unionByName(customers.where(key % 10 == 0).select(F.concat(F.lit("replaced "), key).alias("c_name")))
    rule = {"name": "c_name", "type": "string"}
    return one_rule(spark, sf_dir, rule, "customer", {"c_name": ValueTables(replaced, allowed)})


@query
def rule_predicate(spark, sf_dir):
    """Rows judged across columns: predicates over typed values and over the texts behind them."""
    added = {
        "customer_no": "customer_no % 10 <> 3 AND customer_no > 0",
        "state": "state = 'o' OR price < 20000000",
        "order_day": "order_day <= to_date(placed_at)",
        "placed_at": "cell_text.placed_at NOT LIKE '%+05:30' OR dayofweek(order_day) <> 1",
    }
    fields = [{**f, "check": added[f["name"]]} if f["name"] in added else f for f in ORDER_RULES["fields"]]
    gate = validate(derived(spark, sf_dir, raw_orders, "orders"), parse_rules({"fields": fields}), keep=["o_orderkey"])
    accepted = gate.valid("o_orderkey").select("o_orderkey", "customer_no", F.lit(None).cast("string").alias("errors"))
    rejected = gate.invalid("o_orderkey").select("o_orderkey", F.lit(None).cast("bigint").alias("customer_no"), F.col("__errors").alias("errors"))
    return accepted.unionByName(rejected)
