"""The same questions in DuckDB SQL, written independently of the Spark side (inputs are shared)."""

from __future__ import annotations

from catalog.inputs import DUCKDB, raw_events, raw_lineitem, raw_orders

SQL: dict[str, str] = {}

MISSING = "('', 'none', 'null', 'nan', 'na', 'n/a')"
FLOAT = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def quoted(c: str) -> str:
    """Double-quoted text; the test inputs need no escapes but those of quotes and backslashes."""
    return f"""concat('"', replace(replace({c}, '\\', '\\\\'), '"', '\\"'), '"')"""


def to_float(c: str) -> str:
    cast = f"TRY_CAST({c} AS DOUBLE)"
    return f"CASE WHEN regexp_matches({c}, {FLOAT}) AND NOT isinf({cast}) THEN {cast} END"


# price: default 0 for missing; state and priority lower-cased; placed_at in epoch microseconds
ORDERS = f"""
raw AS ({raw_orders(DUCKDB)}),
trimmed AS (
  SELECT *, trim(order_code) AS rid,
    lower(CASE WHEN lower(state) = 'pend' THEN 'pending' ELSE state END) AS st,
    CASE WHEN lower(trim(price)) IN {MISSING} THEN '0' ELSE trim(price) END AS am,
    lower(placed_at) IN {MISSING} AS no_created, lower(order_day) IN {MISSING} AS no_date
  FROM raw),
parsed AS (
  SELECT *,
    CASE WHEN regexp_matches(order_day, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}( [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})?$')
         THEN TRY_CAST(left(order_day, 10) AS DATE) END AS d,
    CASE WHEN no_created THEN NULL
         WHEN placed_at LIKE '%+05:30'
         THEN epoch_us(TRY_CAST(replace(left(placed_at, 19), 'T', ' ') AS TIMESTAMP)) - 19800000000
         WHEN placed_at LIKE '% 24:%' THEN NULL
         ELSE epoch_us(TRY_CAST(placed_at AS TIMESTAMP)) END AS created_us,
    {to_float("customer_no")} AS q, {to_float("am")} AS a
  FROM trimmed),
messages AS (
  SELECT *,
    CASE WHEN lower(rid) IN {MISSING} THEN 'value is required' END AS e_code,
    CASE WHEN no_date THEN 'value is required' WHEN d IS NULL THEN concat('invalid date: ', {quoted("order_day")}) END AS e_day,
    CASE WHEN NOT no_created AND created_us IS NULL THEN concat('invalid datetime: ', {quoted("placed_at")}) END AS e_placed,
    CASE WHEN st IN {MISSING} THEN 'value is required'
         WHEN st NOT IN ('o', 'pending') THEN concat('value ', {quoted("st")}, ' not in allowed_values') END AS e_state,
    CASE WHEN q IS NULL THEN concat('invalid int: ', {quoted("customer_no")})
         WHEN q <> floor(q) THEN concat('invalid int (fractional): ', {quoted("customer_no")})
         WHEN q = 0 THEN 'must be non-zero' END AS e_customer,
    CASE WHEN a IS NULL THEN concat('invalid float: ', {quoted("am")}) END AS e_price
  FROM parsed),
checked AS (
  SELECT *, concat_ws(' | ', 'order_code: ' || e_code, 'customer_no: ' || e_customer, 'state: ' || e_state, 'price: ' || e_price,
    'order_day: ' || e_day, 'placed_at: ' || e_placed) AS errors
  FROM messages)"""

ORDERS_TYPED = """
SELECT o_orderkey, rid AS order_code, 'orders' AS origin, CAST(d AS VARCHAR) AS order_day, created_us AS placed_at,
  st AS state, CAST(q AS BIGINT) AS customer_no, a AS price, lower(priority) AS order_priority
FROM checked WHERE errors = ''"""

SQL["validate_orders_valid"] = f"WITH {ORDERS} {ORDERS_TYPED}"
SQL["parquet_roundtrip"] = SQL["validate_orders_valid"]
SQL["validate_orders_invalid"] = f"""WITH {ORDERS}
SELECT o_orderkey, order_code, order_day, placed_at, state, customer_no, price, priority, errors AS __errors
FROM checked WHERE errors <> ''"""
SQL["row_errors"] = f"WITH {ORDERS} SELECT o_orderkey, errors AS __errors FROM checked WHERE errors <> ''"

ORDER_MESSAGES = {
    "order_code": "e_code",
    "order_day": "e_day",
    "placed_at": "e_placed",
    "state": "e_state",
    "customer_no": "e_customer",
    "price": "e_price",
}
_each = " UNION ALL ".join(
    f"SELECT '{f}' AS field, {e} AS msg FROM checked WHERE {e} IS NOT NULL" for f, e in ORDER_MESSAGES.items()
)
SQL["error_profile"] = f"WITH {ORDERS}, entries AS ({_each}) SELECT field, msg, count(*) AS n FROM entries GROUP BY field, msg"
SQL["rules_to_schema"] = f"WITH {ORDERS}, typed AS ({ORDERS_TYPED}) " + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{n}' AS name, '{t}' AS type, {r} AS required, count({n}) AS non_null FROM typed"
    for i, (n, t, r) in enumerate(
        [
            ("order_code", "string", True),
            ("customer_no", "bigint", True),
            ("state", "string", True),
            ("price", "double", False),
            ("order_day", "date", True),
            ("placed_at", "timestamp", False),
            ("order_priority", "string", False),
            ("origin", "string", True),
        ]
    )
)

SQL["validate_lineitem_valid"] = f"""
WITH raw AS ({raw_lineitem(DUCKDB)})
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_partkey AS BIGINT) AS l_partkey,
  CAST(l_suppkey AS BIGINT) AS l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CAST(l_quantity AS BIGINT) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
  CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax, lower(l_returnflag) AS l_returnflag,
  l_linestatus, epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS l_shipdate
FROM raw
WHERE l_quantity NOT LIKE '%.%' AND l_extendedprice <> '12.5.1' AND lower(l_returnflag) IN ('a', 'n', 'r')
  AND CAST(l_orderkey AS BIGINT) <> 0"""

# -- single rules ----------------------------------------------------------------------------------

RAW_ORDERS = f"WITH raw AS ({raw_orders(DUCKDB)})"


def one_rule(value: str, errors: str, key: str = "o_orderkey", source: str = "raw") -> str:
    prefix = RAW_ORDERS if source == "raw" else ""
    return f"""{prefix} SELECT {key}, CASE WHEN e IS NULL THEN v END AS value, e AS errors
FROM (SELECT {key}, {value} AS v, {errors} AS e FROM {source})"""


def missing(c: str) -> str:
    return f"lower(trim({c})) IN {MISSING}"


SQL["rule_missing"] = f"{RAW_ORDERS} SELECT o_orderkey, " + ", ".join(
    f"{missing(c)} AS {c}_missing" for c in ("order_code", "order_day", "placed_at", "state", "price")
) + " FROM raw"
SQL["rule_required"] = one_rule("state", f"CASE WHEN {missing('state')} THEN 'state: value is required' END")
SQL["rule_exclude_if_missing"] = one_rule(
    "state", f"CASE WHEN {missing('state')} THEN 'state: missing value excluded by rule' END"
)
SQL["rule_default"] = one_rule(
    f"CASE WHEN {missing('order_code')} THEN 1000000 ELSE TRY_CAST(order_code AS BIGINT) END", "CAST(NULL AS VARCHAR)"
)
SQL["rule_optional_null"] = one_rule(
    f"CASE WHEN {missing('order_day')} THEN NULL ELSE order_day END", "CAST(NULL AS VARCHAR)"
)
SQL["rule_override"] = one_rule("CAST(2.5 AS DOUBLE)", "CAST(NULL AS VARCHAR)")
SQL["rule_trim"] = """
SELECT doc_id, CASE WHEN lower(t) IN ('', 'none', 'null', 'nan', 'na', 'n/a') THEN NULL ELSE t END AS value
FROM (SELECT doc_id, trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(133), chr(160), chr(5760),
  chr(8192), chr(8193), chr(8194), chr(8195), chr(8196), chr(8197), chr(8198), chr(8199), chr(8200), chr(8201),
  chr(8202), chr(8232), chr(8233), chr(8239), chr(8287), chr(12288))) AS t FROM documents)"""
SQL["rule_lower"] = one_rule(
    f"CASE WHEN {missing('text')} THEN NULL ELSE lower(trim(text, concat(' ', chr(9), chr(10), chr(13)))) END",
    "CAST(NULL AS VARCHAR)",
    "doc_id",
    "documents",
)
SQL["rule_inline_replace"] = one_rule(
    f"""CASE WHEN state = 'Pend' THEN 'open' WHEN state = 'F' OR {missing('state')} THEN 'gone' ELSE state END""",
    "CAST(NULL AS VARCHAR)",
)
SQL["rule_min_length"] = """
SELECT doc_id, 'text: min_length=400 violated' AS __errors
FROM (SELECT doc_id, trim(text, concat(' ', chr(9), chr(10), chr(13))) AS t FROM documents)
WHERE lower(t) NOT IN ('', 'none', 'null', 'nan', 'na', 'n/a') AND strlen(t) < 400"""
SQL["rule_allowed_values"] = one_rule(
    "lower(c_mktsegment)",
    f"""CASE WHEN lower(c_mktsegment) NOT IN ('building', 'machinery', 'household')
        THEN concat('c_mktsegment: value ', {quoted("lower(c_mktsegment)")}, ' not in allowed_values') END""",
    "c_custkey",
    "customer",
)

QUANTITY = to_float("customer_no")
INT_ERRORS = f"""CASE WHEN {QUANTITY} IS NULL THEN concat('customer_no: invalid int: ', {quoted("customer_no")})
  WHEN {QUANTITY} <> floor({QUANTITY}) THEN concat('customer_no: invalid int (fractional): ', {quoted("customer_no")})"""
SQL["rule_non_zero"] = one_rule(
    f"TRY_CAST({QUANTITY} AS BIGINT)", INT_ERRORS + f" WHEN {QUANTITY} = 0 THEN 'customer_no: must be non-zero' END"
)
SQL["cast_int"] = one_rule(f"TRY_CAST({QUANTITY} AS BIGINT)", INT_ERRORS + " END")
SQL["cast_float"] = one_rule(
    to_float("trim(price)"),
    f"""CASE WHEN NOT {missing("price")} AND {to_float("trim(price)")} IS NULL
        THEN concat('price: invalid float: ', {quoted("trim(price)")}) END""",
)
SQL["cast_date"] = f"""WITH {ORDERS}
SELECT o_orderkey, CASE WHEN NOT no_date THEN CAST(d AS VARCHAR) END AS value,
  CASE WHEN NOT no_date AND d IS NULL THEN concat('order_day: invalid date: ', {quoted("order_day")}) END AS errors
FROM checked"""
SQL["cast_datetime"] = f"""WITH {ORDERS}
SELECT o_orderkey, created_us AS value, 'placed_at: ' || e_placed AS errors FROM checked"""
SQL["snake_case_names"] = r"""
SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(concat(p_name, ' - ', p_type, ' - ', p_brand, '/x.Y'))),
  '[ \-/.]', '_', 'g'), '_+', '_', 'g') AS column_name
FROM part"""

# -- events: key files, numbers, batches -----------------------------------------------------------

EVENTS = f"""
raw AS ({raw_events(DUCKDB)}),
keyed AS (
  SELECT *, trim(user_key) <> '' AS has_key,
    CASE WHEN trim(user_key) = '' THEN 'missing_keys' ELSE replace(trim(user_key), '/', '_') END AS key_file,
    CAST(event_id AS BIGINT) AS n
  FROM raw),
events_checked AS (
  SELECT *, row_number() OVER (PARTITION BY key_file ORDER BY n) + 1 AS row_no,
    concat_ws(' | ',
      CASE WHEN happened_at LIKE 'yes%' THEN concat('happened_at: invalid datetime: ', {quoted("happened_at")}) END,
      CASE WHEN amount <> '' AND {to_float("amount")} IS NULL THEN concat('amount: invalid float: ', {quoted("amount")}) END
    ) AS errors
  FROM keyed),
ranked AS (
  SELECT key_file, CAST(floor((row_number() OVER (ORDER BY key_file || '.parquet') - 1) / 10) AS BIGINT) + 1 AS batch_no
  FROM (SELECT DISTINCT key_file FROM keyed)),
typed AS (
  SELECT key_file, n AS event_id, CASE WHEN lower(trim(user_key)) IN {MISSING} THEN NULL ELSE trim(user_key) END AS user_key,
    epoch_us(TRY_CAST(happened_at AS TIMESTAMP)) AS happened_at, lower(kind) AS kind,
    CASE WHEN amount = '' THEN -1.0 ELSE TRY_CAST(amount AS DOUBLE) END AS amount
  FROM events_checked WHERE errors = '')"""
COUNTS = """count(*) AS total_rows, count(*) FILTER (WHERE errors = '') AS valid_rows,
  count(*) FILTER (WHERE errors <> '') AS invalid_rows"""
TYPED = "event_id, user_key, happened_at, kind, amount"

SQL["validate_file_stats"] = f"WITH {EVENTS} SELECT key_file, {COUNTS} FROM events_checked GROUP BY key_file"
SQL["validate_dir_stats"] = f"""WITH {EVENTS}
SELECT count(DISTINCT key_file) AS files, CAST(0 AS BIGINT) AS failed_files, {COUNTS} FROM events_checked"""
SQL["empty_error_policy"] = f"""WITH {EVENTS}
SELECT key_file AS source_file, count(*) FILTER (WHERE errors <> '') AS error_rows FROM events_checked GROUP BY key_file"""
SQL["output_names"] = f"""WITH {EVENTS}
SELECT key_file || '.parquet' AS typed_name, key_file || '_error.csv' AS error_name, count(*) AS n
FROM keyed WHERE has_key GROUP BY key_file"""
SQL["split_rows_per_key"] = f"WITH {EVENTS} SELECT key_file, count(*) AS total_rows FROM keyed GROUP BY key_file"
SQL["split_missing_rows"] = f"""WITH {EVENTS}
SELECT user_key, event_id, happened_at, kind, amount, key_file FROM keyed WHERE NOT has_key"""
SQL["split_counts"] = f"""WITH {EVENTS}
SELECT count(*) AS total_rows, count(*) FILTER (WHERE has_key) AS split_rows,
  count(*) FILTER (WHERE NOT has_key) AS missing_key_rows,
  count(DISTINCT CASE WHEN has_key THEN key_file END) AS output_files FROM keyed"""
SQL["row_number_per_key"] = f"WITH {EVENTS} SELECT event_id, key_file, row_no AS row_number FROM events_checked"
SQL["split_by_key"] = f"WITH {EVENTS} SELECT key_file, user_key, event_id, happened_at, kind, amount FROM keyed"
SQL["scan_csv_roundtrip"] = f"WITH {EVENTS} SELECT user_key, event_id, happened_at, kind, amount FROM raw"
SQL["batch_assign"] = f"WITH {EVENTS} SELECT key_file || '.parquet' AS file, batch_no FROM ranked"
SQL["batch_compact"] = f"""WITH {EVENTS}
SELECT {TYPED}, batch_no AS validation_batch FROM typed JOIN ranked USING (key_file)"""
SQL["auto_pipeline"] = SQL["batch_compact"]
SQL["stream_gate"] = f"WITH {EVENTS} SELECT {TYPED} FROM typed"
SQL["batch_summary"] = f"""WITH {EVENTS}
SELECT batch_no AS validation_batch, count(*) AS total_rows, min(event_id) AS first_event, max(event_id) AS last_event
FROM typed JOIN ranked USING (key_file) GROUP BY batch_no"""
SQL["error_csv_roundtrip"] = f"""WITH {EVENTS}
SELECT row_number() OVER (ORDER BY n) + 1 AS __row_number, errors AS __errors, user_key, event_id, happened_at, kind, amount
FROM events_checked QUALIFY errors <> ''"""
SQL["auto_errors"] = f"""WITH {EVENTS}
SELECT key_file AS source_file, row_no AS __row_number, errors AS __errors, n AS event_id
FROM events_checked WHERE errors <> ''"""
SQL["auto_summary"] = f"""WITH {EVENTS}
SELECT 'user_key' AS split_key, count(*) FILTER (WHERE has_key) AS split_rows,
  count(*) FILTER (WHERE NOT has_key) AS missing_key_rows,
  count(DISTINCT CASE WHEN has_key THEN key_file END) AS output_files, count(DISTINCT key_file) AS files, {COUNTS},
  (SELECT max(batch_no) FROM ranked) AS batches, count(*) FILTER (WHERE errors = '') AS batched_rows
FROM events_checked"""

# -- CSV source ------------------------------------------------------------------------------------

SQL["row_ordinals"] = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1 AS row_number FROM orders"
SQL["header_resolve"] = "SELECT o_orderkey AS id, o_custkey AS cust FROM orders"
SQL["header_check"] = """
SELECT DISTINCT o_orderpriority || '.csv' AS file, 'required schema field "cust" not found in CSV header' AS failure
FROM orders WHERE o_orderpriority >= '3'"""
SQL["ragged_align"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS cust,
  CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus ELSE '' END AS status
FROM orders"""
SQL["malformed_files"] = """
WITH placed AS (
  SELECT concat('status-', o_orderstatus, '.csv') AS file, o_orderstatus = 'P' AND o_orderkey % 5 = 0 AS bad,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) + 1 AS row_no
  FROM orders)
SELECT file, concat('read row ', min(row_no) FILTER (WHERE bad), ': malformed quotes') AS failure, CAST(NULL AS BIGINT) AS rows
FROM placed GROUP BY file HAVING bool_or(bad)
UNION ALL SELECT file, NULL, count(*) FROM placed GROUP BY file HAVING NOT bool_or(bad)"""
SQL["detect_key"] = f"""WITH {EVENTS} SELECT 'user_key' AS split_key, count(DISTINCT 'events.csv') AS files FROM raw"""
SQL["schema_compat"] = """
WITH files AS (
  SELECT DISTINCT concat('g', lpad(CAST(o_custkey % 16 AS VARCHAR), 2, '0'), '.parquet') AS file FROM orders),
ranked AS (SELECT file, CAST(floor((row_number() OVER (ORDER BY file) - 1) / 4) AS BIGINT) + 1 AS batch_no FROM files),
typed AS (SELECT *, file IN ('g03.parquet', 'g08.parquet', 'g09.parquet') AS odd,
  first_value(file IN ('g03.parquet', 'g08.parquet', 'g09.parquet')) OVER (PARTITION BY batch_no ORDER BY file) AS first_odd
  FROM ranked)
SELECT batch_no, file FROM typed WHERE odd <> first_odd"""
SQL["folder_inventory"] = """
WITH named AS (SELECT 'p' || left(o_orderpriority, 1) AS name, count(*) AS n FROM orders GROUP BY 1),
kinds AS (SELECT unnest(['csv', 'parquet']) AS kind)
SELECT kind, CASE WHEN name = 'p3' THEN '_p3' ELSE name END AS name, CASE WHEN name <> 'p3' THEN n END AS rows,
  CASE WHEN name <> 'p3' THEN NULL WHEN kind = 'csv' THEN 'read header: names starting with _ or . cannot be read'
       ELSE 'names starting with _ or . cannot be read' END AS failure
FROM named, kinds
UNION ALL SELECT kind, 'empty', NULL, CASE WHEN kind = 'csv' THEN 'read header: EOF' ELSE 'not a Parquet file' END FROM kinds"""
SQL["batch_twice"] = """
WITH rows AS (SELECT o_orderkey, o_custkey % 16 AS g FROM orders),
later AS (SELECT o_orderkey, g FROM rows UNION ALL SELECT -o_orderkey, g FROM rows WHERE g < 4)
SELECT CAST(g // 4 + 1 AS BIGINT) AS validation_batch, count(*) AS total_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
  'write batch 3' AS stopped, 0 AS left_behind
FROM later WHERE g < 8 GROUP BY 1"""
SQL["only_failed_files"] = """
SELECT left(o_orderpriority, 1) || '.csv' AS file, CASE WHEN left(o_orderpriority, 1) = '5' THEN 'read row 2: malformed quotes'
    ELSE 'required schema field "cust" not found in CSV header' END AS failure,
  CAST((SELECT count(DISTINCT left(o_orderpriority, 1)) FROM orders) AS BIGINT) AS files,
  CAST((SELECT count(DISTINCT left(o_orderpriority, 1)) FROM orders) AS BIGINT) AS failed_files,
  CAST(0 AS BIGINT) AS total_rows, CAST(0 AS BIGINT) AS valid_rows, CAST(0 AS BIGINT) AS invalid_rows
FROM orders GROUP BY left(o_orderpriority, 1)"""
SQL["dir_many_headers"] = """
WITH rows AS (
  SELECT 'f' || lpad(CAST(o_custkey % 50 AS VARCHAR), 2, '0') AS source_file, o_orderkey, o_orderstatus,
    row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) + 1 AS number FROM orders)
SELECT source_file, '__row_number,__errors,id,cust,"x, ' || source_file || '"' AS title, CAST(1 AS BIGINT) AS titles,
  number, 'cust: invalid int: "not a number"' AS errors, o_orderkey AS id, 'not a number' AS cust, 'a, "b"' AS extra
FROM rows WHERE o_orderstatus = 'P'"""
ODD_FILES = """
WITH rows AS (
  SELECT 'f' || lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0') AS name, o_orderkey AS id,
    row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) + 1 AS row_number,
    CASE WHEN o_orderkey % 9 = 0 THEN 'cust: value is required' WHEN o_orderstatus = 'P' THEN 'cust: invalid int: "x"' END AS errors
  FROM orders)"""
SQL["stream_quarantine"] = f"{ODD_FILES} SELECT name, row_number, errors, id FROM rows WHERE errors IS NOT NULL AND name <= 'f16'"
SQL["stream_totals"] = f"""{ODD_FILES}
SELECT count(DISTINCT name) AS files, count(DISTINCT name) FILTER (name > 'f16') AS failed_files,
  count(*) FILTER (name <= 'f16') AS total_rows, count(*) FILTER (name <= 'f16' AND errors IS NULL) AS valid_rows,
  count(*) FILTER (name <= 'f16' AND errors IS NOT NULL) AS invalid_rows
FROM rows"""
SQL["rule_many_values"] = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'replaced ' || c_custkey ELSE c_name END AS value FROM customer),
j AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 10 = 0 ELSE c_custkey % 7 <> 0 END AS known FROM c)
SELECT c_custkey, CASE WHEN known THEN value END AS value, CASE WHEN NOT known THEN 'c_name: value "' || value || '" not in allowed_values' END AS errors
FROM j"""
SQL["scan_multiline"] = """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 1 AS row_number, md5(coalesce(text, '')) AS text_md5 FROM documents"""
SQL["rule_predicate"] = f"""WITH {ORDERS},
judged AS (
  SELECT *, CASE WHEN e_customer IS NULL THEN q END AS customer, CASE WHEN e_price IS NULL THEN a END AS amount,
    CASE WHEN e_day IS NULL THEN d END AS day
  FROM checked),
refused AS (
  SELECT *,
    coalesce(e_customer, CASE WHEN q % 10 = 3 OR q <= 0 THEN 'check failed: customer_no % 10 <> 3 AND customer_no > 0' END) AS f_customer,
    coalesce(e_state, CASE WHEN st <> 'o' AND amount >= 20000000 THEN 'check failed: state = ''o'' OR price < 20000000' END) AS f_state,
    coalesce(e_day, CASE WHEN epoch_us(CAST(day AS TIMESTAMP)) > created_us - created_us % 86400000000
      THEN 'check failed: order_day <= to_date(placed_at)' END) AS f_day,
    coalesce(e_placed, CASE WHEN placed_at LIKE '%+05:30' AND dayofweek(day) = 0
      THEN 'check failed: cell_text.placed_at NOT LIKE ''%+05:30'' OR dayofweek(order_day) <> 1' END) AS f_placed
  FROM judged),
listed AS (
  SELECT *, concat_ws(' | ', 'order_code: ' || e_code, 'customer_no: ' || f_customer, 'state: ' || f_state,
    'price: ' || e_price, 'order_day: ' || f_day, 'placed_at: ' || f_placed) AS listing
  FROM refused)
SELECT o_orderkey, CASE WHEN listing = '' THEN CAST(q AS BIGINT) END AS customer_no, nullif(listing, '') AS errors FROM listed"""
SQL["detect_key_files"] = """
WITH f AS (SELECT DISTINCT left(o_orderpriority, 1) || '-' || o_orderstatus AS name FROM orders)
SELECT name || '.csv' AS file,
  CASE WHEN name LIKE '2%' THEN 'key, of "' || name || '"' WHEN name NOT LIKE '1%' AND name NOT LIKE '3%' THEN 'key ' || name END AS split_key,
  CASE WHEN name LIKE '1%' THEN 'failed detecting split primary key: first header column is blank'
       WHEN name LIKE '3%' THEN 'read header: malformed quotes' END AS failure
FROM f"""
