"""Result stores derived from the order and event tables.

The tables hold no quality history, so one is read out of them: customers act as rules,
orders as results and archive rows, order months and priorities as runs, order lines as
evidence, events as day-by-day results. Each text below is valid in both SQL dialects used
here; the operators under test then work on these frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from assayline.operators.evaluate import select
from assayline.plans.registry import Tables

RUN_ID = "(year(o_orderdate) * 100 + month(o_orderdate)) * 10 + CAST(substr(o_orderpriority, 1, 1) AS INT)"
CHECKED = "CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 1000) AS BIGINT) + 8 END"
FAILED = "CASE WHEN o_orderkey % 97 = 0 OR o_orderstatus = 'F' THEN 0 ELSE o_orderkey % 7 END"
VERSION = "CASE WHEN {rule} % 50 = 0 THEN NULL ELSE concat('1.', {number} % 4 + 2) END"
SEVERITY = "CASE {number} % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END"

TEXTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "rules": (
        f"""SELECT c_custkey AS rule_id, concat('cust-', c_custkey) AS rule_key,
          {VERSION.format(rule="c_custkey", number="c_custkey")} AS version,
          CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, c_name AS description,
          c_mktsegment AS rule_type, concat('T', c_custkey % 5 + 1) AS target_table, 'Check failed' AS error_message,
          concat('SELECT a|FROM t', c_custkey % 3, '|WHERE b > ', c_custkey % 10) AS sql_query,
          {SEVERITY.format(number="c_nationkey")} AS severity,
          CASE WHEN c_nationkey % 4 = 0 THEN 'remote' ELSE 'local' END AS execution_mode,
          CASE WHEN c_nationkey % 8 = 0 THEN 'remote' ELSE 'local' END AS sql_engine,
          DATE '1994-01-01' + INTERVAL 5 DAY AS created_at,
          CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '1994-01-01' + INTERVAL 20 DAY END AS activated_at,
          md5(concat('now', c_custkey)) AS revision FROM customer""",
        ("customer",),
    ),
    "results": (
        f"""SELECT o_orderkey AS result_id, o_custkey AS rule_id,
          {VERSION.format(rule="o_custkey", number="o_orderkey")} AS rule_version,
          CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN NULL ELSE {RUN_ID} END AS run_id,
          {CHECKED} - ({FAILED}) AS passed, {FAILED} AS failed, o_orderdate AS executed_at FROM orders""",
        ("orders",),
    ),
    "runs": (
        f"""SELECT {RUN_ID} AS run_id, concat('T', CAST(substr(o_orderpriority, 1, 1) AS INT)) AS table_name,
          min(date_trunc('month', o_orderdate)) AS started_at,
          CASE WHEN min(o_orderkey) % 5 = 0 THEN 'partial' ELSE 'completed' END AS status,
          CASE WHEN ({RUN_ID}) % 3 = 0 THEN 'remote' ELSE 'local' END AS mode,
          count(DISTINCT o_custkey) + CASE WHEN min(o_orderkey) % 5 = 0 THEN 1 ELSE 0 END AS rules_requested,
          count(DISTINCT o_custkey) AS rules_completed
          FROM orders GROUP BY {RUN_ID}, substr(o_orderpriority, 1, 1)""",
        ("orders",),
    ),
    "history": (
        f"""SELECT o_orderkey AS history_id, o_custkey AS rule_id, concat('1.', o_orderkey % 6) AS version,
          'INACTIVE' AS status, o_orderdate AS created_at, concat('was ', o_orderpriority) AS description,
          CASE WHEN o_orderstatus = 'P' THEN 'not json' WHEN o_orderkey % 10 = 1 THEN NULL
            ELSE concat('{{"sql_query":"SELECT a|FROM t', o_custkey % 3, '|WHERE b > ', o_orderkey % 10,
              '","severity":"', {SEVERITY.format(number="o_orderkey")}, '"}}') END AS rule_params,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS deactivated_at FROM orders""",
        ("orders",),
    ),
    "evidence": (
        f"""SELECT CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN NULL ELSE {RUN_ID} END AS run_id,
          o_custkey AS rule_id, {VERSION.format(rule="o_custkey", number="o_orderkey")} AS rule_version,
          concat(l_orderkey, '-', l_partkey, '-', l_linenumber) AS record_id, concat('flag ', l_returnflag) AS field_name,
          CAST(CAST(l_quantity AS BIGINT) AS STRING) AS field_value,
          CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS test_result,
          CASE WHEN l_discount > 0.05 THEN concat('Line status ', l_linestatus) ELSE '' END AS error_message
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        ("lineitem", "orders"),
    ),
    "links": (
        """SELECT c_custkey AS link_id, c_custkey AS rule_id, concat('ep', c_custkey % 3) AS endpoint,
          concat('p', c_custkey % 2) AS profile,
          CASE WHEN c_acctbal < 1000 THEN NULL WHEN c_custkey % 2 = 0 THEN md5(concat('now', c_custkey))
            ELSE md5(concat('then', c_custkey)) END AS base_revision,
          concat('T', c_custkey % 5 + 1) AS target_table, 'main' AS source_catalog, 'sales' AS source_schema,
          concat('t', CASE WHEN c_acctbal < 9900 THEN c_custkey % 5 ELSE c_custkey % 10 END) AS source_table
          FROM customer WHERE c_nationkey % 4 = 0""",
        ("customer",),
    ),
    "published": (
        """SELECT c_custkey AS link_id, md5(concat('then', c_custkey)) AS revision, concat('0.', c_custkey % 4) AS local_version
          FROM customer WHERE c_nationkey % 4 = 0 AND c_custkey % 3 <> 0""",
        ("customer",),
    ),
    "receipts": (
        f"""SELECT concat('ep', o_custkey % 3) AS endpoint, concat('r', o_orderkey) AS remote_run_id,
          {RUN_ID} AS local_run_id, o_orderkey % 100 AS source_version, concat('cust-', o_custkey) AS rule_key,
          md5(concat('rev', o_custkey % 7)) AS revision FROM orders""",
        ("orders",),
    ),
    "load_log": (
        """SELECT event_id AS load_id, concat('U', user_id) AS table_name, concat(event_type, '.csv') AS file_name,
          CAST(floor(value) AS BIGINT) AS row_count, concat('user', event_id % 9) AS loaded_by, ts AS loaded_at FROM events""",
        ("events",),
    ),
    # One result per event type, user and day. A value above 220 is a failing record.
    "daily": (
        f"""SELECT rule_id, table_name, occurred_at, checked, failed, run_id, run_id * 1000 + rule_id AS result_id,
          concat('1.', run_id % 5) AS rule_version, {SEVERITY.format(number="rule_id")} AS severity
          FROM (SELECT CAST(ascii(event_type) AS BIGINT) AS rule_id, concat('U', user_id) AS table_name,
            date_trunc('day', ts) AS occurred_at, CAST(day(ts) AS BIGINT) AS run_id, count(*) AS checked,
            count(CASE WHEN value > 220 THEN 1 END) AS failed FROM events
            GROUP BY ascii(event_type), user_id, date_trunc('day', ts), day(ts)) grouped""",
        ("events",),
    ),
}


def frame(t: Tables, name: str) -> DataFrame:
    """A derived store table as a Spark plan."""
    text, tables = TEXTS[name]
    return select(t.spark, text, t.views(*tables))


def cte(*names: str) -> str:
    """The same store tables as SQL common table expressions."""
    return ", ".join(f"{name} AS ({TEXTS[name][0]})" for name in names)


def day(value: str) -> str:
    """SQL text of a timestamp as a date text."""
    return f"strftime({value}, '%Y-%m-%d')"


def moment(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"
