"""Typed import, audits, upsert, export safety and conversions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from assayline.functions.fingerprint import canonical_column, revision_column
from assayline.operators import audits, columns, loading
from assayline.plans.registry import Tables, query
from assayline.plans.stores import cte, frame, moment
from assayline.session import checkpoint_dir
from assayline.sources import delimited
from assayline.sources.datasets import ColumnSpec
from assayline.sources.delimited import safe_columns

# Orders as a delimited file would hold them: all text, with typical faults.
CELLS = {
    "number": "CAST(o_orderkey AS STRING)",
    "code": "lpad(CAST(o_custkey AS STRING), 9, '0')",
    "amount": "concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), CASE o_orderkey % 5 WHEN 0 THEN '.5' WHEN 1 THEN '.125'"
              " WHEN 2 THEN '' WHEN 3 THEN '.50' ELSE ' EUR' END)",
    "ratio": "CASE WHEN o_orderkey % 11 = 0 THEN '1e500' WHEN o_orderkey % 13 = 0 THEN 'nan'"
             " ELSE concat(CAST(o_orderkey % 100 AS STRING), 'e-2') END",
    "flag": "CASE o_orderstatus WHEN 'O' THEN 'TRUE' WHEN 'F' THEN '0' ELSE 'yes' END",
    "small": "CAST(o_orderkey % 40 * 10 - 150 AS STRING)",
    "note": "CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END",
    "blank": "CASE WHEN o_orderkey < 0 THEN 'x' ELSE '' END",
    "day": "CASE WHEN o_orderkey % 9 = 0 THEN concat(substr({day}, 1, 8), '30') WHEN o_orderkey % 10 = 0 THEN substr({day}, 1, 7)"
           " ELSE {day} END",
    "clock": "concat({day}, CASE o_orderkey % 4 WHEN 0 THEN 'T12:30:00' WHEN 1 THEN ' 23:59:59.123456' WHEN 2 THEN 'T25:00:00'"
             " ELSE 'T08:00:00+02:00' END)",
}
KINDS = {
    "number": "BIGINT", "code": "STRING", "amount": "DECIMAL(10,2)", "ratio": "REAL", "flag": "BOOLEAN",
    "small": "TINYINT", "note": "TEXT", "blank": "INTEGER", "day": "DATE", "clock": "TIMESTAMP_NTZ",
}


def _cells(t: Tables) -> DataFrame:
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    return t.orders.selectExpr(
        "o_orderkey AS _row", *[f"{text.format(day=day)} AS {name}" for name, text in CELLS.items()]
    )


_SQL_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
CELL_ROWS = "cells AS (SELECT o_orderkey AS line, {} FROM orders)".format(
    ", ".join(f"{text.format(day=_SQL_DAY)} AS {name}" for name, text in CELLS.items())
)

# Which cells a kind accepts, spelled for the other engine.
ACCEPTS = {
    "number": "TRY_CAST(number AS BIGINT) IS NOT NULL",
    "code": "TRUE",
    "amount": r"regexp_full_match(amount, '[+-]?\d{1,8}(\.\d{1,2}0*)?')",
    "ratio": r"regexp_full_match(ratio, '\d+e-2')",
    "flag": "lower(flag) IN ('0', '1', 'true', 'false')",
    "small": "TRY_CAST(small AS INTEGER) BETWEEN -128 AND 127",
    "note": "TRUE",
    "blank": "TRY_CAST(blank AS BIGINT) IS NOT NULL",
    "day": r"regexp_full_match(day, '\d{4}-\d\d-\d\d') AND TRY_CAST(day AS DATE) IS NOT NULL",
    "clock": "NOT contains(clock, '+') AND TRY_CAST(clock AS TIMESTAMP) IS NOT NULL",
}
REASONS = {
    "number": "not a whole number of this width", "amount": "does not fit DECIMAL(10,2)", "ratio": "not a finite number",
    "flag": "does not fit BOOLEAN", "small": "not a whole number of this width", "day": "does not fit DATE",
    "clock": "does not fit TIMESTAMP_NTZ", "note": "a value is required", "code": "", "blank": "",
}

_ALL_TEXT = [*CELLS]
_INFER = " UNION ALL ".join(
    f"""SELECT '{name}' AS column_name, CASE WHEN count(*) FILTER (trim({name}) <> '') = 0
      OR count(*) FILTER (regexp_matches({name}, '^\\s*[+-]?0[0-9]')) > 0 THEN 'TEXT'
      WHEN bool_and(trim({name}) = '' OR regexp_full_match({name}, '\\s*[+-]?[0-9]+\\s*')) THEN 'INTEGER'
      WHEN bool_and(trim({name}) = '' OR coalesce(isfinite(TRY_CAST({name} AS DOUBLE)), false)) THEN 'REAL' ELSE 'TEXT' END AS suggested_kind FROM cells"""
    for name in _ALL_TEXT
)


@query("infer_types", f"WITH {CELL_ROWS} {_INFER}")
def infer_types(t: Tables) -> DataFrame:
    return loading.infer_kinds(_cells(t).drop("_row"))


_ISSUES = " UNION ALL ".join(
    [
        f"SELECT line, '{name}' AS column_name, '{REASONS[name]}' AS reason FROM cells"
        f" WHERE {name} <> '' AND ({ACCEPTS[name]}) IS NOT TRUE"
        for name in CELLS if name != "note"
    ]
    + [f"SELECT line, 'note', '{REASONS['note']}' FROM cells WHERE note = ''"]
)


@query("cell_type_issues", f"WITH {CELL_ROWS} {_ISSUES}")
def cell_type_issues(t: Tables) -> DataFrame:
    cells = _cells(t)
    pairs = [(name, ColumnSpec(name, kind, required=name == "note")) for name, kind in KINDS.items()]
    return loading.cell_issues(loading.convert_cells(cells, pairs, ["_row"]), "_row").withColumnRenamed("_row", "line")


@query("typed_cells", f"""WITH {CELL_ROWS} SELECT line, TRY_CAST(number AS BIGINT) AS number, code,
  CASE WHEN {ACCEPTS["amount"]} THEN CAST(CAST(amount AS DECIMAL(10,2)) AS DOUBLE) END AS amount,
  CASE WHEN {ACCEPTS["flag"]} THEN lower(flag) IN ('1', 'true') END AS flag,
  CASE WHEN {ACCEPTS["small"]} THEN CAST(small AS INTEGER) END AS small,
  CASE WHEN {ACCEPTS["day"]} THEN day END AS day, CASE WHEN {ACCEPTS["clock"]} THEN {moment("TRY_CAST(clock AS TIMESTAMP)")} END AS clock
  FROM cells""")
def typed_cells(t: Tables) -> DataFrame:
    pairs = [(name, ColumnSpec(name, kind)) for name, kind in KINDS.items()]
    typed = loading.convert_cells(_cells(t), pairs, ["_row"])
    return typed.select(
        F.col("_row").alias("line"), "number", "code", F.col("amount").cast("double").alias("amount"), "flag",
        F.col("small").cast("int").alias("small"), F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.date_format("clock", "yyyy-MM-dd HH:mm:ss").alias("clock"),
    )


@query("dup_ids_in_batch", """SELECT id, count(*) AS occurrences FROM
  (SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS id FROM lineitem)
  WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1""")
def dup_ids_in_batch(t: Tables) -> DataFrame:
    batch = t.lineitem.selectExpr("CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS id")
    return loading.duplicate_ids(batch)


BATCH = """SELECT id, CASE WHEN min(o_orderkey) % 6 = 0 THEN NULL ELSE CAST(count(*) AS DOUBLE) END AS balance,
  max(o_orderpriority) AS segment FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey + 10000000
    ELSE o_custkey END AS id FROM orders WHERE o_orderstatus = 'P') parked GROUP BY id"""


@query("upsert_by_id", f"""WITH batch AS ({BATCH}) SELECT coalesce(c_custkey, id) AS id, c_name AS name,
  CASE WHEN id IS NOT NULL THEN balance ELSE c_acctbal END AS balance,
  CASE WHEN id IS NOT NULL THEN segment ELSE c_mktsegment END AS segment, c_nationkey AS nation
  FROM customer FULL OUTER JOIN batch ON c_custkey = id""")
def upsert_by_id(t: Tables) -> DataFrame:
    target = t.customer.selectExpr(
        "c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment", "c_nationkey AS nation"
    )
    parked = t.orders.where("o_orderstatus = 'P'").withColumn(
        "id", F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey + 10000000 ELSE o_custkey END")
    )
    batch = parked.groupBy("id").agg(
        F.expr("CASE WHEN min(o_orderkey) % 6 = 0 THEN NULL ELSE CAST(count(*) AS DOUBLE) END").alias("balance"),
        F.max("o_orderpriority").alias("segment"),
    )
    return loading.upsert(target, batch)


@query("load_log_latest", f"""WITH {cte("load_log")}
  SELECT table_name, file_name, loaded_by, row_count, {moment("loaded_at")} AS loaded FROM load_log
  QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY loaded_at DESC, load_id DESC) = 1""")
def load_log_latest(t: Tables) -> DataFrame:
    latest = loading.latest_loads(frame(t, "load_log"))
    return latest.select(
        "table_name", "file_name", "loaded_by", "row_count", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded")
    )


FORMULA = """concat(CASE o_orderkey % 6 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END,
  o_orderpriority)"""


@query("export_safe", f"""SELECT o_orderkey, CASE WHEN regexp_matches(cell, '^\\s*[=+@-]') THEN concat('''', cell) ELSE cell END AS cell
  FROM (SELECT o_orderkey, {FORMULA} AS cell FROM orders)""")
def export_safe(t: Tables) -> DataFrame:
    return safe_columns(t.orders.selectExpr("o_orderkey", f"{FORMULA} AS cell"))


def _audit_sql(refused: str, accepted: str, kinds: dict[str, str], tests: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, '{kind}' AS kind, count(*) FILTER ({accepted.format(name=name, test=tests[name])})"
        f" AS accepted, count(*) FILTER ({refused.format(name=name, test=tests[name])}) AS refused FROM cells"
        for name, kind in kinds.items()
    )


UPLOAD_KINDS = {**KINDS, "day": "STRING"}


@query("upload_audit", f"WITH {CELL_ROWS} " + _audit_sql(
    "{name} IS NOT NULL AND ({test}) IS NOT TRUE", "{name} IS NOT NULL AND ({test}) IS TRUE", UPLOAD_KINDS,
    {**ACCEPTS, "day": "TRUE"}))
def upload_audit(t: Tables) -> DataFrame:
    return audits.upload_audit(_cells(t), KINDS, as_text=["day"])


@query("upload_samples", f"""WITH {CELL_ROWS} SELECT * FROM (
  SELECT line AS record, 'amount' AS column_name, amount AS value FROM cells WHERE ({ACCEPTS["amount"]}) IS NOT TRUE UNION ALL
  SELECT line, 'flag', flag FROM cells WHERE ({ACCEPTS["flag"]}) IS NOT TRUE) ORDER BY record, column_name LIMIT 20""")
def upload_samples(t: Tables) -> DataFrame:
    kinds = {name: KINDS[name] for name in ("amount", "flag")}
    return audits.refused_samples(_cells(t), kinds, "_row").select("record", "column_name", "value")


LOSSLESS_KINDS = {
    "number": "INT", "code": "INTEGER", "amount": "REAL", "ratio": "INTEGER", "flag": "BOOLEAN", "small": "SMALLINT",
    "note": "TEXT", "day": "DATE",
}
KEEPS = {
    "number": "TRY_CAST(number AS INTEGER) IS NOT NULL",
    "code": "NOT starts_with(code, '0') AND TRY_CAST(code AS BIGINT) IS NOT NULL",
    "amount": r"regexp_full_match(amount, '(0|[1-9]\d*)(\.\d+)?')",
    "ratio": "ratio = '0e-2'",
    "flag": ACCEPTS["flag"],
    "small": "TRY_CAST(small AS SMALLINT) IS NOT NULL",
    "note": "TRUE",
    "day": ACCEPTS["day"],
}


@query("lossless_audit", f"WITH {CELL_ROWS} " + _audit_sql(
    "({test}) IS NOT TRUE", "({test}) IS TRUE", LOSSLESS_KINDS, KEEPS))
def lossless_audit(t: Tables) -> DataFrame:
    return audits.lossless_audit(_cells(t), LOSSLESS_KINDS)


LINE_COLUMNS = """l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"""
LINE_CHANGED = "CASE WHEN l_partkey % 1000 = 1 THEN 'X' ELSE l_linestatus END"


@query("tables_equal", f"""WITH b AS (SELECT {LINE_COLUMNS}, count(*) AS n FROM lineitem GROUP BY ALL),
  a AS (SELECT {LINE_COLUMNS}, count(*) AS n FROM (SELECT * REPLACE ({LINE_CHANGED} AS l_linestatus) FROM lineitem) GROUP BY ALL),
  j AS (SELECT coalesce(b.n, 0) AS bn, coalesce(a.n, 0) AS an FROM b FULL OUTER JOIN a USING ({LINE_COLUMNS}))
  SELECT CAST(sum(bn) AS BIGINT) AS rows_before, CAST(sum(an) AS BIGINT) AS rows_after,
    CAST(sum(greatest(bn - an, 0)) AS BIGINT) AS only_before, CAST(sum(greatest(an - bn, 0)) AS BIGINT) AS only_after,
    sum(greatest(bn - an, 0)) = 0 AND sum(greatest(an - bn, 0)) = 0 AS equal FROM j""")
def tables_equal(t: Tables) -> DataFrame:
    before = t.lineitem.select(*LINE_COLUMNS.split(", "))
    return audits.tables_equal(before, before.withColumn("l_linestatus", F.expr(LINE_CHANGED)))


PAYLOAD = """concat('{"active":', CASE WHEN p_size > 5 THEN 'true' ELSE 'false' END, ',"description":"', p_name,
  '","rule_key":"part-', p_partkey, '","severity":"', CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END, '","sql":"SELECT ', p_type, '"}')"""


@query("payload_revision", f"SELECT p_partkey, {PAYLOAD} AS payload, sha256({PAYLOAD}) AS revision FROM part")
def payload_revision(t: Tables) -> DataFrame:
    payload = canonical_column(
        rule_key=F.concat(F.lit("part-"), F.col("p_partkey").cast("string")), description=F.col("p_name"),
        severity=F.when(F.col("p_size") > 25, F.lit("high")).otherwise(F.lit("low")), active=F.col("p_size") > 5,
        sql=F.concat(F.lit("SELECT "), F.col("p_type")),
    )
    return t.part.select("p_partkey", payload.alias("payload")).withColumn("revision", revision_column(F.col("payload")))


NOTE = """concat(c_name, {newline}, '"', c_mktsegment, '"; x')"""


@query("csv_roundtrip", f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, {NOTE.format(newline='chr(10)')} AS note FROM customer")
def csv_roundtrip(t: Tables) -> DataFrame:
    """Customers written as delimited files with quotes and line breaks inside cells, and read again."""
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    delimited.write_delimited(t.customer.select("c_custkey", "c_name", F.expr(NOTE.format(newline="char(10)")).alias("note")), folder)
    return delimited.check_lines(delimited.read_delimited(t.spark, folder)).drop("_row", "_file")


@query("generated_ids", """SELECT count(*) AS records, count(*) AS different, max(c_custkey) FILTER (c_custkey % 3 <> 0) + 1 AS first_new,
  max(c_custkey) FILTER (c_custkey % 3 <> 0) + count(*) FILTER (c_custkey % 3 = 0) AS last_new FROM customer""")
def generated_ids(t: Tables) -> DataFrame:
    """Every third customer loses its id and gets one above the highest."""
    named = F.col("c_custkey") % 3 != 0
    gaps = t.customer.select(F.when(named, F.col("c_custkey").cast("bigint")).alias("id"), named.alias("named"))
    return loading.with_ids(gaps, 10).agg(
        F.count("id").alias("records"), F.count_distinct("id").alias("different"),
        F.min(F.when(~F.col("named"), F.col("id"))).alias("first_new"), F.max("id").alias("last_new"))


@query("column_edits", "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS full_name, CAST(NULL AS VARCHAR) AS note FROM customer")
def column_edits(t: Tables) -> DataFrame:
    frame = t.customer.select(F.col("c_custkey").cast("bigint").alias("id"), "c_name", "c_mktsegment")
    renamed = columns.modify_column(columns.add_column(frame, "note"), "c_name", new_name="full_name")
    return columns.drop_column(renamed, "c_mktsegment")
