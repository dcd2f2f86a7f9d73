"""Checks and rule texts over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayline.functions.text import text_equal
from assayline.operators import checks
from assayline.operators.crossref import CrossReference
from assayline.operators.evaluate import counts, evaluate, evidence, failures, first_rows
from assayline.operators.skew import shuffled_route
from assayline.operators.suite import FusedSuite, fuse, run_status
from assayline.plans.registry import SQL, Tables, query

# Single checks. The conditions are written so that the tables hold some failing rows.

SEGMENT = "nullif(c_mktsegment, 'BUILDING')"


def _customers(t: Tables) -> DataFrame:
    """Customers with gaps: one segment is missing, one is blank."""
    return t.customer.select(
        F.col("c_custkey").alias("id"), "c_name", "c_acctbal", F.expr(SEGMENT).alias("segment"),
        F.expr(f"CASE WHEN c_mktsegment = 'MACHINERY' THEN '  ' ELSE {SEGMENT} END").alias("segment_text"),
        F.expr("concat(lower(c_mktsegment), CASE WHEN c_acctbal < 0 THEN '.mail' ELSE '@mail.test' END)").alias("contact"),
    )


CUSTOMERS = f"""customers AS (
  SELECT c_custkey AS id, c_name, c_acctbal, {SEGMENT} AS segment,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN '  ' ELSE {SEGMENT} END AS segment_text,
    concat(lower(c_mktsegment), CASE WHEN c_acctbal < 0 THEN '.mail' ELSE '@mail.test' END) AS contact
  FROM customer)"""


@query("chk_required", f"""WITH {CUSTOMERS} SELECT id, segment_text,
  CASE WHEN length(trim(segment_text)) > 0 THEN 0 ELSE 1 END AS dq_check FROM customers""")
def chk_required(t: Tables) -> DataFrame:
    return checks.rows(_customers(t), checks.required("segment_text"))


@query("chk_not_null", f"""WITH {CUSTOMERS} SELECT id, segment,
  CASE WHEN segment IS NULL THEN 1 ELSE 0 END AS dq_check FROM customers""")
def chk_not_null(t: Tables) -> DataFrame:
    return checks.rows(_customers(t), checks.not_null("segment"))


@query("chk_format_like", f"""WITH {CUSTOMERS} SELECT id, contact,
  CASE WHEN contact LIKE '%_@_%._%' THEN 0 ELSE 1 END AS dq_check FROM customers""")
def chk_format_like(t: Tables) -> DataFrame:
    return checks.rows(_customers(t), checks.like("contact", "%_@_%._%"))


@query("chk_regex", """SELECT p_partkey AS id, p_type,
  CASE WHEN regexp_matches(p_type, '^(economy|standard)', 'i') THEN 0 ELSE 1 END AS dq_check FROM part""")
def chk_regex(t: Tables) -> DataFrame:
    return checks.rows(t.part.withColumnRenamed("p_partkey", "id"), checks.regex("p_type", "^(economy|standard)"))


@query("chk_range", """SELECT o_orderkey AS id, o_totalprice,
  CASE WHEN o_totalprice BETWEEN 1000 AND 400000 THEN 0 ELSE 1 END AS dq_check FROM orders""")
def chk_range(t: Tables) -> DataFrame:
    return checks.rows(t.orders, checks.between("o_totalprice", 1000, 400000), "o_orderkey")


@query("chk_positive", """SELECT c_custkey AS id, c_acctbal,
  CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END AS dq_check FROM customer""")
def chk_positive(t: Tables) -> DataFrame:
    return checks.rows(t.customer, checks.positive("c_acctbal"), "c_custkey")


@query("chk_positive_text", """SELECT event_id AS id, amount,
  CASE WHEN TRY_CAST(amount AS DOUBLE) > 0 THEN 0 ELSE 1 END AS dq_check
  FROM (SELECT event_id, concat(CASE WHEN event_type = 'error' THEN 'n/a ' WHEN event_type = 'view' THEN '-' ELSE '' END,
    CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS amount FROM events)""")
def chk_positive_text(t: Tables) -> DataFrame:
    amount = F.expr(
        "concat(CASE WHEN event_type = 'error' THEN 'n/a ' WHEN event_type = 'view' THEN '-' ELSE '' END,"
        " string(bigint(floor(value))))"
    )
    return checks.rows(t.events.select(F.col("event_id").alias("id"), amount.alias("amount")), checks.positive("amount"))


@query("chk_threshold", """SELECT l_orderkey AS id, l_discount, l_linenumber,
  CASE WHEN l_discount <= 0.08 THEN 0 ELSE 1 END AS dq_check FROM lineitem""")
def chk_threshold(t: Tables) -> DataFrame:
    check = checks.threshold("l_discount", "<=", 0.08)
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"), "l_discount", "l_linenumber", checks.failed(check, t.lineitem, "").alias("dq_check")
    )


@query("chk_unique", """SELECT p_partkey AS id, p_name,
  CASE WHEN trim(p_name) <> '' AND count(*) OVER (PARTITION BY lower(trim(p_name))) = 1 THEN 0 ELSE 1 END AS dq_check
  FROM part""")
def chk_unique(t: Tables) -> DataFrame:
    return checks.rows(t.part, checks.unique("p_name"), "p_partkey")


@query("chk_unique_text", """SELECT doc_id AS id, md5(text) AS text_md5,
  CASE WHEN trim(text) <> '' AND count(*) OVER (PARTITION BY lower(trim(text))) = 1 THEN 0 ELSE 1 END AS dq_check
  FROM documents""")
def chk_unique_text(t: Tables) -> DataFrame:
    return checks.rows(t.documents, checks.unique("text"), "doc_id").select("id", F.md5("text").alias("text_md5"), "dq_check")


@query("chk_unique_composite", """SELECT l_orderkey AS id, l_linenumber, l_partkey,
  CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 THEN 0 ELSE 1 END AS dq_check FROM lineitem""")
def chk_unique_composite(t: Tables) -> DataFrame:
    check = checks.unique("l_orderkey", "l_linenumber")
    prepared = check.prepare(t.lineitem, "_fact", t.lineitem, "l_orderkey")
    return prepared.select(
        F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", checks.failed(check, prepared, "_fact").alias("dq_check")
    )


DAY_TEXT = """CASE WHEN o_orderstatus = 'P' THEN concat(substr({day}, 1, 8), '31')
  WHEN o_orderpriority = '5-LOW' THEN replace({day}, '-', '/') ELSE {day} END"""


@query("chk_date_text", f"""SELECT id, day,
  CASE WHEN length(day) = 10 AND strftime(try_strptime(day, '%Y-%m-%d'), '%Y-%m-%d') = day THEN 0 ELSE 1 END AS dq_check
  FROM (SELECT o_orderkey AS id, {DAY_TEXT.format(day="strftime(o_orderdate, '%Y-%m-%d')")} AS day FROM orders)""")
def chk_date_text(t: Tables) -> DataFrame:
    day = F.expr(DAY_TEXT.format(day="date_format(o_orderdate, 'yyyy-MM-dd')"))
    return checks.rows(t.orders.select(F.col("o_orderkey").alias("id"), day.alias("day")), checks.date_text("day"))


@query("chk_text_equality", """SELECT c_custkey AS id, spelled,
  CASE WHEN strip_accents(lower(spelled)) = strip_accents(lower(c_mktsegment)) THEN 0 ELSE 1 END AS dq_check
  FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_nationkey % 3 = 0 THEN replace(lower(c_mktsegment), 'o', 'ó')
    WHEN c_nationkey % 3 = 1 THEN replace(lower(c_mktsegment), 'i', 'y') ELSE c_mktsegment END AS spelled FROM customer)""")
def chk_text_equality(t: Tables) -> DataFrame:
    spelled = F.expr(
        "CASE WHEN c_nationkey % 3 = 0 THEN replace(lower(c_mktsegment), 'o', 'ó')"
        " WHEN c_nationkey % 3 = 1 THEN replace(lower(c_mktsegment), 'i', 'y') ELSE c_mktsegment END"
    )
    frame = t.customer.select(F.col("c_custkey").alias("id"), "c_mktsegment", spelled.alias("spelled"))
    return checks.rows(frame, checks.condition("spelled", lambda v: text_equal(v, F.col("c_mktsegment"))))


# Cross-table checks: orders against customers in good standing, keys as text with noise.

ORDER_KEYS = """SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL
    WHEN o_orderpriority = '2-HIGH' THEN concat(' c', {text}, ' ') ELSE concat('C', {text}) END AS code,
    o_custkey % 25 AS nation FROM orders"""
CUSTOMER_KEYS = "SELECT concat('C', {text}) AS code, c_nationkey AS nation, c_acctbal >= 0 AS active FROM customer"


def _order_keys(t: Tables) -> DataFrame:
    code = F.expr(
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '2-HIGH'"
        " THEN concat(' c', string(o_custkey), ' ') ELSE concat('C', string(o_custkey)) END"
    )
    return t.orders.select(F.col("o_orderkey").alias("id"), code.alias("code"), (F.col("o_custkey") % 25).alias("nation"))


def _customer_keys(t: Tables) -> DataFrame:
    return t.customer.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"),
        F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") >= 0).alias("active"),
    )


def _xref_sql(exists: str = "EXISTS", nulls: int = 1, on: str = "r.code = p.code") -> str:
    rows = ORDER_KEYS.format(text="CAST(o_custkey AS VARCHAR)")
    keys = CUSTOMER_KEYS.format(text="CAST(c_custkey AS VARCHAR)")
    return (
        f"WITH p AS ({rows}), r AS ({keys}) SELECT id, code, CASE WHEN code IS NULL THEN {nulls}"
        f" WHEN {exists} (SELECT 1 FROM r WHERE {on}) THEN 0 ELSE 1 END AS dq_check FROM p"
    )


def _xref(t: Tables, **options) -> DataFrame:
    spec = CrossReference("customers", (("code", "code"),), **options)
    return checks.rows(_order_keys(t), checks.cross_reference(spec, _customer_keys(t)))


@query("xref_exists", _xref_sql())
def xref_exists(t: Tables) -> DataFrame:
    return _xref(t)


@query("xref_exists_norm", _xref_sql(on="upper(trim(r.code)) = upper(trim(p.code))"))
def xref_exists_norm(t: Tables) -> DataFrame:
    return _xref(t, normalize=True)


@query("xref_exists_skip_null", _xref_sql(nulls=0))
def xref_exists_skip_null(t: Tables) -> DataFrame:
    return _xref(t, nulls="skip")


@query("xref_exists_active", _xref_sql(on="r.code = p.code AND r.active"))
def xref_exists_active(t: Tables) -> DataFrame:
    return _xref(t, active_column="active")


@query("xref_missing", _xref_sql("NOT EXISTS"))
def xref_missing(t: Tables) -> DataFrame:
    return _xref(t, mode="missing")


@query("xref_two_pairs", _xref_sql(on="r.code = p.code AND r.nation = p.nation").replace(
    "code IS NULL", "code IS NULL OR nation IS NULL"))
def xref_two_pairs(t: Tables) -> DataFrame:
    spec = CrossReference("customers", (("code", "code"), ("nation", "nation")))
    return checks.rows(_order_keys(t), checks.cross_reference(spec, _customer_keys(t)))


# Rules as text. One text serves both engines unless a function is spelled differently.

RULES: dict[str, tuple[str, tuple[str, ...], str | None]] = {
    "chk_left_join": (
        "SELECT l.l_orderkey AS id, l.l_linenumber, l.l_partkey,"
        " CASE WHEN o.o_orderkey IS NULL OR l.l_shipdate < o.o_orderdate THEN 1 ELSE 0 END AS dq_check"
        " FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey",
        ("lineitem", "orders"), None,
    ),
    "chk_cte_exists": (
        "WITH standing AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"
        " SELECT o.o_orderkey AS id, o.o_custkey, CASE WHEN EXISTS"
        " (SELECT 1 FROM standing s WHERE s.c_custkey = o.o_custkey) THEN 0 ELSE 1 END AS dq_check FROM orders o",
        ("orders", "customer"), None,
    ),
    "chk_union_all": (
        "SELECT p_partkey AS id, p_size, CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS dq_check FROM part"
        " UNION ALL SELECT p_partkey, p_size, CASE WHEN p_size < 3 THEN 1 ELSE 0 END FROM part",
        ("part",), None,
    ),
    "sql_inner_join": (
        "SELECT o.o_orderkey AS id, c.c_mktsegment, CASE WHEN c.c_acctbal < 0 AND o.o_totalprice > 100000 THEN 1 ELSE 0"
        " END AS dq_check FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey",
        ("orders", "customer"), None,
    ),
    "sql_union_distinct": (
        "SELECT k AS id, k % 10 AS last_digit, CASE WHEN k % 10 = 7 THEN 1 ELSE 0 END AS dq_check FROM"
        " (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'"
        " UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0) found",
        ("orders", "customer"), None,
    ),
    "sql_count_distinct": (
        "SELECT l_orderkey AS id, COUNT(DISTINCT l_partkey) AS parts,"
        " CASE WHEN COUNT(DISTINCT l_partkey) < 3 THEN 1 ELSE 0 END AS dq_check FROM lineitem GROUP BY l_orderkey",
        ("lineitem",), None,
    ),
    "sql_scalar_subquery": (
        "SELECT o_orderkey AS id, o_custkey, CASE WHEN o_totalprice > (SELECT 1.5 * AVG(o_totalprice) FROM orders)"
        " OR (SELECT MAX(l_discount) FROM lineitem WHERE l_orderkey = o_orderkey) > 0.09 THEN 1 ELSE 0 END AS dq_check"
        " FROM orders",
        ("orders", "lineitem"), None,
    ),
    "sql_set_operations": (
        "SELECT k AS id, k % 7 AS remainder, 1 AS dq_check FROM ("
        " (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'"
        " INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"
        " EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal >= 5000) found",
        ("orders", "customer"), None,
    ),
    "sql_recursive_cte": (
        "WITH RECURSIVE bounds AS (SELECT CAST(MIN(year(o_orderdate) * 4 + quarter(o_orderdate)) AS INT) AS low,"
        " CAST(MAX(year(o_orderdate) * 4 + quarter(o_orderdate)) AS INT) AS high FROM orders),"
        " quarters AS (SELECT low AS q, high FROM bounds UNION ALL SELECT q + 1, high FROM quarters WHERE q < high),"
        " filled AS (SELECT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS INT) AS q, COUNT(*) AS n FROM orders GROUP BY 1)"
        " SELECT quarters.q AS id, COALESCE(n, 0) AS orders, CASE WHEN COALESCE(n, 0) < 100 THEN 1 ELSE 0 END AS dq_check"
        " FROM quarters LEFT JOIN filled ON quarters.q = filled.q",
        ("orders",), None,
    ),
    "json_field": (
        "SELECT event_id AS id, CAST(get_json_object(props, '$.k') AS INT) AS k,"
        " CASE WHEN CAST(get_json_object(props, '$.k') AS INT) <= 90 THEN 0 ELSE 1 END AS dq_check FROM events",
        ("events",),
        "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INT) AS k,"
        " CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) <= 90 THEN 0 ELSE 1 END AS dq_check FROM events",
    ),
}


def _register_rule(name: str, text: str, tables: tuple[str, ...], other: str | None) -> None:
    @query(name, other or text)
    def run(t: Tables) -> DataFrame:
        return evaluate(t.spark, text, t.views(*tables), declared_only=True).frame


for _name, (_text, _tables, _other) in RULES.items():
    _register_rule(_name, _text, _tables, _other)


# Evaluation outputs.

PRICE_RULE = (
    "SELECT o_orderkey AS id, o_orderpriority, CASE WHEN o_totalprice < 450000 AND o_orderpriority <> '4-NOT SPECIFIED'"
    " THEN 0 ELSE 1 END AS dq_check FROM orders"
)
PRICE_MESSAGE = '"Price or priority is \\"odd\\""'
PRICE_TEXT = 'Price or priority is "odd"'


@query("rule_counts", f"""SELECT CAST(count(*) - sum(dq_check) AS BIGINT) AS passed, CAST(sum(dq_check) AS BIGINT) AS failed
  FROM ({PRICE_RULE})""")
def rule_counts(t: Tables) -> DataFrame:
    return counts(evaluate(t.spark, PRICE_RULE, t.views("orders")).frame)


@query("rule_evidence", f"""SELECT CAST(id AS VARCHAR) AS record_id, 'o_orderpriority' AS field_name,
  o_orderpriority AS field_value, dq_check AS test_result,
  CASE WHEN dq_check = 1 THEN '{PRICE_TEXT}' ELSE '' END AS error_message FROM ({PRICE_RULE})""")
def rule_evidence(t: Tables) -> DataFrame:
    output = evaluate(t.spark, PRICE_RULE, t.views("orders"))
    return evidence(output.frame, output.field, PRICE_MESSAGE)


@query("failed_rows", f"""SELECT CAST(id AS VARCHAR) AS record_id, 'o_orderpriority' AS field_name,
  o_orderpriority AS field_value, dq_check AS test_result, '{PRICE_TEXT}' AS error_message FROM ({PRICE_RULE})
  WHERE dq_check = 1""")
def failed_rows(t: Tables) -> DataFrame:
    output = evaluate(t.spark, PRICE_RULE, t.views("orders"))
    return failures(output.frame, output.field, PRICE_MESSAGE)


@query("preview_limit", """SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) > 500 FROM orders) AS truncated
  FROM orders ORDER BY o_orderkey LIMIT 500""")
def preview_limit(t: Tables) -> DataFrame:
    return first_rows(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])


# A suite over orders and one over line items, fused into one scan each.

def order_suite(t: Tables) -> FusedSuite:
    """Range, format, uniqueness and cross-table checks of orders."""
    standing = CrossReference("customers", (("o_custkey", "c_custkey"),), key="o_orderkey", active_column="active")
    customers = t.customer.select("c_custkey", (F.col("c_acctbal") >= 0).alias("active"))
    return fuse(
        t.orders,
        [
            checks.between("o_totalprice", 1000, 400000).named(1, "price in range", "Price is out of range"),
            checks.regex("o_orderpriority", "^[1-5]-[a-z]+$").named(2, "priority format", "Priority is malformed"),
            checks.unique("o_custkey", "o_orderdate").named(3, "one order per customer and day", "Repeated order"),
            checks.cross_reference(standing, customers).named(4, "customer in good standing", "Customer is not active"),
            checks.condition("o_orderstatus", lambda v: v.isin("O", "F")).named(5, "settled status", "Status is pending"),
        ],
        "o_orderkey",
    )


ORDER_FLAGS = """flags AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus,
  CASE WHEN o_totalprice BETWEEN 1000 AND 400000 THEN 0 ELSE 1 END AS f1,
  CASE WHEN regexp_matches(o_orderpriority, '^[1-5]-[a-z]+$', 'i') THEN 0 ELSE 1 END AS f2,
  CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderdate) = 1 THEN 0 ELSE 1 END AS f3,
  CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) THEN 0 ELSE 1 END AS f4,
  CASE WHEN o_orderstatus IN ('O', 'F') THEN 0 ELSE 1 END AS f5 FROM orders)"""
ORDER_RULES = (
    (1, "price in range", "f1", "o_totalprice", "CAST(o_totalprice AS VARCHAR)", "Price is out of range"),
    (2, "priority format", "f2", "o_orderpriority", "o_orderpriority", "Priority is malformed"),
    (3, "one order per customer and day", "f3", "o_custkey", "CAST(o_custkey AS VARCHAR)", "Repeated order"),
    (4, "customer in good standing", "f4", "o_custkey", "CAST(o_custkey AS VARCHAR)", "Customer is not active"),
    (5, "settled status", "f5", "o_orderstatus", "o_orderstatus", "Status is pending"),
)


def _suite_sql() -> str:
    parts = [
        f"SELECT {rule} AS rule_id, '{title}' AS description, CAST(count(*) - sum({flag}) AS BIGINT) AS passed,"
        f" CAST(sum({flag}) AS BIGINT) AS failed, round(100.0 * (count(*) - sum({flag})) / count(*), 6) AS kpi FROM flags"
        for rule, title, flag, *_ in ORDER_RULES
    ]
    return f"WITH {ORDER_FLAGS} " + " UNION ALL ".join(parts)


def _suite_evidence_sql() -> str:
    parts = [
        f"SELECT {rule} AS rule_id, CAST(o_orderkey AS VARCHAR) AS record_id, '{field}' AS field_name, {value} AS field_value,"
        f" '{message}' AS error_message FROM flags WHERE {flag} = 1"
        for rule, _, flag, field, value, message in ORDER_RULES
    ]
    return f"WITH {ORDER_FLAGS} " + " UNION ALL ".join(parts)


@query("run_suite", _suite_sql())
def run_suite(t: Tables) -> DataFrame:
    return order_suite(t).counts().select(
        "rule_id", "description", "passed", "failed", F.round("kpi", 6).alias("kpi")
    )


@query("run_suite_evidence", _suite_evidence_sql())
def run_suite_evidence(t: Tables) -> DataFrame:
    return order_suite(t).evidence().select("rule_id", "record_id", "field_name", "field_value", "error_message")


LINE_RULES = (
    (1, "l_quantity", "l_quantity BETWEEN 1 AND 45"),
    (2, "l_discount", "l_discount <= 0.08"),
    (3, "l_tax", "l_tax < 0.08"),
    (4, "l_returnflag", "l_returnflag IN ('A', 'N')"),
    (5, "l_linestatus", "l_linestatus = 'O'"),
    (6, "l_extendedprice", "l_extendedprice > 5000"),
    (7, "l_linenumber", "l_linenumber < 7"),
    (8, "l_partkey", "l_partkey % 10 <> 3"),
)


def line_suite(t: Tables) -> FusedSuite:
    return fuse(
        t.lineitem, [checks.condition(field, test).named(rule, test) for rule, field, test in LINE_RULES], "l_orderkey"
    )


@query("run_suite_wide", " UNION ALL ".join(
    f"SELECT {rule} AS rule_id, CAST(count(*) FILTER ({test}) AS BIGINT) AS passed,"
    f" CAST(count(*) FILTER (NOT ({test})) AS BIGINT) AS failed FROM lineitem" for rule, _, test in LINE_RULES))
def run_suite_wide(t: Tables) -> DataFrame:
    return line_suite(t).counts().select("rule_id", "passed", "failed")


RUN_DAYS = """SELECT {day} AS run_day, {requested} AS requested,
  {completed} AS completed, {errors} AS errors FROM events GROUP BY {day}"""
RUN_FIGURES = {
    "requested": "CAST(count(DISTINCT CASE WHEN value > 250 THEN event_type END) AS BIGINT)",
    "completed": "CAST(count(DISTINCT CASE WHEN value > 280 THEN event_type END) AS BIGINT)",
    "errors": "CAST(count(DISTINCT CASE WHEN value > 250 THEN event_type END)"
              " - count(DISTINCT CASE WHEN value > 280 THEN event_type END) AS BIGINT)",
}


@query("run_status", f"""SELECT *, CASE WHEN requested = 0 THEN 'no_rules' WHEN errors > 0 AND completed > 0 THEN 'partial'
  WHEN errors > 0 THEN 'failed' ELSE 'completed' END AS status
  FROM ({RUN_DAYS.format(day="strftime(date_trunc('hour', ts), '%Y-%m-%d %H')", **RUN_FIGURES)})""")
def run_status_plan(t: Tables) -> DataFrame:
    """Runs per hour: a type that was requested but reached no high value did not complete."""
    high = lambda limit: F.count_distinct(F.when(F.col("value") > limit, F.col("event_type")))
    hourly = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("run_day")).agg(
        high(250).alias("requested"), high(280).alias("completed"), (high(250) - high(280)).alias("errors")
    )
    return hourly.withColumn("status", run_status(F.col("requested"), F.col("completed"), F.col("errors")))


# The same checks on the route that lookups take once they outgrow a broadcast.

def _shuffled(t: Tables, build) -> DataFrame:
    with shuffled_route():
        return build(t)


@query("chk_unique_shuffled", SQL["chk_unique"])
def chk_unique_shuffled(t: Tables) -> DataFrame:
    return _shuffled(t, chk_unique)


@query("xref_exists_shuffled", SQL["xref_exists"])
def xref_exists_shuffled(t: Tables) -> DataFrame:
    return _shuffled(t, xref_exists)


@query("run_suite_shuffled", SQL["run_suite"])
def run_suite_shuffled(t: Tables) -> DataFrame:
    return _shuffled(t, run_suite)


@query("run_suite_evidence_shuffled", SQL["run_suite_evidence"])
def run_suite_evidence_shuffled(t: Tables) -> DataFrame:
    return _shuffled(t, run_suite_evidence)
