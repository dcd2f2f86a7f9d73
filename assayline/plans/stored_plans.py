"""Stored runs over the order tables: a run is executed and kept, and its tables are the result."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from assayline.operators import job, registry
from assayline.operators.dependencies import impact
from assayline.operators.job import RuleRunner, StoredRule
from assayline.plans.registry import Tables, query
from assayline.session import checkpoint_dir, cut_lineage
from assayline.sources import snapshot
from assayline.sources.tables import TableStore


def scratch_store(t: Tables) -> TableStore:
    """A store in the folder that all executors share; it goes when the driver ends."""
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/assayline-store-{uuid.uuid4().hex}"
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return TableStore(t.spark, folder)


# (rule, text in Spark, tested field, its text and the flag in the other engine, rows). The last one fails when it runs.
STORED = (
    ("price", "SELECT o_orderkey AS id, o_totalprice, CASE WHEN o_totalprice BETWEEN 1000 AND 400000 THEN 0 ELSE 1 END AS dq_check FROM source",
     "o_totalprice", "CAST(o_totalprice AS VARCHAR)", "CASE WHEN o_totalprice BETWEEN 1000 AND 400000 THEN 0 ELSE 1 END", "orders"),
    ("status", "SELECT o_orderkey AS id, o_orderstatus, CASE WHEN o_orderstatus IN ('O', 'F') THEN 0 ELSE 1 END AS dq_check FROM orders",
     "o_orderstatus", "o_orderstatus", "CASE WHEN o_orderstatus IN ('O', 'F') THEN 0 ELSE 1 END", "orders"),
    ("priority", "WITH named AS (SELECT o_orderkey AS id, lower(o_orderpriority) AS word FROM source)"
     " SELECT id, word, CASE WHEN word LIKE '%low%' THEN 1 ELSE 0 END AS dq_check FROM named",
     "word", "lower(o_orderpriority)", "CASE WHEN o_orderpriority LIKE '%LOW%' THEN 1 ELSE 0 END", "orders"),
    ("customer", "SELECT o_orderkey AS id, o_custkey, CASE WHEN o_custkey % 10 <> 3 THEN 0 ELSE 1 END AS dq_check FROM source",
     "o_custkey", "CAST(o_custkey AS VARCHAR)", "CASE WHEN o_custkey % 10 <> 3 THEN 0 ELSE 1 END", "orders"),
    ("pending", "SELECT o_orderkey AS id, o_totalprice, CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS dq_check FROM source"
     " WHERE o_orderstatus = 'P'",
     "o_totalprice", "CAST(o_totalprice AS VARCHAR)", "CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END",
     "(SELECT * FROM orders WHERE o_orderstatus = 'P')"),
    ("repeated", "SELECT o_custkey AS id, count(*) AS n, CASE WHEN count(*) > 12 THEN 1 ELSE 0 END AS dq_check FROM orders GROUP BY o_custkey",
     "n", "CAST(n AS VARCHAR)", "CASE WHEN n > 12 THEN 1 ELSE 0 END",
     "(SELECT o_custkey AS o_orderkey, count(*) AS n FROM orders GROUP BY o_custkey)"),
    ("broken", "SELECT o_orderkey AS id, o_orderpriority, CASE WHEN CAST(o_orderpriority AS INT) > 1 THEN 0 ELSE 1 END AS dq_check FROM source",
     "", "", "", ""),
)


def _run(t: Tables) -> TableStore:
    store = scratch_store(t)
    rules = [StoredRule(name, text, "orders", "1.0", f"rule {name}", f"Wrong {name}") for name, text, *_ in STORED]
    RuleRunner(store, {"orders": t.orders}).run_table("orders", "runner", rules, full_evidence=False)
    return store


@query("stored_run_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS rule_id, '{field}' AS field_name, CAST(count(*) FILTER (f = 0) AS BIGINT) AS passed,"
    f" CAST(count(*) FILTER (f = 1) AS BIGINT) AS failed FROM (SELECT {flag} AS f FROM {rows})"
    for name, _, field, _, flag, rows in STORED if rows))
def stored_run_counts(t: Tables) -> DataFrame:
    return job.results(_run(t)).select("rule_id", "field_name", "passed", "failed")


@query("stored_run_evidence", " UNION ALL ".join(
    f"SELECT '{name}' AS rule_id, CAST(o_orderkey AS VARCHAR) AS record_id, '{field}' AS field_name, {value} AS field_value,"
    f" 'Wrong {name}' AS error_message FROM {rows} WHERE {flag} = 1"
    for name, _, field, value, flag, rows in STORED if rows))
def stored_run_evidence(t: Tables) -> DataFrame:
    return job.stored_evidence(_run(t)).select("rule_id", "record_id", "field_name", "field_value", "error_message")


# What rules depend on, through views.

VIEWS = {
    "settled": "SELECT o_orderkey, o_custkey, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P'",
    "valued": "SELECT s.o_orderkey, s.price, c.* FROM settled s JOIN customer c ON s.o_custkey = c.c_custkey WHERE c.c_acctbal > 0",
}
DEPENDENT = {
    "direct": "SELECT o_orderkey AS id, o_orderdate, CASE WHEN o_orderdate IS NULL THEN 1 ELSE 0 END AS dq_check FROM orders",
    "one view": "SELECT o_orderkey AS id, price, CASE WHEN price > 0 THEN 0 ELSE 1 END AS dq_check FROM settled",
    "two views": "SELECT o_orderkey AS id, c_name, CASE WHEN c_name LIKE '%7' THEN 1 ELSE 0 END AS dq_check FROM valued",
    "subquery": "SELECT c_custkey AS id, c_phone, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 0 ELSE 1 END"
                " AS dq_check FROM (SELECT c_custkey, c_mktsegment AS c_phone FROM customer) c",
}
SETTLED = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
EXPECTED = [
    *[("direct", "orders", c, "") for c in ("o_orderkey", "o_orderdate")], *[("one view", "orders", c, "settled") for c in SETTLED],
    *[("two views", "orders", c, "valued") for c in SETTLED], *[("two views", "customer", c, "valued") for c in CUSTOMER],
    ("subquery", "orders", "o_custkey", ""), *[("subquery", "customer", c, "") for c in ("c_custkey", "c_mktsegment")],
]


@query("rule_dependencies", " UNION ALL ".join(
    f"SELECT '{rule}' AS rule_id, '{table}' AS dataset, '{name}' AS column_name, '{via}' AS via, count(*) AS records,"
    f" count(*) FILTER ({name} IS NULL) AS missing FROM {table}" for rule, table, name, via in EXPECTED))
def rule_dependencies(t: Tables) -> DataFrame:
    return impact(t.spark, DEPENDENT, t.views("orders", "customer"), VIEWS)


# Versions of tables.

PRICED = "CASE WHEN o_totalprice BETWEEN 1000 AND 400000 THEN 0 ELSE 1 END"


@query("rule_counts_as_of", " UNION ALL ".join(
    f"SELECT '{when}' AS moment, CAST(count(*) FILTER (f = 0) AS BIGINT) AS passed, CAST(count(*) FILTER (f = 1) AS BIGINT) AS failed"
    f" FROM (SELECT {PRICED} AS f FROM {rows})"
    for when, rows in (("first", "orders"), ("second", "(SELECT * REPLACE (o_totalprice * 1.5 AS o_totalprice) FROM orders WHERE o_orderstatus <> 'P')"))))
def rule_counts_as_of(t: Tables) -> DataFrame:
    """The same rule over a table as it was at two moments; the second version was there before either run."""
    store = scratch_store(t)
    later = t.orders.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 1.5)
    moments = {}
    for name, rows in (("first", t.orders), ("second", later)):
        version = store.save("orders", rows)
        moments[name] = datetime.fromisoformat(store.manifest("orders", version)["published_at"])
    rule = StoredRule("price", f"SELECT o_orderkey AS id, o_totalprice, {PRICED} AS dq_check FROM source", "orders", message="Wrong price")
    parts = []
    for name, moment in moments.items():
        report = RuleRunner(store, versions=store.as_of(moment)).run_table("orders", "runner", [rule], full_evidence=False)
        parts.append(job.results(store).where(F.col("run_id") == report.run_id).select(F.lit(name).alias("moment"), "passed", "failed"))
    return parts[0].unionByName(parts[1])


REFRESHED = "CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END"


@query("snapshot_refresh", f"""SELECT c_custkey AS source_id, {REFRESHED} AS c_name, c_acctbal FROM customer WHERE c_nationkey <> 5""")
def snapshot_refresh(t: Tables) -> DataFrame:
    """A snapshot of the customers, refreshed from the same source after it changed."""
    store = scratch_store(t)
    source = t.customer.select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal", "c_nationkey")
    snapshot.save_snapshot(store, source.drop("c_nationkey"), "people", "crm.customers", "ann")
    changed = source.where("c_nationkey <> 5").withColumn("c_name", F.expr(REFRESHED.replace("c_custkey", "id"))).drop("c_nationkey")
    snapshot.save_snapshot(store, changed, "people", "crm.customers", "ann", replace=True)
    return store.read("people").select("source_id", "c_name", "c_acctbal")


@query("rule_numbers_after_delete", """SELECT n AS created, lost AS deleted, made AS created_again, 0 AS used_twice, CAST(n + made AS BIGINT) AS highest
  FROM (SELECT count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS lost FROM customer), (SELECT count(*) AS made FROM part)""")
def rule_numbers_after_delete(t: Tables) -> DataFrame:
    """Rules are made, half of them deleted with the highest numbers among them, and others made: no number comes back."""
    store = scratch_store(t)

    def reserve(count: int, in_use: int) -> int:
        return store.reserve("rules", count, in_use)

    def requests(frame: DataFrame, key: str, name: str) -> DataFrame:
        return frame.select(
            F.col(key).alias("rule_key"), F.col(name).alias("description"), F.lit("range").alias("rule_type"), F.lit("t").alias("target_table"),
            F.lit("Wrong").alias("error_message"), F.lit("SELECT 1").alias("sql_query"), F.lit("low").alias("severity"))

    none = t.spark.createDataFrame([], "rule_id bigint, rule_key bigint, description string, rule_type string, target_table string, "
                                       "error_message string, sql_query string, severity string, version string, status string, created_at timestamp")
    at = datetime(2024, 1, 1)
    first = cut_lineage(registry.create_rules(none, requests(t.customer, "c_custkey", "c_name"), at, reserve)[0])
    top = first.count()
    left = first.where(F.col("rule_id") <= top - F.lit(first.where("rule_key % 2 = 0").count()))
    second = registry.create_rules(left, requests(t.part, "p_partkey", "p_name"), at, reserve)[0]
    fresh = second.join(left.select("rule_id"), "rule_id", "left_anti")
    again = fresh.join(first.select("rule_id"), "rule_id", "left_semi")
    return fresh.agg(F.count("*").alias("created_again"), F.max("rule_id").alias("highest")).select(
        F.lit(top).cast("bigint").alias("created"), F.lit(top - left.count()).cast("bigint").alias("deleted"), "created_again",
        F.lit(again.count()).cast("int").alias("used_twice"), "highest")
