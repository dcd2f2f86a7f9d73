"""Changes of the registry and of tables as whole results: edits, imports, deletion, conversions, exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from assayline.operators import columns, contract, registry, sync, tickets
from assayline.operators.evaluate import select
from assayline.plans.registry import Tables, query
from assayline.plans.registry_plans import BUMP, DEFINITIONS, DELETED, ERRORS_SQL, _runs_with_errors
from assayline.plans.stored_plans import scratch_store
from assayline.plans.stores import cte, frame
from assayline.sources import delimited

AT = datetime(2024, 1, 2)


def _rules(t: Tables) -> DataFrame:
    return frame(t, "rules").withColumn("cross_spec", F.lit(None).cast("string"))


# Edits of rules: every fourth customer asks for one; some ask for something that is refused.

EDITS = """SELECT c_custkey + CASE WHEN c_custkey % 40 = 0 THEN 50000000 ELSE 0 END AS rule_id, concat('new ', c_name) AS description,
  CASE WHEN c_custkey % 28 = 0 THEN ' ' ELSE 'edited' END AS rule_type, 'T9' AS target_table, 'Wrong' AS error_message, 'SELECT 2' AS sql_query,
  CASE WHEN c_custkey % 36 = 0 THEN 'urgent' ELSE 'high' END AS severity FROM customer WHERE c_custkey % 4 = 0"""
JUDGED = f"""judged AS (SELECT coalesce(r.rule_id, e.rule_id) AS rule_id, r.version, r.status, r.description, r.severity, e.description AS new_description,
    e.severity AS new_severity, CASE WHEN e.rule_id IS NULL THEN '-' WHEN r.rule_id IS NULL THEN 'rule not found'
    WHEN r.status = 'ACTIVE' THEN 'deactivate the rule before modifying it'
    WHEN e.severity NOT IN ('low', 'medium', 'high') THEN 'severity must be low, medium or high'
    WHEN trim(e.rule_type) = '' THEN 'description and rule type are required' END AS reason
  FROM rules r FULL OUTER JOIN ({EDITS}) e ON e.rule_id = r.rule_id)"""


@query("modify_rules", f"""WITH {cte("rules")}, {JUDGED} SELECT rule_id, reason AS refused, CASE WHEN reason IS NULL THEN new_description ELSE description END AS description,
    CASE WHEN reason IS NULL THEN new_severity ELSE severity END AS severity, CASE WHEN reason IS NULL THEN 'ACTIVE' ELSE status END AS status,
    CASE WHEN reason IS NULL THEN {BUMP.format(v="coalesce(version, '1.0')")} ELSE version END AS version
  FROM (SELECT rule_id, version, status, description, severity, new_description, new_severity, nullif(reason, '-') AS reason,
    reason = '-' AS unasked FROM judged) j WHERE reason IS NOT NULL OR NOT coalesce(unasked, false)
  UNION ALL SELECT rule_id, NULL, description, severity, status, version FROM judged WHERE reason = '-'""")
def modify_rules(t: Tables) -> DataFrame:
    edited, refused = registry.modify_rules(_rules(t), select(t.spark, EDITS, t.views("customer")), AT)
    return edited.join(refused, "rule_id", "full_outer").select("rule_id", "refused", "description", "severity", "status", "version")


@query("archive_rules", f"""WITH {cte("rules")}, asked AS (SELECT c_custkey + CASE WHEN c_custkey % 40 = 0 THEN 50000000 ELSE 0 END AS rule_id
    FROM customer WHERE c_custkey % 4 = 0)
  SELECT coalesce(r.rule_id, a.rule_id) AS rule_id, CASE WHEN a.rule_id IS NOT NULL AND r.status = 'ACTIVE' THEN 'INACTIVE' ELSE r.status END AS status,
    CASE WHEN a.rule_id IS NOT NULL AND r.status = 'ACTIVE' THEN r.version END AS archived_version,
    CASE WHEN a.rule_id IS NOT NULL AND r.status = 'ACTIVE' THEN r.severity END AS archived_severity,
    a.rule_id IS NOT NULL AND r.status IS DISTINCT FROM 'ACTIVE' AS refused FROM rules r FULL OUTER JOIN asked a ON a.rule_id = r.rule_id""")
def archive_rules(t: Tables) -> DataFrame:
    asked = select(t.spark, EDITS, t.views("customer")).select("rule_id")
    after, history, refused = registry.archive_rules(_rules(t), asked, "ann", AT)
    kept = history.select(
        "rule_id", F.col("version").alias("archived_version"), F.get_json_object("rule_params", "$.severity").alias("archived_severity"))
    marked = refused.withColumn("refused", F.lit(True))
    return after.select("rule_id", "status").join(kept, "rule_id", "left").join(marked, "rule_id", "full_outer").select(
        "rule_id", "status", "archived_version", "archived_severity", F.coalesce("refused", F.lit(False)).alias("refused"))


# Import of definitions, those that change a rule's table left out.

STAYING = f"SELECT * FROM ({DEFINITIONS}) d WHERE d.target_table <> 'T9'"


@query("import_rules_registry", f"""WITH {cte("rules")}, given AS ({STAYING}),
  joined AS (SELECT coalesce(o.rule_key, n.rule_key) AS rule_key, o.rule_id, o.version, o.rule_type AS old_type, n.rule_type AS new_type, o.status AS old_status,
    n.status AS new_status, n.rule_key IS NOT NULL AS hit, o.rule_key IS NULL AS fresh,
    coalesce({" AND ".join(f"o.{c} = n.{c}" for c in registry.COMPARED)}, false) AS same
    FROM rules o FULL OUTER JOIN given n ON o.rule_key = n.rule_key)
  SELECT rule_key, rule_id, CASE WHEN hit THEN new_type ELSE old_type END AS rule_type, CASE WHEN hit THEN new_status ELSE old_status END AS status,
    CASE WHEN fresh THEN '1.0' WHEN hit AND NOT same THEN {BUMP.format(v="coalesce(version, '1.0')")} ELSE version END AS version,
    CASE WHEN hit AND NOT fresh AND NOT same THEN 1 ELSE 0 END AS archived FROM joined""")
def import_rules_registry(t: Tables) -> DataFrame:
    rules = _rules(t)
    after, history, _ = registry.import_rules(rules, select(t.spark, STAYING, t.views("customer")), "ann", AT)
    known = rules.select(F.col("rule_key"), F.col("rule_id").alias("known_id"))
    archived = history.groupBy(F.col("rule_id").alias("known_id")).agg(F.count("*").cast("int").alias("archived"))
    return after.join(known, "rule_key", "left").join(archived, "known_id", "left").select(
        "rule_key", F.col("known_id").alias("rule_id"), "rule_type", "status", "version", F.coalesce("archived", F.lit(0)).alias("archived"))


# Deletion of rules with their history, over the runs whose counts add up.

RUN_FACTS = f"""{ERRORS_SQL}, deleted AS ({DELETED}),
  sound AS (SELECT run_id FROM results WHERE run_id IS NOT NULL GROUP BY run_id HAVING min(result_id) % 11 <> 0),
  results_ok AS (SELECT * FROM results WHERE run_id IN (SELECT run_id FROM sound)),
  left_over AS (SELECT run_id, count(DISTINCT rule_id) AS done, count(DISTINCT rule_id) FILTER (rule_id NOT IN (SELECT rule_id FROM deleted)) AS remaining
    FROM results_ok GROUP BY run_id),
  errs AS (SELECT run_id, count(*) FILTER (rule_id NOT IN (SELECT rule_id FROM deleted)) AS errors_left, count(*) AS errors_all FROM errors GROUP BY run_id)"""


def _deletion(t: Tables) -> dict[str, DataFrame]:
    runs, results = _runs_with_errors(t)
    runs = runs.where("rules_requested = rules_completed + size(execution_errors)")
    sound = runs.select("run_id")
    daily = frame(t, "daily")
    kept = {name: rows.join(sound, "run_id", "left_semi") for name, rows in (("results", results), ("evidence", frame(t, "evidence")))}
    made = tickets.replay(daily.withColumn("rule_id", F.expr("CAST(substr(table_name, 2) AS BIGINT)")).groupBy("rule_id", "table_name", "occurred_at").agg(
        F.sum("checked").alias("checked"), F.sum("failed").alias("failed"), F.max("run_id").alias("run_id"), F.max("result_id").alias("result_id"),
        F.max("rule_version").alias("rule_version"), F.lit("low").alias("severity")))
    ticketed = made.select(F.expr("rule_id * 1000 + ordinal").alias("ticket_id"), "rule_id", "table_name", "status", "closed_at")
    tables = {"rules": _rules(t), "history": frame(t, "history"), "runs": runs, "tickets": ticketed, **kept}
    return registry.delete_rules(tables, select(t.spark, DELETED, t.views("customer")), "ann", AT)


@query("delete_rules_runs", f"""WITH {cte("results", "evidence")}, {RUN_FACTS},
  seen AS (SELECT run_id, count(*) FILTER (rule_id NOT IN (SELECT rule_id FROM deleted)) AS rows_left FROM evidence WHERE run_id IS NOT NULL GROUP BY run_id),
  facts AS (SELECT l.*, coalesce(errors_left, 0) AS errors_left, coalesce(errors_all, 0) AS errors_all, coalesce(rows_left, 0) AS rows_left
    FROM left_over l LEFT JOIN errs USING (run_id) LEFT JOIN seen USING (run_id))
  SELECT run_id, CASE WHEN errors_left > 0 AND remaining > 0 THEN 'partial' WHEN errors_left > 0 THEN 'failed' ELSE 'completed' END AS status,
    remaining + errors_left AS rules_requested, remaining AS rules_completed, CAST(errors_left AS INTEGER) AS errors FROM facts
  WHERE NOT (remaining = 0 AND errors_left = 0 AND rows_left = 0 AND (remaining < done OR errors_left < errors_all))""")
def delete_rules_runs(t: Tables) -> DataFrame:
    return _deletion(t)["runs"].select("run_id", "status", "rules_requested", "rules_completed", F.size("execution_errors").alias("errors"))


@query("delete_rules_left", f"""WITH {cte("rules", "history", "results", "evidence")}, {RUN_FACTS}
  SELECT 'rules' AS name, count(*) AS n FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM deleted)
  UNION ALL SELECT 'history', count(*) FROM history WHERE rule_id NOT IN (SELECT rule_id FROM deleted)
  UNION ALL SELECT 'results', count(*) FROM results_ok WHERE rule_id NOT IN (SELECT rule_id FROM deleted)
  UNION ALL SELECT 'evidence', count(*) FROM evidence WHERE run_id IN (SELECT run_id FROM sound) AND rule_id NOT IN (SELECT rule_id FROM deleted)""")
def delete_rules_left(t: Tables) -> DataFrame:
    after = _deletion(t)
    parts = [after[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in ("rules", "history", "results", "evidence")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


# Definitions taken over from the other side.

OFFERED = """SELECT concat('cust-', c_custkey) AS rule_key, CASE WHEN c_custkey % 6 = 0 THEN concat('theirs ', c_name) ELSE c_name END AS description,
  c_mktsegment AS rule_type, {severity} AS severity, 'Check failed' AS error_message, c_acctbal >= CASE WHEN c_custkey % 10 = 2 THEN 500 ELSE 0 END AS active,
  concat('SELECT a|FROM t', c_custkey % 3, '|WHERE b > ', c_custkey % 10) AS sql FROM customer WHERE c_custkey % 2 = 0"""
SEVERITY = "CASE c_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END"


@query("accept_remote", f"""WITH {cte("rules")}, offered AS ({OFFERED.format(severity=SEVERITY)}),
  j AS (SELECT r.*, o.description AS new_description, o.active, o.rule_key IS NOT NULL AND (o.description <> r.description OR o.active <> (r.status = 'ACTIVE')) AS moves
    FROM rules r LEFT JOIN offered o ON o.rule_key = r.rule_key)
  SELECT rule_id, CASE WHEN moves THEN new_description ELSE description END AS description,
    CASE WHEN moves THEN CASE WHEN active THEN 'ACTIVE' ELSE 'INACTIVE' END ELSE status END AS status,
    CASE WHEN moves THEN {BUMP.format(v="coalesce(version, '1.0')")} ELSE version END AS version,
    CASE WHEN moves THEN 'remote' ELSE execution_mode END AS execution_mode, moves AS archived FROM j""")
def accept_remote(t: Tables) -> DataFrame:
    offered = select(t.spark, OFFERED.format(severity=SEVERITY), t.views("customer"))
    after, history = sync.accept_remote(_rules(t), offered, "ann", AT)
    archived = history.select("rule_id", F.lit(True).alias("archived"))
    return after.join(archived, "rule_id", "left").select(
        "rule_id", "description", "status", "version", "execution_mode", F.coalesce("archived", F.lit(False)).alias("archived"))


# What is left to repair, violations, conversions, exports.

OPENED = """opened AS (SELECT rule_id, max(run_id) AS failure_run_id FROM evidence WHERE test_result = 1 AND run_id IS NOT NULL GROUP BY rule_id)"""


@query("ticket_open_failures", f"""WITH {cte("evidence")}, {OPENED} SELECT o.rule_id * 10 AS ticket_id, e.rule_id, record_id, field_name, field_value, error_message
  FROM evidence e JOIN opened o ON o.rule_id = e.rule_id AND o.failure_run_id = e.run_id WHERE test_result = 1 AND o.rule_id % 7 <> 0""")
def ticket_open_failures(t: Tables) -> DataFrame:
    evidence = frame(t, "evidence")
    opened = evidence.where("test_result = 1 AND run_id IS NOT NULL").groupBy("rule_id").agg(F.max("run_id").alias("failure_run_id")).select(
        (F.col("rule_id") * 10).alias("ticket_id"), "rule_id", F.expr("CASE WHEN rule_id % 7 = 0 THEN 'closed' ELSE 'new' END").alias("status"), "failure_run_id")
    return tickets.open_failures(opened, evidence)


FLAGS = """SELECT CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS id, o_orderpriority,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN 2 ELSE CAST(o_orderkey % 2 AS INT) END AS dq_check FROM orders"""


@query("contract_violations", f"""WITH flags AS ({FLAGS}) SELECT id AS record_id, o_orderpriority AS field_value, CASE WHEN id IS NULL OR id = '' THEN 'empty id'
  ELSE concat('dq_check is ', coalesce(CAST(dq_check AS VARCHAR), 'missing')) END AS reason FROM flags
  WHERE id IS NULL OR id = '' OR dq_check IS NULL OR dq_check NOT IN (0, 1)""")
def contract_violations(t: Tables) -> DataFrame:
    return contract.violations(select(t.spark, FLAGS, t.views("orders")))


@query("align_types", """SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation,
  CASE WHEN c_custkey % 9 = 0 THEN 'none' ELSE CAST(c_nationkey AS VARCHAR) END AS mixed, 'BIGINT' AS nation_type, 'VARCHAR' AS mixed_type FROM customer""")
def align_types(t: Tables) -> DataFrame:
    """Whole numbers kept as text become numbers; a column with other texts among them stays text."""
    text = t.customer.select(
        F.col("c_custkey").cast("bigint").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"),
        F.expr("CASE WHEN c_custkey % 9 = 0 THEN 'none' ELSE string(c_nationkey) END").alias("mixed"))
    aligned, _ = columns.align_types(text, {"name": "TEXT", "nation": "BIGINT", "mixed": "BIGINT"}, preserve_invalid=True)
    named = {"bigint": "BIGINT", "string": "VARCHAR"}
    return aligned.select("*", *[F.lit(named[aligned.schema[c].dataType.simpleString()]).alias(f"{c}_type") for c in ("nation", "mixed")])


@query("export_failures", f"""WITH {cte("evidence")} SELECT CAST(rule_id AS VARCHAR) AS rule_id, record_id, field_name, field_value, error_message FROM evidence
  WHERE test_result = 1 AND run_id = (SELECT max(run_id) FROM evidence)""")
def export_failures(t: Tables) -> DataFrame:
    """The failing records of the newest run, written as delimited files and read again."""
    evidence = frame(t, "evidence")
    newest = evidence.agg(F.max("run_id")).first()[0]
    folder = f"{scratch_store(t).root}/export"
    delimited.export_failures(evidence, newest, folder, spreadsheet=False)
    return delimited.check_lines(delimited.read_delimited(t.spark, folder)).select("rule_id", "record_id", "field_name", "field_value", "error_message")
