"""Registry changes, tickets and synchronisation over the derived stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayline.operators import registry, sync, tickets
from assayline.operators.evaluate import select
from assayline.operators.loading import latest_loads
from assayline.plans.registry import SQL, Tables, query
from assayline.plans.stored_plans import scratch_store
from assayline.plans.stores import cte, frame, moment
from assayline.streaming.run_feed import LANDING, RunFeed


def _moment(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


# Registry.

BUMP = """concat(string_split({v}, '.')[1], '.', coalesce(TRY_CAST(string_split({v}, '.')[2] AS INT), 0) + 1)"""


@query("next_version", f"""WITH versions AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL
    WHEN c_custkey % 10 = 1 THEN CAST(c_nationkey AS STRING) ELSE concat(c_nationkey, '.', c_custkey % 100) END AS version FROM customer)
  SELECT c_custkey, version, {BUMP.format(v="coalesce(version, '1.0')")} AS next_version FROM versions""")
def next_version(t: Tables) -> DataFrame:
    versions = t.customer.selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN string(c_nationkey)"
        " ELSE concat(c_nationkey, '.', c_custkey % 100) END AS version",
    )
    return versions.withColumn("next_version", registry.next_version(F.col("version")))


DEFINITION_COLUMNS = """concat('cust-', key) AS rule_key, concat('Customer#', lpad(CAST(key AS STRING), 9, '0')) AS description,
  segment AS rule_type, concat('T', CASE WHEN key % 71 = 3 THEN 9 ELSE key % 5 + 1 END) AS target_table,
  'Check failed' AS error_message, concat('SELECT a|FROM t', key % 3, '|WHERE b > ', key % 10) AS sql_query,
  severity, status, CAST(NULL AS STRING) AS cross_spec"""
DEFINITIONS = f"""SELECT {DEFINITION_COLUMNS} FROM (
  SELECT c_custkey + CASE WHEN c_custkey % 13 = 0 THEN 50000000 ELSE 0 END AS key,
    CASE WHEN c_acctbal > 9000 THEN 'moved' ELSE c_mktsegment END AS segment,
    CASE c_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity,
    CASE WHEN c_acctbal < 500 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status FROM customer WHERE c_custkey % 4 <> 1) given"""


@query("registry_diff", f"""WITH {cte("rules")}, definitions AS ({DEFINITIONS}),
  joined AS (SELECT coalesce(o.rule_key, n.rule_key) AS rule_key, o.rule_id, o.version, n.rule_key IS NULL AS gone,
    o.rule_key IS NULL AS fresh, o.target_table <> n.target_table AS moved,
    ({" AND ".join(f"o.{c} = n.{c}" for c in registry.COMPARED)}) AS same
    FROM rules o FULL OUTER JOIN definitions n ON o.rule_key = n.rule_key),
  judged AS (SELECT *, CASE WHEN gone THEN 'absent' WHEN fresh THEN 'created' WHEN same THEN 'unchanged'
    WHEN moved THEN 'refused' ELSE 'updated' END AS action FROM joined)
  SELECT rule_key, rule_id, action, CASE WHEN action = 'created' THEN '1.0'
    WHEN action = 'updated' THEN {BUMP.format(v="coalesce(version, '1.0')")} ELSE version END AS new_version FROM judged""")
def registry_diff(t: Tables) -> DataFrame:
    rules = frame(t, "rules").withColumn("cross_spec", F.lit(None).cast("string"))
    definitions = select(t.spark, DEFINITIONS, t.views("customer"))
    return registry.registry_diff(rules, definitions).select("rule_key", "rule_id", "action", "new_version")


# Delete the rules of one in a hundred customers and reconcile the runs they took part in.
DELETED = "SELECT c_custkey AS rule_id FROM customer WHERE c_name LIKE '%77'"
ERRORS_SQL = """errors AS (SELECT run_id, first_rule AS rule_id FROM (SELECT run_id, min(rule_id) AS first_rule, min(result_id) AS first_result
  FROM results WHERE run_id IS NOT NULL GROUP BY run_id) WHERE first_result % 5 = 0)"""


def _runs_with_errors(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Runs whose partial ones carry one execution error, and their results."""
    results = frame(t, "results")
    linked = results.where("run_id IS NOT NULL")
    facts = linked.groupBy("run_id").agg(
        F.min("rule_id").alias("_rule"), F.min("result_id").alias("_first"), F.count_distinct("rule_id").alias("_done")
    )
    broken = F.col("_first") % 5 == 0
    error = F.struct(
        F.col("_rule").cast("string").alias("rule_id"), F.lit("").alias("description"), F.lit("1.0").alias("version"),
        F.lit("no such column").alias("message"),
    )
    runs = frame(t, "runs").select("run_id", "table_name").join(facts, "run_id").select(
        "run_id", "table_name",
        F.when(broken, F.lit("partial")).otherwise(F.lit("completed")).alias("status"),
        (F.col("_done") + broken.cast("int") + (F.col("_first") % 11 == 0).cast("int")).alias("rules_requested"),
        F.col("_done").alias("rules_completed"),
        F.when(broken, F.array(error)).otherwise(F.array().cast("array<struct<rule_id:string,description:string,version:string,message:string>>"))
        .alias("execution_errors"),
    )
    return runs, linked


@query("reconcile_runs_after_delete", f"""WITH {cte("results", "evidence")}, deleted AS ({DELETED}), {ERRORS_SQL},
  facts AS (SELECT run_id, min(result_id) AS first, count(DISTINCT rule_id) AS done,
    count(DISTINCT rule_id) FILTER (rule_id IN (SELECT rule_id FROM deleted)) AS lost FROM results WHERE run_id IS NOT NULL GROUP BY run_id),
  seen AS (SELECT run_id, count(*) FILTER (rule_id NOT IN (SELECT rule_id FROM deleted)) AS rows_left,
    count(*) FILTER (rule_id IN (SELECT rule_id FROM deleted)) AS rows_lost FROM evidence WHERE run_id IS NOT NULL GROUP BY run_id),
  gone_errors AS (SELECT run_id, count(*) FILTER (rule_id IN (SELECT rule_id FROM deleted)) AS errors_lost,
    count(*) FILTER (rule_id NOT IN (SELECT rule_id FROM deleted)) AS errors_left FROM errors GROUP BY run_id),
  all_facts AS (SELECT f.*, coalesce(rows_left, 0) AS rows_left, coalesce(rows_lost, 0) AS rows_lost,
    coalesce(errors_left, 0) AS errors_left, coalesce(errors_lost, 0) AS errors_lost, done - lost AS remaining,
    done + CASE WHEN first % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN first % 11 = 0 THEN 1 ELSE 0 END AS requested,
    CASE WHEN first % 5 = 0 THEN 'partial' ELSE 'completed' END AS old_status
    FROM facts f LEFT JOIN seen USING (run_id) LEFT JOIN gone_errors USING (run_id)),
  judged AS (SELECT *, CASE WHEN lost = 0 AND rows_lost = 0 AND errors_lost = 0 THEN 'untouched'
    WHEN requested <> done + errors_left + errors_lost THEN 'inconsistent'
    WHEN remaining = 0 AND errors_left = 0 AND rows_left = 0 THEN 'removed' ELSE 'kept' END AS outcome FROM all_facts)
  SELECT run_id, outcome,
    CASE WHEN outcome <> 'kept' THEN old_status WHEN errors_left > 0 AND remaining > 0 THEN 'partial'
      WHEN errors_left > 0 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN outcome = 'kept' THEN remaining + errors_left ELSE requested END AS rules_requested,
    CASE WHEN outcome = 'kept' THEN remaining ELSE done END AS rules_completed FROM judged""")
def reconcile_runs_after_delete(t: Tables) -> DataFrame:
    runs, results = _runs_with_errors(t)
    deleted = select(t.spark, DELETED, t.views("customer"))
    after = registry.reconcile_after_delete(runs, results, frame(t, "evidence"), deleted)
    return after.select("run_id", "outcome", "status", "rules_requested", "rules_completed")


@query("flip_flags", """SELECT event_id, CASE flag WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE flag END AS test_result
  FROM (SELECT event_id, CAST(event_id % 3 AS INT) AS flag FROM events)""")
def flip_flags(t: Tables) -> DataFrame:
    return registry.flip_flags(t.events.selectExpr("event_id", "CAST(event_id % 3 AS INT) AS test_result"))


@query("table_bindings", f"""WITH {cte("links")}, bound AS (SELECT DISTINCT target_table, source_catalog, source_schema, source_table FROM links)
  SELECT target_table, min(source_catalog) AS source_catalog, min(source_schema) AS source_schema,
    min(source_table) AS source_table, count(*) > 1 AS conflicting FROM bound GROUP BY target_table""")
def table_bindings(t: Tables) -> DataFrame:
    return registry.table_bindings(frame(t, "links"))


# Tickets.

REPLAY = """ordered AS (SELECT *, coalesce(sum(CASE WHEN failed = 0 AND checked > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id, table_name
    ORDER BY occurred_at, result_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ordinal FROM {daily}),
  grouped AS (SELECT rule_id, table_name, ordinal, count(*) FILTER (failed > 0) AS failures, min(occurred_at) FILTER (failed > 0) AS created_at,
    max(occurred_at) FILTER (failed > 0) AS last_seen, min(severity) AS severity, max(occurred_at) FILTER (failed = 0 AND checked > 0) AS closed_at,
    arg_max(failed, occurred_at) FILTER (failed > 0) AS last_failed, arg_max(rule_version, occurred_at) FILTER (failed > 0) AS rule_version,
    arg_max(run_id, occurred_at) FILTER (failed > 0) AS failure_run_id, max(run_id) AS latest_run_id
    FROM ordered GROUP BY rule_id, table_name, ordinal HAVING count(*) FILTER (failed > 0) > 0),
  replayed AS (SELECT *, CASE WHEN closed_at IS NULL THEN 'new' ELSE 'closed' END AS status,
    created_at + to_days(CASE severity WHEN 'low' THEN 7 WHEN 'medium' THEN 3 ELSE 1 END) AS due_at,
    CASE WHEN closed_at IS NULL THEN last_failed ELSE 0 END AS failed_count FROM grouped)"""


@query("tickets_replay", f"""WITH {cte("daily")}, {REPLAY.format(daily="daily")}
  SELECT rule_id, table_name, CAST(ordinal AS BIGINT) AS ordinal, severity, status, {moment("created_at")} AS created,
    {moment("last_seen")} AS seen, {moment("due_at")} AS due, {moment("closed_at")} AS closed, rule_version, failed_count,
    latest_run_id, failure_run_id, failures FROM replayed""")
def tickets_replay(t: Tables) -> DataFrame:
    return tickets.replay(frame(t, "daily")).select(
        "rule_id", "table_name", F.col("ordinal").cast("bigint").alias("ordinal"), "severity", "status",
        _moment("created_at").alias("created"), _moment("last_seen").alias("seen"), _moment("due_at").alias("due"),
        _moment("closed_at").alias("closed"), "rule_version", "failed_count", "latest_run_id", "failure_run_id", "failures",
    )


TITLE = "concat('Check ', rule_id, ' of ', table_name)"


def _tickets(t: Tables, days: str) -> DataFrame:
    """The ticket table as it stands after some days of results."""
    return tickets.replay(frame(t, "daily").where(days)).selectExpr(
        "rule_id * 1000000 + CAST(substr(table_name, 2) AS BIGINT) * 100 + ordinal AS ticket_id", "rule_id", "rule_version", "table_name",
        f"{TITLE} AS title", "severity",
        "CASE WHEN status = 'new' AND rule_id % 2 = 0 THEN 'to_verify' ELSE status END AS status",
        "'runner' AS reporter", "concat('user', rule_id % 4) AS assignee", "CAST(NULL AS STRING) AS imported_by",
        "CAST(NULL AS STRING) AS source_file", "created_at", "last_seen", "due_at", "closed_at", "failed_count",
        "latest_run_id", "failure_run_id",
    )


TICKETS = f"""{REPLAY}, tickets AS (SELECT CAST(rule_id * 1000000 + CAST(substr(table_name, 2) AS BIGINT) * 100 + ordinal AS BIGINT) AS ticket_id,
  rule_id, rule_version, table_name, {TITLE} AS title, severity,
  CASE WHEN status = 'new' AND rule_id % 2 = 0 THEN 'to_verify' ELSE status END AS status, 'runner' AS reporter,
  concat('user', rule_id % 4) AS assignee, created_at, last_seen, due_at, closed_at, failed_count, latest_run_id, failure_run_id FROM replayed)"""
EARLIER, NEXT = "occurred_at < TIMESTAMP '2024-01-21'", "occurred_at = TIMESTAMP '2024-01-21'"


@query("tickets_apply", f"""WITH {cte("daily", "load_log")},
  {TICKETS.format(daily=f"(SELECT * FROM daily WHERE {EARLIER})")},
  loads AS (SELECT * FROM load_log QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY loaded_at DESC, load_id DESC) = 1),
  outcome AS (SELECT * FROM daily WHERE {NEXT}),
  opened AS (SELECT * FROM tickets WHERE status <> 'closed'),
  joined AS (SELECT coalesce(o.rule_id, r.rule_id) AS rule_id, coalesce(o.table_name, r.table_name) AS table_name,
    o.ticket_id, o.status AS old_status, o.severity AS old_severity, o.due_at AS old_due, o.created_at AS old_created, o.last_seen AS old_seen,
    o.failed_count AS old_failed, o.failure_run_id AS old_failure_run, o.assignee AS old_assignee,
    r.severity, r.failed, r.checked, r.run_id, r.occurred_at,
    CASE WHEN r.failed > 0 AND o.ticket_id IS NULL THEN 'created' WHEN r.failed > 0 THEN 'failed'
      WHEN o.ticket_id IS NOT NULL AND r.checked > 0 THEN 'verified' WHEN o.ticket_id IS NOT NULL AND r.rule_id IS NOT NULL THEN 'empty' END AS action
    FROM opened o FULL OUTER JOIN outcome r ON o.rule_id = r.rule_id AND o.table_name = r.table_name)
  SELECT ticket_id, j.rule_id, j.table_name, action,
    CASE action WHEN 'created' THEN 'new' WHEN 'verified' THEN 'closed'
      WHEN 'failed' THEN CASE WHEN old_status = 'to_verify' THEN 'in_progress' ELSE old_status END ELSE old_status END AS status,
    CASE WHEN action = 'created' THEN severity ELSE old_severity END AS severity,
    {moment("CASE WHEN action = 'created' THEN occurred_at + to_days(CASE severity WHEN 'low' THEN 7 WHEN 'medium' THEN 3 ELSE 1 END) ELSE old_due END")} AS due,
    {moment("CASE WHEN action IN ('created', 'failed') THEN occurred_at ELSE old_seen END")} AS seen,
    CASE WHEN action = 'created' THEN 'job' ELSE old_assignee END AS assignee,
    CASE WHEN action = 'created' THEN l.loaded_by END AS imported_by, CASE WHEN action = 'created' THEN l.file_name END AS source_file,
    CASE WHEN action IN ('created', 'failed') THEN failed WHEN action = 'verified' THEN 0 ELSE old_failed END AS failed_count,
    CASE WHEN action IN ('created', 'failed') THEN run_id ELSE old_failure_run END AS failure_run_id
  FROM joined j LEFT JOIN loads l ON l.table_name = j.table_name WHERE ticket_id IS NOT NULL OR action = 'created'
  UNION ALL SELECT ticket_id, rule_id, table_name, NULL, status, severity, {moment("due_at")}, {moment("last_seen")}, assignee, NULL, NULL,
    failed_count, failure_run_id FROM tickets WHERE status = 'closed'""")
def tickets_apply(t: Tables) -> DataFrame:
    outcome = frame(t, "daily").where(NEXT).selectExpr(
        "rule_id", "table_name", "rule_version", f"{TITLE} AS title", "severity", "run_id", "'job' AS actor", "failed", "checked", "occurred_at"
    )
    applied = tickets.apply_run(_tickets(t, EARLIER), outcome, latest_loads(frame(t, "load_log")))
    return applied.select(
        "ticket_id", "rule_id", "table_name", "action", "status", "severity", _moment("due_at").alias("due"),
        _moment("last_seen").alias("seen"), "assignee", "imported_by", "source_file", "failed_count", "failure_run_id",
    )


@query("tickets_apply_many", f"""WITH {cte("daily")}, {REPLAY.format(daily="daily")}
  SELECT rule_id, table_name, severity, status, {moment("created_at")} AS created, {moment("last_seen")} AS seen, {moment("due_at")} AS due,
    {moment("closed_at")} AS closed, rule_version, failed_count, CAST(failure_run_id AS VARCHAR) AS failure_run_id,
    CASE WHEN closed_at IS NOT NULL THEN 'verified' WHEN last_word > last_seen THEN 'empty' WHEN failures = 1 THEN 'created' ELSE 'failed' END AS action
  FROM (SELECT r.*, (SELECT max(occurred_at) FROM ordered o WHERE o.rule_id = r.rule_id AND o.table_name = r.table_name
    AND o.ordinal = r.ordinal) AS last_word FROM replayed r)""")
def tickets_apply_many(t: Tables) -> DataFrame:
    """The whole history as one batch of runs, applied to no tickets."""
    history = frame(t, "daily").selectExpr(
        "rule_id", "table_name", "rule_version", f"{TITLE} AS title", "severity", "string(run_id) AS run_id", "'job' AS actor", "failed", "checked", "occurred_at")
    none = t.spark.createDataFrame([], tickets.TICKET)
    applied = tickets.apply_runs(none, history, latest_loads(frame(t, "load_log")))
    return applied.select(
        "rule_id", "table_name", "severity", "status", _moment("created_at").alias("created"), _moment("last_seen").alias("seen"),
        _moment("due_at").alias("due"), _moment("closed_at").alias("closed"), "rule_version", "failed_count", "failure_run_id", "action")


NOW = "TIMESTAMP '2024-01-25 12:00:00'"


@query("ticket_list", f"""WITH {cte("daily")}, {TICKETS.format(daily="daily")}
  SELECT ticket_id, title, status, {moment("due_at")} AS due, status <> 'closed' AND due_at < {NOW} AS overdue FROM tickets
  ORDER BY status = 'closed', due_at, ticket_id""")
def ticket_list(t: Tables) -> DataFrame:
    listed = tickets.ticket_list(_tickets(t, "true"), F.expr(f"{NOW.replace('TIMESTAMP', 'TIMESTAMP_NTZ')}"))
    return listed.select("ticket_id", "title", "status", _moment("due_at").alias("due"), "overdue")


@query("ticket_scope_counts", f"""WITH {cte("daily")}, {TICKETS.format(daily="daily")}
  SELECT count(*) FILTER (status <> 'closed') AS open_tickets, count(*) AS all_tickets,
    count(*) FILTER (status <> 'closed' AND assignee = 'user2') AS mine,
    count(*) FILTER (status <> 'closed' AND due_at < {NOW}) AS overdue FROM tickets""")
def ticket_scope_counts(t: Tables) -> DataFrame:
    return tickets.scope_counts(_tickets(t, "true"), "user2", F.expr(f"{NOW.replace('TIMESTAMP', 'TIMESTAMP_NTZ')}"))


# Synchronisation: orders as remote runs, order lines with a high discount as their errors.

SOURCE = '["main","sales","orders"]'


def _payload(key: str) -> str:
    return (
        f"concat('{{\"active\":true,\"description\":\"Orders of ', {key}, '\",\"references\":', CASE WHEN {key} % 5 = 0"
        f" THEN '{{\"parts\":[\"main\",\"sales\",\"part\"]}}' ELSE '{{}}' END, ',\"rule_key\":\"cust-', {key}, '\",\"source\":{SOURCE}}}')"
    )


BUNDLE: dict[str, tuple[str, tuple[str, ...]]] = {
    "remote_runs": (
        f"""SELECT concat('ep', o_custkey % 3) AS endpoint, concat('r', o_orderkey) AS run_id, concat('cust-', o_custkey) AS rule_key,
          CASE WHEN o_orderkey % 23 = 0 THEN 'stale' ELSE {{sha}} END AS revision, payload,
          concat({{day}}, CASE WHEN o_orderkey % 17 = 0 THEN 'T08:00:00' ELSE 'T08:00:00+00:00' END) AS started_at,
          concat({{day}}, CASE WHEN o_orderkey % 19 = 0 THEN 'T07:00:00+00:00' ELSE 'T08:05:00+00:00' END) AS completed_at,
          CASE WHEN o_orderkey % 13 = 0 THEN 'running' WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'completed' END AS status,
          o_orderkey % 100 AS source_version, CASE WHEN o_orderkey % 10 = 0 THEN 'no such column' END AS execution_error,
          CASE WHEN o_custkey % 5 = 0 AND o_orderkey % 7 <> 0 THEN '{{{{"parts":3}}}}' END AS reference_versions, o_orderkey, o_orderdate
          FROM (SELECT *, {_payload("o_custkey").replace("{", "{{").replace("}", "}}")} AS payload FROM orders) o""",
        ("orders",),
    ),
    "remote_results": (
        """SELECT concat('r', l_orderkey) AS run_id, count(CASE WHEN l_discount <= 0.08 THEN 1 END) AS passed,
          count(CASE WHEN l_discount > 0.08 THEN 1 END) + CASE WHEN l_orderkey % 29 = 0 THEN 1 ELSE 0 END AS failed,
          'l_discount' AS field_name FROM lineitem GROUP BY l_orderkey""",
        ("lineitem",),
    ),
    "remote_errors": (
        """SELECT concat('r', l_orderkey) AS run_id, CASE WHEN l_orderkey % 31 = 0 THEN '' ELSE concat(l_partkey, '-', l_linenumber) END AS record_id,
          CASE WHEN l_orderkey % 37 = 0 THEN 'l_tax' ELSE 'l_discount' END AS field_name, l_returnflag AS field_value,
          'Discount is too high' AS error_message FROM lineitem WHERE l_discount > 0.08""",
        ("lineitem",),
    ),
    "bound": (
        """SELECT concat('ep', c_custkey % 3) AS endpoint, concat('cust-', c_custkey) AS rule_key, c_custkey AS rule_id,
          'orders' AS target_table, 'main' AS source_catalog, CASE WHEN c_nationkey = 7 THEN 'other' ELSE 'sales' END AS source_schema,
          'orders' AS source_table FROM customer WHERE c_nationkey <> 3""",
        ("customer",),
    ),
    "known": (
        f"""SELECT concat('cust-', c_custkey) AS rule_key, {{sha}} AS revision, concat('1.', c_custkey % 4) AS local_version, payload
          FROM (SELECT *, {_payload("c_custkey").replace("{", "{{").replace("}", "}}")} AS payload FROM customer) c WHERE c_nationkey <> 11""",
        ("customer",),
    ),
    "seen": (
        """SELECT concat('ep', o_custkey % 3) AS endpoint, concat('r', o_orderkey) AS remote_run_id FROM orders
          WHERE o_orderkey % 2 = 0 AND o_orderdate < TIMESTAMP '1997-01-01'""",
        ("orders",),
    ),
}


def _bundle(t: Tables, name: str) -> DataFrame:
    text, tables = BUNDLE[name]
    text = text.format(sha="sha2(payload, 256)", day="date_format(o_orderdate, 'yyyy-MM-dd')") if "{" in text else text
    return select(t.spark, text, t.views(*tables))


def _bundle_cte(*names: str) -> str:
    parts = []
    for name in names:
        text = BUNDLE[name][0]
        text = text.format(sha="sha256(payload)", day="strftime(o_orderdate, '%Y-%m-%d')") if "{" in text else text
        parts.append(f"{name} AS ({text})")
    return ", ".join(parts)


DONE = "status = 'completed'"
AUDITED = f"""summary AS (SELECT run_id, count(*) AS summaries, min(passed) AS passed, min(failed) AS failed, min(field_name) AS field FROM remote_results GROUP BY run_id),
  details AS (SELECT run_id, count(*) AS errors, count(*) FILTER (record_id = '') AS blank, min(field_name) AS low, max(field_name) AS high
    FROM remote_errors GROUP BY run_id),
  audited AS (SELECT r.*, s.passed, s.failed, s.field, b.rule_id, k.local_version, CASE
    WHEN sha256(r.payload) <> r.revision THEN 'checksum mismatch'
    WHEN b.rule_id IS NULL THEN 'rule is not linked'
    WHEN b.source_schema <> 'sales' THEN 'source does not match the mapping'
    WHEN length(r.started_at) = 19 OR length(r.completed_at) = 19 THEN 'timestamps must include their time zone'
    WHEN r.completed_at < r.started_at THEN 'run ends before it starts'
    WHEN status NOT IN ('completed', 'failed') THEN 'run is not complete'
    WHEN {DONE} AND contains(r.payload, '"parts"') <> (r.reference_versions IS NOT NULL) THEN 'reference versions are missing or invalid'
    WHEN {DONE} AND coalesce(summaries, 0) <> 1 THEN 'run summary is incomplete'
    WHEN {DONE} AND coalesce(errors, 0) <> s.failed THEN 'error rows do not match the summary'
    WHEN {DONE} AND (blank > 0 OR low <> field OR high <> field) THEN 'invalid error details'
    WHEN k.local_version IS NULL THEN 'unrecognised revision' END AS reason
    FROM remote_runs r LEFT JOIN summary s ON s.run_id = r.run_id LEFT JOIN details d ON d.run_id = r.run_id
    LEFT JOIN bound b ON b.endpoint = r.endpoint AND b.rule_key = r.rule_key
    LEFT JOIN known k ON k.rule_key = r.rule_key AND k.revision = r.revision)"""
ALL_SQL = f"WITH {_bundle_cte('remote_runs', 'remote_results', 'remote_errors', 'bound', 'known', 'seen')}, {AUDITED}"


def _audited(t: Tables, seen: DataFrame | None = None) -> DataFrame:
    runs = _bundle(t, "remote_runs")
    return sync.audit_bundles(
        runs if seen is None else sync.unseen(runs, seen), _bundle(t, "remote_results"), _bundle(t, "remote_errors"), _bundle(t, "bound"), _bundle(t, "known")
    )


@query("run_bundle_audit", f"{ALL_SQL} SELECT endpoint, run_id, status, passed, failed, rule_id, local_version, reason FROM audited")
def run_bundle_audit(t: Tables) -> DataFrame:
    return _audited(t).select("endpoint", "run_id", "status", "passed", "failed", "rule_id", "local_version", "reason")


@query("run_bundle_audit_rewritten", SQL["run_bundle_audit"])
def run_bundle_audit_rewritten(t: Tables) -> DataFrame:
    """Runs and known versions whose payloads were written another way: order of keys, spaces, escapes."""
    def rewritten(frame: DataFrame) -> DataFrame:
        key = F.substring_index(F.get_json_object("payload", "$.rule_key"), "-", -1)
        other = F.concat(
            F.lit('{ "source" : '), F.get_json_object("payload", "$.source"), F.lit(', "rule_key":"\\u0063ust-'), key, F.lit('",\n "references": '),
            F.get_json_object("payload", "$.references"), F.lit(',"description":"Orders of '), key, F.lit('", "active":true }'))
        return frame.withColumn("payload", other)

    audited = sync.audit_bundles(
        rewritten(_bundle(t, "remote_runs")), _bundle(t, "remote_results"), _bundle(t, "remote_errors"), _bundle(t, "bound"), rewritten(_bundle(t, "known")))
    return audited.select("endpoint", "run_id", "status", "passed", "failed", "rule_id", "local_version", "reason")


@query("import_in_waves", f"""{ALL_SQL} SELECT endpoint, run_id, CASE WHEN reason IS NULL THEN 'imported'
    WHEN reason IN ({", ".join(f"'{w}'" for w in sync.WAITS)}) THEN 'waiting' ELSE 'refused' END AS state, reason,
  CASE WHEN reason IS NULL AND {DONE} THEN failed END AS failed FROM audited""")
def import_in_waves(t: Tables) -> DataFrame:
    """Runs land first, their results later, their errors last; the feed imports each once it is complete."""
    runs = _bundle(t, "remote_runs")
    owner = runs.select("endpoint", "run_id")
    folder = scratch_store(t).root
    feed = RunFeed(
        t.spark, f"{folder}/landing", f"{folder}/state", lambda: _bundle(t, "bound"), lambda: _bundle(t, "known"),
        lambda: latest_loads(frame(t, "load_log")))
    waves = {"runs": runs, "results": _bundle(t, "remote_results").join(owner, "run_id"), "errors": _bundle(t, "remote_errors").join(owner, "run_id")}
    for name, rows in waves.items():
        schema = t.spark.createDataFrame([], LANDING[name]).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(f"{folder}/landing/{name}/wave")
        feed.advance()
    counted = feed.table("results").select(F.col("run_id").alias("local_run_id"), "failed")
    done = feed.table("receipts").join(counted, "local_run_id", "left").select(
        "endpoint", F.col("remote_run_id").alias("run_id"), F.lit("imported").alias("state"), F.lit(None).cast("string").alias("reason"), "failed")
    rest = [
        feed.table(name).select("endpoint", "run_id", F.lit(name).alias("state"), "reason", F.lit(None).cast("bigint").alias("failed"))
        for name in ("waiting", "refused")]
    return done.unionByName(rest[0]).unionByName(rest[1])


FRESH = "fresh AS (SELECT * FROM audited a WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.endpoint = a.endpoint AND s.remote_run_id = a.run_id))"


@query("import_new_runs", f"""{ALL_SQL}, {FRESH} SELECT concat(endpoint, '/', run_id) AS run_id, status, rule_id,
  {moment("CAST(started_at AS TIMESTAMP)")} AS started, CASE WHEN {DONE} THEN 1 ELSE 0 END AS rules_completed,
  CASE WHEN {DONE} THEN passed END AS passed, CASE WHEN {DONE} THEN failed END AS failed,
  CASE WHEN status = 'failed' THEN execution_error END AS execution_error FROM fresh""")
def import_new_runs(t: Tables) -> DataFrame:
    seen = _bundle(t, "seen")
    fresh = sync.new_runs(_audited(t, seen), seen)
    rows = sync.imported_rows(fresh, _bundle(t, "remote_errors"), "sync")
    results = rows["results"].select("run_id", "passed", "failed")
    rule = rows["receipts"].select(F.col("local_run_id").alias("run_id"), "rule_key")
    return rows["runs"].join(results, "run_id", "left").join(rule, "run_id").select(
        "run_id", "status", F.substring_index("rule_key", "-", -1).cast("bigint").alias("rule_id"),
        _moment("started_at").alias("started"), "rules_completed", "passed", "failed",
        F.try_element_at("execution_errors", F.lit(1))["message"].alias("execution_error"),
    )


@query("import_evidence", f"""{ALL_SQL}, {FRESH} SELECT concat(f.endpoint, '/', f.run_id) AS run_id, rule_id, local_version AS rule_version,
  record_id, field_name, field_value, error_message FROM fresh f JOIN remote_errors e ON e.run_id = f.run_id WHERE f.status = 'completed'""")
def import_evidence(t: Tables) -> DataFrame:
    seen = _bundle(t, "seen")
    fresh = sync.new_runs(_audited(t, seen), seen)
    return sync.imported_rows(fresh, _bundle(t, "remote_errors"), "sync")["evidence"].select(
        "run_id", "rule_id", "rule_version", "record_id", "field_name", "field_value", "error_message"
    )


@query("late_runs", """SELECT o_orderkey AS arrival, o_custkey AS rule_id, coalesce(o_orderdate < max(o_orderdate) OVER (PARTITION BY o_custkey
  ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM orders""")
def late_runs(t: Tables) -> DataFrame:
    arrivals = t.orders.select(
        F.lit("ep").alias("endpoint"), F.col("o_custkey").alias("rule_key"), F.col("o_orderkey").alias("arrival"),
        F.col("o_orderdate").alias("started"),
    )
    marked = sync.mark_late(arrivals, ["arrival"], F.floor(F.col("arrival") / 1000))
    return marked.select("arrival", F.col("rule_key").alias("rule_id"), "late")


@query("sync_summary", f"""{ALL_SQL}, finished AS (SELECT a.*, s.remote_run_id IS NOT NULL AS existing FROM audited a
    LEFT JOIN seen s ON s.endpoint = a.endpoint AND s.remote_run_id = a.run_id WHERE status IN ('completed', 'failed'))
  SELECT count(*) AS available, count(*) FILTER (existing) AS existing, count(*) FILTER (NOT existing AND reason IS NULL) AS imported,
    count(*) FILTER (NOT existing AND reason IS NULL AND status = 'failed') AS failed_runs,
    count(*) FILTER (NOT existing AND reason IS NOT NULL) AS refused,
    {moment("max(CASE WHEN length(started_at) > 19 THEN CAST(substr(started_at, 1, 19) AS TIMESTAMP) END)")} AS latest FROM finished""")
def sync_summary(t: Tables) -> DataFrame:
    summary = sync.sync_summary(_audited(t), _bundle(t, "seen"))
    return summary.withColumn("latest", _moment("latest"))


LOCAL = """SELECT concat('cust-', c_custkey) AS rule_key, md5(concat('v2', c_custkey)) AS revision, 'p' AS payload,
  CASE WHEN c_custkey % 9 = 0 THEN 'edited' ELSE md5(concat('v2', c_custkey)) END AS expected_local,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'older' ELSE md5(concat('v', c_custkey % 3, c_custkey)) END AS expected_remote,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE md5(concat('v1', c_custkey)) END AS base_revision FROM customer"""
REMOTE = """SELECT concat('cust-', c_custkey) AS rule_key, md5(concat('v', c_custkey % 3, c_custkey)) AS revision, 'q' AS payload
  FROM customer WHERE c_custkey % 4 <> 0"""


@query("publish_conflicts", f"""WITH l AS ({LOCAL}), r AS ({REMOTE}) SELECT l.rule_key, CASE
  WHEN l.revision <> expected_local THEN 'local changed' WHEN r.revision IS DISTINCT FROM expected_remote THEN 'remote changed'
  WHEN r.revision IS NULL THEN 'insert' WHEN r.revision = l.revision THEN 'same'
  WHEN r.revision IS NOT DISTINCT FROM base_revision THEN 'update' ELSE 'conflict' END AS outcome
  FROM l LEFT JOIN r ON r.rule_key = l.rule_key""")
def publish_conflicts(t: Tables) -> DataFrame:
    local, remote = (select(t.spark, text, t.views("customer")) for text in (LOCAL, REMOTE))
    return sync.publish_outcome(local, remote).select("rule_key", "outcome")


@query("compare_definitions", f"""WITH l AS ({LOCAL}), r AS ({REMOTE} UNION ALL SELECT concat('part-', p_partkey), 'x', 'q' FROM part)
  SELECT coalesce(l.rule_key, r.rule_key) AS rule_key, CASE WHEN r.revision IS NULL THEN 'only local' WHEN l.revision IS NULL THEN 'only remote'
  WHEN l.revision = r.revision THEN 'same' ELSE 'different' END AS state FROM l FULL OUTER JOIN r ON r.rule_key = l.rule_key""")
def compare_definitions(t: Tables) -> DataFrame:
    local, remote = (select(t.spark, text, t.views("customer")) for text in (LOCAL, REMOTE))
    parts = t.part.selectExpr("concat('part-', p_partkey) AS rule_key", "'x' AS revision", "'q' AS payload")
    return sync.compare_definitions(local, remote.unionByName(parts)).select("rule_key", "state")
