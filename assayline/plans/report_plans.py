"""Result analytics and the rule library over the derived stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayline.operators import library, reports
from assayline.plans.registry import Tables, query
from assayline.plans.stores import cte, day, frame

KPI = "100.0 * passed / nullif(passed + failed, 0)"
SUMS = """sums AS (SELECT run_id, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed) AS BIGINT) AS failed
  FROM results WHERE run_id IS NOT NULL GROUP BY run_id)"""
LATEST = """latest AS (SELECT * FROM results
  QUALIFY row_number() OVER (PARTITION BY rule_id, rule_version ORDER BY executed_at DESC, result_id DESC) = 1)"""


def _day(name: str | Column) -> Column:
    return F.date_format(name, "yyyy-MM-dd")


def _rounded(name: str = "kpi") -> Column:
    return F.round(name, 6).alias(name)


@query("run_totals", f"""WITH {cte("runs", "results")}, {SUMS}
  SELECT runs.run_id, status, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed
  FROM runs LEFT JOIN sums ON runs.run_id = sums.run_id""")
def run_totals(t: Tables) -> DataFrame:
    return reports.run_totals(frame(t, "runs"), frame(t, "results")).select("run_id", "status", "passed", "failed")


VERSIONS = """versions AS (SELECT concat('cust-', c_custkey) AS rule_key, md5(concat('rev', c_custkey % 7)) AS revision,
  concat('{"description":"Check of ', c_name, '"}') AS payload FROM customer)"""


@query("runs_for_table", f"""WITH {cte("runs", "receipts")}, {VERSIONS},
  described AS (SELECT local_run_id, min(json_extract_string(payload, '$.description')) AS rule_description
    FROM receipts JOIN versions USING (rule_key, revision) GROUP BY local_run_id)
  SELECT run_id, table_name, {day("started_at")} AS started, rule_description
  FROM runs LEFT JOIN described ON run_id = local_run_id""")
def runs_for_table(t: Tables) -> DataFrame:
    versions = t.customer.selectExpr(
        "concat('cust-', c_custkey) AS rule_key", "md5(concat('rev', c_custkey % 7)) AS revision",
        "concat('{\"description\":\"Check of ', c_name, '\"}') AS payload",
    )
    return reports.runs_for_table(frame(t, "runs"), frame(t, "receipts"), versions).select(
        "run_id", "table_name", _day("started_at").alias("started"), "rule_description"
    )


@query("kpi_trend", f"""WITH {cte("results", "rules", "runs")}
  SELECT coalesce(runs.table_name, rules.target_table) AS table_name, results.rule_id, result_id, {day("executed_at")} AS at,
    round({KPI}, 6) AS kpi
  FROM results JOIN rules ON rules.rule_id = results.rule_id LEFT JOIN runs ON runs.run_id = results.run_id
  WHERE rules.status = 'ACTIVE'""")
def kpi_trend(t: Tables) -> DataFrame:
    return reports.kpi_trend(frame(t, "results"), frame(t, "rules"), frame(t, "runs")).select(
        "table_name", "rule_id", "result_id", _day("executed_at").alias("at"), _rounded()
    )


@query("kpi_trend_scoped", f"""WITH {cte("results", "rules", "runs")}
  SELECT runs.table_name, results.rule_id, result_id, round({KPI}, 6) AS kpi
  FROM results JOIN rules ON rules.rule_id = results.rule_id JOIN runs ON runs.run_id = results.run_id
  WHERE rules.status = 'ACTIVE' AND mode <> 'remote'""")
def kpi_trend_scoped(t: Tables) -> DataFrame:
    runs = frame(t, "runs")
    local = reports.runs_in_scope(runs, "local")
    return reports.kpi_trend(frame(t, "results"), frame(t, "rules"), runs, allowed_runs=local).select(
        "table_name", "rule_id", "result_id", _rounded()
    )


@query("kpi_daily", f"""WITH {cte("results")} SELECT rule_id, result_id, {day("executed_at")} AS day, round({KPI}, 2) AS kpi
  FROM results""")
def kpi_daily(t: Tables) -> DataFrame:
    return reports.kpi_daily(frame(t, "results")).withColumn("day", _day("day"))


@query("description_asof_version", f"""WITH {cte("results", "history", "rules")},
  archived AS (SELECT rule_id, version, description FROM history
    QUALIFY row_number() OVER (PARTITION BY rule_id, version ORDER BY history_id DESC) = 1)
  SELECT result_id, coalesce(archived.description, rules.description, '') AS description
  FROM results JOIN rules ON rules.rule_id = results.rule_id
  LEFT JOIN archived ON archived.rule_id = results.rule_id AND archived.version = results.rule_version""")
def description_asof_version(t: Tables) -> DataFrame:
    return library.description_asof_version(frame(t, "results"), frame(t, "history"), frame(t, "rules"))


@query("rule_latest_kpi", f"""WITH {cte("rules", "results")}, {LATEST}
  SELECT rules.rule_id, version, result_id, {day("executed_at")} AS at, passed, failed, run_id, round({KPI}, 6) AS kpi
  FROM rules LEFT JOIN latest ON latest.rule_id = rules.rule_id AND latest.rule_version IS NOT DISTINCT FROM rules.version""")
def rule_latest_kpi(t: Tables) -> DataFrame:
    return library.rules_with_latest(frame(t, "rules"), frame(t, "results")).select(
        "rule_id", "version", "result_id", _day("executed_at").alias("at"), "passed", "failed", "run_id", _rounded()
    )


LABEL = f"""CASE WHEN status <> 'ACTIVE' THEN '—' WHEN result_id IS NULL THEN 'No results'
  WHEN {KPI} IS NULL THEN 'No checked rows' ELSE printf('%.1f%%', {KPI}) END"""


@query("kpi_label", f"""WITH {cte("rules", "results")}, {LATEST} SELECT rules.rule_id, {LABEL} AS label
  FROM rules LEFT JOIN latest ON latest.rule_id = rules.rule_id AND latest.rule_version IS NOT DISTINCT FROM rules.version""")
def kpi_label(t: Tables) -> DataFrame:
    latest = library.rules_with_latest(frame(t, "rules"), frame(t, "results"))
    return latest.select("rule_id", library.kpi_label(F.col("status"), F.col("result_id"), F.col("kpi")).alias("label"))


@query("kpi_sort", f"""WITH {cte("rules", "results")}, {LATEST},
  listed AS (SELECT rules.rule_id, round({KPI}, 6) AS kpi FROM rules
    LEFT JOIN latest ON latest.rule_id = rules.rule_id AND latest.rule_version IS NOT DISTINCT FROM rules.version)
  SELECT rule_id, kpi FROM listed ORDER BY kpi DESC NULLS LAST, rule_id""")
def kpi_sort(t: Tables) -> DataFrame:
    latest = library.rules_with_latest(frame(t, "rules"), frame(t, "results"))
    return reports.sort_by_kpi(latest.select("rule_id", _rounded()))


@query("rule_versions", f"""WITH {cte("rules", "history")},
  archived AS (SELECT *, TRY_CAST(rule_params AS JSON) AS params FROM history
    QUALIFY row_number() OVER (PARTITION BY rule_id, version ORDER BY history_id DESC) = 1)
  SELECT r.rule_id, r.version, true AS is_current, CAST(NULL AS BIGINT) AS history_id, r.description, r.sql_query, r.severity,
    {day('''CASE WHEN r.status = 'INACTIVE' THEN coalesce(h.deactivated_at, r.activated_at, r.created_at)
      ELSE coalesce(r.activated_at, r.created_at) END''')} AS event_day
  FROM rules r LEFT JOIN archived h ON h.rule_id = r.rule_id AND h.version = r.version
  UNION ALL
  SELECT h.rule_id, h.version, false, h.history_id, h.description, json_extract_string(params, '$.sql_query'),
    coalesce(json_extract_string(params, '$.severity'), 'medium'), {day("coalesce(h.deactivated_at, h.created_at)")}
  FROM archived h JOIN rules r ON r.rule_id = h.rule_id WHERE h.version IS DISTINCT FROM r.version""")
def rule_versions(t: Tables) -> DataFrame:
    return library.rule_versions(frame(t, "rules"), frame(t, "history")).select(
        "rule_id", "version", "is_current", "history_id", "description", "sql_query", "severity",
        _day("event_time").alias("event_day"),
    )


@query("latest_failures", f"""WITH {cte("rules", "results", "evidence")}, {LATEST},
  newest AS (SELECT rules.rule_id, version, run_id FROM rules JOIN latest
    ON latest.rule_id = rules.rule_id AND latest.rule_version IS NOT DISTINCT FROM rules.version WHERE run_id IS NOT NULL)
  SELECT e.rule_id, record_id, field_name, field_value, error_message FROM evidence e JOIN newest n
    ON n.rule_id = e.rule_id AND n.run_id = e.run_id AND n.version IS NOT DISTINCT FROM e.rule_version WHERE test_result = 1""")
def latest_failures(t: Tables) -> DataFrame:
    return library.latest_failures(frame(t, "rules"), frame(t, "results"), frame(t, "evidence"))


@query("run_board", f"""WITH {cte("runs", "results")}, {SUMS}
  SELECT runs.run_id, table_name, {day("started_at")} AS started, status, rules_completed,
    coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed FROM runs LEFT JOIN sums ON runs.run_id = sums.run_id""")
def run_board(t: Tables) -> DataFrame:
    board = reports.run_board(frame(t, "runs"), frame(t, "results"))
    return board.select(
        "run_id", "table_name", _day("started_at").alias("started"), "status", "rules_completed", "passed", "failed"
    )


@query("run_report", f"""WITH {cte("results", "rules")}
  SELECT run_id, results.rule_id, description AS rule, rule_version AS version, passed, failed
  FROM results JOIN rules ON rules.rule_id = results.rule_id WHERE run_id IS NOT NULL""")
def run_report(t: Tables) -> DataFrame:
    return reports.run_report(frame(t, "results"), frame(t, "rules"))


@query("run_failures", f"""WITH {cte("evidence", "rules")}
  SELECT run_id, description AS rule, record_id, field_name, field_value, evidence.error_message
  FROM evidence JOIN rules ON rules.rule_id = evidence.rule_id WHERE test_result = 1 AND run_id IS NOT NULL""")
def run_failures(t: Tables) -> DataFrame:
    return reports.run_failures(frame(t, "evidence"), frame(t, "rules"))


@query("latest_pass_rate", f"""WITH {cte("runs", "results")}, {SUMS},
  newest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY started_at DESC, run_id DESC) = 1),
  total AS (SELECT count(*) AS datasets, CAST(sum(coalesce(passed, 0)) AS BIGINT) AS passed,
    CAST(sum(coalesce(failed, 0)) AS BIGINT) AS failed FROM newest LEFT JOIN sums ON newest.run_id = sums.run_id)
  SELECT *, round({KPI}, 1) AS pass_rate FROM total""")
def latest_pass_rate(t: Tables) -> DataFrame:
    return reports.latest_pass_rate(frame(t, "runs"), frame(t, "results"))


@query("run_cards", f"""WITH {cte("runs", "results")}, {SUMS}
  SELECT runs.run_id, CASE WHEN coalesce(passed + failed, 0) > 0 THEN printf('%.1f%%', {KPI}) ELSE '—' END AS rate,
    coalesce(passed + failed, 0) AS checks, coalesce(failed, 0) AS failed,
    concat(rules_completed, ' / ', rules_requested) AS rules FROM runs LEFT JOIN sums ON runs.run_id = sums.run_id""")
def run_cards(t: Tables) -> DataFrame:
    return reports.run_cards(frame(t, "runs"), frame(t, "results"))


@query("failure_search", f"""WITH {cte("evidence")} SELECT run_id, rule_id, record_id, field_name, field_value, error_message
  FROM evidence WHERE test_result = 1 AND
    contains(lower(concat_ws(' ', rule_id, record_id, field_name, field_value, error_message)), 'flag r 1')""")
def failure_search(t: Tables) -> DataFrame:
    return reports.failure_search(frame(t, "evidence"), "FLAG r 1")


@query("library_filter", f"""WITH {cte("rules")}
  SELECT count(*) FILTER (status = 'ACTIVE' AND contains(lower(concat_ws(' ', rule_id, description, target_table, rule_type)), '9 t'))
    AS shown, count(*) AS total, count(*) FILTER (status = 'ACTIVE') AS active FROM rules""")
def library_filter(t: Tables) -> DataFrame:
    return library.library_counts(frame(t, "rules"), "9 T", active=True)


@query("library_search", f"""WITH {cte("rules")} SELECT rule_id, description, target_table FROM rules
  WHERE contains(lower(concat_ws(' ', rule_id, description, target_table, rule_type)), 'build')""")
def library_search(t: Tables) -> DataFrame:
    return library.library_filter(frame(t, "rules"), " Build ").select("rule_id", "description", "target_table")


@query("runs_scope", f"""WITH {cte("runs", "receipts", "links", "rules")}
  SELECT 'local' AS scope, run_id FROM runs WHERE mode <> 'remote' UNION ALL
  SELECT 'remote', run_id FROM runs WHERE mode = 'remote' UNION ALL
  SELECT 'profile p1', run_id FROM runs WHERE run_id IN (SELECT local_run_id FROM receipts x
    JOIN links l ON l.endpoint = x.endpoint JOIN rules r ON r.rule_id = l.rule_id AND r.rule_key = x.rule_key
    WHERE l.profile = 'p1')""")
def runs_scope(t: Tables) -> DataFrame:
    runs = frame(t, "runs")
    scopes = {
        "local": reports.runs_in_scope(runs, "local"),
        "remote": reports.runs_in_scope(runs, "remote"),
        "profile p1": reports.runs_in_scope(
            runs, profile="p1", receipts=frame(t, "receipts"), links=frame(t, "links"), rules=frame(t, "rules")
        ),
    }
    first, *others = [f.select(F.lit(name).alias("scope"), "run_id") for name, f in scopes.items()]
    for other in others:
        first = first.unionAll(other)
    return first


DATASETS = "datasets AS (SELECT DISTINCT concat('D', c_nationkey) AS table_name FROM customer)"


@query("report_tables", f"""WITH {cte("runs", "rules", "links")}, {DATASETS}
  SELECT 'any' AS scope, table_name FROM (SELECT table_name FROM datasets UNION SELECT table_name FROM runs) UNION ALL
  SELECT 'local', table_name FROM datasets UNION ALL
  SELECT 'remote', table_name FROM (SELECT DISTINCT r.target_table AS table_name FROM rules r JOIN links l
    ON l.rule_id = r.rule_id WHERE execution_mode = 'remote' AND profile = 'p0')""")
def report_tables(t: Tables) -> DataFrame:
    datasets = t.customer.select(F.concat(F.lit("D"), "c_nationkey").alias("table_name")).distinct()
    frames = (frame(t, "runs"), frame(t, "rules"), frame(t, "links"), datasets)
    shown = [
        reports.report_tables(*frames).select(F.lit("any").alias("scope"), "table_name"),
        reports.report_tables(*frames, "local").select(F.lit("local").alias("scope"), "table_name"),
        reports.report_tables(*frames, "remote", "p0").select(F.lit("remote").alias("scope"), "table_name"),
    ]
    return shown[0].unionAll(shown[1]).unionAll(shown[2])


@query("publication_state", f"""WITH {cte("rules", "links", "published")}
  SELECT r.rule_id, r.description,
    CASE WHEN r.sql_engine = 'remote' OR r.execution_mode = 'remote' THEN 'remote' ELSE 'local' END AS environment,
    CASE WHEN NOT (r.sql_engine = 'remote' OR r.execution_mode = 'remote') OR l.link_id IS NULL THEN '—'
      WHEN l.base_revision = r.revision THEN 'Published' WHEN l.base_revision IS NOT NULL THEN 'Pending publication'
      ELSE 'Draft' END AS publication_state,
    CASE WHEN r.sql_engine = 'remote' OR r.execution_mode = 'remote' THEN coalesce(l.profile, '') ELSE '' END AS profile,
    coalesce(p.local_version, r.version) AS shown_version
  FROM rules r LEFT JOIN links l ON l.rule_id = r.rule_id
  LEFT JOIN published p ON p.link_id = l.link_id AND p.revision = l.base_revision""")
def publication_state(t: Tables) -> DataFrame:
    return library.publication_state(frame(t, "rules"), frame(t, "links"), frame(t, "published"))


LINES = "string_split(replace(coalesce({text}, ''), '|', chr(10)), chr(10))"


@query("definition_changes", f"""WITH {cte("rules", "history")},
  old AS (SELECT history_id, rule_id, version, json_extract_string(TRY_CAST(rule_params AS JSON), '$.sql_query') AS text FROM history),
  both_sides AS (SELECT old.history_id, old.rule_id, old.version, old.text, rules.sql_query AS now,
    {LINES.format(text="old.text")} AS before_lines, {LINES.format(text="rules.sql_query")} AS now_lines
    FROM old JOIN rules ON rules.rule_id = old.rule_id WHERE old.text IS NOT NULL)
  SELECT history_id, rule_id, version, text IS DISTINCT FROM now AS changed,
    array_to_string(list_sort(list_distinct(list_filter(now_lines, lambda x: NOT list_contains(before_lines, x)))), ';') AS added,
    array_to_string(list_sort(list_distinct(list_filter(before_lines, lambda x: NOT list_contains(now_lines, x)))), ';') AS removed
  FROM both_sides""")
def definition_changes(t: Tables) -> DataFrame:
    text = library.archived_params(F.col("rule_params"))["sql_query"]
    old = frame(t, "history").select(
        "history_id", "rule_id", "version", F.replace(text, F.lit("|"), F.lit("\n")).alias("sql_query")
    ).where("sql_query IS NOT NULL")
    rules = frame(t, "rules").withColumn("sql_query", F.replace("sql_query", F.lit("|"), F.lit("\n")))
    changes = library.definition_changes(rules, old)
    return changes.select(
        "history_id", "rule_id", "version", "changed", F.array_join("added", ";").alias("added"),
        F.array_join("removed", ";").alias("removed"),
    )


# Older texts: some had a join more, some lacked their first line, some said the condition twice.
OLDER = """CASE WHEN history_id % 4 = 0 THEN replace({text}, '|WHERE', '|JOIN u|WHERE') WHEN history_id % 4 = 1 THEN substr({text}, 10)
  WHEN history_id % 4 = 2 THEN concat({text}, '|', {text}) ELSE {text} END"""


@query("definition_diff", f"""WITH {cte("rules", "history")},
  old AS (SELECT history_id, rule_id, json_extract_string(TRY_CAST(rule_params AS JSON), '$.sql_query') AS text FROM history),
  sides AS (SELECT old.history_id, old.rule_id, string_split(text, '|') AS o, string_split(sql_query, '|') AS n
    FROM old JOIN rules ON rules.rule_id = old.rule_id WHERE text IS NOT NULL),
  parts AS (SELECT *, history_id % 4 AS form, o[3] = n[3] AS same, '-' || o[1] || ';-' || o[2] || ';-' || o[3] AS again FROM sides)
  SELECT history_id, rule_id, CASE form
    WHEN 0 THEN ' ' || o[1] || '; ' || o[2] || ';-JOIN u;' || CASE WHEN same THEN ' ' || o[3] ELSE '-' || o[3] || ';+' || n[3] END
    WHEN 1 THEN '+' || n[1] || '; ' || o[2] || ';' || CASE WHEN same THEN ' ' || o[3] ELSE '-' || o[3] || ';+' || n[3] END
    WHEN 2 THEN ' ' || o[1] || '; ' || o[2] || ';' || CASE WHEN same THEN ' ' || o[3] || ';' || again
      ELSE '-' || o[3] || ';' || again || ';+' || n[3] END
    ELSE ' ' || o[1] || '; ' || o[2] || ';' || CASE WHEN same THEN ' ' || o[3] ELSE '-' || o[3] || ';+' || n[3] END END AS changes,
    CAST(CASE WHEN same THEN 0 ELSE 1 END + CASE form WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS added,
    CAST(CASE WHEN same THEN 0 ELSE 1 END + CASE form WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS INTEGER) AS removed FROM parts""")
def definition_diff(t: Tables) -> DataFrame:
    text = library.archived_params(F.col("rule_params"))["sql_query"]
    old = frame(t, "history").select("history_id", "rule_id", text.alias("sql_query")).where("sql_query IS NOT NULL")
    old = old.withColumn("sql_query", F.replace(F.expr(OLDER.format(text="sql_query")), F.lit("|"), F.lit("\n")))
    rules = frame(t, "rules").withColumn("sql_query", F.replace("sql_query", F.lit("|"), F.lit("\n")))
    sign = F.create_map(*[F.lit(x) for pair in (("kept", " "), ("added", "+"), ("removed", "-")) for x in pair])
    lines = F.transform("changes", lambda change: F.concat(sign[change["kind"]], change["line"]))
    return library.definition_diff(rules, old).select("history_id", "rule_id", F.array_join(lines, ";").alias("changes"), "added", "removed")
