from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assayline.errors import DataQualityError, HistoryInconsistent, SchemaRefused
from assayline.operators import library, registry, reports
from assayline.operators.crossref import CrossReference
from assayline.operators.evaluate import evaluate

NOW = datetime(2026, 9, 24, 12)
RULES = (
    "rule_id bigint, rule_key string, version string, status string, description string, rule_type string, target_table string,"
    " error_message string, sql_query string, severity string, cross_spec string, created_at timestamp, activated_at timestamp,"
    " execution_mode string"
)


def rule(rule_id, version="1.0", status="ACTIVE", **more):
    base = {
        "rule_id": rule_id, "rule_key": f"key-{rule_id}", "version": version, "status": status, "description": f"Rule {rule_id}",
        "rule_type": "range", "target_table": "people", "error_message": '"bad"', "sql_query": "SELECT 1 ", "severity": "medium",
        "cross_spec": None, "created_at": datetime(2026, 1, 1), "activated_at": None, "execution_mode": "local",
    }
    return tuple({**base, **more}.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RULES)


def by_id(rules):
    return {r["rule_id"]: r for r in rules.collect()}


def test_versions_are_bumped(spark):
    values = ["1.0", "2.9", None, "3", "1.0.7"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(registry.next_version(F.col("v"))).collect()
    assert [r[0] for r in got] == ["1.1", "2.10", "1.1", "3.1", "1.1"]


def request(rule_id, **more):
    base = {"rule_id": rule_id, "description": "new", "rule_type": "range", "target_table": "people", "error_message": "m",
            "sql_query": "SELECT 2", "severity": "high"}
    return tuple({**base, **more}.values())


REQUEST = "rule_id bigint, description string, rule_type string, target_table string, error_message string, sql_query string, severity string"


def test_create_modify_archive(spark):
    rules = frame(spark, rule(1), rule(2, "1.4", "INACTIVE"), rule(3, "1.0", "INACTIVE", cross_spec="{}"))
    asked = spark.createDataFrame([request(0), request(0, severity="x"), request(0, description=" ")], REQUEST).drop("rule_id")
    after, refused = registry.create_rules(rules, asked, NOW)
    assert by_id(after)[4]["version"] == "1.0" and after.count() == 4 and refused.count() == 2
    edits = spark.createDataFrame([request(1), request(2), request(3), request(9)], REQUEST)
    after, refused = registry.modify_rules(rules, edits, NOW)
    assert {r["rule_id"]: r["refused"][:10] for r in refused.collect()} == {1: "deactivate", 3: "create a n", 9: "rule not f"}
    changed = by_id(after)
    assert (changed[2]["version"], changed[2]["status"], changed[2]["severity"], changed[2]["activated_at"]) == ("1.5", "ACTIVE", "high", NOW)
    assert changed[1]["version"] == "1.0" and after.count() == 3
    stopped, history, refused = registry.archive_rules(rules, spark.createDataFrame([(1,), (2,)], "rule_id bigint"), "ann", NOW)
    assert by_id(stopped)[1]["status"] == "INACTIVE" and [r["rule_id"] for r in refused.collect()] == [2]
    line = history.first()
    assert line["rule_params"] == '{"sql_query":"SELECT 1 ","error_message":"bad","severity":"medium"}' and line["deactivated_by"] == "ann"


def definitions(spark, *rows):
    kind = ("rule_key string, description string, rule_type string, target_table string, error_message string, sql_query string,"
            " severity string, status string, cross_spec string")
    return spark.createDataFrame(list(rows), kind)


def test_registry_import(spark):
    rules = frame(spark, rule(1), rule(2), rule(3))
    same = ("key-1", "Rule 1", "range", "people", "bad", "SELECT 1", "medium", "ACTIVE", None)
    changed = ("key-2", "Rule 2", "range", "people", "bad", "SELECT 5", "medium", "INACTIVE", None)
    new = ("key-9", "Rule 9", "range", "people", "bad", "SELECT 1", "low", "ACTIVE", None)
    after, history, counts = registry.import_rules(rules, definitions(spark, same, changed, new), "ann", NOW)
    assert counts == {"created": 1, "updated": 1, "unchanged": 1}
    rows = by_id(after)
    assert set(rows) == {1, 2, 3, 4} and (rows[2]["version"], rows[2]["status"]) == ("1.1", "INACTIVE") and rows[4]["rule_key"] == "key-9"
    assert [r["rule_id"] for r in history.collect()] == [2]
    again = registry.import_rules(after, definitions(spark, same, changed, new), "ann", NOW)[2]
    assert again == {"created": 0, "updated": 0, "unchanged": 3}
    moved = ("key-1", "Rule 1", "range", "elsewhere", "bad", "SELECT 1", "medium", "ACTIVE", None)
    for bad in ((moved,), (same, same), (("Bad Key", *same[1:]),), ((*same[:6], "urgent", *same[7:]),)):
        with pytest.raises(DataQualityError):
            registry.import_rules(rules, definitions(spark, *bad), "ann", NOW)


ERRORS = "array<struct<rule_id:string,description:string,version:string,message:string>>"


def history_tables(spark):
    def err(rule_id):
        return [(str(rule_id), "", "1.0", "broken")]

    runs = spark.createDataFrame(
        [("shared", "completed", 2, 2, []), ("solo", "completed", 1, 1, []), ("partial", "partial", 2, 1, err(1)),
         ("failed", "failed", 1, 0, err(1)), ("empty", "no_rules", 0, 0, []), ("other", "partial", 2, 1, err(3))],
        f"run_id string, status string, rules_requested int, rules_completed int, execution_errors {ERRORS}",
    )
    results = spark.createDataFrame([("shared", 1), ("shared", 2), ("solo", 1), ("partial", 2), ("other", 2)], "run_id string, rule_id bigint")
    evidence = spark.createDataFrame([("shared", 1, "a"), ("shared", 2, "b"), ("solo", 1, "c")], "run_id string, rule_id bigint, record_id string")
    tickets = spark.createDataFrame(
        [(1, 1, "new", None), (2, 1, "closed", None), (3, 2, "new", None)], "ticket_id bigint, rule_id bigint, status string, closed_at timestamp")
    history = spark.createDataFrame([(1, 1), (2, 2)], "history_id bigint, rule_id bigint")
    return {"rules": frame(spark, rule(1), rule(2), rule(3)), "history": history, "runs": runs, "results": results,
            "evidence": evidence, "tickets": tickets}


def test_deletion_reconciles_runs(spark):
    gone = spark.createDataFrame([(1,)], "rule_id bigint")
    after = registry.delete_rules(history_tables(spark), gone, "ann", NOW)
    runs = {r["run_id"]: (r["status"], r["rules_requested"], r["rules_completed"], len(r["execution_errors"])) for r in after["runs"].collect()}
    assert runs == {"shared": ("completed", 1, 1, 0), "partial": ("completed", 1, 1, 0), "empty": ("no_rules", 0, 0, 0), "other": ("partial", 2, 1, 1)}
    assert {r["rule_id"] for r in after["rules"].collect()} == {2, 3}
    assert after["results"].count() == 3 and after["evidence"].count() == 1 and after["history"].count() == 1
    tickets = {r["ticket_id"]: r["status"] for r in after["tickets"].collect()}
    assert tickets == {1: "cancelled", 2: "closed", 3: "new"} and [r["ticket_id"] for r in after["events"].collect()] == [1]


def test_deletion_counts_results_and_evidence_once(spark, tmp_path):
    tables = history_tables(spark)
    for name in ("results", "evidence"):
        tables[name].write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    after = registry.delete_rules(tables, spark.createDataFrame([(1,)], "rule_id bigint"), "ann", NOW)
    # The runs that are left come from what the check has read, not from results and evidence again.
    assert not [file for file in after["runs"].inputFiles() if str(tmp_path) in file]
    assert after["runs"].count() == 4


def test_inconsistent_history_blocks_deletion(spark):
    tables = history_tables(spark)
    gone = spark.createDataFrame([(1,)], "rule_id bigint")
    for name, value in (("rules_completed", F.lit(5)), ("status", F.lit("running")), ("rules_requested", F.lit(9))):
        broken = tables["runs"].withColumn(name, F.when(F.col("run_id") == "solo", value).otherwise(F.col(name)))
        with pytest.raises(HistoryInconsistent):
            registry.delete_rules({**tables, "runs": broken}, gone, "ann", NOW)
    unrelated = tables["runs"].withColumn("rules_completed", F.when(F.col("run_id") == "other", 5).otherwise(F.col("rules_completed")))
    registry.delete_rules({**tables, "runs": unrelated}, gone, "ann", NOW)


def test_polarity(spark):
    old = spark.createDataFrame([(0,), (1,), (2,), (None,)], "test_result int")
    assert [r[0] for r in registry.flip_flags(old).collect()] == [1, 0, 2, None]
    people = spark.createDataFrame([(1, 20), (2, 10)], "id int, age int")
    text = "SELECT id, age, CASE WHEN age > 18 THEN 1 ELSE 0 END AS dq_check FROM people -- old;\n;"
    flipped = registry.flip_rule(spark, text, {"people": people})
    assert [tuple(r) for r in evaluate(spark, flipped, {"people": people}).frame.orderBy("id").collect()] == [(1, 20, 0), (2, 10, 1)]
    assert registry.flip_rule(spark, "SELECT id FROM people", {"people": people}) == "SELECT id FROM people"


def test_cross_rule_and_bindings(spark, shipments, tariffs):
    made = registry.cross_rule(CrossReference("tariffs", (("zone", "zone"),)), "shipments", "known zone")
    assert evaluate(spark, made["sql_query"], {"source": shipments, "tariffs": tariffs}).frame.count() == 6
    links = spark.createDataFrame(
        [("a", "c", "s", "t"), ("a", "c", "s", "t"), ("b", "c", "s", "t1"), ("b", "c", "s", "t2")],
        "target_table string, source_catalog string, source_schema string, source_table string")
    assert {r["target_table"]: r["conflicting"] for r in registry.table_bindings(links).collect()} == {"a": False, "b": True}
    with pytest.raises(SchemaRefused, match="b"):
        registry.check_bindings(links)


RESULTS = "result_id bigint, rule_id bigint, rule_version string, run_id string, passed bigint, failed bigint, executed_at timestamp"


def test_library_is_version_exact(spark):
    rules = frame(spark, rule(1, "1.1"), rule(2, "1.0", "INACTIVE"), rule(3, None))
    at = datetime(2026, 1, 1)
    old = [(1, 1, "1.0", "r1", 20, 0, at)]
    shown = library.rules_with_latest(rules, spark.createDataFrame(old, RESULTS)).collect()
    assert all(r["kpi"] is None for r in shown)
    more = old + [(2, 1, "1.1", "r2", 3, 1, at), (3, 1, "1.1", "r3", 1, 1, at), (4, 3, None, "r4", 0, 0, at)]
    results = spark.createDataFrame(more, RESULTS)
    latest = library.rules_with_latest(rules, results)
    by_rule = {r["rule_id"]: r for r in latest.collect()}
    assert (by_rule[1]["kpi"], by_rule[1]["result_id"], by_rule[3]["result_id"]) == (50.0, 3, 4)
    labels = latest.select("rule_id", library.kpi_label(F.col("status"), F.col("result_id"), F.col("kpi")))
    assert dict(map(tuple, labels.collect())) == {1: "50.0%", 2: "—", 3: "No checked rows"}
    evidence = spark.createDataFrame(
        [("r3", 1, "1.1", "7", "f", "v", 1, "bad"), ("r3", 1, "1.1", "8", "f", "v", 0, ""), ("r1", 1, "1.0", "9", "f", "v", 1, "bad")],
        "run_id string, rule_id bigint, rule_version string, record_id string, field_name string, field_value string, test_result int, error_message string")
    assert [r["record_id"] for r in library.latest_failures(rules, results, evidence).collect()] == ["7"]
    assert [r["record_id"] for r in library.latest_failures(rules, results, evidence, 1, 500).collect()] == ["7"]
    assert tuple(library.library_counts(rules, "rule 1").first()) == (1, 3, 2)
    kpis = [r["rule_id"] for r in reports.sort_by_kpi(latest).collect()]
    assert kpis == [1, 2, 3] and [r["rule_id"] for r in reports.sort_by_kpi(latest, False).collect()] == [1, 2, 3]


def test_versions_of_a_rule(spark):
    rules = frame(spark, rule(1, "1.1", activated_at=datetime(2026, 3, 1)), rule(2, "1.0", "INACTIVE"))
    kind = ("history_id bigint, rule_id bigint, version string, description string, rule_params string, created_at timestamp,"
            " deactivated_at timestamp")
    history = spark.createDataFrame(
        [(1, 1, "1.0", "a", '{"sql_query":"old"}', NOW, NOW), (2, 1, "1.0", "b", '{"sql_query":"newer","severity":"high"}', NOW, None),
         (3, 1, "1.1", "c", "oops", NOW, NOW), (4, 2, "1.0", "d", "[]", NOW, datetime(2026, 5, 5))], kind)
    got = {(r["rule_id"], r["version"]): (r["is_current"], r["description"], r["sql_query"], r["severity"], r["event_time"])
           for r in library.rule_versions(rules, history).collect()}
    assert got == {
        (1, "1.1"): (True, "Rule 1", "SELECT 1 ", "medium", datetime(2026, 3, 1)),
        (1, "1.0"): (False, "b", "newer", "high", NOW),
        (2, "1.0"): (True, "Rule 2", "SELECT 1 ", "medium", datetime(2026, 5, 5)),
    }


def test_kpis_of_runs(spark):
    at = datetime(2026, 9, 24)
    runs = spark.createDataFrame(
        [("a", "people", "local", "completed", at, 1, 1, []), ("b", "people", "remote", "failed", at, 1, 0, [("1", "", "", "x")]),
         ("c", "things", "local", "completed", at, 1, 1, [])],
        f"run_id string, table_name string, mode string, status string, started_at timestamp, rules_requested int, rules_completed int, execution_errors {ERRORS}")
    results = spark.createDataFrame([(1, 1, "1.0", "a", 2, 1, at), (2, 1, "1.0", "c", 0, 0, at), (3, 1, "1.0", None, 5, 0, at)], RESULTS)
    totals = {r["run_id"]: (r["passed"], r["failed"], r["execution_error_count"]) for r in reports.run_totals(runs, results).collect()}
    assert totals == {"a": (2, 1, 0), "b": (0, 0, 1), "c": (0, 0, 0)}
    cards = {r["run_id"]: (r["rate"], r["checks"], r["rules"]) for r in reports.run_cards(runs, results).collect()}
    assert cards == {"a": ("66.7%", 3, "1 / 1"), "b": ("—", 0, "0 / 1"), "c": ("—", 0, "1 / 1")}
    daily = {r["result_id"]: r["kpi"] for r in reports.kpi_daily(results).collect()}
    assert daily == {1: 66.67, 2: None, 3: 100.0}
    trend = reports.kpi_trend(results, frame(spark, rule(1)), runs, "people")
    assert sorted(r["result_id"] for r in trend.collect()) == [1, 3]
    scoped = reports.kpi_trend(results, frame(spark, rule(1)), runs, allowed_runs=reports.runs_in_scope(runs, "local"))
    assert sorted(r["result_id"] for r in scoped.collect()) == [1, 2]
