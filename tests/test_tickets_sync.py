import glob
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assayline.functions import fingerprint
from assayline.operators import skew, sync, tickets
from assayline.streaming.run_feed import follow_runs

DAY = datetime(2026, 9, 1)
OUTCOME = ("rule_id bigint, table_name string, rule_version string, title string, severity string, run_id string, actor string,"
           " failed bigint, checked bigint, occurred_at timestamp")


def outcome(spark, failed, checked=2, day=0, severity="high", run="r", title="Name required"):
    line = (1, "people", "1.0", title, severity, run, "ann", failed, checked, DAY + timedelta(days=day))
    return spark.createDataFrame([line], OUTCOME)


@pytest.fixture
def loads(spark):
    return spark.createDataFrame([("people", "people.csv", "bob")], "table_name string, file_name string, loaded_by string")


def step(spark, state, loads, result):
    applied = tickets.number_new(tickets.apply_run(state, result, loads))
    rows = applied.collect()
    events = [(r["kind"], r["detail"]) for r in tickets.events(applied, result).collect()]
    return spark.createDataFrame([tuple(r)[:-1] for r in rows], tickets.TICKET), rows, events


def test_ticket_life(spark, loads):
    state = spark.createDataFrame([], tickets.TICKET)
    state, rows, events = step(spark, state, loads, outcome(spark, 1, run="r1"))
    t = rows[0]
    assert (t["status"], t["due_at"], t["imported_by"], t["source_file"], t["ticket_id"]) == ("new", DAY + timedelta(days=1), "bob", "people.csv", 1)
    assert events == [("created", "1")]
    state = state.withColumn("status", F.lit("to_verify")).withColumn("assignee", F.lit("eve"))
    state, rows, events = step(spark, state, loads, outcome(spark, 2, day=3, severity="low", run="r2"))
    t = rows[0]
    assert (t["status"], t["due_at"], t["severity"], t["assignee"], t["failed_count"], t["last_seen"]) == (
        "in_progress", DAY + timedelta(days=1), "high", "eve", 2, DAY + timedelta(days=3))
    state, rows, events = step(spark, state, loads, outcome(spark, 0, 0, day=4, run="r3"))
    assert rows[0]["status"] == "in_progress" and events == [("empty", "0")]
    state, rows, events = step(spark, state, loads, outcome(spark, 0, 2, day=5, run="r4"))
    t = rows[0]
    assert (t["status"], t["failed_count"], t["closed_at"], t["failure_run_id"], t["latest_run_id"], t["last_seen"]) == (
        "closed", 0, DAY + timedelta(days=5), "r2", "r4", DAY + timedelta(days=3))
    assert events == [("verified", "2")]
    state, rows, events = step(spark, state, loads, outcome(spark, 0, 2, day=6, run="r5"))
    assert len(rows) == 1 and events == []
    state, rows, events = step(spark, state, loads, outcome(spark, 1, day=7, severity="low", run="r6", title=""))
    opened = next(r for r in rows if r["status"] == "new")
    assert (opened["ticket_id"], opened["due_at"], opened["title"], len(rows)) == (2, DAY + timedelta(days=14), "Rule #1", 2)
    listed = tickets.ticket_list(state, DAY + timedelta(days=30)).collect()
    assert [(r["ticket_id"], r["overdue"]) for r in listed] == [(2, True), (1, False)]
    assert tuple(tickets.scope_counts(state, "ann", DAY + timedelta(days=30)).first()) == (1, 2, 1, 1)
    assert tickets.in_scope(state, "mine", "eve", DAY).count() == 0 and tickets.in_scope(state, "all", "eve", DAY).count() == 2


def simulate(history):
    done, open_ticket = [], {}
    for r in sorted(history, key=lambda r: (r["occurred_at"], r["result_id"])):
        key = (r["rule_id"], r["table_name"])
        if r["failed"] > 0:
            t = open_ticket.setdefault(key, {"created": r["occurred_at"], "severity": r["severity"], "closed": None, "n": 0, "key": key})
            t.update(seen=r["occurred_at"], run=r["run_id"], failed=r["failed"], n=t["n"] + 1)
        elif r["checked"] > 0 and key in open_ticket:
            t = open_ticket.pop(key)
            t.update(closed=r["occurred_at"], failed=0)
            done.append(t)
    return done + list(open_ticket.values())


def test_replay_equals_simulation_with_a_hot_rule(spark):
    pick = random.Random(3)
    history = []
    for i in range(1500):
        rule = 1 if pick.random() < 0.4 else pick.randrange(2, 30)
        checked = pick.choice([0, 5, 5, 5])
        history.append({
            "rule_id": rule, "table_name": f"t{rule % 2}", "result_id": i, "occurred_at": DAY + timedelta(minutes=pick.randrange(60 * 24 * 20)),
            "failed": pick.choice([0, 0, 2]) if checked else 0, "checked": checked, "severity": pick.choice(["low", "medium", "high"]),
            "run_id": f"r{i}", "rule_version": "1.0"})
    kind = ("rule_id bigint, table_name string, result_id bigint, occurred_at timestamp, failed bigint, checked bigint, severity string,"
            " run_id string, rule_version string")
    frame = spark.createDataFrame([tuple(h.values()) for h in history], kind)
    got = {(r["rule_id"], r["table_name"], r["created_at"], r["last_seen"], r["closed_at"], r["severity"], r["failure_run_id"],
            r["failed_count"], r["failures"]) for r in tickets.replay(frame).collect()}
    want = {(*t["key"], t["created"], t["seen"], t["closed"], t["severity"], t["run"], t["failed"], t["n"]) for t in simulate(history)}
    assert got == want and len(want) > 50


def test_running_max_and_sum_match_a_plain_loop(spark):
    pick = random.Random(5)
    rows = [(pick.choice("aab"), i, pick.randrange(100)) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, i int, v int")
    for how, fold in (("sum", lambda seen: sum(seen)), ("max", lambda seen: max(seen, default=None))):
        got = skew.running(frame, ["k"], ["i"], F.floor(F.col("i") / 13), F.col("v"), how, "before").collect()
        for r in got:
            assert r["before"] == fold([v for k, i, v in rows if k == r["k"] and i < r["i"]])


@pytest.mark.usefixtures("no_broadcast")
def test_attach_keeps_every_row_of_hot_and_missing_keys(spark):
    pick = random.Random(11)
    rows = [(i, 7 if i % 3 == 0 else None if i % 7 == 0 else pick.randrange(3000), i % 2) for i in range(6000)]
    keyed = [(k, b, f"v{k}-{b}") for k in range(0, 3000, 2) for b in (0, 1)] + [(7, 0, "hot")]
    left = spark.createDataFrame(rows, "i int, k int, b int")
    right = spark.createDataFrame(keyed, "k int, b int, v string")
    known = {(k, b): v for k, b, v in keyed}
    got = {r["i"]: r["v"] for r in skew.attach(left, right, ["k", "b"]).collect()}
    assert got == {i: known.get((k, b)) for i, k, b in rows}
    spread = skew.attach(left.where("k = 7 OR k IS NULL"), right, ["k", "b"]).groupBy(F.spark_partition_id()).count()
    shares = [r["count"] for r in spread.collect()]
    assert len(shares) == 4 and max(shares) < 2 * min(shares)  # the hot and missing keys fill all partitions evenly


@pytest.mark.usefixtures("no_broadcast")
@pytest.mark.parametrize("kinds", [("int", "bigint"), ("bigint", "smallint"), ("decimal(10,2)", "int"), ("double", "int")])
def test_attach_compares_keys_of_different_types(spark, kinds):
    left = spark.range(0, 40).select(F.col("id").alias("i"), F.when(F.col("id") < 20, 5).otherwise(F.col("id")).cast(kinds[0]).alias("k"))
    right = spark.range(0, 30, 5).select(F.col("id").cast(kinds[1]).alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    got = {r["i"]: r["v"] for r in skew.attach(left, right, ["k"]).collect()}
    assert got == {i: "v5" if i < 20 else f"v{i}" if i < 30 and i % 5 == 0 else None for i in range(40)}
    assert skew.attach(left, right, ["k"]).columns == ["i", "k", "v"]
    assert skew.only(left, right, ["k"]).count() == 22 and skew.without(left, right, ["k"]).count() == 18


def payload(rule_key="name-check", **more):
    body = {"active": True, "description": "Name required", "references": {}, "rule_key": rule_key, "source": ["main", "sales", "people"]}
    return fingerprint.canonical({**body, **more})


def bundle(spark, runs, errors=None, results=None):
    rows = []
    for r in runs:
        text = r.pop("payload", payload())
        base = {"endpoint": "e", "run_id": "r1", "rule_key": "name-check", "revision": fingerprint.revision_of_text(text), "payload": text,
                "started_at": "2026-09-01T08:00:00+00:00", "completed_at": "2026-09-01T08:01:00+00:00", "status": "completed",
                "source_version": 4, "execution_error": None, "reference_versions": "{}"}
        rows.append(tuple({**base, **r}.values()))
    kind = ("endpoint string, run_id string, rule_key string, revision string, payload string, started_at string, completed_at string,"
            " status string, source_version bigint, execution_error string, reference_versions string")
    results = results if results is not None else [(row[1], 2, 1, "name") for row in rows if row[7] == "completed"]
    errors = errors if errors is not None else [(row[1], "source-42", "name", None, "bad") for row in rows if row[7] == "completed"]
    return {
        "runs": spark.createDataFrame(rows, kind),
        "results": spark.createDataFrame(results, "run_id string, passed bigint, failed bigint, field_name string"),
        "errors": spark.createDataFrame(errors, "run_id string, record_id string, field_name string, field_value string, error_message string"),
        "links": spark.createDataFrame(
            [("e", "name-check", 1, "people", "main", "sales", "people")],
            "endpoint string, rule_key string, rule_id bigint, target_table string, source_catalog string, source_schema string, source_table string"),
        "versions": spark.createDataFrame(
            [("name-check", fingerprint.revision_of_text(p), "1.0", p) for p in (payload(), payload(references={"countries": ["main", "sales", "countries"]}))],
            "rule_key string, revision string, local_version string, payload string"),
    }


def reasons(tables):
    audited = sync.audit_bundles(*[tables[n] for n in ("runs", "results", "errors", "links", "versions")])
    return {r["run_id"]: r["reason"] for r in audited.collect()}


REFERRED = payload(references={"countries": ["main", "sales", "countries"]})


def test_bundle_audit_of_runs(spark):
    cases = [
        ({}, None),
        ({"status": "failed", "execution_error": "x"}, None),
        ({"revision": "x"}, "checksum mismatch"),
        ({"payload": payload("other")}, "rule key mismatch"),
        ({"payload": payload("other"), "rule_key": "other"}, "rule is not linked"),
        ({"payload": payload(source=["main", "sales", "x"])}, "source does not match the mapping"),
        ({"started_at": "2026-09-01T08:00:00"}, "timestamps must include their time zone"),
        ({"completed_at": "2026-09-01T07:00:00+00:00"}, "run ends before it starts"),
        ({"status": "running"}, "run is not complete"),
        ({"payload": payload(description="edited")}, "unrecognised revision"),
        ({"payload": REFERRED}, "reference versions are missing or invalid"),
        ({"payload": REFERRED, "reference_versions": '{"countries":-1}'}, "reference versions are missing or invalid"),
        ({"payload": REFERRED, "reference_versions": '{"countries":3}'}, None),
    ]
    runs = [{**run, "run_id": f"r{i}"} for i, (run, _) in enumerate(cases)]
    assert reasons(bundle(spark, runs)) == {f"r{i}": reason for i, (_, reason) in enumerate(cases)}


def test_bundle_audit_of_details(spark):
    good, error = [("-", 2, 1, "name")], [("-", "7", "name", None, "m")]
    cases = [
        ([], error, "run summary is incomplete"),
        (good * 2, error, "run summary is incomplete"),
        ([("-", -2, 1, "name")], error, "invalid counts"),
        ([("-", 2, 2, "name")], error, "error rows do not match the summary"),
        (good, [], "error rows do not match the summary"),
        (good, [("-", "", "name", None, "m")], "invalid error details"),
        (good, [("-", "7", "other", None, "m")], "invalid error details"),
        (good, error, None),
    ]

    def filled(position):
        return [(f"r{i}", *line[1:]) for i, case in enumerate(cases) for line in case[position]]

    tables = bundle(spark, [{"run_id": f"r{i}"} for i in range(len(cases))], filled(1), filled(0))
    assert reasons(tables) == {f"r{i}": case[2] for i, case in enumerate(cases)}


def test_foreign_evidence_is_found(spark):
    tables = bundle(spark, [{}], errors=[("r1", "7", "name", None, "m"), ("r9", "7", "name", None, "m")])
    assert [r[0] for r in sync.orphan_evidence(tables["runs"], tables["results"], tables["errors"]).collect()] == ["r9"]


def test_import_is_idempotent_and_isolates_bad_runs(spark):
    days = [{"run_id": f"r{d}", "started_at": f"2026-09-0{d}T08:00:00+02:00", "completed_at": f"2026-09-0{d}T09:00:00+02:00"} for d in (1, 2, 3)]
    tables = bundle(spark, [*days, {"run_id": "r4", "status": "failed", "execution_error": "boom"}, {"run_id": "bad", "revision": "x"}])
    receipts = spark.createDataFrame([], "endpoint string, remote_run_id string")
    names = ("runs", "results", "errors", "links", "versions")
    audited = sync.audit_bundles(*[tables[n] for n in names])
    summary = sync.sync_summary(audited, receipts).first()
    assert (summary["available"], summary["existing"], summary["imported"], summary["failed_runs"], summary["refused"]) == (5, 0, 4, 1, 1)
    rows = sync.imported_rows(sync.new_runs(audited, receipts), tables["errors"], "ann")
    assert {k: v.count() for k, v in rows.items()} == {"runs": 4, "results": 3, "evidence": 3, "receipts": 4}
    failed = rows["runs"].where("status = 'failed'").first()
    assert failed["execution_errors"][0]["message"] == "boom" and failed["rules_completed"] == 0
    assert rows["runs"].where("run_id = 'e/r1'").first()["started_at"] == datetime(2026, 9, 1, 6)
    again = sync.new_runs(audited, rows["receipts"])
    assert again.count() == 0
    second = sync.sync_summary(audited, rows["receipts"]).first()
    assert (second["imported"], second["existing"]) == (0, 4)
    doubled = sync.new_runs(audited.unionAll(audited), receipts)
    assert doubled.count() == 4


def test_late_runs_do_not_move_tickets(spark):
    rows = [("e", "k", 1, DAY, "completed"), ("e", "k", 2, DAY + timedelta(days=1), "completed"), ("e", "k", 3, DAY, "completed"),
            ("e", "k", 4, DAY + timedelta(days=1), "completed"), ("e", "j", 5, DAY, "failed")]
    arrivals = spark.createDataFrame(rows, "endpoint string, rule_key string, n int, started timestamp, status string")
    marked = sync.mark_late(arrivals, ["n"], F.floor(F.col("n") / 2))
    assert {r["n"]: r["late"] for r in marked.collect()} == {1: False, 2: False, 3: True, 4: False, 5: False}
    assert sorted(r["n"] for r in sync.ticket_outcomes(marked).collect()) == [1, 2, 4]


def test_publication(spark):
    local = spark.createDataFrame(
        [("new", "v2", "p", "v2", None, None), ("edit", "v2", "p", "v2", "v1", "v1"), ("mine", "v2", "p", "v9", "v1", "v1"),
         ("theirs", "v2", "p", "v2", "v1", "v1"), ("clash", "v2", "p", "v2", "v3", "v1"), ("same", "v2", "p", "v2", "v2", None)],
        "rule_key string, revision string, payload string, expected_local string, expected_remote string, base_revision string")
    remote = spark.createDataFrame(
        [("edit", "v1", "q"), ("mine", "v1", "q"), ("theirs", "v5", "q"), ("clash", "v3", "q"), ("same", "v2", "q"), ("other", "v1", "q")],
        "rule_key string, revision string, payload string").withColumn("updated_at", F.lit(DAY))
    assert {r["rule_key"]: r["outcome"] for r in sync.publish_outcome(local, remote).collect()} == {
        "new": "insert", "edit": "update", "mine": "local changed", "theirs": "remote changed", "clash": "conflict", "same": "same"}
    after = {r["rule_key"]: r["revision"] for r in sync.published_registry(local, remote, DAY + timedelta(days=1)).collect()}
    assert after == {"new": "v2", "edit": "v2", "mine": "v1", "theirs": "v5", "clash": "v3", "same": "v2", "other": "v1"}
    states = {r["rule_key"]: r["state"] for r in sync.compare_definitions(local, remote).collect()}
    assert states["same"] == "same" and states["new"] == "only local" and states["other"] == "only remote" and states["edit"] == "different"


def test_accepting_a_remote_definition_twice_changes_nothing_more(spark):
    from tests.test_registry import frame, rule

    rules = frame(spark, rule(1), rule(2))
    offer = spark.createDataFrame(
        [("key-1", "Rule 1", "range", "high", '"bad"', False, "SELECT 7")],
        "rule_key string, description string, rule_type string, severity string, error_message string, active boolean, sql string")
    after, history = sync.accept_remote(rules, offer, "ann", DAY)
    one = after.where("rule_id = 1").first()
    assert (one["version"], one["status"], one["severity"], one["sql_query"], one["execution_mode"]) == ("1.1", "INACTIVE", "high", "SELECT 7", "remote")
    assert history.count() == 1
    again, history = sync.accept_remote(after, offer, "ann", DAY)
    assert history.count() == 0 and again.where("version = '1.1'").count() == 1


def test_runs_are_imported_as_files_arrive(spark, tmp_path):
    tables = bundle(spark, [{"run_id": "r1"}, {"run_id": "r2"}])
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    kind = "endpoint string, remote_run_id string, local_run_id string"

    def receipts():
        if (tmp_path / "out" / "receipts").exists():
            return spark.read.parquet(f"{out}/receipts")
        return spark.createDataFrame([], kind)

    def save(rows, number):
        for name, frame in rows.items():
            frame.write.mode("append").parquet(f"{out}/{name}")

    def run():
        query = follow_runs(spark, landing, lambda: tables, receipts, save, str(tmp_path / "progress"), "ann")
        assert query.awaitTermination(60)

    tables["runs"].where("run_id = 'r1'").write.parquet(landing)
    run()
    tables["runs"].write.mode("append").parquet(landing)
    run()
    assert sorted(r["run_id"] for r in spark.read.parquet(f"{out}/runs").collect()) == ["e/r1", "e/r2"]
    assert spark.read.parquet(f"{out}/evidence").count() == 2


def test_a_batch_of_runs_moves_tickets_in_order(spark):
    from assayline.operators import tickets as t

    kind = ("rule_id bigint, table_name string, rule_version string, title string, severity string, run_id string, actor string, "
            "failed bigint, checked bigint, occurred_at timestamp")
    def run(rule, n, failed):
        return (rule, "t", "1.0", "title", "low", f"r{n}", "ann", failed, 10, DAY + timedelta(hours=n))
    outcomes = spark.createDataFrame([run(1, 3, 2), run(1, 1, 4), run(1, 2, 0), run(2, 1, 1), run(2, 2, 0)], kind)
    empty = spark.createDataFrame([], t.TICKET)
    loads = spark.createDataFrame([("t", "bob", "f.csv")], "table_name string, loaded_by string, file_name string")
    after = sorted((r.rule_id, r.status, r.failed_count, r.latest_run_id, r.action) for r in t.apply_runs(empty, outcomes, loads).collect())
    assert after == [(1, "closed", 0, "r2", "verified"), (1, "new", 2, "r3", "created"), (2, "closed", 0, "r2", "verified")]
    with pytest.raises(Exception, match="apply_runs"):
        t.apply_run(empty, outcomes, loads).collect()


def test_running_values_keep_one_history_for_null_keys(spark):
    from assayline.operators.skew import running

    rows = spark.createDataFrame([(None, 1), (None, 2), (None, 3)], "k string, n int")
    got = running(rows, ["k"], ["n"], F.col("n"), F.lit(1), "sum", "before").collect()
    assert sorted((r.n, r.before) for r in got) == [(1, 0), (2, 1), (3, 2)]


def test_equal_run_ids_of_two_endpoints_stay_apart(spark):
    tables = bundle(spark, [{}, {"endpoint": "f"}], errors=[], results=[])
    tables["results"] = spark.createDataFrame(
        [("e", "r1", 2, 1, "name"), ("f", "r1", 5, 0, "name")], "endpoint string, run_id string, passed bigint, failed bigint, field_name string")
    tables["errors"] = spark.createDataFrame(
        [("e", "r1", "source-42", "name", None, "bad")],
        "endpoint string, run_id string, record_id string, field_name string, field_value string, error_message string")
    tables["links"] = tables["links"].unionAll(tables["links"].withColumn("endpoint", F.lit("f")))
    audited = sync.audit_bundles(*[tables[n] for n in ("runs", "results", "errors", "links", "versions")])
    assert {r.endpoint: (r.reason, r.passed) for r in audited.collect()} == {"e": (None, 2), "f": (None, 5)}
    rows = sync.imported_rows(audited, tables["errors"], "ann")
    assert [r.run_id for r in rows["evidence"].collect()] == ["e/r1"]


def test_spacing_of_a_payload_does_not_matter(spark):
    spaced = payload().replace(",", " ,\n ").replace('":', '" : ')
    assert reasons(bundle(spark, [{"payload": spaced}])) == {"r1": None}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_batch_equals_its_runs_one_by_one(spark, loads, seed):
    pick = random.Random(seed)
    kinds = ["new", "in_progress", "to_verify", "closed", "cancelled"]

    def ticket(n, rule, status):
        values = {"ticket_id": n, "rule_id": rule, "rule_version": "0.9", "table_name": "people", "title": f"old {n}", "severity": "medium",
                  "status": status, "reporter": "rep", "assignee": "eve", "created_at": DAY, "last_seen": DAY, "due_at": DAY, "failed_count": 3,
                  "latest_run_id": "old", "failure_run_id": "old"}
        return tuple(values.get(c.split()[0]) for c in tickets.TICKET.split(", "))

    state = [ticket(n, n % 8, pick.choice(kinds[:3]) if n < 8 and n % 2 else pick.choice(kinds[3:])) for n in range(20)]
    start = spark.createDataFrame(state, tickets.TICKET)
    lines = []
    for n in range(60):
        rule = 1 if pick.random() < 0.4 else pick.randrange(9)
        checked = pick.choice([0, 4, 4])
        lines.append((rule, "people", f"1.{n}", pick.choice(["", f"t{n}"]), pick.choice(["low", "high"]), f"r{n:03d}", pick.choice(["ann", "bob"]),
                      pick.choice([0, 2]) if checked else 0, checked, DAY + timedelta(hours=5 * pick.randrange(60))))
    pick.shuffle(lines)
    batch = spark.createDataFrame(lines, OUTCOME)
    got = sorted((str(tuple(r)) for r in tickets.apply_runs(start, batch, loads).collect()))

    names = [c.split()[0] for c in tickets.TICKET.split(", ")]
    now = [dict(zip(names, row), action=None) for row in state]
    fields = [c.split()[0] for c in OUTCOME.split(", ")]
    for o in (dict(zip(fields, line)) for line in sorted(lines, key=lambda x: (x[9], x[5]))):
        mine = [t for t in now if (t["rule_id"], t["table_name"]) == (o["rule_id"], o["table_name"]) and t["status"] not in tickets.TERMINAL]
        if o["failed"] > 0:
            if not mine:
                mine = [dict.fromkeys(names)]
                mine[0].update(rule_id=o["rule_id"], table_name="people", title=o["title"] or f"Rule #{o['rule_id']}", severity=o["severity"],
                               status="new", reporter=o["actor"], assignee=o["actor"], imported_by="bob", source_file="people.csv",
                               created_at=o["occurred_at"], due_at=o["occurred_at"] + timedelta(days=tickets.DUE_DAYS[o["severity"]]), action="created")
                now += mine
            else:
                mine[0]["action"] = "failed"
                mine[0]["status"] = "in_progress" if mine[0]["status"] == "to_verify" else mine[0]["status"]
            mine[0].update(rule_version=o["rule_version"], last_seen=o["occurred_at"], failed_count=o["failed"], latest_run_id=o["run_id"], failure_run_id=o["run_id"])
        elif mine and o["checked"] > 0:
            mine[0].update(status="closed", failed_count=0, closed_at=o["occurred_at"], latest_run_id=o["run_id"], action="verified")
        elif mine:
            mine[0]["action"] = "empty"
    assert got == sorted(str(tuple(t[n] for n in [*names, "action"])) for t in now)


def test_the_plan_of_a_batch_does_not_grow_with_it(spark, loads):
    none = spark.createDataFrame([], tickets.TICKET)
    sizes = []
    for n in (1, 50):
        runs = [(1, "people", "1", "t", "low", f"r{i}", "ann", i % 2, 3, DAY + timedelta(hours=i)) for i in range(n)]
        frame = tickets.apply_runs(none, spark.createDataFrame(runs, OUTCOME), loads)
        sizes.append(frame._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert sizes[0] == sizes[1]


def _feed(spark, tmp_path, tables):
    from assayline.streaming.run_feed import LANDING, RunFeed

    loads = spark.createDataFrame([("people", "people.csv", "bob")], "table_name string, file_name string, loaded_by string")
    feed = RunFeed(spark, str(tmp_path / "landing"), str(tmp_path / "state"), lambda: tables["links"], lambda: tables["versions"], lambda: loads)

    def land(name, frame):
        frame = frame if "endpoint" in frame.columns else frame.withColumn("endpoint", F.lit("e"))
        schema = spark.createDataFrame([], LANDING[name]).schema
        frame.select(*[f.name for f in schema]).write.mode("append").parquet(str(tmp_path / "landing" / name))
        feed.advance(120)

    return feed, land


def _state(feed):
    return (sorted(r.remote_run_id for r in feed.table("receipts").collect()), {r.run_id: r.reason for r in feed.table("waiting").collect()},
            {r.run_id: r.reason for r in feed.table("refused").collect()})


def test_a_run_waits_for_its_evidence(spark, tmp_path):
    days = {f"r{d}": {"run_id": f"r{d}", "started_at": f"2026-09-0{d}T08:00:00+00:00", "completed_at": f"2026-09-0{d}T09:00:00+00:00"} for d in (1, 2, 3)}
    tables = bundle(spark, [*days.values(), {"run_id": "bad", "revision": "x"}])
    feed, land = _feed(spark, tmp_path, tables)
    feed.advance(120)  # nothing has landed
    assert _state(feed) == ([], {}, {})
    runs = tables["runs"]
    land("runs", runs.where("run_id IN ('r1', 'r3', 'bad')"))
    assert _state(feed) == ([], dict.fromkeys(("r1", "r3"), "run summary is incomplete"), {"bad": "checksum mismatch"})
    land("results", tables["results"].where("run_id <> 'r2'"))
    assert _state(feed)[1] == dict.fromkeys(("r1", "r3"), "error rows do not match the summary")
    land("errors", tables["errors"].where("run_id = 'r3'"))
    assert _state(feed)[:2] == (["r3"], {"r1": "error rows do not match the summary"})
    (ticket,) = feed.table("tickets").collect()
    assert (ticket.ticket_id, ticket.status, ticket.latest_run_id, ticket.severity, ticket.imported_by) == (1, "new", "e/r3", "medium", "bob")
    land("errors", tables["errors"].where("run_id <> 'r3'"))  # r1 is complete now, but late for the ticket
    assert _state(feed)[:2] == (["r1", "r3"], {})
    assert [r.latest_run_id for r in feed.table("tickets").collect()] == ["e/r3"]
    land("runs", runs.where("run_id IN ('r1', 'r2')"))  # r1 again: it has its receipt
    assert _state(feed)[:2] == (["r1", "r3"], {"r2": "run summary is incomplete"})
    land("results", tables["results"].where("run_id = 'r2'"))
    assert _state(feed)[:2] == (["r1", "r2", "r3"], {})
    assert feed.table("runs").count() == feed.table("results").count() == feed.table("evidence").count() == 3


def test_a_repeated_batch_writes_the_same_again(spark, tmp_path):
    tables = bundle(spark, [{"run_id": "r1"}, {"run_id": "r2", "status": "failed", "execution_error": "boom"}])
    feed, land = _feed(spark, tmp_path, tables)
    land("results", tables["results"])
    land("errors", tables["errors"])
    land("runs", tables["runs"])
    number = feed._last()
    stream = next(n for n in range(20) if feed._number(n) == number)
    rows = tables["runs"].select(F.struct(*tables["runs"].columns).alias("run"))
    for _ in range(2):
        feed._import(rows, stream)
    assert feed._last() == number and _state(feed) == (["r1", "r2"], {}, {})
    assert feed.table("evidence").count() == 1 and feed.table("tickets").count() == 1


def test_a_link_made_later_frees_waiting_runs(spark, tmp_path):
    tables = bundle(spark, [{}])
    links, tables["links"] = tables["links"], tables["links"].limit(0)
    feed, land = _feed(spark, tmp_path, tables)
    for name in ("results", "errors", "runs"):
        land(name, tables[name])
    assert _state(feed)[1] == {"r1": "rule is not linked"}
    tables["links"] = links
    feed.retry()
    assert _state(feed) == (["r1"], {}, {}) and feed.table("tickets").count() == 1
    land("runs", tables["runs"])  # the stream goes on after a retry by hand
    assert _state(feed) == (["r1"], {}, {}) and feed.table("runs").count() == 1


def test_order_of_keys_and_escapes_of_a_payload_do_not_matter(spark):
    import json

    body = json.loads(payload(description="Größe \u0001 \"x\" / \\\\"))
    known = fingerprint.canonical(body)
    turned = json.dumps(dict(reversed(body.items())), ensure_ascii=True, indent=1)
    tables = bundle(spark, [{"run_id": "a", "payload": known}, {"run_id": "b", "payload": turned}, {"run_id": "c", "payload": known[:-1] + ',"active":true}'}])
    tables["versions"] = spark.createDataFrame([("name-check", fingerprint.revision(body), "1.0", turned)], tables["versions"].schema)
    assert reasons(tables) == {"a": None, "b": None, "c": "checksum mismatch"}


def test_local_ids_of_different_runs_differ(spark):
    pairs = [("a/b", "c"), ("a", "b/c"), ("a%2Fb", "c"), ("e", "r1")]
    frame = spark.createDataFrame(pairs, "endpoint string, run_id string").select(sync.local_run_id(F.col("endpoint"), F.col("run_id")).alias("id"))
    ids = [r["id"] for r in frame.collect()]
    assert len(set(ids)) == 4 and ids[3] == "e/r1"


def test_foreign_evidence_of_another_endpoint_is_found(spark):
    tables = bundle(spark, [{}])
    named = {n: tables[n].withColumn("endpoint", F.lit("f")) for n in ("results", "errors")}
    found = sync.orphan_evidence(tables["runs"], named["results"], named["errors"]).collect()
    assert [(r.endpoint, r.run_id) for r in found] == [("f", "r1")]


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_texts_of_a_run_stay_out_of_the_audits_joins(spark, no_broadcast):
    tables = bundle(spark, [{}, {"run_id": "r2", "revision": "stale"}, {"run_id": "r3", "payload": payload(severity="high")}])
    audited = sync.audit_bundles(*[tables[n] for n in ("runs", "results", "errors", "links", "versions")])
    plan = audited.select("endpoint", "run_id", "reason")._jdf.queryExecution().optimizedPlan()
    joins = [node for node in _nodes(plan) if node.nodeName() == "Join"]
    met = {node.output().apply(i).name() for node in joins for i in range(node.output().size())}
    assert len(joins) >= 4 and not met & {"payload", "_payload", "_normal", "_value"}


def test_waiting_runs_are_rewritten_only_when_runs_arrive(spark, tmp_path):
    tables = bundle(spark, [{}])
    feed, land = _feed(spark, tmp_path, tables)
    kept = f"{spark.conf.get('spark.checkpoint.dir')}/assayline-candidates-*"
    before = len(glob.glob(kept))
    land("runs", tables["runs"])
    land("results", tables["results"])
    assert len(glob.glob(kept)) == before + 1
    assert _state(feed) == ([], {"r1": "error rows do not match the summary"}, {})
