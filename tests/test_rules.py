import pytest
from pyspark.sql import functions as F

from assayline.errors import AccessError, ContractError, DataQualityError, JobFailed, PreviewTooLarge
from assayline.functions import fingerprint
from assayline.operators import job, tickets
from assayline.operators.columns import columns_read
from assayline.operators.evaluate import (
    counts, evaluate, evidence, first_rows, message_column, preview, preview_rule, rule_message, validate,
)
from assayline.operators.job import RuleRunner, StoredRule

DEPTH = "SELECT id, depth, CASE WHEN depth < 50 THEN 0 ELSE 1 END AS dq_check FROM wells"


@pytest.fixture
def holes(spark):
    rows = [(4, "Oak", "o@w", 12), (5, "fen", "F@w", 73), (6, None, None, 49)]
    return spark.createDataFrame(rows, "id int, name string, email string, depth int")


def test_counts_and_evidence(spark, holes):
    output = evaluate(spark, DEPTH, {"wells": holes})
    assert output.field == "depth" and output.facts.datasets == {"wells"}
    assert tuple(counts(output.frame).first()) == (2, 1)
    lines = [tuple(r) for r in evidence(output.frame, "depth", '"Too deep"').orderBy("record_id").collect()]
    assert lines == [("4", "depth", "12", 0, ""), ("5", "depth", "73", 1, "Too deep"), ("6", "depth", "49", 0, "")]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT id, depth FROM wells",
        "SELECT depth, id, 0 AS dq_check FROM wells",
        "SELECT id, 0 AS dq_check, depth FROM wells",
        "SELECT id, depth, 0 AS passed FROM wells",
        "SELECT id, id, 0 AS dq_check FROM wells",
        "SELECT id, depth, depth, 0 AS dq_check FROM wells",
        "SELECT id, depth, '0' AS dq_check FROM wells",
        "SELECT id, depth, 0.0D AS dq_check FROM wells",
        "SELECT id, depth, NULL AS dq_check FROM wells",
    ],
)
def test_wrong_output_columns_are_refused(spark, holes, sql):
    with pytest.raises(ContractError):
        validate(spark, sql, {"wells": holes})


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT id, depth, 2 AS dq_check FROM wells",
        "SELECT id, depth, CAST(NULL AS INT) AS dq_check FROM wells",
        "SELECT '' AS id, depth, 0 AS dq_check FROM wells",
        "SELECT name AS id, depth, 0 AS dq_check FROM wells",
    ],
)
def test_wrong_output_values_are_refused(spark, holes, sql):
    assert validate(spark, sql, {"wells": holes}) == "depth"
    with pytest.raises(ContractError):
        validate(spark, sql, {"wells": holes}, full=True)
    with pytest.raises(ContractError):
        preview_rule(spark, sql, {"wells": holes})


def test_lenient_flags_must_still_equal_zero_or_one(spark, holes):
    views = {"wells": holes}
    assert validate(spark, "SELECT id, depth, depth < 18 AS dq_check FROM wells", views, strict=False, full=True) == "depth"
    assert validate(spark, "SELECT id, depth, 1.0D AS dq_check FROM wells", views, strict=False, full=True) == "depth"
    with pytest.raises(ContractError):
        validate(spark, "SELECT id, depth, 0.5D AS dq_check FROM wells", views, strict=False, full=True)
    with pytest.raises(ContractError):
        validate(spark, DEPTH.replace("depth,", "depth, name,", 1), views, exact=True)


@pytest.mark.parametrize(
    "sql",
    [
        "", ";", "DELETE FROM wells", "INSERT INTO wells SELECT * FROM wells", "DROP TABLE wells",
        "SELECT 1; SELECT 2", "SELECT id FROM nowhere", "SELECT id FROM wells) q; DROP VIEW wells; SELECT (1",
        "SELECT id, reflect('java.lang.System', 'getProperty', 'user.home') AS v, 0 AS dq_check FROM wells",
        "SELECT id, 1 AS v, 0 AS dq_check FROM range(5)", "SELECT id FROM secret", "SHOW TABLES",
        "SELECT id, 1 AS v, 0 AS dq_check FROM wells WHERE id IN (SELECT id FROM secret)",
        "SELECT id, java_method('java.lang.Math', 'abs', 1) AS v, (SELECT max(id) FROM range(3)) AS dq_check FROM wells",
    ],
)
def test_only_queries_over_declared_datasets_run(spark, holes, sql):
    holes.createOrReplaceTempView("secret")
    with pytest.raises(AccessError):
        evaluate(spark, sql, {"wells": holes})


def test_files_cannot_be_read_by_path(spark, holes, tmp_path):
    holes.write.parquet(str(tmp_path / "p"))
    with pytest.raises(AccessError):
        evaluate(spark, f"SELECT id, depth, 0 AS dq_check FROM parquet.`{tmp_path}/p`", {"wells": holes})
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_every_declared_dataset_must_be_read(spark, holes):
    with pytest.raises(AccessError):
        evaluate(spark, DEPTH, {"wells": holes, "other": holes}, declared_only=True)
    text = DEPTH + " WHERE EXISTS (SELECT 1 FROM other o WHERE o.id = wells.id)"
    assert evaluate(spark, text, {"wells": holes, "other": holes}, declared_only=True).field == "depth"


def test_views_of_the_caller_are_left_as_they_were(spark, holes):
    holes.limit(1).createOrReplaceTempView("wells")
    evaluate(spark, DEPTH, {"wells": holes})
    assert spark.table("wells").count() == 1
    spark.catalog.dropTempView("wells")
    evaluate(spark, DEPTH, {"wells": holes})
    assert not spark.catalog.tableExists("wells")


def test_columns_read_resolves_stars_aliases_and_subqueries(spark, holes):
    other = holes.select("id", F.col("email").alias("mail"))
    views = {"wells": holes, "other": other}
    assert columns_read(spark, DEPTH, views) == {"wells": {"id", "depth"}}
    assert columns_read(spark, "SELECT c.*, 0 AS dq_check FROM wells c", views)["wells"] == set(holes.columns)
    nested = "SELECT id, name, CASE WHEN EXISTS (SELECT 1 FROM other o WHERE o.mail = c.email) THEN 0 ELSE 1 END AS dq_check FROM wells c"
    assert columns_read(spark, nested, views) == {"wells": {"id", "name", "email"}, "other": {"mail"}}
    joined = "SELECT id, depth, 0 AS dq_check FROM wells NATURAL JOIN (SELECT id FROM other) o"
    assert columns_read(spark, joined, views)["other"] == {"id"}


def test_preview_is_cut_or_refused(spark):
    many = spark.range(504).select(F.col("id"), F.lit(1).alias("v"), F.lit(0).alias("dq_check"))
    page = preview(spark, "SELECT * FROM many", {"many": many})
    assert (len(page.rows), page.truncated, page.columns) == (500, True, ["id", "v", "dq_check"])
    assert not preview(spark, "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 5) SELECT i FROM n", {}).truncated
    assert len(preview(spark, "SELECT a.id FROM many a CROSS JOIN (SELECT max(id) AS m FROM many) b WHERE a.id = b.m", {"many": many}).rows) == 1
    with pytest.raises(PreviewTooLarge):
        preview_rule(spark, "SELECT * FROM many", {"many": many})
    assert len(preview_rule(spark, "SELECT * FROM many LIMIT 5", {"many": many})) == 5
    first = first_rows(many.select("id", "v"), ["id"], 10)
    assert [r["id"] for r in first.orderBy("id").collect()] == list(range(10)) and first.first()["truncated"]


def test_slow_preview_is_cancelled(spark):
    slow = spark.range(0, 10**10, 1, 4).select("id")
    with pytest.raises(Exception, match="(?i)cancel"):
        preview(spark, "SELECT max(hash(id)) AS m FROM slow", {"slow": slow}, timeout=1.5)


def test_messages(spark):
    texts = ['"quoted \\"one\\""', "plain", None, "", '"open', '{"a":1}']
    assert [rule_message(t) for t in texts][:2] == ['quoted "one"', "plain"]
    frame = spark.createDataFrame([(t,) for t in texts], "m string")
    assert [r[0] for r in frame.select(message_column(F.col("m"))).collect()] == ['quoted "one"', "plain", "", "", '"open', '{"a":1}']


def rules():
    return [
        StoredRule("shallow", DEPTH, "wells", "1.2", "depth below 50", "Too deep"),
        StoredRule("broken", "SELECT id, nothing, 0 AS dq_check FROM wells", "wells", description="broken"),
        StoredRule("off", DEPTH, "wells", active=False),
    ]


def test_partial_run_keeps_good_rules_and_reports_bad_ones(store, holes):
    store.save("wells", holes)
    runner = RuleRunner(store)
    report = runner.run_table("wells", "ann", rules())
    assert (report.status, report.requested, report.completed) == ("partial", 2, 1)
    assert report.errors[0]["rule_id"] == "broken"
    run = job.runs(store).collect()
    assert len(run) == 1 and run[0]["status"] == "partial" and run[0]["execution_errors"][0]["rule_id"] == "broken"
    assert [(r["passed"], r["failed"]) for r in job.results(store).collect()] == [(2, 1)]
    saved = job.stored_evidence(store)
    assert saved.count() == 3 and saved.where("test_result = 1").first()["error_message"] == "Too deep"
    assert run[0]["source_versions"] == {"wells": 1}


def test_a_run_opens_and_closes_its_ticket(spark, store, holes):
    store.save("wells", holes)
    runner = RuleRunner(store)
    loads = spark.createDataFrame([], "table_name string, file_name string, loaded_by string")
    state = spark.createDataFrame([], tickets.TICKET.replace("rule_id bigint", "rule_id string"))
    for ages, status in ((holes, "new"), (holes.where("depth < 50"), "closed")):
        store.save("wells", ages)
        report = runner.run_table("wells", "ann", rules())
        said = job.ticket_outcomes(spark, report, "wells", "ann")
        rows = tickets.number_new(tickets.apply_run(state, said, loads)).drop("action").collect()
        assert [(r["rule_id"], r["status"], r["latest_run_id"]) for r in rows] == [("shallow", status, report.run_id)]
        state = spark.createDataFrame(rows, state.schema)


def test_empty_and_missing_rules(store, holes):
    store.save("wells", holes.limit(0))
    runner = RuleRunner(store)
    assert runner.run_table("wells", "ann", []).status == "no_rules"
    report = runner.run_table("wells", "ann", rules()[:1])
    assert report.status == "completed" and (report.counts[0]["passed"], report.counts[0]["failed"]) == (0, 0)
    assert runner.run_table("wells", "ann", rules()[1:2]).status == "failed"
    assert runner.run_table("wells", "ann", rules(), "shallow").requested == 1
    with pytest.raises(DataQualityError):
        runner.run_table("nowhere", "ann", rules())


def test_run_reads_pinned_versions(store, holes):
    store.save("wells", holes)
    store.save("wells", holes.where("id = 4"))
    report = RuleRunner(store).run_table("wells", "ann", rules()[:1])
    assert report.counts[0]["passed"] == 1
    assert store.read("wells", 1).count() == 3


def test_runtime_errors_and_missing_references_are_execution_errors(store, holes):
    store.save("wells", holes)
    cast = StoredRule("cast", "SELECT id, name, CASE WHEN CAST(name AS INT) > 1 THEN 0 ELSE 1 END AS dq_check FROM source", "wells")
    lost = StoredRule("lost", DEPTH, "wells", references={"countries": "countries"})
    report = RuleRunner(store).run_table("wells", "ann", [cast, lost])
    assert report.status == "failed" and {e["rule_id"] for e in report.errors} == {"cast", "lost"}
    assert "Missing reference" in next(e["message"] for e in report.errors if e["rule_id"] == "lost")
    assert job.stored_evidence(store).count() == 0


def test_scheduled_job(store, holes):
    store.save("wells", holes)
    payload = {"rule_key": "shallow"}
    good = StoredRule("shallow", DEPTH, "wells", payload=fingerprint.canonical(payload), revision=fingerprint.revision(payload))
    runner = RuleRunner(store)
    assert len(runner.run_job([good])) == 1
    assert job.stored_evidence(store).count() == 1  # failing rows only
    with pytest.raises(JobFailed, match="checksum"):
        runner.run_job([StoredRule("shallow", DEPTH, "wells", payload="{}", revision="x")])
    with pytest.raises(JobFailed, match="broken"):
        runner.run_job([good, rules()[1]])
    with pytest.raises(JobFailed, match="No active"):
        runner.run_job([rules()[2]])
    with pytest.raises(DataQualityError, match="Duplicate"):
        runner.run_job([good, good])


def test_payload_contract():
    payload = {
        "contract": 1, "rule_key": "a-1", "local_version": "1.0", "description": "ä", "rule_type": "x", "severity": "low",
        "error_message": "", "active": True, "source": ["c", "s", "t"], "sql": "SELECT 1",
    }
    assert fingerprint.check_payload(payload) is payload
    assert fingerprint.canonical({"b": 1, "a": "ä"}) == '{"a":"ä","b":1}'
    for change in ({"contract": 4}, {"severity": "x"}, {"active": 1}, {"source": ["a"]}, {"rule_key": "A"}, {"more": 1}, {"sql": None}):
        with pytest.raises(DataQualityError):
            fingerprint.check_payload({**payload, **change})


def test_stored_views_and_python_table_functions_are_refused(spark, holes, tmp_path):
    from pyspark.sql.functions import udtf

    spark.sql("CREATE DATABASE IF NOT EXISTS elsewhere")
    try:
        spark.sql("CREATE OR REPLACE VIEW elsewhere.wells AS SELECT 9 AS id, 1 AS depth")
        with pytest.raises(AccessError):
            evaluate(spark, "SELECT id, depth, 0 AS dq_check FROM elsewhere.wells", {"wells": holes})
    finally:
        spark.sql("DROP DATABASE elsewhere CASCADE")

    @udtf(returnType="n int")
    class Numbers:
        def eval(self):
            yield (1,)

    spark.udtf.register("numbers_of_mine", Numbers)
    with pytest.raises(AccessError):
        evaluate(spark, "SELECT w.id, w.depth, 0 AS dq_check FROM wells w, numbers_of_mine()", {"wells": holes})


@pytest.mark.usefixtures("no_broadcast")
def test_uniqueness_reads_only_the_columns_it_needs(spark, tmp_path):
    from assayline.operators import checks

    frame = spark.range(50).selectExpr("id", "id % 7 AS k", "map('a', id) AS m", "cast(id AS string) AS wide")
    frame.write.parquet(str(tmp_path / "t"))
    rows = checks.rows(spark.read.parquet(str(tmp_path / "t")), checks.unique("k"))
    assert rows.where("dq_check = 1").count() == 50
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan and "m#" not in plan


def test_a_missing_id_leaves_a_fused_suite_without_results(spark):
    from assayline.operators import checks, suite

    frame = spark.createDataFrame([("1", 5), (None, 6)], "id string, v int")
    fused = suite.fuse(frame, [checks.positive("v").named(1, "positive")])
    assert [(r.passed, r.failed, r.bad_ids) for r in fused.counts().collect()] == [(None, None, 1)]
    with pytest.raises(Exception, match="no id"):
        fused.evidence(failures_only=False).collect()


def _scans(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_many_rule_texts_share_one_scan(spark, store, holes):
    from assayline.operators.rule_fusion import FusedRules, RuleText, fusable

    store.save("wells", holes)
    wells = store.read("wells")
    texts = {
        "shallow": DEPTH,
        "named": "WITH a AS (SELECT id, upper(name) AS n FROM source) SELECT id, n, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS dq_check FROM a;",
        "star": "SELECT *, 0 AS dq_check FROM source",
    }
    outputs = {k: evaluate(spark, text, {"wells": wells, "source": wells}) for k, text in texts.items()}
    assert all(fusable(o, ("source", "wells")) for o in outputs.values())
    fused = FusedRules(spark, wells, ("source", "wells"), [RuleText(k, "1.0", t, outputs[k].field, "bad") for k, t in texts.items()])
    assert _scans(fused.counts()) == _scans(fused.evidence()) == 1
    assert {r.rule_id: (r.passed, r.failed, r.bad_flags, r.bad_ids) for r in fused.counts().collect()} == {
        "shallow": (2, 1, 0, 0), "named": (2, 1, 0, 0), "star": (3, 0, 0, 0)}
    assert sorted(tuple(r) for r in fused.evidence().collect()) == [
        ("named", "1.0", "6", "n", None, 1, "bad"), ("shallow", "1.0", "5", "depth", "73", 1, "bad")]
    assert fused.evidence(failures_only=False).count() == 9
    for text in ("SELECT id, count(*) AS n, 0 AS dq_check FROM wells GROUP BY id", DEPTH + " WHERE id > 4",
                 "SELECT id, depth, CASE WHEN depth > (SELECT avg(depth) FROM wells) THEN 1 ELSE 0 END AS dq_check FROM wells",
                 "SELECT id, rand() AS r, 0 AS dq_check FROM wells", "SELECT a.id, a.depth, 0 AS dq_check FROM wells a JOIN wells b ON a.id = b.id",
                 "SELECT id, row_number() OVER (ORDER BY id) AS n, 0 AS dq_check FROM wells", "SELECT id, explode(array(1, 2)) AS n, 0 AS dq_check FROM wells"):
        assert not fusable(evaluate(spark, text, {"wells": wells}), ("source", "wells"))


def test_one_failing_rule_leaves_the_others_of_its_scan_alone(store, holes):
    store.save("wells", holes)
    good = [StoredRule(f"r{i}", f"SELECT id, depth, CASE WHEN depth < {i * 10} THEN 0 ELSE 1 END AS dq_check FROM source", "wells") for i in range(9)]
    cast = StoredRule("cast", "SELECT id, name, CASE WHEN CAST(name AS INT) > 1 THEN 0 ELSE 1 END AS dq_check FROM source", "wells")
    odd = StoredRule("odd", "SELECT id, depth, depth % 5 AS dq_check FROM source", "wells")
    blank = StoredRule("blank", "SELECT name AS id, depth, 0 AS dq_check FROM source", "wells")
    report = RuleRunner(store).run_table("wells", "ann", [*good[:4], cast, *good[4:], odd, blank])
    assert (report.requested, report.completed) == (12, 9) and {e["rule_id"] for e in report.errors} == {"cast", "odd", "blank"}
    assert {c["rule_id"]: c["failed"] for c in report.counts} == {f"r{i}": sum(d >= i * 10 for d in (12, 73, 49)) for i in range(9)}
    saved = job.stored_evidence(store)
    assert saved.count() == 27 and saved.where("rule_id NOT LIKE 'r%'").count() == 0
    assert store._folders(f"{store.root}/stages") == []


def test_a_job_keeps_a_run_for_each_rule_of_a_shared_scan(store, holes):
    store.save("wells", holes)
    seen = []
    reports = RuleRunner(store).run_job(
        [StoredRule(f"r/{i}", DEPTH, "wells") for i in range(3)], on_run=lambda report: seen.append(report.run_id))
    assert len({r.run_id for r in reports}) == 3 and seen == [r.run_id for r in reports]
    assert sorted((r.rule_id, r.run_id) for r in job.stored_evidence(store).collect()) == [(f"r/{i}", reports[i].run_id) for i in range(3)]
    assert job.runs(store).where("status = 'completed'").count() == job.results(store).count() == 3


def test_a_global_view_of_a_declared_name_is_refused(spark, holes):
    spark.range(1).selectExpr("7 AS id", "1 AS depth").createOrReplaceGlobalTempView("wells")
    spark.range(1).selectExpr("8 AS id", "1 AS depth").createOrReplaceTempView("wells")
    try:
        with pytest.raises(AccessError, match="declared"):
            evaluate(spark, "SELECT id, depth, 0 AS dq_check FROM global_temp.wells", {"wells": holes})
        with pytest.raises(AccessError, match="declared"):
            evaluate(spark, "SELECT id, depth, 0 AS dq_check FROM wells", {"holes": holes})
        assert evaluate(spark, "SELECT id, depth, 0 AS dq_check FROM wells", {"wells": holes}).frame.count() == 3
        assert spark.table("wells").first()["id"] == 8  # the caller's view is as it was
    finally:
        spark.catalog.dropGlobalTempView("wells")
        spark.catalog.dropTempView("wells")
    assert not [v.name for v in spark.catalog.listTables() if v.name.startswith("_dq_")]


def test_rules_of_two_threads_do_not_see_each_others_datasets(spark, holes):
    from concurrent.futures import ThreadPoolExecutor

    def one(n):
        return evaluate(spark, DEPTH, {"wells": holes.where(f"id = {4 + n % 3}")}).frame.collect()[0]["id"]

    with ThreadPoolExecutor(6) as pool:
        assert list(pool.map(one, range(18))) == [4 + n % 3 for n in range(18)]


def test_dependencies_reach_through_views(spark, holes):
    from assayline.operators.dependencies import dependencies, impact

    views = {"deep": "SELECT id, depth FROM wells WHERE name <> 'x'", "deeper": "SELECT d.id, d.depth FROM deep d WHERE d.depth > 1"}
    rules = {"a": "SELECT id, depth, 0 AS dq_check FROM deeper", "b": "SELECT id, email, 0 AS dq_check FROM wells"}
    found = {tuple(r) for r in dependencies(spark, rules, {"wells": holes}, views).collect()}
    assert found == {("a", "wells", c, "deeper") for c in ("id", "depth", "name")} | {("b", "wells", c, "") for c in ("id", "email")}
    counted = {(r.rule_id, r.column_name): (r.records, r.missing) for r in impact(spark, rules, {"wells": holes}, views).collect()}
    assert counted["a", "name"] == counted["b", "email"] == (3, 1) and counted["a", "depth"] == (3, 0)
    with pytest.raises(DataQualityError, match="ring"):
        dependencies(spark, rules, {"wells": holes}, {"x": "SELECT * FROM y", "y": "SELECT * FROM x"})
    assert columns_read(spark, "WITH a AS (SELECT * FROM wells), b AS (SELECT id, depth AS d FROM a) SELECT id, d, 0 AS dq_check FROM b",
                        {"wells": holes})["wells"] >= {"id", "depth"}


def test_partitions_of_a_task_are_written_side_by_side(spark, store):
    """Files are open for several partitions at once, so a task need not sort its rows; more partitions than files lose nothing."""
    seen = []

    class Recorded:
        def hint(self, *_):
            seen.append(int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
            return spark.range(1000).selectExpr("string(id % 40) AS run_id", "id AS n")

    store.append_by("many", Recorded(), ["run_id"])
    assert seen[0] > 1 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    back = store.history("many", "run_id string, n bigint")
    assert back.where("run_id = string(n % 40)").count() == back.select("n").distinct().count() == 1000
