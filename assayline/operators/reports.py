"""Quality indicators over stored runs, results and evidence.

Frames follow the store's history layout: ``runs`` (run_id, table_name, mode, status,
started_at, rules_requested, rules_completed, ...), ``results`` (result_id, run_id, rule_id,
rule_version, passed, failed, executed_at) and ``evidence``. Per-rule and per-run facts are
combined before any shuffle, and facts joined back to many rows go through ``attach``, so a
rule or run that owns most of the history does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayline.functions.text import column, percent_text
from assayline.operators.skew import attach, latest_by, only
from assayline.operators.suite import kpi

REMOTE = "remote"
FAILURE_ROWS = 500


def _zero(total: Column) -> Column:
    return F.coalesce(total, F.lit(0)).cast("bigint")


def _sums(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(
        _zero(F.sum("passed")).alias("passed"), _zero(F.sum("failed")).alias("failed")
    )


def run_totals(runs: DataFrame, results: DataFrame, receipts: DataFrame | None = None) -> DataFrame:
    """Every run with its summed counts, number of execution errors and receipt, if any."""
    joined = runs.join(_sums(results.where("run_id IS NOT NULL"), "run_id"), "run_id", "left")
    fields = [n for n in runs.columns if n != "execution_errors"]
    extra = [F.coalesce(F.size("execution_errors"), F.lit(0)).alias("execution_error_count")] if (
        "execution_errors" in runs.columns
    ) else []
    output = joined.select(*map(column, fields), _zero(F.col("passed")).alias("passed"), _zero(F.col("failed")).alias("failed"), *extra)
    if receipts is None:
        return output
    found = receipts.select(F.col("local_run_id").alias("run_id"), "remote_run_id", "source_version")
    return output.join(found, "run_id", "left")


def run_errors(evidence: DataFrame, run_id) -> DataFrame:
    """Failing evidence of one run; the filter reaches the run's partition."""
    return evidence.where((F.col("run_id") == run_id) & (F.col("test_result") == 1)).select(
        "rule_id", "rule_version", "record_id", "field_name", "field_value", "error_message"
    )


def runs_for_table(runs: DataFrame, receipts: DataFrame, versions: DataFrame, table: str | None = None) -> DataFrame:
    """Runs of a table (or of all), newest first, with the published description of remote runs."""
    described = receipts.join(versions, ["rule_key", "revision"]).select(
        F.col("local_run_id").alias("run_id"), F.get_json_object("payload", "$.description").alias("rule_description")
    )
    one = described.groupBy("run_id").agg(F.min("rule_description").alias("rule_description"))
    chosen = runs if table is None else runs.where(F.col("table_name") == table)
    return chosen.join(one, "run_id", "left").orderBy(F.desc("started_at"), F.desc("run_id"))


def kpi_trend(
    results: DataFrame, rules: DataFrame, runs: DataFrame, table: str | None = None, allowed_runs: DataFrame | None = None
) -> DataFrame:
    """KPI of each result of active rules, under its run's table, else the rule's target.

    With ``allowed_runs`` only results of those runs count; without it results that belong
    to no run are shown too.
    """
    active = rules.where("status = 'ACTIVE'").select("rule_id", "target_table")
    named = attach(results, active, ["rule_id"]).where("target_table IS NOT NULL")
    tabled = attach(named, runs.select("run_id", "table_name"), ["run_id"], results)
    if allowed_runs is not None:
        tabled = only(tabled, allowed_runs, ["run_id"], results)
    shown = tabled.select(
        F.coalesce("table_name", "target_table").alias("table_name"), "rule_id", "result_id", "executed_at",
        kpi(F.col("passed"), F.col("failed")).alias("kpi"),
    )
    return shown if table is None else shown.where(F.col("table_name") == table)


def kpi_daily(results: DataFrame) -> DataFrame:
    """KPI of each result with its calendar day, rounded to two digits."""
    return results.select(
        "rule_id", "result_id", F.to_date("executed_at").alias("day"),
        F.round(kpi(F.col("passed"), F.col("failed")), 2).alias("kpi"),
    )


def latest_pass_rate(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Pass rate over the newest run of each dataset: one row."""
    newest = runs.groupBy("table_name").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    totals = newest.join(_sums(results.where("run_id IS NOT NULL"), "run_id"), "run_id", "left")
    return totals.agg(
        F.count(F.lit(1)).alias("datasets"), _zero(F.sum("passed")).alias("passed"), _zero(F.sum("failed")).alias("failed")
    ).withColumn("pass_rate", F.round(kpi(F.col("passed"), F.col("failed")), 1))


def run_board(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs with their sums; a run without results stays with zeros."""
    sums = _sums(results.where("run_id IS NOT NULL"), "run_id")
    return runs.join(sums, "run_id", "left").select(
        "run_id", "table_name", "started_at", "status", "rules_completed",
        _zero(F.col("passed")).alias("passed"), _zero(F.col("failed")).alias("failed"),
    )


def run_report(results: DataFrame, rules: DataFrame, run_id=None) -> DataFrame:
    """Counts per rule of one run (or of every run), with the rule's description."""
    chosen = results.where("run_id IS NOT NULL") if run_id is None else results.where(F.col("run_id") == run_id)
    named = attach(chosen, rules.select("rule_id", F.struct("description").alias("_rule")), ["rule_id"])
    return named.where("_rule IS NOT NULL").select(
        "run_id", "rule_id", F.col("_rule.description").alias("rule"), F.col("rule_version").alias("version"), "passed", "failed"
    )


def run_failures(evidence: DataFrame, rules: DataFrame, run_id=None) -> DataFrame:
    """Failing records with the rule's description."""
    failed = evidence.where("test_result = 1 AND run_id IS NOT NULL")
    failed = failed if run_id is None else failed.where(F.col("run_id") == run_id)
    named = attach(failed, rules.select("rule_id", F.struct("description").alias("_rule")), ["rule_id"])
    return named.where("_rule IS NOT NULL").select(
        "run_id", F.col("_rule.description").alias("rule"), "record_id", "field_name", "field_value", "error_message"
    )


def run_cards(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Per run the figures of a report card: rate as text, checks, failed, rules done."""
    board = run_board(runs.select("*"), results)
    done = runs.select("run_id", "rules_requested")
    checks = F.col("passed") + F.col("failed")
    return board.join(done, "run_id").select(
        "run_id",
        F.when(checks > 0, percent_text(kpi(F.col("passed"), F.col("failed")))).otherwise(F.lit("—")).alias("rate"),
        checks.alias("checks"), "failed",
        F.concat_ws(" / ", F.col("rules_completed").cast("string"), F.col("rules_requested").cast("string")).alias("rules"),
    )


def failure_search(evidence: DataFrame, text: str) -> DataFrame:
    """Failing records whose joined fields contain the text, ignoring case."""
    fields = ("rule_id", "record_id", "field_name", "field_value", "error_message")
    joined = F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    failed = evidence.where("test_result = 1")
    return failed.where(F.lower(joined).contains(text.lower())).select("run_id", *fields)


def sort_by_kpi(frame: DataFrame, descending: bool = True) -> DataFrame:
    """Rows by KPI, rows without one last in either direction."""
    order = F.desc_nulls_last("kpi") if descending else F.asc_nulls_last("kpi")
    return frame.orderBy(order, "rule_id")


def runs_in_scope(
    runs: DataFrame, environment: str | None = None, profile: str | None = None, *,
    receipts: DataFrame | None = None, links: DataFrame | None = None, rules: DataFrame | None = None,
) -> DataFrame:
    """Runs of an environment (local = anything not remote) or of a connection profile."""
    if profile is not None:
        linked = links.where(F.col("profile") == profile).select("endpoint", "rule_id").join(
            rules.select("rule_id", "rule_key"), "rule_id"
        )
        through = only(receipts, linked, ["endpoint", "rule_key"])
        return runs.join(through.select(F.col("local_run_id").alias("run_id")).distinct(), "run_id", "left_semi")
    if environment is None:
        return runs
    if environment == "local":
        return runs.where(F.col("mode") != REMOTE)
    return runs.where(F.col("mode") == environment)


def report_tables(
    runs: DataFrame, rules: DataFrame, links: DataFrame, datasets: DataFrame,
    environment: str | None = None, profile: str | None = None,
) -> DataFrame:
    """Tables a report can be opened for, per environment."""
    if environment == REMOTE:
        chosen = links if profile is None else links.where(F.col("profile") == profile)
        remote = rules.where(F.col("execution_mode") == REMOTE).join(chosen.select("rule_id"), "rule_id", "left_semi")
        return remote.select(F.col("target_table").alias("table_name")).distinct()
    if environment == "local":
        return datasets.select("table_name").distinct()
    return datasets.select("table_name").union(runs.select("table_name")).distinct()


def latest_results(results: DataFrame) -> DataFrame:
    """The newest result of every rule and version."""
    return latest_by(results, ["rule_id", "rule_version"], ["executed_at", "result_id"])
