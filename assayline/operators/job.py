"""Execute stored rules and keep runs, counts and evidence; nothing half-finished is visible.

Order of writing: evidence is staged by one scan per table for all rules that allow it, counts are observed on the way, the
staged evidence of sound rules is published and counted, and only then do the counts and the
final run row appear. Readers take results of finished runs only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from assayline.errors import ContractError, DataQualityError, JobFailed
from assayline.functions import fingerprint
from assayline.operators import contract, suite
from assayline.operators.evaluate import RuleOutput, evaluate, evidence, quoted, rule_message
from assayline.operators.rule_fusion import FusedRules, RuleText, fusable
from assayline.operators.skew import only
from assayline.sources.tables import TableStore

RUNS = (
    "run_id string, table_name string, username string, mode string, status string, started_at timestamp, "
    "completed_at timestamp, rules_requested int, rules_completed int, "
    "execution_errors array<struct<rule_id:string,description:string,version:string,message:string>>, "
    "source_versions map<string,bigint>"
)
RESULTS = (
    "run_id string, rule_id string, rule_version string, field_name string, passed bigint, failed bigint, "
    "executed_at timestamp"
)


@dataclass
class StoredRule:
    """A rule as text, with the datasets it declares besides the tested one."""

    rule_id: str
    sql: str
    table: str
    version: str = "1.0"
    description: str = ""
    message: str = ""
    severity: str = "medium"
    active: bool = True
    references: Mapping[str, str] = field(default_factory=dict)
    profile: str = ""
    revision: str = ""
    payload: str = ""


@dataclass
class RunReport:
    run_id: str
    status: str
    requested: int
    completed: int
    errors: list[dict]
    counts: list[dict]


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def select_rules(
    rules: Sequence[StoredRule], *, table: str | None = None, rule_id: str | None = None, profile: str | None = None
) -> list[StoredRule]:
    """Active rules, optionally of one table, one profile, or a single rule, in id order."""
    chosen = [
        rule for rule in rules
        if rule.active
        and (table is None or rule.table == table)
        and (rule_id is None or rule.rule_id == rule_id)
        and (profile is None or rule.profile == profile)
    ]
    return sorted(chosen, key=lambda rule: str(rule.rule_id))


@dataclass
class _Outcome:
    """A rule's counts, or why it has none."""

    rule: StoredRule
    field: str = ""
    passed: int = 0
    failed: int = 0
    error: str | None = None

    def counted(self) -> dict:
        rule = self.rule
        return {
            "rule_id": str(rule.rule_id), "rule_version": rule.version, "field_name": self.field, "passed": self.passed,
            "failed": self.failed, "description": rule.description, "severity": rule.severity,
        }

    def refused(self) -> dict:
        rule = self.rule
        return {"rule_id": str(rule.rule_id), "description": rule.description, "version": rule.version, "message": self.error}


class RuleRunner:
    """Runs rules over a store's datasets and appends the outcome to the store.

    ``datasets`` names the tables rules may read. All of them are pinned to their current
    version (or to ``versions``) when a run starts, so every rule of the run reads the same data. A mapping gives frames of the
    caller's own in their place, which have no versions.

    Rules that ask one record at a time share one scan of their table, see ``rule_fusion``; the others run by themselves. Evidence is
    staged in either case and published in one write, after the counts have been seen.
    """

    def __init__(
        self, store: TableStore, datasets: Sequence[str] | Mapping[str, DataFrame] | None = None, versions: Mapping[str, int] | None = None
    ):
        self.store = store
        self.spark: SparkSession = store.spark
        self.given = dict(datasets) if isinstance(datasets, Mapping) else {}
        self.datasets = list(datasets) if datasets is not None else store.dataset_names()
        self.versions = dict(versions or {})

    def run_table(
        self, table: str, username: str, rules: Sequence[StoredRule], rule_id: str | None = None, *, full_evidence: bool = True
    ) -> RunReport:
        """All active rules of a table, or one of them, as one run."""
        if table not in self.datasets:
            raise DataQualityError(f"Unknown dataset: {table}")
        chosen = select_rules(rules, table=table, rule_id=rule_id)
        run_id, started, versions = uuid.uuid4().hex, _now(), self._pinned()
        mode = "single" if rule_id else "all"
        self._save_runs([self._run_row(run_id, table, username, mode, started, versions, len(chosen))], "started")
        outcomes = self._execute(chosen, versions, full_evidence, {str(rule.rule_id): run_id for rule in chosen})
        report = self._report(run_id, outcomes)
        self._save_counts([report])
        self._save_runs([self._run_row(run_id, table, username, mode, started, versions, len(chosen), report)], "finished")
        return report

    def run_job(self, rules: Sequence[StoredRule], username: str = "job", *, on_run: Callable | None = None, **selection) -> list[RunReport]:
        """A scheduled job: every active rule is a run of its own with failing rows as evidence.

        The rules of a table still share its scan. Rules with a published payload are refused when their revision does not
        match it. A refused or failing rule does not stop the others; the job fails at the end.
        """
        keys = [rule.rule_id for rule in rules]
        if len(keys) != len(set(keys)):
            raise DataQualityError("Duplicate rule keys.")
        chosen = select_rules(rules, **selection)
        if not chosen:
            raise JobFailed("No active rules were found.")
        reports: dict[str, RunReport] = {}
        sound = []
        for rule in chosen:
            if rule.payload and fingerprint.revision_of_text(rule.payload) != rule.revision:
                reports[rule.rule_id] = RunReport("", suite.FAILED, 1, 0, [{"rule_id": rule.rule_id, "message": "checksum mismatch"}], [])
            elif rule.table not in self.datasets:
                raise DataQualityError(f"Unknown dataset: {rule.table}")
            else:
                sound.append(rule)
        started, versions = _now(), self._pinned()
        ids = {str(rule.rule_id): uuid.uuid4().hex for rule in sound}

        def row(rule: StoredRule, report: RunReport | None = None):
            return self._run_row(ids[str(rule.rule_id)], rule.table, username, "single", started, versions, 1, report)

        if sound:
            self._save_runs([row(rule) for rule in sound], "started")
            outcomes = self._execute(sound, versions, False, ids)
            done = {o.rule.rule_id: self._report(ids[str(o.rule.rule_id)], [o]) for o in outcomes}
            self._save_counts(list(done.values()))
            self._save_runs([row(rule, done[rule.rule_id]) for rule in sound], "finished")
            for rule in sound if on_run is not None else ():
                on_run(done[rule.rule_id])
            reports |= done
        ordered = [reports[rule.rule_id] for rule in chosen]
        failures = [f"{e['rule_id']}: {e['message']}" for report in ordered for e in report.errors]
        if failures:
            raise JobFailed("\n".join(failures))
        return ordered

    def _pinned(self) -> dict[str, int]:
        return {name: self.versions.get(name) or self.store.version(name) for name in self.datasets if name not in self.given}

    def _execute(self, rules: Sequence[StoredRule], versions: Mapping[str, int], full_evidence: bool, runs: Mapping[str, str]) -> list[_Outcome]:
        """Outcomes of the rules in their order; evidence of the counted ones is published under their runs."""
        frames: dict[str, DataFrame] = {}

        def frame(name: str) -> DataFrame:
            if name not in frames:
                frames[name] = self.given[name] if name in self.given else self.store.read(name, versions[name])
            return frames[name]

        outcomes: dict[str, _Outcome] = {}
        stages: list[str] = []
        together: dict[str, list[tuple[StoredRule, RuleOutput]]] = {}
        try:
            for rule in rules:
                try:  # one rule's failure never stops or falsifies another
                    output = evaluate(self.spark, rule.sql, self._views(rule, frame))
                    if fusable(output, ("source", rule.table)):
                        together.setdefault(rule.table, []).append((rule, output))
                    else:
                        outcomes[rule.rule_id] = self._stage_alone(rule, output, full_evidence, stages)
                except Exception as error:
                    outcomes[rule.rule_id] = _Outcome(rule, error=str(error)[:4000])
            for table, group in together.items():
                outcomes |= self._stage_together(frame(table), table, group, full_evidence, stages)
            self._publish(list(outcomes.values()), stages, runs)
        finally:
            for stage in stages:
                self.store.drop_stage(stage)
        return [outcomes[rule.rule_id] for rule in rules]

    def _views(self, rule: StoredRule, frame: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
        views = {name: frame(name) for name in self.datasets}
        views["source"] = views[rule.table]
        for alias, name in rule.references.items():
            if name not in views:
                raise DataQualityError(f"Missing reference: {alias}")
            views[alias] = views[name]
        return views

    def _stage_alone(self, rule: StoredRule, output: RuleOutput, full_evidence: bool, stages: list[str]) -> _Outcome:
        """Stage one rule's evidence; its totals are observed while it is written, so the query runs once."""
        seen = Observation()
        facts = contract.total_columns()
        field_value = F.col(quoted(output.field)).cast("string")
        rows = output.frame.select(F.col("id").cast("string").alias("id"), field_value.alias("value"), contract.FLAG)
        saved = evidence(rows.observe(seen, *facts), "value", rule_message(rule.message), failures_only=not full_evidence).select(
            F.lit(str(rule.rule_id)).alias("rule_id"), F.lit(rule.version).alias("rule_version"), "record_id",
            F.lit(output.field).alias("field_name"), "field_value", "test_result", "error_message", F.lit(rule.table).alias("target_table"))
        stages.append(self.store.stage(saved))
        try:
            passed, failed = contract.check_totals(seen.get)
        except ContractError:
            self.store.drop_stage(stages.pop())
            raise
        return _Outcome(rule, output.field, passed, failed)

    def _stage_together(
        self, table: DataFrame, name: str, group: Sequence[tuple[StoredRule, RuleOutput]], full_evidence: bool, stages: list[str]
    ) -> dict[str, _Outcome]:
        """One scan for the group. If it fails at run time, its halves are tried, down to the rule that fails."""
        texts = [RuleText(str(rule.rule_id), rule.version, rule.sql, output.field, rule.message) for rule, output in group]
        seen = Observation()
        try:
            fused = FusedRules(self.spark, table, ("source", name), texts)
            stage = self.store.stage(
                fused.evidence(failures_only=not full_evidence, observation=seen).withColumn("target_table", F.lit(name)))
        except Exception as error:
            if len(group) == 1:
                rule = group[0][0]
                return {rule.rule_id: _Outcome(rule, error=str(error)[:4000])}
            middle = len(group) // 2
            return self._stage_together(table, name, group[:middle], full_evidence, stages) | self._stage_together(
                table, name, group[middle:], full_evidence, stages)
        stages.append(stage)
        found = {}
        for (rule, output), verdict in zip(group, fused.judged(seen.get)):
            if isinstance(verdict, Exception):
                found[rule.rule_id] = _Outcome(rule, output.field, error=str(verdict))
            else:
                found[rule.rule_id] = _Outcome(rule, output.field, *verdict)
        return found

    def _publish(self, outcomes: Sequence[_Outcome], stages: Sequence[str], runs: Mapping[str, str]) -> None:
        """Publish staged evidence of the counted rules, and see that all failures have arrived."""
        good = {str(o.rule.rule_id): o for o in outcomes if o.error is None}
        if not good or not stages:
            return
        staged = reduce(DataFrame.unionByName, [self.store.read_stage(stage) for stage in stages]).where(F.col("rule_id").isin(*good))
        run = F.create_map(*[F.lit(text) for pair in runs.items() for text in pair])[F.col("rule_id")]
        self.store.append_by("evidence", staged.withColumn("run_id", run), ["run_id", "rule_id"])
        saved = self.store.history("evidence", EVIDENCE).where(F.col("run_id").isin(*set(runs.values())))
        arrived = {row["rule_id"]: row["n"] for row in saved.groupBy("rule_id").agg(F.count_if(F.col("test_result") == 1).alias("n")).collect()}
        for rule_id, outcome in good.items():
            if arrived.get(rule_id, 0) != outcome.failed:
                outcome.error = f"Saved evidence ({arrived.get(rule_id, 0)}) does not match the count ({outcome.failed})."

    def _report(self, run_id: str, outcomes: Sequence[_Outcome]) -> RunReport:
        errors = [o.refused() for o in outcomes if o.error is not None]
        counted = [o.counted() for o in outcomes if o.error is None]
        if not outcomes:
            status = suite.NO_RULES
        elif errors:
            status = suite.PARTIAL if counted else suite.FAILED
        else:
            status = suite.COMPLETED
        return RunReport(run_id, status, len(outcomes), len(counted), errors, counted)

    def _save_counts(self, reports: Sequence[RunReport]) -> None:
        at = _now()
        lines = [
            (report.run_id, c["rule_id"], c["rule_version"], c["field_name"], c["passed"], c["failed"], at)
            for report in reports for c in report.counts
        ]
        if lines:
            self.store.append_by("results", self.spark.createDataFrame(lines, RESULTS), ["run_id"])

    def _run_row(self, run_id, table, username, mode, started, versions, requested, report: RunReport | None = None) -> tuple:
        errors = [] if report is None else [(e.get("rule_id"), e.get("description"), e.get("version"), e.get("message")) for e in report.errors]
        status, completed, done = (suite.RUNNING, None, 0) if report is None else (report.status, _now(), report.completed)
        return run_id, table, username, mode, status, started, completed, requested, done, errors, versions

    def _save_runs(self, rows: Sequence[tuple], state: str) -> None:
        frame = self.spark.createDataFrame(list(rows), RUNS).withColumn("state", F.lit(state))
        self.store.append_by("runs", frame, ["run_id", "state"])


def ticket_outcomes(spark: SparkSession, report: RunReport, table: str, actor: str, at: datetime | None = None) -> DataFrame:
    """What a run says to the tickets: one row per rule that was executed, see ``tickets.apply_run``."""
    moment = at or _now()
    lines = [
        (c["rule_id"], table, c["rule_version"], c["description"], c["severity"], report.run_id, actor, c["failed"],
         c["passed"] + c["failed"], moment)
        for c in report.counts
    ]
    return spark.createDataFrame(
        lines,
        "rule_id string, table_name string, rule_version string, title string, severity string, run_id string, actor string,"
        " failed bigint, checked bigint, occurred_at timestamp",
    )


def runs(store: TableStore) -> DataFrame:
    """Current state of every run: the finished row where there is one."""
    rows = store.history("runs", RUNS)
    fields = [name for name in rows.columns if name not in ("run_id", "state")]
    return rows.groupBy("run_id").agg(
        F.max_by(F.struct(*fields), F.col("completed_at").isNotNull()).alias("_run")
    ).select("run_id", *[F.col("_run")[name].alias(name) for name in fields])


def results(store: TableStore) -> DataFrame:
    """Counts of finished runs."""
    finished = runs(store).where("completed_at IS NOT NULL").select("run_id")
    return only(store.history("results", RESULTS), finished, ["run_id"])


EVIDENCE = (
    "run_id string, rule_id string, rule_version string, record_id string, field_name string, field_value string, "
    "test_result int, error_message string, target_table string"
)


def stored_evidence(store: TableStore) -> DataFrame:
    """Evidence of rules whose counts were published; leftovers of failed rules stay hidden."""
    counted = results(store).select("run_id", "rule_id")
    return only(store.history("evidence", EVIDENCE), counted, ["run_id", "rule_id"])
