"""Rule texts of one table side by side in a single scan.

A rule that gives each record one row of its own - no join, aggregate, filter or subquery - can be asked of one record at a time. Such
rules are put next to each other as lateral queries over the record; Spark turns these into one projection of the table, so any number of
them costs one scan. Counts are observed while the evidence is written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from assayline.errors import ContractError
from assayline.operators import contract
from assayline.operators.evaluate import RuleOutput, private_views, quoted, rule_message
from assayline.operators.suite import kpi


@dataclass(frozen=True)
class RuleText:
    """What fusing needs to know of a rule whose plan has been checked."""

    rule_id: str
    version: str
    sql: str
    field: str
    message: str = ""


def fusable(output: RuleOutput, names: Sequence[str]) -> bool:
    """Whether a checked rule asks one record at a time of the table that ``names`` stand for."""
    return output.facts.record_wise and output.facts.datasets <= set(names)


class FusedRules:
    """Checked rules (see ``fusable``) over one table, which they call by any of ``names``."""

    def __init__(self, spark: SparkSession, table: DataFrame, names: Sequence[str], rules: Sequence[RuleText]):
        if not rules:
            raise ValueError("Nothing to run together.")
        self.rules = list(rules)
        first, *others = names
        record = ", ".join(f"t.{quoted(name)} AS {quoted(name)}" for name in table.columns)
        bound = ", ".join([f"{quoted(first)} AS (SELECT {record})", *(f"{quoted(name)} AS (TABLE {quoted(first)})" for name in others)])
        asked = "".join(
            f", LATERAL (WITH {bound} SELECT struct(q.*) AS r FROM (\n{rule.sql.strip().rstrip(';')}\n) AS q) AS q{i}"
            for i, rule in enumerate(self.rules))
        answers = ", ".join(f"q{i}.r AS r{i}" for i in range(len(self.rules)))
        with private_views(spark, {"table": table}) as declared:
            self.frame = spark.sql(f"SELECT {answers} FROM {next(iter(declared))} AS t{asked}")

    def _facts(self) -> list[F.Column]:
        """Aggregates that judge every rule; named n, f0, b0, i0, f1, ..."""
        facts = [F.count(F.lit(1)).alias("n")]
        for i in range(len(self.rules)):
            answer = F.col(f"r{i}")
            flag = answer[contract.FLAG]
            facts += [
                F.count_if(flag == 1).alias(f"f{i}"), F.count_if(contract.bad_flag(flag)).alias(f"b{i}"),
                F.count_if(contract.bad_id(answer["id"])).alias(f"i{i}"),
            ]
        return facts

    def counts(self) -> DataFrame:
        """One row per rule: passed, failed, bad_flags, bad_ids and KPI; one aggregate over one scan.

        A rule that breaks the contract has no counts.
        """
        once = self.frame.agg(*self._facts())
        lines = F.array(*[
            F.struct(
                F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.version).alias("rule_version"), F.lit(rule.field).alias("field_name"),
                F.col(f"f{i}").alias("failed"), F.col(f"b{i}").alias("bad_flags"), F.col(f"i{i}").alias("bad_ids"))
            for i, rule in enumerate(self.rules)])
        sound = (F.col("bad_flags") == 0) & (F.col("bad_ids") == 0)
        passed = F.col("n") - F.col("failed")
        return once.select("n", F.inline(lines)).select(
            "rule_id", "rule_version", "field_name", F.when(sound, passed).alias("passed"), F.when(sound, F.col("failed")).alias("failed"),
            "bad_flags", "bad_ids", F.when(sound, kpi(passed, F.col("failed"))).alias("kpi"))

    def evidence(self, *, failures_only: bool = True, observation: Observation | None = None) -> DataFrame:
        """Evidence of all rules from one scan; ``observation`` sees the counts of every record on the way."""
        frame = self.frame if observation is None else self.frame.observe(observation, *self._facts())
        lines = []
        for i, rule in enumerate(self.rules):
            answer = F.col(f"r{i}")
            failed = answer[contract.FLAG] == 1
            line = F.struct(
                F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.version).alias("rule_version"), answer["id"].cast("string").alias("record_id"),
                F.lit(rule.field).alias("field_name"), answer[rule.field].cast("string").alias("field_value"),
                answer[contract.FLAG].cast("int").alias("test_result"),
                F.when(failed, F.lit(rule_message(rule.message))).otherwise(F.lit("")).alias("error_message"))
            lines.append(F.when(failed, line) if failures_only else line)
        found = F.array(*lines)
        if not failures_only:
            return frame.select(F.inline(found))
        return frame.select(F.inline_outer(F.array_compact(found))).where("test_result = 1")

    def judged(self, seen: dict) -> list[tuple[int, int] | Exception]:
        """(passed, failed) or the broken contract of each rule, from what an observation saw."""
        verdicts: list[tuple[int, int] | Exception] = []
        for i in range(len(self.rules)):
            row = {"checked": seen["n"], "failed": seen[f"f{i}"], "bad_flags": seen[f"b{i}"], "bad_ids": seen[f"i{i}"]}
            try:
                verdicts.append(contract.check_totals(row))
            except ContractError as error:
                verdicts.append(error)
        return verdicts

