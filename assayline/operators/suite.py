"""Run many checks over one table: fused into a single scan, or one rule at a time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayline.functions.text import column
from assayline.operators import contract
from assayline.operators.checks import Check, failed
from assayline.operators.evaluate import rule_message

RUNNING, COMPLETED, PARTIAL, FAILED, NO_RULES = "running", "completed", "partial", "failed", "no_rules"


def run_status(requested: Column, completed: Column, errors: Column) -> Column:
    """Outcome of a run from the rules it was asked for, finished, and could not execute."""
    return (
        F.when(requested == 0, F.lit(NO_RULES))
        .when((errors > 0) & (completed > 0), F.lit(PARTIAL))
        .when(errors > 0, F.lit(FAILED))
        .otherwise(F.lit(COMPLETED))
    )


def kpi(passed: Column, failed_count: Column) -> Column:
    """Share of passed records in percent, NULL when nothing was checked."""
    return F.try_divide(F.lit(100.0) * passed, passed + failed_count)


@dataclass
class FusedSuite:
    """All checks of one table over one prepared frame.

    ``plain`` is the frame without the facts of checks whose failures are tallied per key; their flags are NULL there.
    """

    frame: DataFrame
    checks: Sequence[Check]
    key: str
    flags: list[Column] = field(default_factory=list)
    table: DataFrame | None = None
    plain: DataFrame | None = None

    def counts(self) -> DataFrame:
        """One row per rule. The table is scanned and aggregated once for all rules that look at records.

        Uniqueness is counted from its keys alone: an aggregate of key counts, no record is joined with its key again. Records
        without an id break the contract of every rule: ``bad_ids`` counts them, and there are no results then.
        """
        tallied = [i for i, check in enumerate(self.checks) if check.tally is not None and self.plain is not None]
        frame = self.frame if self.plain is None else self.plain
        sums = [F.sum(flag).alias(f"_f{i}") for i, flag in enumerate(self.flags) if i not in tallied]
        once = frame.agg(
            F.count(F.lit(1)).alias("_n"), F.count_if(contract.bad_id(column(self.key))).alias("_bad"), *sums
        )
        lines = [
            F.struct(
                F.lit(i).alias("_place"),
                F.lit(check.rule_id).alias("rule_id"),
                F.lit(check.version).alias("rule_version"),
                F.lit(check.description).alias("description"),
                F.lit(check.field).alias("field_name"),
                (F.lit(None) if i in tallied else F.coalesce(F.col(f"_f{i}"), F.lit(0))).cast("bigint").alias("failed"),
            )
            for i, check in enumerate(self.checks)
        ]
        rows = once.select("_n", "_bad", F.inline(F.array(*lines)))
        if tallied:
            found = [self.checks[i].tally(self.table).select(F.lit(i).alias("_place"), F.col("failed").alias("_tally")) for i in tallied]
            # One row per rule on either side.
            rows = rows.join(F.broadcast(reduce(DataFrame.unionAll, found)), "_place", "left").withColumn("failed", F.coalesce("failed", "_tally"))
        sound = F.col("_bad") == 0
        return rows.select(
            "rule_id", "rule_version", "description", "field_name",
            F.when(sound, F.col("_n") - F.col("failed")).alias("passed"), F.when(sound, F.col("failed")).alias("failed"),
            F.col("_bad").alias("bad_ids"),
            F.when(sound, kpi(F.col("_n") - F.col("failed"), F.col("failed"))).alias("kpi"),
        )

    def evidence(self, failures_only: bool = True) -> DataFrame:
        """Evidence of every rule from the same scan; passing records only if asked for.

        A record without an id fails the whole evaluation, as the contract asks.
        """
        # The flags are columns of their own first, so that compiled code evaluates each once.
        flagged = self.frame.select("*", *[flag.alias(f"_flag{i}") for i, flag in enumerate(self.flags)])
        lines = []
        known_id = F.when(contract.bad_id(column(self.key)), F.raise_error(F.lit("A record has no id."))).otherwise(
            column(self.key).cast("string"))
        for i, check in enumerate(self.checks):
            flag = F.col(f"_flag{i}")
            line = F.struct(
                F.lit(check.rule_id).alias("rule_id"),
                F.lit(check.version).alias("rule_version"),
                known_id.alias("record_id"),
                F.lit(check.field).alias("field_name"),
                column(check.field).cast("string").alias("field_value"),
                flag.alias("test_result"),
                F.when(flag == 1, F.lit(rule_message(check.message))).otherwise(F.lit("")).alias("error_message"),
            )
            lines.append(F.when(flag == 1, line) if failures_only else line)
        found = F.array(*lines)
        if not failures_only:
            return flagged.select(F.inline(found))
        # The outer form keeps the optimiser from testing the list before it is built.
        return flagged.select(F.inline_outer(F.array_compact(found))).where("test_result = 1")


def fuse(frame: DataFrame, checks: Sequence[Check], key: str = "id") -> FusedSuite:
    """Attach each check's per-key fact once, then evaluate all conditions side by side."""
    if not checks:
        raise ValueError("A suite needs at least one check.")
    prepared = plain = frame
    facts = []
    for position, check in enumerate(checks):
        fact = f"_fact{position}"
        facts.append(fact)
        if check.prepare is not None:
            prepared = check.prepare(prepared, fact, frame, key)
            if check.tally is None:
                plain = check.prepare(plain, fact, frame, key)
    flags = [failed(check, prepared, fact) for check, fact in zip(checks, facts)]
    return FusedSuite(prepared, checks, key, flags, frame, plain)
