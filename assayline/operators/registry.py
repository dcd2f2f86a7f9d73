"""The rule registry as a table: create, modify, archive, import, delete, migrate.

Every function takes the present registry frames and returns the next ones; saving them is
the caller's new table version. Requests arrive in batches, at most one per rule.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayline.errors import DataQualityError, HistoryInconsistent, SchemaRefused
from assayline.functions.fingerprint import RULE_KEY, SEVERITIES, canonical
from assayline.operators.crossref import CrossReference
from assayline.operators.evaluate import analyse, message_column
from assayline.operators.loading import number_rows
from assayline.operators.skew import attach, without
from assayline.operators.suite import COMPLETED, FAILED, PARTIAL, RUNNING
from assayline.session import cut_lineage, written

RULE_FIELDS = ("description", "rule_type", "target_table", "error_message", "sql_query", "severity")


def next_version(version: Column) -> Column:
    """The minor number plus one; a missing version counts as 1.0, a missing minor as 0."""
    parts = F.split(F.coalesce(version, F.lit("1.0")), "[.]")
    minor = F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.lit(0))
    return F.concat(parts[0], F.lit("."), (minor + 1).cast("string"))


def _refusal(*tests: tuple[Column, str]) -> Column:
    reason = F.lit(None).cast("string")
    for test, text in reversed(tests):
        reason = F.when(test, F.lit(text)).otherwise(reason)
    return reason


def _invalid_request() -> list[tuple[Column, str]]:
    blank = (F.length(F.trim(F.coalesce("description", F.lit("")))) == 0) | (
        F.length(F.trim(F.coalesce("rule_type", F.lit("")))) == 0
    )
    return [
        (~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "severity must be low, medium or high"),
        (blank, "description and rule type are required"),
    ]


# Gives the highest number that was ever used and sets ``count`` numbers above it aside; see ``TableStore.reserve``.
Reserve = Callable[[int, int], int]


def _numbered(rules: DataFrame, fresh: DataFrame, reserve: Reserve | None) -> DataFrame:
    """New rules with numbers. With ``reserve`` a number is never used again, not even after its rule was deleted."""
    top = rules.agg(F.max("rule_id")).first()[0] or 0
    if reserve is not None:
        fresh = cut_lineage(fresh)  # so that as many rows are numbered as numbers are set aside
        top = reserve(fresh.count(), top)
    return number_rows(fresh, "rule_id", top)


def create_rules(rules: DataFrame, requests: DataFrame, at: datetime, reserve: Reserve | None = None) -> tuple[DataFrame, DataFrame]:
    """(registry with the accepted requests at version 1.0, refused requests with reasons)."""
    judged = requests.withColumn("refused", _refusal(*_invalid_request()))
    accepted = _numbered(rules, judged.where("refused IS NULL").drop("refused"), reserve)
    fresh = accepted.withColumns(
        {"version": F.lit("1.0"), "status": F.lit("ACTIVE"), "created_at": F.lit(at)}
    )
    return rules.unionByName(fresh, allowMissingColumns=True), judged.where("refused IS NOT NULL")


def modify_rules(rules: DataFrame, requests: DataFrame, at: datetime) -> tuple[DataFrame, DataFrame]:
    """Apply edits to inactive rules: minor version plus one, active again.

    Active rules, unknown rules and edits of a cross-table rule's text are refused.
    """
    asked = requests.select("rule_id", F.struct(*RULE_FIELDS).alias("_ask"))
    joined = rules.join(asked, "rule_id", "full_outer")
    known = F.col("version").isNotNull() | F.col("status").isNotNull()
    reason = _refusal(
        (F.col("_ask").isNull(), "-"),
        (~known, "rule not found"),
        (F.upper("status") == "ACTIVE", "deactivate the rule before modifying it"),
        (
            F.col("cross_spec").isNotNull() & (F.trim(F.col("_ask.sql_query")) != F.trim("sql_query")),
            "create a new cross-table rule to change its column pairs",
        ),
        (~F.coalesce(F.col("_ask.severity").isin(*SEVERITIES), F.lit(False)), "severity must be low, medium or high"),
        (
            (F.length(F.trim("_ask.description")) == 0) | (F.length(F.trim("_ask.rule_type")) == 0),
            "description and rule type are required",
        ),
    )
    judged = joined.withColumn("_reason", reason)
    apply = F.col("_reason").isNull()
    changed = {name: F.when(apply, F.col("_ask")[name]).otherwise(F.col(name)) for name in RULE_FIELDS}
    changed |= {
        "version": F.when(apply, next_version(F.col("version"))).otherwise(F.col("version")),
        "status": F.when(apply, F.lit("ACTIVE")).otherwise(F.col("status")),
        "activated_at": F.when(apply, F.lit(at)).otherwise(F.col("activated_at")),
    }
    edited = judged.where(known).withColumns(changed).select(*rules.columns)
    refused = judged.where("_reason <> '-'").select("rule_id", F.col("_reason").alias("refused"))
    return edited, refused


def archive_entry(rules: DataFrame, actor: str, at: datetime, status: Column | None = None) -> DataFrame:
    """History rows that keep the rules as they are now."""
    return rules.select(
        "rule_id", "version", (F.lit("INACTIVE") if status is None else status).alias("status"), "created_at",
        "description", "rule_type", "target_table",
        F.to_json(
            F.struct("sql_query", message_column(F.col("error_message")).alias("error_message"), "severity")
        ).alias("rule_params"),
        F.lit(actor).alias("deactivated_by"), F.lit(at).alias("deactivated_at"),
    )


def archive_rules(rules: DataFrame, requests: DataFrame, actor: str, at: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry, new history rows, refused requests): active rules become inactive."""
    asked = requests.select("rule_id").distinct().withColumn("_asked", F.lit(True))
    marked = rules.join(asked, "rule_id", "left")
    stops = F.col("_asked") & (F.col("status") == "ACTIVE")
    history = archive_entry(marked.where(stops), actor, at)
    after = marked.withColumn("status", F.when(stops, F.lit("INACTIVE")).otherwise(F.col("status"))).select(*rules.columns)
    refused = asked.join(rules.where("status = 'ACTIVE'").select("rule_id"), "rule_id", "left_anti").select("rule_id")
    return after, history, refused


# Registry import.

COMPARED = ("description", "rule_type", "target_table", "error_message", "sql_query", "severity", "status")


def check_definitions(definitions: DataFrame) -> None:
    """Refuse a batch with a bad or repeated key, a blank field or an unknown severity."""
    invalid = definitions.where(
        ~F.coalesce(F.col("rule_key").rlike(f"^{RULE_KEY}$"), F.lit(False))
        | ~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))
        | (F.length(F.trim(F.coalesce("description", F.lit("")))) == 0)
        | (F.length(F.trim(F.coalesce("rule_type", F.lit("")))) == 0)
        | (F.length(F.trim(F.coalesce("target_table", F.lit("")))) == 0)
    ).limit(1).collect()
    if invalid:
        raise DataQualityError(f"Invalid rule definition: {invalid[0]['rule_key']}")
    repeated = definitions.groupBy("rule_key").count().where("count > 1").limit(1).collect()
    if repeated:
        raise DataQualityError(f"Rule keys must be unique: {repeated[0]['rule_key']}")


def registry_diff(rules: DataFrame, definitions: DataFrame) -> DataFrame:
    """What an import would do per key: created, updated, unchanged, refused, or absent.

    ``absent`` rules have no definition in the batch and stay as they are. A definition may
    not move a rule to another table.
    """
    new = definitions.select("rule_key", F.struct(*COMPARED, "cross_spec").alias("_new"))
    old = rules.select(
        "rule_key", "rule_id", "version",
        F.struct(
            *[
                F.trim("sql_query").alias("sql_query") if name == "sql_query"
                else message_column(F.col(name)).alias(name) if name == "error_message"
                else F.col(name)
                for name in COMPARED
            ],
            "cross_spec",
        ).alias("_old"),
    )
    joined = old.join(new, "rule_key", "full_outer")
    action = (
        F.when(F.col("_new").isNull(), F.lit("absent"))
        .when(F.col("_old").isNull(), F.lit("created"))
        .when(F.col("_old").eqNullSafe(F.col("_new")), F.lit("unchanged"))
        .when(F.col("_old.target_table") != F.col("_new.target_table"), F.lit("refused"))
        .otherwise(F.lit("updated"))
    )
    return joined.withColumn("action", action).withColumn(
        "new_version",
        F.when(F.col("action") == "created", F.lit("1.0"))
        .when(F.col("action") == "updated", next_version(F.col("version")))
        .otherwise(F.col("version")),
    )


def import_rules(
    rules: DataFrame, definitions: DataFrame, actor: str, at: datetime, reserve: Reserve | None = None
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(registry, new history rows, counts). One refused definition refuses the whole batch."""
    check_definitions(definitions)
    diff = registry_diff(rules, definitions)
    counts = {row["action"]: row["count"] for row in diff.groupBy("action").count().collect()}
    if counts.get("refused"):
        raise DataQualityError("Use a new rule key when changing a rule's target table.")
    changed = diff.where("action = 'updated'").select("rule_key", "_new", "new_version")
    history = archive_entry(rules.join(changed.select("rule_key"), "rule_key", "left_semi"), actor, at, F.col("status"))
    kept = rules.join(changed, "rule_key", "left")
    hit = F.col("_new").isNotNull()
    values = {name: F.when(hit, F.col("_new")[name]).otherwise(F.col(name)) for name in (*COMPARED, "cross_spec")}
    values["version"] = F.when(hit, F.col("new_version")).otherwise(F.col("version"))
    values["activated_at"] = F.when(hit & (F.col("_new.status") == "ACTIVE"), F.lit(at)).otherwise(F.col("activated_at"))
    after = kept.withColumns(values).select(*rules.columns)
    fresh = diff.where("action = 'created'").select("rule_key", "_new.*").drop("rule_id")
    created = _numbered(rules, fresh, reserve).withColumns({"version": F.lit("1.0"), "created_at": F.lit(at)})
    summary = {name: counts.get(name, 0) for name in ("created", "updated", "unchanged")}
    return after.unionByName(created, allowMissingColumns=True), history, summary


# Hard deletion.

def reconcile_after_delete(runs: DataFrame, results: DataFrame, evidence: DataFrame, deleted: DataFrame) -> DataFrame:
    """Runs as they stand once the given rules are gone, with ``outcome`` per run.

    Outcomes: untouched, kept (recounted), removed (nothing left), inconsistent (the stored
    history does not add up). Counts per run come from distinct (run, rule) pairs, combined
    before the shuffle.
    """
    gone = deleted.select("rule_id").distinct().withColumn("_gone", F.lit(True))
    pairs = results.where("run_id IS NOT NULL").select("run_id", "rule_id").distinct()
    pairs = attach(pairs, gone, ["rule_id"], results)
    counted = pairs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_actual"), F.count_if(F.col("_gone").isNull()).alias("_left"),
        F.count_if(F.col("_gone")).alias("_lost"),
    )
    stored = evidence.where("run_id IS NOT NULL").groupBy("run_id", "rule_id").agg(F.count(F.lit(1)).alias("_rows"))
    seen = attach(stored, gone, ["rule_id"], evidence).groupBy("run_id").agg(
        F.sum(F.when(F.col("_gone").isNull(), F.col("_rows")).otherwise(0)).alias("_rows_left"),
        F.count_if(F.col("_gone")).alias("_rows_lost"),
    )
    errors = runs.select("run_id", F.explode("execution_errors").alias("_e")).join(
        gone.withColumnRenamed("rule_id", "_rule"), F.col("_e.rule_id") == F.col("_rule").cast("string"), "left"
    )
    failed = errors.groupBy("run_id").agg(
        F.count_if(F.col("_gone").isNull()).alias("_errors_left"), F.count_if(F.col("_gone")).alias("_errors_lost")
    )
    joined = runs.join(counted, "run_id", "left").join(seen, "run_id", "left").join(failed, "run_id", "left").fillna(
        0, ["_actual", "_left", "_lost", "_rows_left", "_rows_lost", "_errors_left", "_errors_lost"]
    )
    affected = (F.col("_lost") > 0) | (F.col("_rows_lost") > 0) | (F.col("_errors_lost") > 0)
    all_errors = F.col("_errors_left") + F.col("_errors_lost")
    broken = (
        (F.col("status") == RUNNING)
        | (F.col("rules_completed") != F.col("_actual"))
        | (F.col("rules_requested") != F.col("_actual") + all_errors)
    )
    empty = (F.col("_left") == 0) & (F.col("_errors_left") == 0) & (F.col("_rows_left") == 0)
    outcome = (
        F.when(~affected, F.lit("untouched")).when(broken, F.lit("inconsistent"))
        .when(empty, F.lit("removed")).otherwise(F.lit("kept"))
    )
    recount = F.col("outcome") == "kept"
    status = (
        F.when((F.col("_errors_left") > 0) & (F.col("_left") > 0), F.lit(PARTIAL))
        .when(F.col("_errors_left") > 0, F.lit(FAILED)).otherwise(F.lit(COMPLETED))
    )
    return joined.withColumn("outcome", outcome).withColumns(
        {
            "status": F.when(recount, status).otherwise(F.col("status")),
            "rules_requested": F.when(recount, F.col("_left") + F.col("_errors_left")).otherwise(F.col("rules_requested")),
            "rules_completed": F.when(recount, F.col("_left")).otherwise(F.col("rules_completed")),
        }
    ).select(*[c for c in runs.columns], "outcome")


def delete_rules(tables: Mapping[str, DataFrame], deleted: DataFrame, actor: str, at: datetime) -> dict[str, DataFrame]:
    """Registry and history without the given rules, or HistoryInconsistent and no change.

    ``tables``: rules, history, runs, results, evidence, tickets. The reconciled runs are written out once, so the check and the
    runs that are left speak of the same rows, and results and evidence are not counted again.
    """
    reconciled = written(reconcile_after_delete(tables["runs"], tables["results"], tables["evidence"], deleted), "reconciled")
    if reconciled.where("outcome = 'inconsistent'").limit(1).count():
        raise HistoryInconsistent("Run history cannot be verified; nothing was deleted.")
    gone = deleted.select("rule_id").distinct()
    after = {name: without(tables[name], gone, ["rule_id"]) for name in ("rules", "history", "results", "evidence")}
    texts = gone.select(F.col("rule_id").cast("string").alias("_id")).withColumn("_gone", F.lit(True))
    remaining = reconciled.where("outcome <> 'removed'").drop("outcome")
    lines = remaining.select("run_id", F.explode("execution_errors").alias("_e"))
    left = lines.join(texts, F.col("_e.rule_id") == F.col("_id"), "left_anti").groupBy("run_id").agg(
        F.sort_array(F.collect_list("_e")).alias("_kept")  # at most one error per rule of a run
    )
    none = F.array().cast(remaining.schema["execution_errors"].dataType)
    after["runs"] = remaining.join(left, "run_id", "left").withColumn(
        "execution_errors", F.coalesce("_kept", none)
    ).select(*tables["runs"].columns)
    marked = tables["tickets"].join(gone.withColumn("_gone", F.lit(True)), "rule_id", "left")
    cancels = F.col("_gone") & ~F.col("status").isin("closed", "cancelled")
    after["events"] = marked.where(cancels).select(
        "ticket_id", F.lit(at).alias("created_at"), F.lit(actor).alias("actor"), F.lit("rule_deleted").alias("kind"),
        F.col("rule_id").cast("string").alias("detail"),
    )
    after["tickets"] = marked.withColumns(
        {
            "status": F.when(cancels, F.lit("cancelled")).otherwise(F.col("status")),
            "closed_at": F.when(cancels, F.lit(at)).otherwise(F.col("closed_at")),
            "rule_id": F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("rule_id")),
        }
    ).select(*tables["tickets"].columns)
    return after


# Polarity.

def flip_flag(value: Column) -> Column:
    """Old polarity (1 = pass) to new (0 = pass); any other value is kept."""
    return F.when(value == 0, F.lit(1)).when(value == 1, F.lit(0)).otherwise(value)


def flip_flags(evidence: DataFrame, name: str = "test_result") -> DataFrame:
    return evidence.withColumn(name, flip_flag(F.col(name)).cast(evidence.schema[name].dataType))


def flip_rule(spark: SparkSession, sql: str, views: Mapping[str, DataFrame]) -> str:
    """Rule text of the old polarity wrapped so that it returns the new one."""
    frame, _ = analyse(spark, sql, views)
    if "dq_check" not in frame.columns:
        return sql
    shown = [
        "CASE WHEN dq_check IN (0, 1) THEN 1 - dq_check ELSE dq_check END AS dq_check" if name == "dq_check"
        else "`" + name.replace("`", "``") + "`"
        for name in frame.columns
    ]
    body = sql.strip()
    body = body[:-1] if body.endswith(";") else body
    return f"SELECT {', '.join(shown)}\nFROM (\n{body}\n) AS old_polarity"


# Cross-table rules and table bindings.

def cross_rule(spec: CrossReference, table: str, description: str, message: str = "", severity: str = "medium") -> dict:
    """A create request for a cross-table rule; its text follows from the spec."""
    return {
        "description": description, "rule_type": "cross_table", "target_table": table, "error_message": message,
        "sql_query": spec.sql(), "severity": severity, "cross_spec": canonical(spec.to_dict()),
    }


def table_bindings(links: DataFrame) -> DataFrame:
    """Outside table bound to each local table; ``conflicting`` where several are.

    ``links``: target_table, source_catalog, source_schema, source_table.
    """
    bound = F.struct("source_catalog", "source_schema", "source_table")
    return links.groupBy("target_table").agg(
        F.min(bound).alias("binding"), (F.min(bound) != F.max(bound)).alias("conflicting")
    ).select("target_table", "binding.*", "conflicting")


def check_bindings(links: DataFrame) -> DataFrame:
    bindings = table_bindings(links)
    conflict = bindings.where("conflicting").limit(1).collect()
    if conflict:
        raise SchemaRefused(f"Conflicting sources for table {conflict[0]['target_table']}")
    return bindings
