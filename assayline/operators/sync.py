"""Result synchronisation between registries, as set operations over whole bundles.

A bundle is four tables: ``runs`` (endpoint, run_id, rule_key, revision, payload, started_at,
completed_at, status, source_version, execution_error, reference_versions - times as ISO
text), ``results`` (endpoint, run_id, passed, failed, field_name) and ``errors`` (endpoint, run_id,
record_id, field_name, field_value, error_message). Results and errors of a bundle with one endpoint
may leave the endpoint out; with several it keeps equal run ids apart. ``links`` binds (endpoint, rule_key) to a local rule:
rule_id, target_table, source_catalog, source_schema, source_table; ``versions`` lists the
known (rule_key, revision, local_version).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from assayline.functions.text import column
from assayline.functions.fingerprint import normal_column, parsed_column
from assayline.operators.registry import archive_entry, next_version
from assayline.operators.skew import attach, running
from assayline.session import written

ZONED = r"(Z|[+-]\d{2}:?\d{2})$"
# What an import does not read again: its facts are columns of the audit.
TEXTS = ("payload", "started_at", "completed_at", "reason")
VERSION_MAP = r'^\{("[^"]+":\d+(,"[^"]+":\d+)*)?\}$'


def run_keys(frame: DataFrame) -> list[str]:
    """What identifies a run in a table of the bundle."""
    return ["endpoint", "run_id"] if "endpoint" in frame.columns else ["run_id"]


def _zoned(text: Column) -> Column:
    return F.when(text.rlike(ZONED), text.try_cast("timestamp"))


def audit_bundles(runs: DataFrame, results: DataFrame, errors: DataFrame, links: DataFrame, versions: DataFrame) -> DataFrame:
    """Runs with local facts, description and severity of their payload, and ``reason``: why a run cannot be imported, NULL when it can.

    Errors and results are reduced to one row per run before they meet the runs.
    """
    summary = results.groupBy(*run_keys(results)).agg(
        F.count(F.lit(1)).alias("_summaries"), F.min("passed").alias("passed"), F.min("failed").alias("failed"),
        F.min("field_name").alias("field_name"),
    )
    details = errors.groupBy(*run_keys(errors)).agg(
        F.count(F.lit(1)).alias("_errors"), F.min("field_name").alias("_low"), F.max("field_name").alias("_high"),
        F.count_if(F.col("field_name").isNull() | F.col("record_id").isNull() | (F.col("record_id") == "")).alias("_bad"),
    )
    bound = links.select(
        "endpoint", "rule_key", "rule_id", "target_table",
        F.to_json(F.array("source_catalog", "source_schema", "source_table")).alias("_source"),
    )
    # A run gets here with a payload that hashes to its revision, so the known payload is the same if it does too.
    same = F.sha2(normal_column(parsed_column(F.col("payload"))), 256) == F.col("revision")
    known = versions.select("rule_key", "revision", "local_version", F.coalesce(same, F.lit(False)).alias("_same"))
    references = F.coalesce("reference_versions", F.lit("{}"))
    value = F.col("_value")
    names = F.json_object_keys(F.to_json(F.try_variant_get(value, "$.references", "variant")))
    none = F.array().cast("array<string>")
    # The payload is parsed once; everything else is read from its value.
    parsed = runs.withColumn("_value", parsed_column(F.col("payload")))
    read = parsed.select(
        *map(column, runs.columns), (F.sha2(normal_column(value), 256) == F.col("revision")).alias("_intact"),
        _zoned(F.col("started_at")).alias("started"), _zoned(F.col("completed_at")).alias("ended"),
        F.try_variant_get(value, "$.rule_key", "string").alias("_key"), F.to_json(F.try_variant_get(value, "$.source", "variant")).alias("_from"),
        (F.coalesce(F.sort_array(names), none) != F.coalesce(F.sort_array(F.json_object_keys(references)), none)).alias("_unpinned"),
        F.try_variant_get(value, "$.description", "string").alias("description"),
        F.try_variant_get(value, "$.severity", "string").alias("severity"),
    )
    done = F.col("status") == "completed"
    count = F.coalesce("_errors", F.lit(0))
    # What a run says itself is judged before it meets anything, so that its texts stay out of the joins.
    alone = read.select(
        *map(column, runs.columns), "started", "ended", "description", "severity", "_from",
        _first([
            (~F.coalesce("_intact", F.lit(False)), "checksum mismatch"),
            (~F.col("_key").eqNullSafe(F.col("rule_key")), "rule key mismatch"),
        ]).alias("_payload_fault"),
        _first([
            (F.col("started").isNull() | F.col("ended").isNull(), "timestamps must include their time zone"),
            (F.col("ended") < F.col("started"), "run ends before it starts"),
            (~F.col("status").isin("completed", "failed"), "run is not complete"),
            (done & (~references.rlike(VERSION_MAP) | F.col("_unpinned")), "reference versions are missing or invalid"),
        ]).alias("_run_fault"),
    )
    linked = attach(alone, bound, ["endpoint", "rule_key"], runs, ["endpoint", "run_id"]).withColumn(
        "_link_fault",
        _first([
            (F.col("rule_id").isNull(), "rule is not linked"),
            (~F.col("_from").eqNullSafe(F.col("_source")), "source does not match the mapping"),
        ]),
    ).drop("_from", "_source")
    versioned = attach(linked, known, ["rule_key", "revision"], runs, ["endpoint", "run_id"])
    joined = versioned.join(summary, run_keys(results), "left").join(details, run_keys(errors), "left")
    evidence_fault = _first([
        (done & (F.coalesce("_summaries", F.lit(0)) != 1), "run summary is incomplete"),
        (
            done & (F.col("passed").isNull() | F.col("failed").isNull() | (F.col("passed") < 0) | (F.col("failed") < 0)),
            "invalid counts",
        ),
        (done & (count != F.col("failed")), "error rows do not match the summary"),
        (
            done & (count > 0) & ((F.col("_bad") > 0) | (F.col("_low") != F.col("field_name")) | (F.col("_high") != F.col("field_name"))),
            "invalid error details",
        ),
        (F.col("local_version").isNull() | ~F.col("_same"), "unrecognised revision"),
    ])
    return joined.select(
        *map(column, runs.columns), "passed", "failed", "field_name", "rule_id", "target_table", "local_version",
        "started", "ended", "description", "severity", F.coalesce("_payload_fault", "_link_fault", "_run_fault", evidence_fault).alias("reason"),
    )


def _first(tests: list[tuple[Column, str]]) -> Column:
    """The text of the first test that holds, else NULL."""
    (test, text), *others = tests
    found = F.when(test, F.lit(text))
    for test, text in others:
        found = found.when(test, F.lit(text))
    return found


def orphan_evidence(runs: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """Keys of results or errors that belong to no run of the bundle: run ids, with their endpoint where evidence names it."""
    keys = run_keys(results) if run_keys(results) == run_keys(errors) else ["run_id"]
    ids = results.select(*keys).union(errors.select(*keys)).distinct()
    return ids.join(runs.select(*keys).distinct(), keys, "left_anti")


def unseen(runs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Runs without a receipt. Taken before the audit, so that only new runs are audited."""
    return runs.join(receipts.select("endpoint", F.col("remote_run_id").alias("run_id")), ["endpoint", "run_id"], "left_anti").select(
        *map(column, runs.columns))


def new_runs(audited: DataFrame, receipts: DataFrame) -> DataFrame:
    """Importable runs that have no receipt yet, each remote run once, without the texts the audit has read.

    A run that arrives twice in one batch is kept once; both copies are equal in what
    matters, because its payload and counts passed the audit.
    """
    fresh = audited.where("reason IS NULL").drop(*TEXTS)
    return one_each(fresh.join(receipts.select("endpoint", F.col("remote_run_id").alias("run_id")), ["endpoint", "run_id"], "left_anti"))


def one_each(fresh: DataFrame) -> DataFrame:
    rest = [n for n in fresh.columns if n not in ("endpoint", "run_id")]
    return fresh.groupBy("endpoint", "run_id").agg(F.min(F.struct(*rest)).alias("_r")).select("endpoint", "run_id", "_r.*")


def local_run_id(endpoint: Column, run_id: Column) -> Column:
    """A local id that follows from the remote one, so importing again finds the same run.

    The first slash ends the endpoint; one inside the endpoint is written as a percent code.
    """
    return F.concat_ws("/", F.replace(F.replace(endpoint, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), run_id)


def imported_rows(fresh: DataFrame, errors: DataFrame, actor: str, *, settled: bool = False) -> dict[str, DataFrame]:
    """Rows to append for new runs: runs, results, evidence and receipts.

    Failed runs are kept without counts or evidence; their error becomes an execution error.
    The new runs are written out once, so all four outputs speak of the same runs; ``settled`` says that they have been.
    """
    kept = fresh if settled else written(fresh.drop(*TEXTS), "imported")
    named = kept.withColumn("local_run_id", local_run_id(F.col("endpoint"), F.col("run_id")))
    good = F.col("status") == "completed"
    error = F.struct(
        F.col("rule_id").cast("string").alias("rule_id"), "description",
        F.col("local_version").alias("version"), F.col("execution_error").alias("message"),
    )
    none = F.array().cast("array<struct<rule_id:string,description:string,version:string,message:string>>")
    runs = named.select(
        F.col("local_run_id").alias("run_id"), F.col("target_table").alias("table_name"), F.lit(actor).alias("username"),
        F.lit("remote").alias("mode"), "status", F.col("started").alias("started_at"), F.col("ended").alias("completed_at"),
        F.lit(1).alias("rules_requested"), good.cast("int").alias("rules_completed"),
        F.when(good, none).otherwise(F.array(error)).alias("execution_errors"),
    )
    done = named.where(good)
    results = done.select(
        F.col("local_run_id").alias("run_id"), "rule_id", F.col("local_version").alias("rule_version"),
        "field_name", "passed", "failed", F.col("ended").alias("executed_at"),
    )
    owner = done.select(*run_keys(errors), "local_run_id", "rule_id", "local_version", "target_table", "ended")
    known = attach(errors, owner, run_keys(errors)).where("local_run_id IS NOT NULL")
    evidence = known.select(
        F.col("local_run_id").alias("run_id"), "rule_id", F.col("local_version").alias("rule_version"), "record_id",
        "field_name", "field_value", F.lit(1).alias("test_result"), "error_message", F.col("ended").alias("executed_at"),
        "target_table",
    )
    receipts = named.select(
        "endpoint", F.col("run_id").alias("remote_run_id"), "local_run_id", "source_version", "rule_key", "revision",
        F.coalesce("reference_versions", F.lit("{}")).alias("reference_versions"), F.col("started").alias("started_at"),
    )
    return {"runs": runs, "results": results, "evidence": evidence, "receipts": receipts}


def mark_late(arrivals: DataFrame, arrival: list[str], bucket: Column) -> DataFrame:
    """Runs with ``late``: an earlier arrival of the same rule had a later start.

    A late run is history only; it must not move a ticket. ``arrival`` orders the arrivals
    and ends with a column that identifies a run; ``bucket`` rises with it.
    """
    before = running(arrivals, ["endpoint", "rule_key"], arrival, bucket, F.col("started"), "max", "latest_before")
    return before.withColumn("late", F.coalesce(F.col("started") < F.col("latest_before"), F.lit(False)))


def ticket_outcomes(marked: DataFrame) -> DataFrame:
    """The runs that may move tickets: completed and not late. Several of one rule go to ``tickets.apply_runs``."""
    return marked.where("status = 'completed' AND NOT late")


# Reasons that more evidence, a link or a definition may still remove.
WAITS = (
    "rule is not linked", "source does not match the mapping", "run summary is incomplete", "error rows do not match the summary",
    "unrecognised revision",
)


def ticket_moves(fresh: DataFrame, receipts: DataFrame, actor: str) -> DataFrame:
    """What newly imported runs say to the tickets, see ``tickets.apply_runs``: completed runs that are not late.

    Runs of one import count in the order of their start. A run is late if an earlier import had a run of the same rule that
    started after it. ``receipts`` are those of the earlier imports.
    """
    before = receipts.groupBy("endpoint", "rule_key").agg(F.max("started_at").alias("_latest"))
    known = attach(fresh.where("status = 'completed'"), before, ["endpoint", "rule_key"])
    return known.where(F.col("_latest").isNull() | (F.col("started") >= F.col("_latest"))).select(
        "rule_id", F.col("target_table").alias("table_name"), F.col("local_version").alias("rule_version"),
        F.coalesce("description", F.lit("")).alias("title"),
        F.coalesce("severity", F.lit("medium")).alias("severity"),
        local_run_id(F.col("endpoint"), F.col("run_id")).alias("run_id"), F.lit(actor).alias("actor"), "failed",
        (F.col("passed") + F.col("failed")).alias("checked"), F.col("started").alias("occurred_at"))


def sync_summary(audited: DataFrame, receipts: DataFrame) -> DataFrame:
    """Counts of one synchronisation: available, existing, imported, failed runs, refused, latest.

    Only finished runs are available. A refused run does not block the others.
    """
    seen = receipts.select("endpoint", F.col("remote_run_id").alias("run_id"), F.lit(True).alias("_seen")).distinct()
    finished = audited.where(F.col("status").isin("completed", "failed")).join(seen, ["endpoint", "run_id"], "left")
    known = F.coalesce("_seen", F.lit(False))
    fits = ~known & F.col("reason").isNull()
    return finished.agg(
        F.count(F.lit(1)).alias("available"), F.count_if(known).alias("existing"), F.count_if(fits).alias("imported"),
        F.count_if(fits & (F.col("status") == "failed")).alias("failed_runs"),
        F.count_if(~known & F.col("reason").isNotNull()).alias("refused"), F.max("started").alias("latest"),
    )


# Publication of definitions.

def publish_outcome(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Whether each local definition may be published, and why not.

    ``local``: rule_key, revision, payload, expected_local, expected_remote, base_revision.
    ``remote``: rule_key, revision, payload, at most one row per key.
    """
    theirs = remote.select("rule_key", F.col("revision").alias("remote_revision"))
    joined = local.join(theirs, "rule_key", "left")
    there = F.col("remote_revision")
    outcome = (
        F.when(F.col("revision") != F.col("expected_local"), F.lit("local changed"))
        .when(~there.eqNullSafe(F.col("expected_remote")), F.lit("remote changed"))
        .when(there.isNull(), F.lit("insert"))
        .when(there == F.col("revision"), F.lit("same"))
        .when(there.eqNullSafe(F.col("base_revision")), F.lit("update"))
        .otherwise(F.lit("conflict"))
    )
    return joined.withColumn("outcome", outcome)


def published_registry(local: DataFrame, remote: DataFrame, at: datetime) -> DataFrame:
    """The remote registry once the allowed definitions are published; others stay."""
    allowed = publish_outcome(local, remote).where(F.col("outcome").isin("insert", "update", "same"))
    fresh = allowed.select("rule_key", "revision", "payload", F.lit(at).alias("updated_at"))
    kept = remote.join(fresh.select("rule_key"), "rule_key", "left_anti")
    return kept.select("rule_key", "revision", "payload", "updated_at").unionByName(fresh)


def compare_definitions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local and remote revision per key: same, different, only local or only remote."""
    mine = local.select("rule_key", F.col("revision").alias("local_revision"), "base_revision")
    theirs = remote.select("rule_key", F.col("revision").alias("remote_revision"))
    state = (
        F.when(F.col("remote_revision").isNull(), F.lit("only local"))
        .when(F.col("local_revision").isNull(), F.lit("only remote"))
        .when(F.col("local_revision") == F.col("remote_revision"), F.lit("same"))
        .otherwise(F.lit("different"))
    )
    return mine.join(theirs, "rule_key", "full_outer").withColumn("state", state)


ACCEPTED = ("description", "rule_type", "severity", "error_message")


def accept_remote(rules: DataFrame, accepted: DataFrame, actor: str, at: datetime) -> tuple[DataFrame, DataFrame]:
    """(registry, new history rows) after taking over remote definitions.

    ``accepted``: rule_key, description, rule_type, severity, error_message, active, sql. A
    rule that already equals the definition is left alone, so accepting twice changes nothing.
    """
    offered = accepted.select("rule_key", F.struct(*ACCEPTED, "active", "sql").alias("_new"))
    joined = rules.join(offered, "rule_key", "left")
    same = F.col("sql_query").eqNullSafe(F.col("_new.sql")) & ((F.col("status") == "ACTIVE") == F.col("_new.active"))
    for name in ACCEPTED:
        same = same & F.col(name).eqNullSafe(F.col("_new")[name])
    marked = joined.withColumn("_moves", F.col("_new").isNotNull() & ~same)
    moves = F.col("_moves")
    history = archive_entry(marked.where(moves), actor, at, F.col("status"))
    values = {name: F.when(moves, F.col("_new")[name]).otherwise(F.col(name)) for name in ACCEPTED}
    values |= {
        "sql_query": F.when(moves, F.col("_new.sql")).otherwise(F.col("sql_query")),
        "status": F.when(moves & F.col("_new.active"), F.lit("ACTIVE")).when(moves, F.lit("INACTIVE")).otherwise(F.col("status")),
        "version": F.when(moves, next_version(F.col("version"))).otherwise(F.col("version")),
        "execution_mode": F.when(moves, F.lit("remote")).otherwise(F.col("execution_mode")),
    }
    return marked.withColumns(values).select(*rules.columns), history
