"""Tickets: who repairs a failing rule, from the first failure to a clean run.

There is at most one open ticket per rule and table. Times are timestamps in UTC.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayline.functions.text import column
from assayline.operators.reports import FAILURE_ROWS
from assayline.operators.skew import attach, running
from assayline.session import cut_lineage

# Days until a ticket is due, by severity.
DUE_DAYS = {"low": 7, "medium": 3, "high": 1}
TERMINAL = ("closed", "cancelled")

TICKET = (
    "ticket_id bigint, rule_id bigint, rule_version string, table_name string, title string, severity string, "
    "status string, reporter string, assignee string, imported_by string, source_file string, created_at timestamp, "
    "last_seen timestamp, due_at timestamp, closed_at timestamp, failed_count bigint, latest_run_id string, "
    "failure_run_id string"
)


def due_at(created: Column, severity: Column) -> Column:
    days = F.lit(None).cast("int")
    for name, number in DUE_DAYS.items():
        days = F.when(severity == name, F.lit(number)).otherwise(days)
    return created + F.make_dt_interval(days=days)


def is_open(status: Column) -> Column:
    return ~status.isin(*TERMINAL)


def apply_run(tickets: DataFrame, outcome: DataFrame, loads: DataFrame) -> DataFrame:
    """All tickets after a run, with ``action``: created, failed, verified, empty or NULL.

    ``outcome`` has one row per rule and table: rule_id, table_name, rule_version, title,
    severity, run_id, actor, failed, checked, occurred_at. ``loads`` is the newest load per table.
    Rules that could not be executed have no row and leave their ticket alone. New tickets
    get no number here; see ``number_new``. Two outcomes of one rule and table are an error; for
    several runs see ``apply_runs``.
    """
    keys = ["rule_id", "table_name"]
    names = [n for n in tickets.columns if n not in keys]
    # Only the open ticket of a rule and table shares its slot with the outcome. Settled ones
    # have a slot each: one pass keeps them, and a rule's many old tickets stay spread.
    slot = F.when(is_open(F.col("status")), F.xxhash64(*keys)).otherwise(F.xxhash64(*keys, "ticket_id"))
    present = tickets.select(*keys, slot.alias("_slot"), F.struct(*map(column, names)).alias("_t"), is_open(F.col("status")).alias("_open"))
    # Hashes depend on the type: the outcome's keys take the types of the tickets'.
    outcome = outcome.withColumns({key: column(key).cast(tickets.schema[key].dataType) for key in keys})
    outcome = outcome.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    single = F.when(F.col("_times") > 1, F.raise_error(F.lit("Several outcomes of one rule: use apply_runs.")).cast("boolean")).otherwise(True)
    outcome = outcome.withColumn("_single", single)
    fresh = outcome.select(
        *keys, F.xxhash64(*keys).alias("_slot"), F.col("_single").alias("_open"),
        F.struct(*[column(n) for n in outcome.columns if n not in (*keys, "_times", "_single")]).alias("_o"),
    )
    joined = present.join(fresh, [*keys, "_slot", "_open"], "full_outer")
    tables = tickets.select("table_name").unionAll(outcome.select("table_name"))
    newest = loads.select("table_name", F.struct("loaded_by", "file_name").alias("_load"))
    joined = attach(joined, newest, ["table_name"], tables)
    fails = F.coalesce(F.col("_o.failed") > 0, F.lit(False))
    known = F.col("_t").isNotNull()
    action = (
        F.when(fails & known, F.lit("failed")).when(fails, F.lit("created"))
        .when(known & (F.col("_o.checked") > 0), F.lit("verified"))
        .when(known & F.col("_o").isNotNull(), F.lit("empty"))
    )
    judged = joined.withColumn("action", action).where(known | (F.col("action") == "created"))
    acts = F.col("action")

    def either(created: Column, updated: Column, kept: Column) -> Column:
        return F.when(acts == "created", created).when(acts == "failed", updated).otherwise(kept)

    old, new = F.col("_t"), F.col("_o")
    closes = acts == "verified"
    title = F.coalesce(F.when(new["title"] != "", new["title"]), F.concat(F.lit("Rule #"), F.col("rule_id").cast("string")))
    resumed = F.when(old["status"] == "to_verify", F.lit("in_progress")).otherwise(old["status"])
    values = {
        "rule_version": either(new["rule_version"], new["rule_version"], old["rule_version"]),
        "title": either(title, old["title"], old["title"]),
        "severity": either(new["severity"], old["severity"], old["severity"]),
        "status": F.when(closes, F.lit("closed")).otherwise(either(F.lit("new"), resumed, old["status"])),
        "reporter": either(new["actor"], old["reporter"], old["reporter"]),
        "assignee": either(new["actor"], old["assignee"], old["assignee"]),
        "imported_by": either(F.col("_load.loaded_by"), old["imported_by"], old["imported_by"]),
        "source_file": either(F.col("_load.file_name"), old["source_file"], old["source_file"]),
        "created_at": either(new["occurred_at"], old["created_at"], old["created_at"]),
        "last_seen": either(new["occurred_at"], new["occurred_at"], old["last_seen"]),
        "due_at": either(due_at(new["occurred_at"], new["severity"]), old["due_at"], old["due_at"]),
        "closed_at": F.when(closes, new["occurred_at"]).otherwise(old["closed_at"]),
        "failed_count": F.when(closes, F.lit(0)).otherwise(either(new["failed"], new["failed"], old["failed_count"])),
        "latest_run_id": F.when(closes, new["run_id"]).otherwise(either(new["run_id"], new["run_id"], old["latest_run_id"])),
        "failure_run_id": either(new["run_id"], new["run_id"], old["failure_run_id"]),
    }
    return judged.select(
        *[
            (column(n) if n in keys else values[n] if n in values else old[n])
            .cast(tickets.schema[n].dataType).alias(n)
            for n in tickets.columns
        ],
        "action",
    )


def _segments(outcomes: DataFrame, bucket: Column | None) -> DataFrame:
    """What each stretch of outcomes between two closing ones says: rule_id, table_name, ordinal and the outcomes that matter.

    A clean outcome with rows closes whatever ticket is open, so the closing outcomes before an outcome say which ticket it
    belongs to. Of a stretch only its first and last failure, its closing outcome, and its last word are needed.
    """
    keys = ["rule_id", "table_name"]
    closing = (F.col("failed") <= 0) & (F.col("checked") > 0)
    marked = running(
        outcomes.withColumn("_closing", F.coalesce(closing, F.lit(False)).cast("int")), keys, ["occurred_at", "run_id"],
        F.date_trunc("day", "occurred_at") if bucket is None else bucket, F.col("_closing"), "sum", "ordinal",
    )
    fails, closes = F.coalesce(F.col("failed") > 0, F.lit(False)), F.col("_closing") == 1
    order = F.struct("occurred_at", "run_id")
    line = F.struct("occurred_at", "run_id", "rule_version", "title", "severity", "actor", "failed")
    return marked.groupBy(*keys, "ordinal").agg(
        F.min_by(F.when(fails, line), F.when(fails, order)).alias("_first"), F.max_by(F.when(fails, line), F.when(fails, order)).alias("_last"),
        F.max(F.when(closes, order)).alias("_closed"), F.max(order).alias("_word"),
        F.max(F.when(fails, order)).alias("_last_fail"), F.count_if(fails).alias("_fails"),
    )


def apply_runs(tickets: DataFrame, outcomes: DataFrame, loads: DataFrame, bucket: Column | None = None) -> DataFrame:
    """All tickets after a batch of runs, taken in their order; ``action`` is the last one of a ticket.

    Each rule's outcomes count oldest first (occurred_at, then run_id). The plan is the same for any batch: outcomes are folded into
    one row per ticket they concern, the first of which meets the ticket that is open. ``bucket`` rises with the time and splits the
    running count of closing outcomes (default: the day), so a rule may own most of the batch. Settled tickets are passed on as they are.
    """
    keys = ["rule_id", "table_name"]
    outcomes = outcomes.withColumns({key: column(key).cast(tickets.schema[key].dataType) for key in keys})
    opened = F.coalesce(is_open(F.col("status")), F.lit(False))
    settled = tickets.where(~opened).withColumn("action", F.lit(None).cast("string"))
    rest = [n for n in tickets.columns if n not in keys]
    present = tickets.where(opened).select(*keys, F.lit(0).cast("bigint").alias("ordinal"), F.struct(*map(column, rest)).alias("_t"))
    segments = _segments(outcomes, bucket).withColumn("ordinal", F.col("ordinal").cast("bigint"))
    joined = present.join(segments, [*keys, "ordinal"], "full_outer")
    newest = loads.select("table_name", F.struct("loaded_by", "file_name").alias("_load"))
    joined = attach(joined, newest, ["table_name"])

    old, first, last = F.col("_t"), F.col("_first"), F.col("_last")
    known, failed = old.isNotNull(), first.isNotNull()
    # A closing outcome ends its stretch, so it finds the ticket that was open or that a failure before it opened.
    closed = F.col("_closed").isNotNull()
    judged = joined.where(known | failed)
    action = (
        F.when(closed, F.lit("verified"))
        .when(failed & (F.col("_word") == F.col("_last_fail")), F.when(~known & (F.col("_fails") == 1), F.lit("created")).otherwise(F.lit("failed")))
        .when(F.col("_word").isNotNull(), F.lit("empty"))
    )
    title = F.coalesce(F.when(first["title"] != "", first["title"]), F.concat(F.lit("Rule #"), F.col("rule_id").cast("string")))
    resumed = F.when(failed & (old["status"] == "to_verify"), F.lit("in_progress")).otherwise(old["status"])

    def begun(kept: str, made: Column) -> Column:
        return F.when(known, old[kept]).otherwise(made)

    def latest(kept: str, said: Column) -> Column:
        return F.when(failed, said).otherwise(old[kept])

    values = {
        "rule_version": latest("rule_version", last["rule_version"]),
        "title": begun("title", title), "severity": begun("severity", first["severity"]),
        "status": F.when(closed, F.lit("closed")).when(known, resumed).otherwise(F.lit("new")),
        "reporter": begun("reporter", first["actor"]), "assignee": begun("assignee", first["actor"]),
        "imported_by": begun("imported_by", F.col("_load.loaded_by")), "source_file": begun("source_file", F.col("_load.file_name")),
        "created_at": begun("created_at", first["occurred_at"]), "last_seen": latest("last_seen", last["occurred_at"]),
        "due_at": begun("due_at", due_at(first["occurred_at"], first["severity"])),
        "closed_at": F.when(closed, F.col("_closed.occurred_at")).otherwise(old["closed_at"]),
        "failed_count": F.when(closed, F.lit(0)).otherwise(latest("failed_count", last["failed"])),
        "latest_run_id": F.when(closed, F.col("_closed.run_id")).otherwise(latest("latest_run_id", last["run_id"])),
        "failure_run_id": latest("failure_run_id", last["run_id"]),
    }
    moved = judged.select(
        *[(column(n) if n in keys else values[n] if n in values else old[n]).cast(tickets.schema[n].dataType).alias(n) for n in tickets.columns],
        action.alias("action"))
    return moved.unionByName(settled)


def number_new(applied: DataFrame, reserve: Callable[[int, int], int] | None = None) -> DataFrame:
    """Give new tickets numbers above the highest one.

    ``reserve`` (see ``TableStore.reserve``) sets numbers aside, so that none is used again after its ticket is gone.
    """
    from assayline.operators.loading import number_rows, with_ids

    if reserve is None:
        return with_ids(applied, 0, "ticket_id")
    named = applied.where("ticket_id IS NOT NULL")
    fresh = cut_lineage(applied.where("ticket_id IS NULL").drop("ticket_id"))
    last = reserve(fresh.count(), named.agg(F.max("ticket_id")).first()[0] or 0)
    return named.unionByName(number_rows(fresh, "ticket_id", last).select(*map(column, applied.columns)))


def events(applied: DataFrame, outcome: DataFrame) -> DataFrame:
    """Log lines of a run: the count that failed or was checked, per touched ticket."""
    facts = outcome.select("rule_id", "table_name", "actor", "run_id", "occurred_at", "failed", "checked")
    touched = applied.where("action IS NOT NULL").join(facts, ["rule_id", "table_name"])
    detail = (
        F.when(F.col("action").isin("created", "failed"), F.col("failed").cast("string"))
        .when(F.col("action") == "verified", F.col("checked").cast("string")).otherwise(F.lit("0"))
    )
    return touched.select(
        "ticket_id", "rule_id", "table_name", F.col("occurred_at").alias("created_at"), "actor",
        F.col("action").alias("kind"), detail.alias("detail"), "run_id",
    )


def replay(results: DataFrame, bucket: Column | None = None) -> DataFrame:
    """All tickets a whole history of results gives rise to, in one pass over the history.

    ``results``: rule_id, table_name, result_id, occurred_at, failed, checked, severity, run_id,
    rule_version. A clean run with rows closes whatever ticket is open, so the number of
    closing results before a result says which ticket (``ordinal``) it belongs to. Results
    of one ordinal are then combined by an aggregate. ``bucket`` (default: the hour) splits
    the running count, see ``running``.
    """
    closing = ((F.col("failed") == 0) & (F.col("checked") > 0)).cast("int")
    marked = running(
        results.withColumn("_closing", closing), ["rule_id", "table_name"], ["occurred_at", "result_id"],
        F.date_trunc("hour", "occurred_at") if bucket is None else bucket, F.col("_closing"), "sum", "ordinal",
    )
    fails = F.col("failed") > 0
    order = F.struct("occurred_at", "result_id")
    grouped = marked.groupBy("rule_id", "table_name", "ordinal").agg(
        F.count_if(fails).alias("failures"),
        F.min(F.when(fails, F.col("occurred_at"))).alias("created_at"),
        F.max(F.when(fails, F.col("occurred_at"))).alias("last_seen"),
        F.min_by(F.when(fails, F.col("severity")), F.when(fails, order)).alias("severity"),
        F.max_by(F.when(fails, F.struct("run_id", "rule_version", "failed")), F.when(fails, order)).alias("_last"),
        F.max(F.when(F.col("_closing") == 1, F.col("occurred_at"))).alias("closed_at"),
        F.max_by("run_id", order).alias("_any_run"),
        F.max_by(F.when(F.col("checked") > 0, F.col("run_id")), F.when(F.col("checked") > 0, order)).alias("latest_run_id"),
    )
    return grouped.where("failures > 0").select(
        "rule_id", "table_name", "ordinal", "severity",
        F.when(F.col("closed_at").isNull(), F.lit("new")).otherwise(F.lit("closed")).alias("status"),
        "created_at", "last_seen", due_at(F.col("created_at"), F.col("severity")).alias("due_at"), "closed_at",
        F.col("_last.rule_version").alias("rule_version"),
        F.when(F.col("closed_at").isNull(), F.col("_last.failed")).otherwise(F.lit(0)).cast("bigint").alias("failed_count"),
        "latest_run_id", F.col("_last.run_id").alias("failure_run_id"), "failures",
    )


def overdue(now: Column) -> Column:
    return is_open(F.col("status")) & (F.col("due_at") < now)


def ticket_list(tickets: DataFrame, now: datetime | Column) -> DataFrame:
    """Tickets with an overdue mark: open ones first, then by due time."""
    moment = now if isinstance(now, Column) else F.lit(now)
    return tickets.withColumn("overdue", overdue(moment)).orderBy(~is_open(F.col("status")), "due_at", "ticket_id")


def scope_counts(tickets: DataFrame, user: str, now: datetime | Column) -> DataFrame:
    """How many tickets each list scope shows, and how many of all are overdue: one scan."""
    moment = now if isinstance(now, Column) else F.lit(now)
    opened = is_open(F.col("status"))
    return tickets.agg(
        F.count_if(opened).alias("open_tickets"), F.count(F.lit(1)).alias("all_tickets"),
        F.count_if(opened & (F.col("assignee") == user)).alias("mine"), F.count_if(overdue(moment)).alias("overdue"),
    )


def in_scope(tickets: DataFrame, scope: str, user: str, now: datetime) -> DataFrame:
    """Rows of one scope: open, all, mine or overdue."""
    opened = is_open(F.col("status"))
    tests = {
        "open": opened, "all": F.lit(True), "mine": opened & (F.col("assignee") == user), "overdue": overdue(F.lit(now)),
    }
    return tickets.where(tests[scope])


def ticket_failures(tickets: DataFrame, evidence: DataFrame, ticket_id, limit: int = FAILURE_ROWS) -> DataFrame:
    """Failing records of the run that last failed a ticket, at most ``limit`` of them."""
    wanted = tickets.where(F.col("ticket_id") == ticket_id).select(F.col("failure_run_id").alias("run_id"), "rule_id")
    failed = evidence.where("test_result = 1").join(F.broadcast(wanted), ["run_id", "rule_id"], "left_semi")  # one ticket
    return failed.select("record_id", "field_name", "field_value", "error_message").orderBy("record_id").limit(limit)


def open_failures(tickets: DataFrame, evidence: DataFrame) -> DataFrame:
    """Failing records of the run that last failed each open ticket: what is left to repair, over all tickets.

    Evidence is the large side and may hold one rule's records for the most part; the tickets' keys are attached to it.
    """
    wanted = tickets.where(is_open(F.col("status"))).groupBy(F.col("failure_run_id").alias("run_id"), "rule_id").agg(F.max("ticket_id").alias("ticket_id"))
    failed = evidence.where("test_result = 1").withColumns({key: column(key).cast(wanted.schema[key].dataType) for key in ("run_id", "rule_id")})
    found = attach(failed, wanted, ["run_id", "rule_id"], row_id=["record_id", "field_name"])
    return found.where("ticket_id IS NOT NULL").select("ticket_id", "rule_id", "record_id", "field_name", "field_value", "error_message")


def ticket_history(log: DataFrame, ticket_id) -> DataFrame:
    return log.where(F.col("ticket_id") == ticket_id).orderBy("created_at")
