"""The rule library: versions, latest results of the current version, search, publication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from assayline.functions.text import column, percent_text
from assayline.operators.reports import latest_results
from assayline.operators.skew import attach, latest_by
from assayline.operators.suite import kpi

DASH = "—"
DRAFT, PENDING, PUBLISHED = "Draft", "Pending publication", "Published"


def description_asof_version(results: DataFrame, history: DataFrame, rules: DataFrame) -> DataFrame:
    """Description each result had: newest archived one of its version, else current, else ''."""
    archived = (
        history.groupBy("rule_id", F.col("version").alias("rule_version"))
        .agg(F.max_by("description", "history_id").alias("_archived"))
    )
    current = rules.select("rule_id", F.struct("description").alias("_current"))
    joined = attach(attach(results, archived, ["rule_id", "rule_version"]), current, ["rule_id"], results)
    return joined.where("_current IS NOT NULL").select(
        "result_id", F.coalesce("_archived", F.col("_current.description"), F.lit("")).alias("description")
    )


def rules_with_latest(rules: DataFrame, results: DataFrame) -> DataFrame:
    """Each rule with the newest result of its current version and the KPI of that result.

    The version comparison is null-safe: a rule without a version matches results without one.
    """
    newest = latest_results(results).select(
        F.col("rule_id").alias("_rule"), F.col("rule_version").alias("_version"),
        "result_id", "executed_at", "passed", "failed", "run_id",
    )
    joined = rules.join(
        newest, (F.col("rule_id") == F.col("_rule")) & F.col("version").eqNullSafe(F.col("_version")), "left"
    )
    return joined.drop("_rule", "_version").withColumn("kpi", kpi(F.col("passed"), F.col("failed")))


def kpi_label(status: Column, result_id: Column, value: Column) -> Column:
    """What a library list shows in the KPI column."""
    return (
        F.when(status != "ACTIVE", F.lit(DASH))
        .when(result_id.isNull(), F.lit("No results"))
        .when(value.isNull(), F.lit("No checked rows"))
        .otherwise(percent_text(value))
    )


PARAMS = "sql_query string, error_message string, severity string"


def archived_params(params: Column) -> Column:
    """Archived definition; unreadable JSON gives NULL members."""
    return F.from_json(params, PARAMS, {"mode": "PERMISSIVE"})


def rule_versions(rules: DataFrame, history: DataFrame) -> DataFrame:
    """Versions of every rule: the current one, then one row per archived version label.

    ``position`` is 0 for the current version and rises with age. The event time is when a
    version was deactivated, else activated, else created. The labels of one rule are as
    many as its archived versions, so only they are ranked, not the archive rows.
    """
    newest = latest_by(
        history.select("rule_id", "version", "history_id", "description", "rule_params", "created_at", "deactivated_at"),
        ["rule_id", "version"], ["history_id"],
    )
    parsed = newest.withColumn("_p", archived_params(F.col("rule_params")))
    joined = rules.select(
        "rule_id", "version", "status", "description", "sql_query", "severity",
        F.coalesce("activated_at", "created_at").alias("_since"),
    )
    stopped = newest.select("rule_id", "version", F.col("deactivated_at").alias("_stopped"))
    current = joined.join(stopped, ["rule_id", "version"], "left").select(
        "rule_id", "version", F.lit(True).alias("is_current"), F.lit(None).cast("bigint").alias("history_id"), "description",
        F.when(F.col("status") == "INACTIVE", F.coalesce("_stopped", "_since")).otherwise(F.col("_since")).alias("event_time"),
        "sql_query", "severity",
    )
    older = (
        attach(parsed, rules.select("rule_id", F.struct("version").alias("_now")), ["rule_id"])
        .where("_now IS NOT NULL").where(~F.col("version").eqNullSafe(F.col("_now.version")))
        .select(
            "rule_id", "version", F.lit(False).alias("is_current"), "history_id", "description",
            F.coalesce("deactivated_at", "created_at").alias("event_time"),
            F.col("_p.sql_query").alias("sql_query"), F.coalesce("_p.severity", F.lit("medium")).alias("severity"),
        )
    )
    return current.unionByName(older)


def latest_failures(
    rules: DataFrame, results: DataFrame, evidence: DataFrame, rule_id=None, limit: int | None = None
) -> DataFrame:
    """Failing records behind each rule's newest result; a result without a run has none.

    For one rule (as its details page shows it) pass ``rule_id`` and a ``limit``.
    """
    if rule_id is not None:
        rules, results, evidence = (frame.where(F.col("rule_id") == rule_id) for frame in (rules, results, evidence))
    label = F.coalesce(F.col("rule_version"), F.lit("\u0000"))  # a missing version equals a missing version
    newest = rules_with_latest(rules, results).where("run_id IS NOT NULL").select(
        "run_id", "rule_id", F.coalesce("version", F.lit("\u0000")).alias("_label"), F.lit(True).alias("_newest")
    )
    failed = evidence.where("test_result = 1 AND run_id IS NOT NULL").withColumn("_label", label)
    shown = attach(failed, newest, ["run_id", "rule_id", "_label"]).where("_newest").select(
        "rule_id", "record_id", "field_name", "field_value", "error_message"
    )
    return shown if limit is None else shown.orderBy("record_id").limit(limit)


def library_match(text: str = "", table: str | None = None, active: bool | None = None) -> Column:
    """Whether a rule is shown for a search text, a table and a state."""
    shown = F.lit(True)
    if table is not None:
        shown = shown & (F.col("target_table") == table)
    if active is not None:
        shown = shown & ((F.col("status") == "ACTIVE") == F.lit(active))
    if text.strip():
        joined = F.concat_ws(" ", F.col("rule_id").cast("string"), "description", "target_table", "rule_type")
        shown = shown & F.lower(joined).contains(text.strip().lower())
    return F.coalesce(shown, F.lit(False))


def library_filter(rules: DataFrame, text: str = "", table: str | None = None, active: bool | None = None) -> DataFrame:
    return rules.where(library_match(text, table, active))


def library_counts(rules: DataFrame, text: str = "", table: str | None = None, active: bool | None = None) -> DataFrame:
    """Shown, total and active rules for a filter: one row from one scan."""
    return rules.agg(
        F.count_if(library_match(text, table, active)).alias("shown"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ACTIVE").alias("active"),
    )


def publication_state(rules: DataFrame, links: DataFrame, published: DataFrame) -> DataFrame:
    """One row per rule: its environment and whether its definition is published.

    ``rules`` carries ``revision``, the hash of its present definition; ``links`` the last
    published ``base_revision``; ``published`` the stored versions (link_id, revision, ...).
    """
    stored = published.select("link_id", F.col("revision").alias("base_revision"), "local_version")
    linked = links.select("rule_id", "link_id", "base_revision", "profile").join(stored, ["link_id", "base_revision"], "left")
    joined = rules.join(linked, "rule_id", "left")
    remote = (F.col("sql_engine") == "remote") | (F.col("execution_mode") == "remote")
    state = (
        F.when(~remote | F.col("link_id").isNull(), F.lit(DASH))
        .when(F.col("base_revision") == F.col("revision"), F.lit(PUBLISHED))
        .when(F.col("base_revision").isNotNull(), F.lit(PENDING))
        .otherwise(F.lit(DRAFT))
    )
    return joined.select(
        "rule_id", "description",
        F.when(remote, F.lit("remote")).otherwise(F.lit("local")).alias("environment"),
        state.alias("publication_state"),
        F.coalesce(F.when(remote, F.col("profile")), F.lit("")).alias("profile"),
        F.coalesce(F.col("local_version"), F.col("version")).alias("shown_version"),
    )


def definition_changes(rules: DataFrame, versions: DataFrame) -> DataFrame:
    """For each archived version: whether its text differs from the current one, and the lines.

    Lines are compared as sets; the order of ``added`` and ``removed`` is alphabetical.
    """
    now = rules.select("rule_id", F.col("sql_query").alias("_now"))
    joined = attach(versions, now, ["rule_id"])
    old_lines = F.split(F.col("sql_query"), "\n")
    new_lines = F.split(F.coalesce("_now", F.lit("")), "\n")
    kept = [column(name) for name in versions.columns if name != "sql_query"]
    return joined.select(
        *kept,
        (~F.col("sql_query").eqNullSafe(F.coalesce("_now", F.lit("")))).alias("changed"),
        F.array_sort(F.array_except(new_lines, old_lines)).alias("added"),
        F.array_sort(F.array_except(old_lines, new_lines)).alias("removed"),
    )


LINE_CHANGE = "array<struct<kind: string, line: string>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used: it is bound to the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _line(kind: str | Column, line: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), line.alias("line"))


def _every(kind: str, lines: Column) -> Column:
    return F.transform(lines, lambda line: _line(kind, line)).cast(LINE_CHANGE)


def _equal_ahead(one: Column, other: Column) -> Column:
    """How many lines at the beginning are equal."""
    shorter = F.least(F.size(one), F.size(other))
    unequal = F.filter(F.sequence(F.lit(1), shorter), lambda i: F.get(one, i - 1) != F.get(other, i - 1))
    return F.when(shorter == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(unequal, F.lit(1)) - 1, shorter))


def _edited(a: Column, b: Column) -> Column:
    """The lines of two lists whose first and last lines differ, by a longest common subsequence."""
    n, m = F.size(a), F.size(b)

    def row(i: Column, below: Column) -> Column:
        # Common lengths of a from i on and b from each line on, from the last line back.
        return F.aggregate(
            F.sequence(m, F.lit(1)), F.array(F.lit(0)),
            lambda found, j: F.concat(F.array(
                F.when(F.get(a, i - 1) == F.get(b, j - 1), F.get(below, j) + 1).otherwise(F.greatest(F.get(below, j - 1), F.get(found, F.lit(0))))), found))

    table = F.aggregate(
        F.sequence(n, F.lit(1)), F.array(F.array_repeat(F.lit(0), m + 1)), lambda rows, i: F.concat(F.array(row(i, F.get(rows, F.lit(0)))), rows))

    def step(state: Column, rows: Column) -> Column:
        i, j = state["i"], state["j"]
        # What happens to the next line: both texts have it, it is removed, it is added; or both are at their end.
        move = (
            F.when((i >= n) & (j >= m), F.lit("")).when((i < n) & (j < m) & (F.get(a, i) == F.get(b, j)), F.lit("kept"))
            .when((i < n) & ((j >= m) | (F.get(F.get(rows, i + 1), j) >= F.get(F.get(rows, i), j + 1))), F.lit("removed")).otherwise(F.lit("added")))
        return _bound(move, lambda kind: F.struct(
            (i + kind.isin("kept", "removed").cast("int")).alias("i"), (j + kind.isin("kept", "added").cast("int")).alias("j"),
            F.when(kind == "", state["out"]).otherwise(F.concat(state["out"], F.array(
                _line(kind, F.when(kind == "added", F.get(b, j)).otherwise(F.get(a, i)))).cast(LINE_CHANGE))).alias("out")))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.array().cast(LINE_CHANGE).alias("out"))
    return _bound(table, lambda rows: F.aggregate(F.sequence(F.lit(1), n + m), start, lambda state, _: step(state, rows), lambda state: state["out"]))


def line_diff(old: Column, new: Column) -> Column:
    """The lines of two texts in order, each ``kept``, ``removed`` or ``added``: a longest common subsequence, removals first.

    ``LINE_CHANGE``. The table of common lengths is built row by row from the end, then followed from the
    beginning. Equal lines at either end of the texts are set aside first, so that the table holds what was edited; its size is the product
    of the edited lines. A null text has no lines.
    """
    def lines(text: Column) -> Column:
        return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))

    def without_head(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return _bound(_equal_ahead(a, b), lambda head: _bound(
            F.struct(F.slice(a, head + 1, F.size(a) - head).alias("a"), F.slice(b, head + 1, F.size(b) - head).alias("b")),
            lambda rest: F.concat(_every("kept", F.slice(a, F.lit(1), head)), without_tail(rest))))

    def without_tail(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return _bound(F.struct(F.reverse(a).alias("a"), F.reverse(b).alias("b")), lambda back: _bound(_equal_ahead(back["a"], back["b"]), lambda tail: _bound(
            F.struct(F.slice(a, F.lit(1), F.size(a) - tail).alias("a"), F.slice(b, F.lit(1), F.size(b) - tail).alias("b")),
            lambda middle: F.concat(between(middle), _every("kept", F.slice(a, F.size(a) - tail + 1, tail))))))

    def between(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return F.when(F.size(a) == 0, _every("added", b)).when(F.size(b) == 0, _every("removed", a)).otherwise(_edited(a, b))

    return _bound(F.struct(lines(old).alias("a"), lines(new).alias("b")), without_head)


def definition_diff(rules: DataFrame, versions: DataFrame) -> DataFrame:
    """For each archived version the lines from its text to the current one, in order (``changes``), and how many were added and removed."""
    now = rules.select("rule_id", F.col("sql_query").alias("_now"))
    joined = attach(versions, now, ["rule_id"]).withColumn("changes", line_diff(F.col("sql_query"), F.coalesce("_now", F.lit(""))))
    kept = [column(name) for name in versions.columns if name != "sql_query"]

    def how_many(name: str) -> Column:
        return F.size(F.filter("changes", lambda change: change["kind"] == name))

    return joined.select(*kept, "changes", how_many("added").alias("added"), how_many("removed").alias("removed"))
