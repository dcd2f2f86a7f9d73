"""Evaluate one rule query over named datasets, under the output contract."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from assayline.errors import AccessError, ContractError, PreviewTooLarge
from assayline.functions.text import column
from assayline.operators import contract
from assayline.operators.plan_facts import PlanFacts, read_plan

PREVIEW_ROWS = 500
DEFAULT_MESSAGE = "The record did not pass this check"


@contextmanager
def private_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> Iterator[dict[str, str]]:
    """The declared name behind each view that this analysis alone can see.

    A query gets its datasets as named subqueries over these, so neither the caller's views nor those of a query
    analysed at the same time are touched, and a plan tells a declared dataset from anything of the same name.
    """
    declared = {}
    try:
        for name, frame in views.items():
            private = f"_dq_{uuid.uuid4().hex}"
            frame.createOrReplaceTempView(private)
            declared[private] = name
        yield declared
    finally:
        for private in declared:
            spark.catalog.dropTempView(private)


def bound_text(text: str, declared: Mapping[str, str], alias: str = "checked_rows") -> str:
    """The query in subquery position, where Spark accepts queries only, with its datasets by name."""
    names = ", ".join(f"{quoted(name)} AS (TABLE {private})" for private, name in declared.items())
    text = text.strip()
    text = text[:-1] if text.endswith(";") else text
    prefix = f"WITH {names} " if names else ""
    return f"{prefix}SELECT * FROM (\n{text}\n) AS {alias}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def select(spark: SparkSession, sql: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """A query the caller wrote itself, over named frames; rule texts go through ``analyse``."""
    with private_views(spark, views) as declared:
        return spark.sql(bound_text(sql, declared))


def analyse(
    spark: SparkSession, sql: str, views: Mapping[str, DataFrame], *, declared_only: bool = False
) -> tuple[DataFrame, PlanFacts]:
    """The query as a DataFrame, refused unless it only reads the given datasets.

    With ``declared_only`` every given dataset must also be read.
    """
    if not sql.strip().rstrip(";").strip():
        raise AccessError("The rule has no text.")
    with private_views(spark, views) as declared:
        try:
            frame = spark.sql(bound_text(sql, declared))
        except ParseException as error:
            raise AccessError(f"Use one SELECT query: {_first_line(error)}") from error
        except AnalysisException as error:
            raise AccessError(_first_line(error)) from error
        facts = read_plan(frame)
    other = sorted(facts.datasets - set(declared))
    if facts.foreign or other:
        raise AccessError(f"Only the declared datasets may be read: {facts.foreign or other}")
    if facts.refused:
        raise AccessError(f"Function not allowed in a rule: {facts.refused[0]}")
    facts.datasets = {declared[name] for name in facts.datasets}
    facts.columns = {declared[name]: columns for name, columns in facts.columns.items()}
    if declared_only and facts.datasets != set(views):
        raise AccessError(f"Declared but not read: {sorted(set(views) - facts.datasets)}")
    return frame, facts


def _first_line(error: Exception) -> str:
    return str(error).strip().splitlines()[0]


@dataclass
class RuleOutput:
    """A rule's plan: the tested field, the output rows and the datasets it reads."""

    field: str
    frame: DataFrame
    facts: PlanFacts


def evaluate(
    spark: SparkSession,
    sql: str,
    views: Mapping[str, DataFrame],
    *,
    strict: bool = True,
    exact: bool = False,
    declared_only: bool = False,
) -> RuleOutput:
    """Analyse a rule and check its columns; nothing runs yet."""
    frame, facts = analyse(spark, sql, views, declared_only=declared_only)
    field = contract.output_field(frame.schema, strict=strict, exact=exact)
    if not strict:
        frame = frame.withColumn("dq_check", _whole_flag())
    return RuleOutput(field, frame, facts)


def _whole_flag() -> Column:
    """0 or 1 of any number type; anything else becomes 2, which the contract refuses."""
    number = column("dq_check").cast("double")
    return F.when(number == 0, 0).when(number == 1, 1).when(number.isNotNull(), 2)


def validate(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], *, full: bool = False, **options) -> str:
    """Dry run: the tested field of an acceptable rule. ``full`` also checks every value."""
    output = evaluate(spark, sql, views, **options)
    if full:
        contract.check_totals(contract.totals(output.frame).first())
    return output.field


def rule_message(message: str | None) -> str:
    """Plain message text; older rules kept it as a JSON string."""
    try:
        decoded = json.loads(message or '""')
    except ValueError:
        decoded = None
    if isinstance(decoded, str):
        return decoded
    return message or DEFAULT_MESSAGE


def message_column(message: Column) -> Column:
    """The same decoding for a column of messages."""
    quoted = F.trim(message).rlike(r'^"([^"\\]|\\.)*"$')
    wrapped = F.concat(F.lit('{"m":'), F.trim(message), F.lit("}"))
    decoded = F.get_json_object(wrapped, "$.m")
    return (
        F.when(message.isNull() | (message == ""), F.lit(""))
        .when(quoted, F.coalesce(decoded, message))
        .otherwise(message)
    )


def evidence(output: DataFrame, field: str, message: str | Column, *, failures_only: bool = False) -> DataFrame:
    """Stored evidence of a rule: id and value as text, a message on failures only."""
    text = F.lit(rule_message(message)) if isinstance(message, str) else message
    frame = output.where("dq_check = 1") if failures_only else output
    return frame.select(
        column("id").cast("string").alias("record_id"),
        F.lit(field).alias("field_name"),
        column(field).cast("string").alias("field_value"),
        column("dq_check").cast("int").alias("test_result"),
        F.when(column("dq_check") == 1, text).otherwise(F.lit("")).alias("error_message"),
    )


def failures(output: DataFrame, field: str, message: str | Column) -> DataFrame:
    return evidence(output, field, message, failures_only=True)


def counts(output: DataFrame) -> DataFrame:
    """Pass and fail counts of a rule output."""
    return contract.totals(output).select(
        (F.col("checked") - F.col("failed")).alias("passed"), F.col("failed")
    )


@dataclass
class Preview:
    columns: list[str]
    rows: list[Row]
    truncated: bool
    seconds: float


def preview(
    spark: SparkSession,
    sql: str,
    views: Mapping[str, DataFrame],
    *,
    limit: int = PREVIEW_ROWS,
    timeout: float | None = None,
) -> Preview:
    """The first rows of any allowed query. One row more is fetched to know if rows were cut.

    With ``timeout`` the Spark job of the preview is cancelled after that many seconds.
    """
    frame, _ = analyse(spark, sql, views)
    started = time.monotonic()
    fetched = _bounded(frame.limit(limit + 1), timeout)
    return Preview(frame.columns, fetched[:limit], len(fetched) > limit, time.monotonic() - started)


def _bounded(frame: DataFrame, timeout: float | None) -> list[Row]:
    """Collect a limited frame, cancelling its Spark jobs after ``timeout`` seconds."""
    if timeout is None:
        return frame.collect()
    context = frame.sparkSession.sparkContext
    group = f"preview-{uuid.uuid4().hex}"
    context.setJobGroup(group, "bounded preview", interruptOnCancel=True)
    timer = threading.Timer(timeout, context.cancelJobGroup, [group])
    timer.start()
    try:
        return frame.collect()
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def preview_rule(
    spark: SparkSession, sql: str, views: Mapping[str, DataFrame], *, limit: int = PREVIEW_ROWS, **options
) -> list[Row]:
    """Rows of a rule that must be small and must follow the contract."""
    output = evaluate(spark, sql, views, **options)
    fetched = output.frame.limit(limit + 1).collect()
    if len(fetched) > limit:
        raise PreviewTooLarge(f"The query returns more than {limit} rows; add a LIMIT.")
    for row in fetched:
        if row["dq_check"] not in (0, 1):
            raise ContractError("dq_check must be 0 or 1")
        if row["id"] is None or str(row["id"]) == "":
            raise ContractError("A record id cannot be empty")
    return fetched


def first_rows(frame: DataFrame, order: list[str], limit: int = PREVIEW_ROWS) -> DataFrame:
    """A bounded, ordered page with a mark that says whether rows were left out.

    Sorting with a limit keeps ``limit + 1`` rows per task, so the page stays small at any
    input size; the mark is computed on those rows only.
    """
    page = frame.orderBy(*order).limit(limit + 1)
    keyed = F.struct(*map(column, order), F.struct(*map(column, frame.columns)).alias("_row"))
    packed = page.agg(F.array_sort(F.collect_list(keyed)).alias("_rows"))
    kept = packed.select(
        F.explode(F.slice("_rows", 1, limit)).alias("_item"), (F.size("_rows") > limit).alias("truncated")
    )
    return kept.select(*[F.col("_item._row")[name].alias(name) for name in frame.columns], "truncated")
