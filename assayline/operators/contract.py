"""What a rule query must return: id, the tested field, dq_check (0 pass, 1 fail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayline.errors import ContractError
from assayline.functions.text import column

FLAG = "dq_check"


def output_field(schema: T.StructType, *, strict: bool = True, exact: bool = False) -> str:
    """Name of the tested field, or a ContractError saying what is wrong with the columns.

    ``strict`` demands an integer flag, as scheduled jobs do. Otherwise any number or
    boolean equal to 0 or 1 is fine. ``exact`` allows the three contract columns only.
    """
    names = [field.name for field in schema]
    wanted = "Return id, the tested field second, and dq_check (0 = pass, 1 = fail)"
    if len(names) < 3 or names[0] != "id" or FLAG not in names:
        raise ContractError(wanted)
    if names[1] in ("id", FLAG) or len(set(names)) < len(names):
        raise ContractError(wanted + ", each name once")
    if exact and len(names) != 3:
        raise ContractError(wanted + " and nothing else")
    kind = schema[FLAG].dataType
    allowed = (T.IntegralType,) if strict else (T.NumericType, T.BooleanType)
    if not isinstance(kind, allowed):
        raise ContractError(f"dq_check must be a whole number, not {kind.simpleString()}")
    return names[1]


def bad_flag(flag_column: Column) -> Column:
    return flag_column.isNull() | ~flag_column.isin(0, 1)


def bad_id(id_column: Column) -> Column:
    text = id_column.cast("string")
    return text.isNull() | (text == "")


def total_columns() -> list[Column]:
    """Aggregates over a rule output: checked, failed and the two kinds of contract violation."""
    value = column(FLAG)
    return [
        F.count(F.lit(1)).alias("checked"), F.count_if(value == 1).alias("failed"), F.count_if(bad_flag(value)).alias("bad_flags"),
        F.count_if(bad_id(column("id"))).alias("bad_ids"),
    ]


def totals(output: DataFrame) -> DataFrame:
    """One row of ``total_columns``, in one pass."""
    return output.agg(*total_columns())


def check_totals(row) -> tuple[int, int]:
    """(passed, failed) of a collected ``totals`` row, or a ContractError."""
    if row["bad_flags"]:
        raise ContractError(f"{row['bad_flags']} rows have a dq_check other than 0 or 1")
    if row["bad_ids"]:
        raise ContractError(f"{row['bad_ids']} rows have an empty id")
    return row["checked"] - row["failed"], row["failed"]


def violations(output: DataFrame) -> DataFrame:
    """The rows of a rule output that break the contract, with ``reason``: what to look for when ``check_totals`` refuses a rule.

    A row with an empty id and a wrong flag is listed for its id. One pass, no shuffle.
    """
    reason = F.when(bad_id(column("id")), F.lit("empty id")).when(
        bad_flag(column(FLAG)), F.concat(F.lit("dq_check is "), F.coalesce(column(FLAG).cast("string"), F.lit("missing"))))
    field = output_field(output.schema, strict=False)
    return output.select(
        column("id").cast("string").alias("record_id"), column(field).cast("string").alias("field_value"), reason.alias("reason")
    ).where("reason IS NOT NULL")
