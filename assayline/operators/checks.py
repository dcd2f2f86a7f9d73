"""Check specifications: one pass condition per record, ready to be fused into one scan.

A check is a condition over columns. Checks that compare a record with other records
(uniqueness, cross-table) first attach a small per-key fact to every record; the
condition then only reads that fact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field as dataclass_field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayline.functions.text import column, folded, regex_matches
from assayline.operators.crossref import CrossReference
from assayline.operators.skew import attach

# (frame so far, name of the fact column, the untouched table) -> frame with the fact
Prepare = Callable[[DataFrame, str, DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Check:
    """One rule: the tested field, when a record passes, and what to report when it fails."""

    field: str
    passes: Callable[[DataFrame, str], Column]
    prepare: Prepare | None = None
    rule_id: int | str = 0
    version: str = "1.0"
    description: str = ""
    message: str = ""
    severity: str = "medium"
    rule_type: str = ""
    requires: tuple[str, ...] = dataclass_field(default=())
    # Where the number of failing records follows from counts per key: table -> one row with ``failed``, without looking records up.
    tally: Callable[[DataFrame], DataFrame] | None = None

    def named(self, rule_id, description, message="", **more) -> Check:
        return replace(self, rule_id=rule_id, description=description, message=message, **more)


def rows(frame: DataFrame, check: Check, key: str = "id") -> DataFrame:
    """The rule output of one check: id, tested field, dq_check."""
    prepared = frame if check.prepare is None else check.prepare(frame, "_fact", frame, key)
    return prepared.select(
        column(key).alias("id"), column(check.field), failed(check, prepared, "_fact").alias("dq_check")
    )


def failed(check: Check, prepared: DataFrame, fact: str) -> Column:
    """1 where the condition is false or unknown, 0 where it holds."""
    return F.when(check.passes(prepared, fact), F.lit(0)).otherwise(F.lit(1))


def condition(field: str, test: Callable[[Column], Column] | Column | str, **named) -> Check:
    """Any condition: a column, a SQL expression, or a function of the tested column."""
    def passes(frame: DataFrame, fact: str) -> Column:
        if isinstance(test, str):
            return F.expr(test)
        return test if isinstance(test, Column) else test(column(field))

    return Check(field, passes, **named)


def required(field: str, **named) -> Check:
    return condition(field, lambda value: F.length(F.trim(value.cast("string"))) > 0, rule_type="completeness", **named)


def not_null(field: str, **named) -> Check:
    return condition(field, lambda value: value.isNotNull(), rule_type="completeness", **named)


def like(field: str, pattern: str, ignore_case: bool = False, **named) -> Check:
    return condition(
        field, lambda value: value.ilike(pattern) if ignore_case else value.like(pattern),
        rule_type="format", **named,
    )


def regex(field: str, pattern: str, options: str = "", **named) -> Check:
    return condition(field, lambda value: regex_matches(value, pattern, options), rule_type="format", **named)


def between(field: str, low, high, **named) -> Check:
    return condition(field, lambda value: value.between(low, high), rule_type="range", **named)


def positive(field: str, **named) -> Check:
    """A number above zero; a text column passes only where it holds such a number."""
    def passes(frame: DataFrame, fact: str) -> Column:
        kind = frame.schema[field].dataType
        value = column(field)
        if isinstance(kind, T.NumericType):
            return value > 0
        if isinstance(kind, T.StringType):
            number = value.try_cast("double")
            return (number > 0) & ~F.isnan(number)
        return F.lit(False)

    return Check(field, passes, rule_type="range", **named)


COMPARISONS = {
    "<": lambda value, limit: value < limit,
    "<=": lambda value, limit: value <= limit,
    ">": lambda value, limit: value > limit,
    ">=": lambda value, limit: value >= limit,
    "=": lambda value, limit: value == limit,
    "<>": lambda value, limit: value != limit,
}


def threshold(field: str, operator: str, limit, **named) -> Check:
    """Compare with a literal or with another column."""
    return condition(field, lambda value: COMPARISONS[operator](value, limit), rule_type="range", **named)


def date_text(field: str, **named) -> Check:
    """Text of exactly ten characters that is a real calendar date."""
    return condition(
        field,
        lambda value: (F.length(value) == 10)
        & (F.date_format(F.try_to_date(value, "yyyy-MM-dd"), "yyyy-MM-dd") == value),
        rule_type="validity", **named,
    )


def unique(*fields: str, ignore_case: bool = True, **named) -> Check:
    """Present and unique, over one column or several.

    Keys are counted with a combining aggregate, and only the repeated keys are looked up
    again: a value shared by a third of the table is one row on the lookup side, and its
    records stay spread over all tasks.
    """
    def comparable(frame: DataFrame, name: str) -> Column:
        is_text = isinstance(frame.schema[name].dataType, T.StringType)
        return folded(column(name)) if is_text and ignore_case else column(name)

    def present(frame: DataFrame) -> Column:
        found = F.lit(True)
        for name in fields:
            found = found & column(name).isNotNull()
            if isinstance(frame.schema[name].dataType, T.StringType):
                found = found & (F.trim(column(name)) != "")
        return found

    def prepare(frame: DataFrame, fact: str, table: DataFrame, key: str) -> DataFrame:
        keys = [f"{fact}_k{i}" for i in range(len(fields))]
        made = [F.when(present(table), comparable(table, name)).alias(key) for name, key in zip(fields, keys)]
        keyed, source = frame.select("*", *made), table.select(*made)
        repeated = (
            source.dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .where("_n > 1").select(*keys, F.lit(True).alias(fact))
        )
        return attach(keyed, repeated, keys, source, [key]).drop(*keys)

    def passes(frame: DataFrame, fact: str) -> Column:
        return present(frame) & column(fact).isNull()

    def tally(table: DataFrame) -> DataFrame:
        # Long texts travel as their SHA-256; records without a key are one group of their own.
        made = []
        for i, name in enumerate(fields):
            value = comparable(table, name)
            text = isinstance(table.schema[name].dataType, T.StringType)
            made.append(F.when(present(table), F.when(F.octet_length(value) > 64, F.sha2(value, 256)).otherwise(value) if text else value).alias(f"_k{i}"))
        per_key = table.select(*made).groupBy(*[f"_k{i}" for i in range(len(fields))]).agg(F.count(F.lit(1)).alias("_n"))
        return per_key.agg(F.coalesce(F.sum(F.when(F.col("_k0").isNull() | (F.col("_n") > 1), F.col("_n"))), F.lit(0)).alias("failed"))

    return Check(fields[0], passes, prepare, rule_type="uniqueness", requires=tuple(fields), tally=tally, **named)


def cross_reference(spec: CrossReference, reference: DataFrame, **named) -> Check:
    """Existence or absence of the record's values in a reference table.

    The reference is reduced to distinct keys first, so repeated reference rows never
    multiply records.
    """
    def prepare(frame: DataFrame, fact: str, table: DataFrame, key: str) -> DataFrame:
        keys = [f"{fact}_k{i}" for i in range(len(spec.pairs))]
        made = [value.alias(key) for value, key in zip(spec.row_keys(), keys)]
        known = spec.reference_keys(reference, keys, fact)
        return attach(frame.select("*", *made), known, keys, table.select(*made), [key]).drop(*keys)

    def passes(frame: DataFrame, fact: str) -> Column:
        return spec.passes(column(fact))

    tested: Sequence[str] = [mine for mine, _ in spec.pairs]
    return Check(spec.field, passes, prepare, rule_type="cross_table", requires=tuple(tested), **named)
