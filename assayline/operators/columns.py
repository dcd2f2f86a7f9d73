"""Guarded column edits: each edit yields a new table version or is refused."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayline.errors import AccessError, DataQualityError, SchemaRefused
from assayline.functions import datatypes
from assayline.functions.text import column
from assayline.operators.audits import lossless_audit, tables_equal
from assayline.operators.evaluate import analyse
from assayline.sources.datasets import ColumnSpec, describe, to_schema
from assayline.sources.tables import IDENTIFIER


def columns_read(spark: SparkSession, sql: str, views: Mapping[str, DataFrame]) -> dict[str, set[str]]:
    """Columns a rule reads, per dataset, aliases, joins and stars resolved."""
    _, facts = analyse(spark, sql, views)
    return facts.columns


def protect(spark: SparkSession, rules: Mapping[str, str], views: Mapping[str, DataFrame], table: str, name: str | None) -> None:
    """Refuse an edit of a column that a current rule reads; an unreadable rule blocks too.

    Without a name (adding a column) every rule with a wildcard over the table blocks.
    """
    for rule_id, sql in rules.items():
        if name is None and "*" not in sql:
            continue
        try:
            read = columns_read(spark, sql, views)
        except (AccessError, DataQualityError) as error:
            raise SchemaRefused(f"Rule {rule_id} cannot be verified; fix it before editing columns.") from error
        by_table = {key.lower(): {c.lower() for c in names} for key, names in read.items()}
        if name is None and table.lower() in by_table:
            raise SchemaRefused(f"Rule {rule_id} uses a wildcard; review it before adding columns.")
        if name is not None and name.lower() in by_table.get(table.lower(), set()):
            raise SchemaRefused(f"The column is used by rule {rule_id}.")


def _retyped(frame: DataFrame, specs: Sequence[ColumnSpec], values: Mapping[str, F.Column]) -> DataFrame:
    fields = to_schema(specs)
    return frame.select(
        *[values[f.name].cast(f.dataType).alias(f.name, metadata=f.metadata) for f in fields]
    )


def _check_name(name: str | None, specs: Sequence[ColumnSpec], current: ColumnSpec | None) -> None:
    if not name or not re.fullmatch(IDENTIFIER, name):
        raise SchemaRefused(f"Not a valid column name: {name}")
    clash = any(s.name.lower() == name.lower() and s is not current for s in specs)
    if name.lower() == "id" or clash:
        raise SchemaRefused("Another column has this name already, or it is id.")


def add_column(frame: DataFrame, name: str, kind: str = "TEXT", required: bool = False) -> DataFrame:
    """A new empty column; a required one only fits an empty table."""
    specs = describe(frame)
    _check_name(name, specs, None)
    if required and frame.limit(1).count():
        raise SchemaRefused("A required column can only be added to an empty table.")
    values = {s.name: column(s.name) for s in specs} | {name: F.lit(None)}
    return _retyped(frame, [*specs, ColumnSpec(name, kind, required)], values)


def drop_column(frame: DataFrame, name: str) -> DataFrame:
    _editable(describe(frame), name)
    return frame.drop(name)


def _editable(specs: Sequence[ColumnSpec], name: str) -> ColumnSpec:
    current = next((s for s in specs if s.name == name), None)
    if current is None:
        raise SchemaRefused("Name the column to edit.")
    if current.pk or name.lower() == "id":
        raise SchemaRefused("The id column stays as it is.")
    return current


def modify_column(
    frame: DataFrame, name: str, new_name: str | None = None, kind: str | None = None, required: bool | None = None
) -> DataFrame:
    """Rename, retype or toggle a column. A retype must keep every value exactly."""
    specs = describe(frame)
    current = _editable(specs, name)
    new_name = new_name or name
    _check_name(new_name, specs, current)
    kind = kind or current.kind
    required = current.required if required is None else required
    values = {s.name: column(s.name) for s in specs}
    if kind != current.kind:
        refused = lossless_audit(frame, {name: kind}).first()["refused"]
        if refused:
            raise SchemaRefused(f"{refused} values would lose data; no changes were made.")
        values[name] = datatypes.convert(column(name), frame.schema[name].dataType, kind)
    if required and frame.where(column(name).isNull()).limit(1).count():
        raise SchemaRefused("Empty cells would remain in a required column.")
    values[new_name] = values.pop(name)
    changed = [ColumnSpec(new_name, kind, required, s.default) if s is current else s for s in specs]
    return _retyped(frame, changed, values)


def edit(store, table: str, action: str, rules: Mapping[str, str], *, name: str | None = None, **change) -> int:
    """Apply one edit as a new version, after checking every current rule."""
    views = {dataset: store.read(dataset) for dataset in store.dataset_names()}
    views["source"] = views[table]
    frame = views[table]
    if action not in ("add", "modify", "drop"):
        raise SchemaRefused(f"Unknown edit: {action}")
    protect(store.spark, rules, views, table, None if action == "add" else name)
    if action == "add":
        edited = add_column(frame, name, **change)
    elif action == "drop":
        edited = drop_column(frame, name)
    else:
        edited = modify_column(frame, name, **change)
    return store.save(table, edited)


def align_types(
    frame: DataFrame, kinds: Mapping[str, str], *, preserve_invalid: bool = False
) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Declare the given kinds on a table whose values must survive unchanged.

    With ``preserve_invalid`` a column holding values that do not fit stays as text, under
    its own name, so that known anomalies remain visible to rules.
    """
    specs = describe(frame)
    names = {s.name for s in specs}
    if set(kinds) not in (names, names - {"id"}):
        raise SchemaRefused("Source and local column names differ; no types were changed.")
    changes, wanted = [], {}
    for spec in specs:
        kind = kinds.get(spec.name, spec.kind)
        datatypes.spark_type(kind)
        if spec.pk or spec.name == "id":
            if not (spec.kind in datatypes.INTEGER_TYPES and kind in datatypes.INTEGER_TYPES) and kind != spec.kind:
                raise SchemaRefused("The id column stays as it is.")
            continue
        if kind != spec.kind:
            changes.append((spec.name, spec.kind, kind))
            wanted[spec.name] = kind
    if not changes:
        return frame, []
    audit = {row["column_name"]: row["refused"] for row in lossless_audit(frame, wanted).collect()}
    broken = [name for name, refused in audit.items() if refused]
    if broken and not preserve_invalid:
        raise SchemaRefused(f"Values of {', '.join(broken)} would change; no types were changed.")
    final = {name: ("STRING" if name in broken else kind) for name, kind in wanted.items()}
    values = {s.name: column(s.name) for s in specs}
    for name, kind in final.items():
        values[name] = datatypes.convert(column(name), frame.schema[name].dataType, kind)
    aligned = _retyped(
        frame, [ColumnSpec(s.name, final.get(s.name, s.kind), s.required, s.default, s.pk) for s in specs], values
    )
    # Compare both sides in text form: no value may have been dropped or moved.
    def as_text(value, name):
        return value if name not in final else value.cast("string")

    back = aligned.select(*[as_text(column(n), n).alias(n) for n in frame.columns])
    original = frame.select(*[as_text(values[n], n).alias(n) for n in frame.columns])
    if not tables_equal(original, back).first()["equal"]:
        raise SchemaRefused("Conversion would lose data; no types were changed.")
    return aligned, changes
