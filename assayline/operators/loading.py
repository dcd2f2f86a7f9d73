"""Typed import of text rows: reasons per cell, duplicate ids, upsert, generated ids, log."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from assayline.errors import ImportRejected
from assayline.functions import datatypes
from assayline.functions.text import column
from assayline.session import cut_lineage
from assayline.sources.datasets import ColumnSpec, to_schema

SHOWN_ISSUES = 30


def infer_kinds(frame: DataFrame) -> DataFrame:
    """Suggested kind of every text column: (column_name, suggested_kind). One aggregate."""
    measures = []
    for position, name in enumerate(frame.columns):
        text = F.trim(column(name))
        filled = F.coalesce(text != "", F.lit(False))
        number = F.when(text.rlike(datatypes.REAL_TEXT), text.try_cast("double"))
        finite = F.coalesce(number.between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False))
        measures += [
            F.count_if(filled).alias(f"n{position}"),
            F.count_if(filled & text.rlike(datatypes.LEADING_ZERO)).alias(f"z{position}"),
            F.count_if(filled & text.rlike(datatypes.INTEGER_TEXT)).alias(f"w{position}"),
            F.count_if(filled & finite).alias(f"r{position}"),
        ]
    lines = [
        F.struct(
            F.lit(name).alias("column_name"),
            datatypes.suggest_kind(*[F.col(f"{m}{position}") for m in "nzwr"]).alias("suggested_kind"),
        )
        for position, name in enumerate(frame.columns)
    ]
    return frame.agg(*measures).select(F.inline(F.array(*lines)))


def check_mapping(
    headers: Sequence[str], columns: Sequence[ColumnSpec], mapping: Mapping[str, str | None] | None = None
) -> list[tuple[str, ColumnSpec]]:
    """(source, target) pairs. Every source column is mapped or explicitly ignored (None)."""
    mapping = dict(zip(headers, headers)) if mapping is None else dict(mapping)
    if set(mapping) != set(headers) or "" in mapping.values():
        raise ImportRejected("Map every column or explicitly ignore it.")
    known = {spec.name: spec for spec in columns}
    targets = [mapping[name] for name in headers if mapping[name] is not None]
    if not targets:
        raise ImportRejected("No columns are selected for import.")
    if len(set(targets)) < len(targets):
        raise ImportRejected("Several source columns map to the same target.")
    unknown = [name for name in targets if name not in known]
    if unknown:
        raise ImportRejected(f"Unknown column: {unknown[0]}")
    for spec in columns:
        if spec.required and spec.default is None and not spec.pk and spec.name not in targets:
            raise ImportRejected(f"Missing required column: {spec.name}")
    return [(name, known[mapping[name]]) for name in headers if mapping[name] is not None]


def convert_cells(frame: DataFrame, pairs: Sequence[tuple[str, ColumnSpec]], carry: Sequence[str] = ()) -> DataFrame:
    """Typed target columns plus ``issues``: one (column_name, reason) per refused cell."""
    fields = {f.name: f for f in to_schema([spec for _, spec in pairs])}
    typed = [
        datatypes.cell_value(column(source), spec.kind).alias(spec.name, metadata=fields[spec.name].metadata)
        for source, spec in pairs
    ]
    # The reasons are columns of their own first: each is then evaluated once, in compiled code.
    reasons = [
        datatypes.cell_reason(column(source), spec.kind, spec.required, spec.default).alias(f"_reason{i}")
        for i, (source, spec) in enumerate(pairs)
    ]
    found = [
        F.when(
            F.col(f"_reason{i}").isNotNull(),
            F.struct(F.lit(spec.name).alias("column_name"), F.col(f"_reason{i}").alias("reason")),
        )
        for i, (_, spec) in enumerate(pairs)
    ]
    judged = frame.select(*map(column, carry), *typed, *reasons)
    kept = [column(name) for name in judged.columns[: len(carry) + len(typed)]]
    return judged.select(*kept, F.array_compact(F.array(*found)).alias("issues"))


def cell_issues(converted: DataFrame, row: str) -> DataFrame:
    """One line per refused cell."""
    # The outer form keeps the optimiser from testing the list before it is built.
    return converted.select(column(row), F.inline_outer("issues")).where("reason IS NOT NULL")


def duplicate_ids(frame: DataFrame, key: str = "id") -> DataFrame:
    """Ids that occur more than once in a batch, with their number of rows; NULL ids excluded."""
    return (
        frame.where(column(key).isNotNull()).groupBy(column(key).alias(key))
        .agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    )


def upsert(target: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Target rows with the batch applied: matching ids take the batch's columns, others append.

    Columns the batch does not have keep their value. Both sides are unique by key. The batch is written once, so that
    each of its uses sees the same rows, whatever it takes to compute them.
    """
    arriving = cut_lineage(batch).select(
        column(key).alias("_key"),
        F.struct(*[column(n) for n in batch.columns if n != key] or [F.lit(1).alias("_none")]).alias("_new"),
        F.lit(True).alias("_present"),
    )
    # Neither side needs the other whole: with a small batch, which Spark broadcasts, the target stays where it is.
    updated = target.join(arriving, column(key) == F.col("_key"), "left")
    matched = target.select(column(key).alias("_key")).join(arriving.select("_key"), "_key", "left_semi")
    inserted = arriving.join(matched, "_key", "left_anti")
    empty = [F.lit(None).cast(field.dataType).alias(field.name) for field in target.schema]
    joined = updated.unionByName(inserted.select(*empty, "_key", "_new", "_present"))
    changed = set(batch.columns) - {key}
    output = []
    for field in target.schema:
        if field.name == key:
            value = F.coalesce(column(key), F.col("_key"))
        elif field.name in changed:
            value = F.when(F.col("_present"), F.col("_new")[field.name].cast(field.dataType)).otherwise(column(field.name))
        else:
            value = column(field.name)
        output.append(value.alias(field.name, metadata=field.metadata))
    return joined.select(*output)


def number_rows(frame: DataFrame, name: str, last: int) -> DataFrame:
    """Consecutive numbers above ``last``, without moving rows between tasks.

    Rows are written once together with their partition and position; the offsets are one
    small row per partition.
    """
    placed = cut_lineage(frame.withColumn("_at", F.monotonically_increasing_id()))
    partition, position = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(partition.alias("_part")).count().select(
        "_part", (F.coalesce(F.sum("count").over(before), F.lit(0)) + F.lit(last)).alias("_start"))
    numbered = placed.withColumn("_part", partition).join(starts, "_part")
    rest = [column(n) for n in frame.columns if n != name]
    return numbered.select((F.col("_start") + position + 1).alias(name), *rest)


def with_ids(frame: DataFrame, high_water: int, key: str = "id") -> DataFrame:
    """Fill missing ids with new ones above the highest id ever used."""
    named = frame.where(column(key).isNotNull())
    top = named.agg(F.max(column(key))).first()[0]
    start = max(high_water, top if top is not None else high_water)
    fresh = number_rows(frame.where(column(key).isNull()).drop(key), key, start)
    return named.unionByName(fresh.select(*map(column, frame.columns)))


def load_entry(spark: SparkSession, table: str, file_name: str, rows: int, username: str) -> DataFrame:
    line = (uuid.uuid4().hex, table, file_name, rows, username, datetime.now(timezone.utc).replace(tzinfo=None))
    return spark.createDataFrame(
        [line],
        "load_id string, table_name string, file_name string, row_count bigint, loaded_by string, loaded_at timestamp",
    )


def latest_loads(log: DataFrame) -> DataFrame:
    """The newest load of every table."""
    from assayline.operators.skew import latest_by

    return latest_by(log, ["table_name"], ["loaded_at", "load_id"])


def check_batch(converted: DataFrame, row: str, key: str = "id") -> None:
    """Refuse the whole batch when any cell or id is bad, showing the first few reasons."""
    shown = cell_issues(converted, row).orderBy(column(row), "column_name").limit(SHOWN_ISSUES).collect()
    lines = [f"Row {r[0]}, {r['column_name']}: {r['reason']}" for r in shown]
    if key in converted.columns:
        repeated = duplicate_ids(converted, key).orderBy(column(key)).limit(SHOWN_ISSUES).collect()
        lines += [f"{key} {r[0]} occurs {r['occurrences']} times in the file" for r in repeated]
    if lines:
        raise ImportRejected("Import rejected; no data was saved.\n" + "\n".join(lines[:SHOWN_ISSUES]))


def import_rows(
    store, frame: DataFrame, table: str, username: str, *, file_name: str,
    mapping: Mapping[str, str | None] | None = None, new_columns: Sequence[ColumnSpec] | None = None, row: str = "_row",
) -> int:
    """Import text rows into a dataset, all or nothing: a new table version or no change."""
    from assayline.sources.datasets import check_definition, describe

    spark = store.spark
    columns = check_definition(table, new_columns) if new_columns is not None else describe(store.read(table))
    headers = [n for n in frame.columns if n not in (row, "_file")]
    pairs = check_mapping(headers, columns, mapping)
    stage = store.stage(convert_cells(frame, pairs, [row]))
    try:
        converted = store.read_stage(stage)
        total = converted.count()
        if not total:
            raise ImportRejected("The file has no data rows.")
        check_batch(converted, row)
        batch = converted.drop(row, "issues")
        if new_columns is not None:
            current = spark.createDataFrame([], to_schema(columns))
            high_water = 0
        else:
            current = store.read(table)
            high_water = store.high_water(table)
        id_kind = next(spec.kind for spec in columns if spec.name == "id")
        if id_kind != "TEXT":
            if "id" not in batch.columns:
                batch = batch.withColumn("id", F.lit(None).cast(T.LongType()))
            batch = with_ids(batch, high_water)
        elif "id" not in batch.columns or batch.where("id IS NULL").limit(1).count():
            raise ImportRejected("A text id is required on every row.")
        version = store.save(table, upsert(current, batch), create=new_columns is not None)
    finally:
        store.drop_stage(stage)
    store.append("load_log", load_entry(spark, table, file_name, total, username), load=f"{table}-{version}")
    return total
