"""Snapshots of outside tables: safe names, exact types, local row numbers, guarded refresh."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain, count

from pyspark.sql import DataFrame, functions as F, types as T

from assayline.errors import SchemaRefused
from assayline.functions.text import column
from assayline.operators.loading import load_entry, number_rows
from assayline.sources.datasets import ColumnSpec, check_definition, describe, kind_of, to_schema
from assayline.sources.tables import IDENTIFIER, TableStore


# Prefix of a name that would begin with a digit or be empty, the name of a source's own id, and what counts as a whole number.
NUMBERED, FOREIGN_ID, WHOLE = "col_", "source_id", ("BIGINT", "INT", "SMALLINT", "TINYINT")


def snapshot_columns(schema: T.StructType, *, preserve_names: bool = False) -> list[ColumnSpec]:
    """Local column names and kinds for a source schema; complex types are refused."""
    if not schema.fields:
        raise SchemaRefused("The source has no columns to copy.")
    untyped = (T.NullType, T.CharType, T.VarcharType)
    kinds = ["TEXT" if isinstance(field.dataType, untyped) else kind_of(field) for field in schema]
    originals = [field.name for field in schema]
    if not preserve_names:
        return [ColumnSpec(name, kind, source=source) for name, kind, source in zip(local_names(originals), kinds, originals)]
    folded = [name.lower() for name in originals]
    odd = sorted({name for name in originals if not re.fullmatch(IDENTIFIER, name) or folded.count(name.lower()) > 1})
    if odd:
        raise SchemaRefused(f"Rename these source columns to keep their names (letters, digits, _; each once): {odd}")
    return [
        ColumnSpec(name, "INTEGER" if name.lower() == "id" and kind in WHOLE else kind, source=name) for name, kind in zip(originals, kinds)]


def local_names(originals: Sequence[str]) -> list[str]:
    """A plain, unused name for each source column, in order; ``id`` is the local row number's.

    A name made of letters, digits and underscores is kept; a clash takes the lowest free number from 2 on.
    """
    used = {"id"}
    chosen = []
    for original in originals:
        plain = "".join(c if c.isascii() and c.isalnum() else "_" for c in original)
        plain = FOREIGN_ID if plain.lower() == "id" else NUMBERED + plain if plain[:1].isdigit() or not plain else plain
        candidates = chain([plain], (f"{plain}_{n}" for n in count(2)))
        chosen.append(next(name for name in candidates if name.lower() not in used))
        used.add(chosen[-1].lower())
    return chosen


def _renamed(frame: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    fields = {f.name: f for f in to_schema(specs)}
    return frame.select(
        *[
            column(s.source).cast(fields[s.name].dataType).alias(s.name, metadata=fields[s.name].metadata)
            for s in specs
        ]
    )


def save_snapshot(
    store: TableStore, source: DataFrame, table: str, reference: str, username: str, *,
    replace: bool = False, preserve_names: bool = False,
) -> int:
    """Save a source as a dataset; returns the number of rows.

    A refresh must come from the same source (by the load log) and have the same columns.
    With preserved names a source ``id`` is kept when it holds unique whole numbers;
    otherwise rows get local numbers, which say nothing about the source's keys.
    """
    specs = snapshot_columns(source.schema, preserve_names=preserve_names)
    keeps_id = preserve_names and any(s.name.lower() == "id" for s in specs)
    if keeps_id:
        name = next(s.name for s in specs if s.name.lower() == "id")
        saved = _renamed(source, specs)
        _check_ids(source, saved, name)
    else:
        check_definition(table, specs)
        saved = number_rows(_renamed(source, specs), "id", 0)
    if replace:
        current = store.read(table)
        if not keeps_id:
            log = store.history("load_log", LOAD_LOG).where(F.col("table_name") == table)
            last = log.agg(F.max_by("file_name", F.struct("loaded_at", "load_id"))).first()[0]
            if last != reference:
                raise SchemaRefused(f"{table} was loaded from another source than {reference}; import it as a new table.")
        if [(c.name, c.kind) for c in describe(current)] != [(c.name, c.kind) for c in describe(saved)]:
            raise SchemaRefused("Local and source columns differ; the table was not changed.")
    version = store.save(table, saved, create=not replace)
    rows = store.manifest(table, version)["rows"]
    store.append("load_log", load_entry(store.spark, table, reference, rows, username), load=f"{table}-{version}")
    return rows


LOAD_LOG = "load_id string, table_name string, file_name string, row_count bigint, loaded_by string, loaded_at timestamp"


def _check_ids(source: DataFrame, saved: DataFrame, name: str) -> None:
    original = {f.name: f for f in source.schema}[name]
    if not isinstance(original.dataType, T.IntegralType):
        raise SchemaRefused("The source id must hold unique whole numbers.")
    ids = saved.select(column(name).alias("id"))
    repeated = ids.groupBy("id").count().where("count > 1 OR id IS NULL").limit(1).count()
    if repeated:
        raise SchemaRefused("The source id must hold unique whole numbers.")
