"""Datasets as rules see them: allowed names, column facts and definition checks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

from assayline.errors import SchemaRefused
from assayline.functions.datatypes import INTEGER_TYPES, spark_type
from assayline.sources.tables import IDENTIFIER

# Name prefixes kept for the engine's own tables.
RESERVED_PREFIXES = ("dq_", "sqlite_")
RESERVED_NAMES = frozenset({"users", "data_load_log"})
KIND_KEY = "kind"


@dataclass(frozen=True)
class ColumnSpec:
    """A dataset column: logical kind, whether a value is required, default, key flag."""

    name: str
    kind: str = "TEXT"
    required: bool = False
    default: object = None
    pk: bool = False
    source: str | None = None


def is_reserved(name: str) -> bool:
    return name.lower() in RESERVED_NAMES or name.lower().startswith(RESERVED_PREFIXES)


def check_definition(table: str, columns: Iterable[ColumnSpec]) -> list[ColumnSpec]:
    """Refuse a table definition; a missing id column is added as a whole number key."""
    columns = list(columns)
    if not re.fullmatch(IDENTIFIER, table):
        raise SchemaRefused(f"Not a valid table name: {table}")
    if is_reserved(table):
        raise SchemaRefused("The engine uses this table name itself.")
    if not columns:
        raise SchemaRefused("A dataset needs columns.")
    if len({c.name.lower() for c in columns}) != len(columns):
        raise SchemaRefused("Two columns share a name.")
    for spec in columns:
        if not re.fullmatch(IDENTIFIER, spec.name):
            raise SchemaRefused(f"Not a valid column name: {spec.name}")
        spark_type(spec.kind)
        if spec.name.lower() == "id" and (spec.name != "id" or spec.kind not in ("INTEGER", "TEXT")):
            raise SchemaRefused("An id is either INTEGER or TEXT.")
    if not any(spec.name == "id" for spec in columns):
        columns.insert(0, ColumnSpec("id", "INTEGER", pk=True))
    return [
        ColumnSpec(c.name, c.kind, c.required, c.default, c.name == "id", c.source) for c in columns
    ]


def to_schema(columns: Iterable[ColumnSpec]) -> T.StructType:
    """Spark schema that carries the logical facts in its metadata."""
    return T.StructType(
        [
            T.StructField(
                c.name, spark_type(c.kind), True,
                {KIND_KEY: c.kind, "required": c.required, "pk": c.pk, "default": c.default},
            )
            for c in columns
        ]
    )


def kind_of(field: T.StructField) -> str:
    """Logical kind of a field: its metadata where present, else from the Spark type."""
    if KIND_KEY in (field.metadata or {}):
        return field.metadata[KIND_KEY]
    kind = field.dataType
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.LongType):
        return "BIGINT"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "REAL"
    for name, candidate in INTEGER_TYPES.items():
        if kind == candidate:
            return name
    names = {
        T.StringType: "STRING", T.BooleanType: "BOOLEAN", T.DateType: "DATE",
        T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP_NTZ",
    }
    for type_class, name in names.items():
        if isinstance(kind, type_class):
            return name
    raise SchemaRefused(f"Unsupported source type for {field.name}: {kind.simpleString()}")


def describe(frame: DataFrame) -> list[ColumnSpec]:
    """Column facts of a dataset."""
    specs = []
    for field in frame.schema:
        facts = field.metadata or {}
        specs.append(
            ColumnSpec(
                field.name, kind_of(field), bool(facts.get("required", not field.nullable)),
                facts.get("default"), bool(facts.get("pk", field.name == "id")),
            )
        )
    return specs


class Datasets:
    """The tables rules may read, by name: frames, or names of tables in the session catalog."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame] | None = None):
        self.spark = spark
        self._frames: dict[str, DataFrame] = {}
        for name, frame in (frames or {}).items():
            self.add(name, frame)

    def add(self, name: str, frame: DataFrame | None = None) -> None:
        if is_reserved(name):
            raise SchemaRefused("The engine uses this table name itself.")
        self._frames[name] = self.spark.table(name) if frame is None else frame

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, names: Iterable[str]) -> Datasets:
        return cls(spark, {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names})

    def names(self) -> list[str]:
        return sorted(self._frames)

    def scan(self, name: str) -> DataFrame:
        if name not in self._frames:
            raise SchemaRefused(f"Table does not exist: {name}")
        return self._frames[name]

    def columns(self, name: str) -> list[ColumnSpec]:
        return describe(self.scan(name))

    def views(self) -> dict[str, DataFrame]:
        return dict(self._frames)
