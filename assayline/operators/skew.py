"""Key-based joins and running totals that survive one key holding most of the rows.

A window or a join by key sends every row of a key to one task. The two helpers here
keep the per-key work on pre-aggregated data and spread the rows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from assayline.functions.text import column
from assayline.session import broadcast_limit, planned_bytes

# At most this many heavy keys are looked up on their own. Any key with more than one
# HEAVY_KEYS-th of the rows must be among the most frequent HEAVY_KEYS, so the keys left
# for the shuffle are each smaller than that share.
HEAVY_KEYS = 1000
TRACKED_KEYS = 10000


def heavy_hashes(rows: DataFrame, keys: Sequence[Column]) -> list[int]:
    """Hashes of the most frequent keys: at most HEAVY_KEYS numbers, whatever the input size.

    The sketch is merged map-side, so the keys themselves are not shuffled.
    """
    named = [key.alias(f"_k{i}") for i, key in enumerate(keys)]
    present = rows.select(*named).dropna()
    top = present.select(F.xxhash64(*present.columns).alias("_hash")).agg(
        F.expr(f"approx_top_k(_hash, {HEAVY_KEYS}, {TRACKED_KEYS})").alias("top")
    )
    return [item["item"] for item in top.first()["top"] or []]


_shuffled: ContextVar[bool] = ContextVar("shuffled", default=False)


@contextmanager
def shuffled_route() -> Iterator[None]:
    """Frames built inside look keys up by shuffled sort-merge joins, whatever Spark estimates or finds at run time."""
    token = _shuffled.set(True)
    try:
        yield
    finally:
        _shuffled.reset(token)


def plain_columns(frame: DataFrame) -> list[str]:
    """Columns of atomic types: what a row can be told apart by with a hash."""
    nested = (T.MapType, T.ArrayType, T.StructType, T.VariantType)
    return [field.name for field in frame.schema if not isinstance(field.dataType, nested)]


def attach(
    rows: DataFrame, keyed: DataFrame, on: Sequence[str], heavy_from: DataFrame | None = None, row_id: Sequence[str] | None = None
) -> DataFrame:
    """Left-join ``rows`` with ``keyed``, which has at most one row per key.

    A NULL in a key matches nothing. Where Catalyst itself will broadcast the keyed side
    (its estimate is under the session's threshold) this is a plain join. Otherwise the
    most frequent keys of ``rows`` are looked up through a broadcast of their keyed rows -
    at most HEAVY_KEYS of them - and every other row is shuffled by key. Rows of heavy or
    NULL keys travel through that shuffle under a route of their own each, so no task
    receives a whole heavy key. Which keys count as heavy changes a row's route, never its result.

    ``row_id`` names the columns that tell rows apart; their hash spreads the rows of a heavy
    key. Only these and the columns used later are read. Without it all columns of atomic types
    serve, so rows may hold values of any type.

    ``heavy_from`` is a cheaper frame with the same key columns to look for heavy keys in,
    for example the table ``rows`` was derived from; it spares deriving ``rows`` twice.
    """
    on = list(on)
    values = [name for name in keyed.columns if name not in on]
    forced = _shuffled.get()
    size = planned_bytes(keyed)
    if not forced and size is not None and 0 <= size <= broadcast_limit(rows.sparkSession):
        return rows.join(keyed, on, "left").select(*map(column, rows.columns), *map(column, values))

    # Hashes depend on the type, so both sides take the type Spark would compare them in.
    common = rows.select(*map(column, on)).unionAll(keyed.select(*map(column, on))).schema
    typed = [column(name).cast(field.dataType) for name, field in zip(on, common)]
    heavy = heavy_hashes(rows if heavy_from is None else heavy_from, typed)
    is_heavy = F.xxhash64(*typed).isin(heavy) if heavy else F.lit(False)
    absent = F.lit(False)
    for name in on:
        absent = absent | column(name).isNull()
    # The keyed side has names of its own, so the rows keep their keys once.
    join_keys = [f"_key{position}" for position in range(len(on))]
    hot_keys = [f"_hot{position}" for position in range(len(on))]
    sides = keyed.select(
        *[value.alias(key) for value, key in zip(typed, join_keys)],
        F.struct(*map(column, values)).alias("_row"),
        is_heavy.alias("_heavy"),
    )
    few = sides.where("_heavy").select(*[F.col(key).alias(hot) for key, hot in zip(join_keys, hot_keys)], F.col("_row").alias("_heavy_row"))
    # The route is a join key of its own, so it takes part in the partitioning. It is the hash
    # of the key, except that heavy and NULL keys are routed by the hash of the row's id.
    many = sides.where("NOT _heavy").select(
        *join_keys, F.xxhash64(*join_keys).alias("_cold_route"), F.col("_row").alias("_cold_row")
    )
    apart = list(row_id or plain_columns(rows)) or on
    routed = rows.select(
        "*",
        is_heavy.alias("_heavy"),
        F.when(is_heavy | absent, F.xxhash64(*map(column, apart)))
        .otherwise(F.xxhash64(*typed)).alias("_route"),
    )

    def equal(names: Sequence[str]) -> Column:
        tests = [value == F.col(name) for value, name in zip(typed, names)]
        return reduce(Column.__and__, tests)

    joined = routed.join(F.broadcast(few), equal(hot_keys), "left").join(
        many.hint("shuffle_merge") if forced else many, equal(join_keys) & (F.col("_route") == F.col("_cold_route")), "left")
    return joined.select(
        *map(column, rows.columns),
        *[
            F.when(F.col("_heavy"), F.col("_heavy_row")[name]).otherwise(F.col("_cold_row")[name]).alias(name)
            for name in values
        ],
    )


def only(rows: DataFrame, keys: DataFrame, on: Sequence[str], heavy_from: DataFrame | None = None) -> DataFrame:
    """Rows whose key is among ``keys``: a semi join on the route of ``attach``."""
    marks = keys.select(*map(column, on)).distinct().withColumn("_found", F.lit(True))
    return attach(rows, marks, on, heavy_from).where("_found").drop("_found")


def without(rows: DataFrame, keys: DataFrame, on: Sequence[str], heavy_from: DataFrame | None = None) -> DataFrame:
    """Rows whose key is not among ``keys``: an anti join on the route of ``attach``."""
    marks = keys.select(*map(column, on)).distinct().withColumn("_found", F.lit(True))
    return attach(rows, marks, on, heavy_from).where("_found IS NULL").drop("_found")


def running(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column,
    how: str,
    name: str,
) -> DataFrame:
    """Running sum or max of ``value`` over the rows strictly before each row.

    ``bucket`` must rise with ``order`` (for example the hour of the ordering time). The
    window inside a bucket and the window over bucket totals are both short: a key's
    history is never collected in one task. Ties are ordered by the later ``order``
    columns, which should identify a row.
    """
    combine = {"sum": F.sum, "max": F.max}[how]
    marked = rows.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    local = marked.withColumn(
        "_local", combine("_value").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        marked.groupBy(*by, "_bucket")
        .agg(combine("_value").alias("_total"))
        .withColumn("_carried", combine("_total").over(before))
        .drop("_total")
    )
    # Null-safe, so that a NULL key keeps one history over its buckets.
    keys = [*by, "_bucket"]
    totals = totals.select(*[column(key).alias(f"_of_{i}") for i, key in enumerate(keys)], "_carried")
    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & column(key).eqNullSafe(F.col(f"_of_{i}"))
    joined = local.join(totals, same, "left").drop(*[f"_of_{i}" for i in range(len(keys))])
    if how == "sum":
        result = F.coalesce("_carried", F.lit(0)) + F.coalesce("_local", F.lit(0))
    else:
        result = F.greatest("_carried", "_local")
    return joined.withColumn(name, result).drop("_bucket", "_value", "_local", "_carried")


def latest_by(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: an aggregate that combines before the shuffle."""
    by, order = list(by), list(order)
    rest = [name for name in rows.columns if name not in by]
    picked = rows.groupBy(*map(column, by)).agg(
        F.max_by(
            F.struct(*map(column, rest)), F.struct(*map(column, order))
        ).alias("_latest")
    )
    return picked.select(*map(column, by), *[F.col("_latest")[name].alias(name) for name in rest]).select(
        *map(column, rows.columns)
    )
