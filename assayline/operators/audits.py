"""Audits of whole tables: refused values per column, lossless conversions, equality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayline.errors import SchemaRefused
from assayline.functions import datatypes
from assayline.functions.text import column

SAMPLES = 20


def _per_column(frame: DataFrame, tests: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """One aggregate over all columns, turned into one line per column.

    A test is (column, kind, whether the value counts, whether it is accepted).
    """
    totals = frame.agg(
        *[F.count_if(counts).alias(f"n{i}") for i, (_, _, counts, _) in enumerate(tests)],
        *[F.count_if(accepted).alias(f"a{i}") for i, (_, _, _, accepted) in enumerate(tests)],
    )
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("column_name"), F.lit(kind).alias("kind"),
                        F.col(f"a{i}").alias("accepted"), (F.col(f"n{i}") - F.col(f"a{i}")).alias("refused"),
                    )
                    for i, (name, kind, _, _) in enumerate(tests)
                ]
            )
        )
    )


def upload_audit(frame: DataFrame, kinds: Mapping[str, str], as_text: Sequence[str] = ()) -> DataFrame:
    """Per column: values that fit its kind and values that do not.

    Columns listed in ``as_text`` fall back to STRING, which keeps every value.
    """
    unknown = set(as_text) - set(frame.columns)
    if unknown or any(name.lower() == "id" for name in as_text):
        raise SchemaRefused("Choose existing non-key columns for text upload.")
    tests = []
    for name, kind in kinds.items():
        kind = "STRING" if name in as_text else kind
        value = column(name)
        fits = datatypes.parse(value.cast("string"), kind).isNotNull()
        tests.append((name, kind, value.isNotNull(), fits))
    return _per_column(frame, tests)


def refused_samples(frame: DataFrame, kinds: Mapping[str, str], key: str, limit: int = SAMPLES) -> DataFrame:
    """The first refused values, smallest record first: the report shown to a user."""
    lines = [
        F.when(
            column(name).isNotNull() & datatypes.parse(column(name).cast("string"), kind).isNull(),
            F.struct(
                column(key).alias("record"), F.lit(name).alias("column_name"), F.lit(kind).alias("kind"),
                F.substring(column(name).cast("string"), 1, 100).alias("value"),
            ),
        )
        for name, kind in kinds.items()
    ]
    found = frame.select(F.inline_outer(F.array_compact(F.array(*lines)))).where("column_name IS NOT NULL")
    return found.orderBy("record", "column_name").limit(limit)


def lossless_audit(frame: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Per column: values a conversion would keep exactly and values it would change."""
    fields = {f.name: f.dataType for f in frame.schema}
    tests = []
    for name, kind in kinds.items():
        tests.append((name, kind, F.lit(True), datatypes.lossless(column(name), fields[name], kind)))
    return _per_column(frame, tests)


def _fingerprints(frame: DataFrame) -> DataFrame:
    """Order-independent digest: row count and exact sums of two independent row hashes."""
    row = [column(name) for name in frame.columns]
    return frame.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64(*row).cast("decimal(38,0)")), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.hash(*row).cast("decimal(38,0)")), F.lit(0)).alias("h"),
    )


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows with different multiplicity: (all columns, in_before, in_after).

    Both sides are counted per distinct row, so repeated rows combine before the shuffle.
    """
    names = before.columns
    counted = before.select(*names, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionAll(
        after.select(*names, F.lit(0).alias("_b"), F.lit(1).alias("_a"))
    )
    return (
        counted.groupBy(*map(column, names))
        .agg(F.sum("_b").alias("in_before"), F.sum("_a").alias("in_after"))
        .where("in_before <> in_after")
    )


# Buckets of the two levels of a comparison. Their product bounds the list of differing buckets that is broadcast: a million pairs of numbers.
BUCKETS, FINER = 4096, 256


def tables_equal(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows on each side, rows only on one side, and the verdict.

    Rows fall into buckets by a hash, and a bucket is its number of rows and the exact sums of the halves of two 64-bit row hashes, combined
    before the shuffle. Only in buckets that differ are rows told apart by a second hash, and only in the differing ones of these
    are whole rows compared. Equal tables are read and digested; none of their rows moves.
    """
    if [(f.name, f.dataType) for f in before.schema] != [(f.name, f.dataType) for f in after.schema]:
        raise SchemaRefused("The tables have different columns.")
    names = before.columns
    row = [column(name) for name in names]
    both = before.select(*row, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionAll(after.select(*row, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    hashed = both.select(
        "*", F.xxhash64(*row).alias("_x"), F.xxhash64(F.lit(1), *row).alias("_y")
    ).withColumns({"_bucket": F.pmod("_x", F.lit(BUCKETS)), "_finer": F.pmod("_y", F.lit(FINER))})

    def digests(rows: DataFrame, *by: str) -> DataFrame:
        # Sums of half a hash each stay exact in 64 bits for two billion rows a bucket.
        sign = F.col("_b") - F.col("_a")
        halves = [half for h in ("_x", "_y") for half in (F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
        return rows.groupBy(*by).agg(F.sum("_b").alias("_nb"), F.sum("_a").alias("_na"), *[F.sum(half * sign).alias(f"_s{i}") for i, half in enumerate(halves)])

    apart = F.col("_nb") != F.col("_na")
    for i in range(4):
        apart = apart | (F.col(f"_s{i}") != 0)
    coarse = digests(hashed, "_bucket")
    suspects = hashed.join(F.broadcast(coarse.where(apart).select("_bucket")), "_bucket", "left_semi")
    finer = digests(suspects, "_bucket", "_finer").where(apart).select("_bucket", "_finer")
    moved = suspects.join(F.broadcast(finer), ["_bucket", "_finer"], "left_semi").groupBy(*row).agg(F.sum("_b").alias("_nb"), F.sum("_a").alias("_na"))

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name)

    zero = F.lit(0).cast("bigint")
    sizes = coarse.select("_nb", "_na", zero.alias("only_b"), zero.alias("only_a"))
    rest = moved.select(
        zero.alias("_nb"), zero.alias("_na"), F.greatest(F.col("_nb") - F.col("_na"), zero).alias("only_b"), F.greatest(F.col("_na") - F.col("_nb"), zero).alias("only_a"))
    summed = sizes.unionAll(rest).agg(
        total(F.col("_nb"), "rows_before"), total(F.col("_na"), "rows_after"), total(F.col("only_b"), "only_before"), total(F.col("only_a"), "only_after"))
    return summed.withColumn("equal", (F.col("only_before") == 0) & (F.col("only_after") == 0))


def probably_equal(before: DataFrame, after: DataFrame) -> bool:
    """A cheap screen without a shuffle of rows: equal digests. ``tables_equal`` is the proof."""
    return _fingerprints(before).first() == _fingerprints(after).first()
