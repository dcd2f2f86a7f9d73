"""Proportional stratified interleaving: shards of equal row counts that all have the corpus mixture.

Rows of each source are put in a seeded random order and get the fractional rank
(rank + 1/2) / (rows of the source). Sorted by that number the sources interleave in proportion,
and equal cuts of the sorted list are the shards. Both ranks are counted in two levels: inside
buckets of the random number (or of the fractional rank), and over the bucket totals. Buckets
are about ``BUCKET_ROWS`` rows whatever a source's share, so a hot source is spread like any other.

DataFrame functions only. Defined results: a null source is a source of its own; a null id is a
value; repeated rows get a slot each. Input columns named ``shard`` or ``slot`` are replaced. No
rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

BUCKET_ROWS = 10_000
HASH_BITS = 60


def interleave(rows: DataFrame, shards: int, seed: int = 0, source: str = "source", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The rows with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard).

    ``keys`` identify a row; their seeded hash is the random order. Row counts of two shards
    differ by one at most. Give only the columns needed later: they all travel through the shuffles.
    """
    kept = [name for name in rows.columns if name not in ("shard", "slot")]
    total = rows.count()
    buckets = max(1, total // BUCKET_ROWS)
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in keys])
    drawn = rows.select(
        F.struct(*[F.col(f"`{name}`") for name in kept]).alias("row"),
        F.col(f"`{source}`").isNull().alias("no_source"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"),
        F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long").alias("draw"),
    ).withColumn("bucket", F.floor(F.col("draw") / F.lit(float(1 << HASH_BITS)) * buckets))

    group, tie = ["no_source", "source"], [F.col("row")[k] for k in keys]
    ahead = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = drawn.groupBy(*group, "bucket").count().select(
        *group, "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"),
        F.sum("count").over(Window.partitionBy(*group)).alias("of_source"))
    inside = Window.partitionBy(*group, "bucket").orderBy("draw", *tie)
    ranked = drawn.withColumn("own", F.row_number().over(inside)).join(totals, [*group, "bucket"])
    fraction = (F.col("before") + F.col("own") - F.lit(0.5)) / F.col("of_source")
    placed = ranked.select("row", *group, "draw", fraction.alias("fraction")).withColumn("part", F.floor(F.col("fraction") * buckets))

    # One row per bucket of about BUCKET_ROWS rows meets here.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    order = Window.partitionBy("part").orderBy("fraction", *group, "draw", *tie)
    numbered = placed.withColumn("own", F.row_number().over(order) - 1).join(starts, "part").withColumn(
        "number", F.col("start") + F.col("own"))
    return numbered.withColumn("shard", F.expr(f"int(number * {shards} div {max(total, 1)})")).select(
        "row.*", "shard", (F.col("number") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).alias("slot"))
