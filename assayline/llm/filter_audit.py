"""Filter interaction audit: what each filter removes, alone and in every order, from additive counts per mask.

A document's mask has one bit per filter, set where the document fails it. A filter chain's outcome depends on the
masks only, so one aggregate of counts per part and mask answers every order: with S[P] the number of documents that fail
none of the filters in P, the step from P to P + f keeps S[P + f] and removes S[P] - S[P + f].

The duplicate filter needs other rows. Its prepass is a counting Bloom filter: every text adds one to ``PROBES`` cells,
counts are combined per task and merged by cell, and a text with any cell counted once is certainly
unique. Crowded cells become bitmaps of 4 KiB, at most ``MAX_CELLS`` bits in all (128 MiB), which is the bound of the one
broadcast; larger corpora are taken in shares of the hash space, each with a sketch of its own. Only texts whose
cells are all crowded travel, grouped by the full text (copies combine before the shuffle), to find the smallest id. The rows
themselves meet their text's first id by (id, text hash), a key that copies do not share, so no group of copies meets in one task.

DataFrame functions only. Defined results: a null text counts as empty, so null and empty texts are identical. Rows equal in
id and text are no copies of each other (neither id is smaller). A null id is smaller than nothing and has no smaller id: it
never fails as a copy and makes no other row fail. A null part is the empty string. Repeated rows count each. Of several labels of
an id, one that says so is enough. No rows in, no rows out. Input columns are read by name and none are returned, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from assayline.llm.common import written

CELLS_PER_ROW, PROBES = 8, 3
MAX_CELLS = 1 << 30
BUCKET = 1 << 15  # bits of one bitmap of Spark's bitmap functions
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#$%&*|"


def row_filters(text: Column, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> dict[str, Column]:
    """Failure conditions on a text alone: A short, B repetitive, C capitals, D symbols."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    length = F.char_length(text)
    return {
        "A": F.size(words) < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < distinct_percent * F.size(words),
        "C": 100 * (length - F.char_length(F.translate(text, CAPITALS, ""))) > capital_percent * length,
        "D": text.rlike("[" + SYMBOLS + "]"),
    }


def _cell(hashed: str, probe: int, cells: int) -> Column:
    """The cell of a probe: the two halves of a hash, combined (Kirsch and Mitzenmacher)."""
    return F.expr(f"pmod(({hashed} & 4294967295L) + {probe}L * ((shiftrightunsigned({hashed}, 32)) | 1L) + {probe * probe * probe}L, {cells}L)")


def crowded(hashes: DataFrame, hashed: str, cells: int) -> DataFrame:
    """(bucket, bits): bitmaps of the cells that two rows or more have touched. At most cells / BUCKET rows of 4 KiB.

    A row touches a cell once, even where two of its probes fall together.
    """
    touched = hashes.select(F.explode(F.array_distinct(F.array(*[_cell(hashed, p, cells) for p in range(PROBES)]))).alias("cell"))
    full = touched.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    return full.groupBy(F.expr(f"cell div {BUCKET}").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(cell % {BUCKET})").alias("bits"))


def _may_repeat(rows: DataFrame, bitmaps: DataFrame, hashed: str, cells: int) -> DataFrame:
    """The rows with ``may_repeat``: all cells are crowded. ``bitmaps`` has at most MAX_CELLS bits, so it is broadcast."""
    sure = F.lit(True)
    names = rows.columns
    for probe in range(PROBES):
        cell, bits = f"_cell{probe}", f"_bits{probe}"
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_bucket{probe}"), F.col("bits").alias(bits)))
        rows = rows.withColumn(cell, _cell(hashed, probe, cells)).withColumn(f"_bucket{probe}", F.expr(f"{cell} div {BUCKET}"))
        rows = rows.join(side, f"_bucket{probe}", "left")
        byte = F.conv(F.hex(F.expr(f"substring({bits}, cast(({cell} % {BUCKET}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        sure = sure & F.coalesce(F.getbit(byte, (F.col(cell) % 8).cast("int")) == 1, F.lit(False))
    return rows.select(*names, sure.alias("may_repeat"))


@dataclass(frozen=True)
class Sketch:
    """The crowded cells of one share of the hash space."""

    share: int
    shares: int
    cells: int
    bitmaps: DataFrame

    def mark(self, rows: DataFrame) -> DataFrame:
        """The rows of this share (by their ``h1``) with ``may_repeat``."""
        return _may_repeat(_share(rows, self.share, self.shares), self.bitmaps, "h1", self.cells)


def _share(rows: DataFrame, share: int, shares: int) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64(F.lit(7), "h1"), F.lit(shares)) == share)


def sketches(hashes: DataFrame, max_cells: int = MAX_CELLS) -> list[Sketch]:
    """Counting Bloom filters of the rows' ``h1``, as many as it takes to give each row CELLS_PER_ROW cells."""
    total = hashes.count()
    shares = max(1, -(-total * CELLS_PER_ROW // max_cells))
    cells = BUCKET
    while cells < min(max_cells, total * CELLS_PER_ROW // shares):
        cells *= 2
    return [
        Sketch(share, shares, cells, written(crowded(_share(hashes.select("h1"), share, shares), "h1", cells), "crowded-cells"))
        for share in range(shares)]


def text_hashes(text: Column) -> list[Column]:
    """128 bits that name a text beside its id."""
    return [F.xxhash64(F.lit(seed), text).alias(f"h{seed}") for seed in (1, 2)]


def first_ids(texts: DataFrame, found: Sequence[Sketch]) -> DataFrame:
    """(doc_id, h1, h2) of the smallest id of each text that may occur more than once, by comparing full texts.

    ``texts`` has doc_id (not null) and text.
    """
    hashed = texts.select("doc_id", "text", *text_hashes(F.col("text"))[:1])
    parts = [
        written(sketch.mark(hashed).where("may_repeat").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select(
            "doc_id", *text_hashes(F.col("text"))), "first-ids")
        for sketch in found]
    return reduce(DataFrame.unionByName, parts)


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], part: str = "source", max_cells: int = MAX_CELLS) -> DataFrame:
    """(part, mask, n, good, toxic): documents per set of failed filters.

    ``filters`` are failure conditions over a column ``text``; bit i belongs to the i-th of them, the last bit to copies:
    the same text under a smaller id.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())), F.lit(0))
    facts = written(rows.select("part", "doc_id", own.alias("mask"), *text_hashes(F.col("text"))), "filter-masks")
    with_id = facts.where("doc_id IS NOT NULL")
    found = sketches(with_id, max_cells)
    firsts = first_ids(rows.where("doc_id IS NOT NULL").select("doc_id", "text"), found).withColumn("first", F.lit(True))
    marked = reduce(DataFrame.unionByName, [written(sketch.mark(with_id), "marked") for sketch in found])

    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    judged = marked.join(firsts, ["doc_id", "h1", "h2"], "left").join(known, "doc_id", "left").select(
        "part", (F.col("mask") + F.when(F.col("may_repeat") & F.col("first").isNull(), 1 << len(filters)).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = facts.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return judged.unionByName(nameless).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def orders(counts: DataFrame, letters: str) -> DataFrame:
    """What each step of each order of the filters does, per part, from the counts per mask.

    Per part the counts become S[P], documents that fail no filter of the set P, for each of the 2^k sets; everything
    else is a difference of two of them.
    """
    k = len(letters)
    size = 1 << k
    dense = counts.groupBy("part").agg(*[
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(name))), F.lit(0)) for m in range(size)]).alias(name)
        for name in ("n", "good", "toxic")])
    alive = dense.select("part", F.col("n").alias("_n"), *[
        F.expr(f"transform(sequence(0, {size - 1}), p -> aggregate(sequence(0, {size - 1}), 0L, (a, m) -> a + if((m & p) = 0, {name}[m], 0L)))").alias(name)
        for name in ("n", "good", "toxic")])
    # Of the k! orders, so many have exactly the filters of a set ahead of a given one.
    weights = [factorial(bin(p).count("1")) * factorial(k - 1 - bin(p).count("1")) if p != size - 1 else 0 for p in range(size)]
    steps = alive.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(map("".join, permutations(letters)))), " "))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bit = f"shiftleft(1, cast(instr('{letters}', substring(filter_order, {{}}, 1)) as int) - 1)"
    ahead = f"aggregate(sequence(1, {k}), 0, (a, i) -> a + if(i < step, {bit.format('i')}, 0))"
    placed = steps.withColumn("own", F.expr(bit.format("step"))).withColumn("before", F.expr(ahead)).withColumn("after", F.expr("before + own"))
    shapley = f"""aggregate(sequence(0, {size - 1}), 0L, (a, p) -> a + if((p & own) = 0,
        array({', '.join(f'{w}L' for w in weights)})[p] * (n[p] - n[p + own]), 0L))"""
    return placed.select(
        "part", "filter_order", "step", F.expr("n[after]").alias("kept"), F.expr("n[before] - n[after]").alias("removed"),
        F.expr("(n[0] - n[own]) - (n[before] - n[after])").alias("redundant"), F.expr("_n[own]").alias("unique_fails"),
        F.expr("good[before] - good[after]").alias("good_lost"), F.expr("toxic[before] - toxic[after]").alias("toxic_lost"),
        F.expr(shapley).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E", part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    filters = row_filters(F.col("text")) if filters is None else filters
    return orders(masks(docs, labels, filters, part), "".join(filters) + copies)
