"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line; its digest is a SHA-256 prefix. A section ends after a paragraph whose
digest starts with 0 or 1 - about every eighth - so sections depend on content, not on position,
and an inserted paragraph changes only its own section. Section digests cover their
paragraphs' digests, the root covers the sections. Equal roots mean equal texts; where roots
differ, the differing sections and in them the differing paragraphs locate the edits. Below
the paragraphs the fingerprint keeps short digests of pieces of sentences, so that the
likeness of two fingerprints is seen also where a paragraph is only partly the same.

A fingerprint is text: ``root:sections:paragraphs:pieces``, the lists separated by spaces.

DataFrame functions only. Defined results: a null text counts as empty; an empty text has one
empty paragraph and no pieces. Two texts without pieces are alike (1.0) if equal, else 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DIGEST, PIECE_DIGEST = 32, 8  # hex digits
PIECE = r"[^.!?\n]{1,120}[.!?]*"
BOUNDS = 64
BUCKET_ROWS = 2000


def _digest(value: Column, digits: int = DIGEST) -> Column:
    return F.substring(F.sha2(value, 256), 1, digits)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.transform(F.split(text, "\n", -1), lambda p: _digest(p))
    marked = F.array_join(F.transform(paragraphs, lambda p: F.when(F.substring(p, 1, 1).isin("0", "1"), F.concat(p, F.lit("/"))).otherwise(p)), " ")
    sections = F.transform(F.filter(F.split(marked, "/ ?", -1), lambda s: s != ""), lambda s: _digest(s))
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda piece: _digest(piece, PIECE_DIGEST))
    sections = F.array_join(sections, " ")
    return F.concat_ws(":", F.sha2(sections, 256), sections, F.replace(marked, F.lit("/"), F.lit("")), F.array_join(pieces, " "))


def level(print_: Column, number: int) -> Column:
    """The digests of one level: 1 sections, 2 paragraphs, 3 pieces."""
    return F.filter(F.split(F.split(print_, ":")[number], " "), lambda d: d != "")


def likeness(one: Column, other: Column) -> Column:
    """Dice likeness of the different pieces of two fingerprints, 0 to 1; 1 for equal roots."""
    first, second = F.array_distinct(level(one, 3)), F.array_distinct(level(other, 3))
    total = F.size(first) + F.size(second)
    return F.when(F.substring_index(one, ":", 1) == F.substring_index(other, ":", 1), F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(
        2.0 * F.size(F.array_intersect(first, second)) / total)


def edited_paragraphs(one: Column, other: Column) -> Column:
    """Positions (from 1) of paragraphs of ``one`` that ``other`` lacks; empty where the roots are equal."""
    own = level(one, 2)
    return F.when(F.substring_index(one, ":", 1) == F.substring_index(other, ":", 1), F.array().cast("array<bigint>")).otherwise(
        F.transform(F.array_except(own, level(other, 2)), lambda digest: F.array_position(own, digest)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the next document by descending doc_id; after the last, the first.

    Null texts become empty. Null ids come last; rows of one id are ordered by text digest. Rows
    meet their neighbours in buckets of ids: quantiles of the ids, cut evenly so that a bucket
    has about BUCKET_ROWS rows. Only the first row of a bucket is needed by another bucket.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / BOUNDS for i in range(BOUNDS + 1)]
    facts = docs.agg(F.count("*").alias("rows"), F.percentile_approx("doc_id", shares, 10_000).alias("bounds")).first()
    bounds = sorted(set(facts["bounds"] or [0]))
    cuts = facts["rows"] // (BOUNDS * BUCKET_ROWS) + 1
    at = sum((F.when(F.col("doc_id") >= b, 1).otherwise(0) for b in bounds[1:]), F.lit(0))
    low = F.element_at(F.array(*map(F.lit, bounds)), at + 1)
    high = F.element_at(F.array(*map(F.lit, [*bounds[1:], bounds[-1] + 1])), at + 1)
    # In doubles, so that ids far apart do not overflow; rising with doc_id, which is all that matters.
    wide = F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0))
    inside = F.floor((F.col("doc_id").cast("double") - low.cast("double")) / wide * cuts)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at * cuts + F.least(F.greatest(inside, F.lit(0)), F.lit(cuts - 1)))
    bucketed = docs.withColumn("bucket", bucket.cast("long"))

    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.sha2("text", 256))
    rows = bucketed.select(
        "*", F.lead("text").over(order).alias("following"), F.row_number().over(order).alias("place"))
    heads = rows.where("place = 1").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("head"))
    used = bucketed.select("bucket").distinct()  # one row per bucket
    downward = Window.orderBy(F.desc("bucket"))
    follows = used.select(
        "bucket", F.coalesce(F.lead("bucket").over(downward), F.max("bucket").over(Window.partitionBy())).alias("next_bucket"))
    return rows.join(follows.join(heads, "next_bucket").select("bucket", "head"), "bucket").select(
        "doc_id", "text", F.coalesce("following", "head").alias("next_text"))
