"""Near-duplicate documents: one-permutation MinHash, optimal densification, banded buckets, stars.

Every document becomes the set of its distinct word shingles. Equal sets form a class. Each
class gets one sketch of ``bands * rows`` bins from a single hash of its shingles; an empty
bin borrows the value of the first filled bin in a random order of its own (optimal
densification). Classes that agree on all rows of a band share a bucket. Within a bucket
only edges to one leader are tried (a star), exactly checked on the full sets, and joined into
components. Members of buckets that are still in several components are compared across
components by an exact prefix filter, so no link is lost where a star's centre is unlike two
members that are alike. No bucket is capped.

Defined results: a null or word-less text has an empty set and is linked with nothing. A null
doc_id counts as no id: the component's smallest id ignores it, and it is never ``kept``
unless its component has no id at all. Repeated rows and equal texts share a class. Other
columns of the input are ignored. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest

from assayline.llm.common import Memo, lean, lists, mixed, portions, text_key, texts, word_hashes, written

FIRST_BANDS = 4  # the first round looks at so many bands only, which joins most copies cheaply


def shingle_set(text: bytes | None, width: int, memo: Memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z lower-cased)."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = word_hashes(words, memo)
    width = min(width, len(ids))
    found = ids[: len(ids) - width + 1] + np.uint64(width)
    for step in range(1, width):
        found = mixed(found) * np.uint64(0x9E3779B97F4A7C15) + ids[step: len(ids) - width + 1 + step]
    return np.unique(mixed(found))


class Sketch:
    """One-permutation bins of a sorted hash set, densified, folded into band keys."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows, bins = bands, rows, bands * rows
        self.edges = np.array([(b << 64) // bins for b in range(bins)], np.uint64)
        draw = np.random.default_rng(seed)
        self.place = np.stack([draw.permutation(bins) for _ in range(bins)])

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        first = np.searchsorted(shingles, self.edges)
        filled = first < np.append(first[1:], len(shingles))
        values = shingles[np.minimum(first, len(shingles) - 1)]
        if not filled.all():
            empty, full = np.flatnonzero(~filled), np.flatnonzero(filled)
            values[empty] = values[full[self.place[empty][:, full].argmin(axis=1)]]
        keys = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in values.reshape(self.bands, self.rows).T:
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
        return keys


def _signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sketch, none = Memo(xxh3_64_intdigest), Sketch(bands, rows), np.zeros(0, np.uint64)
        for batch in portions(batches):
            sizes, first, second, keys = [], [], [], []
            for text in texts(batch):
                found = shingle_set(text, width, memo)
                digest = blake2b(found.tobytes(), digest_size=16).digest()
                sizes.append(len(found))
                first.append(int.from_bytes(digest[:8], "little", signed=True))
                second.append(int.from_bytes(digest[8:], "little", signed=True))
                keys.append(sketch.band_keys(found) if len(found) else none)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tk"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(second, pa.int64()), lists(keys, pa.int64())],
                ["doc_id", "tk", "n", "c1", "c2", "keys"],
            )

    return docs.mapInArrow(lean(sign), "doc_id long, tk long, n long, c1 long, c2 long, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxh3_64_intdigest)
        for batch in portions(batches):
            found = [shingle_set(text, width, memo) for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists(found, pa.int64())], ["node", "shingles"])

    return docs.mapInArrow(lean(build), "node long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected edges (a, b).

    Labels take the minimum of the neighbours' labels and then jump to their label's label, so
    stars settle in two steps and long chains in about the logarithm of their length.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        moved = written(
            lowered.join(jump, "low", "left").select("node", "was", F.least("low", "far").alias("label")), "labels"
        )
        labels = moved.select("node", "label")
        if moved.where("was != label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its group), kept, text_key.

    Linked are documents with ``100 * |A & B| >= percent * |A | B|``. At 80 percent and 32 bands
    of 5 rows a linked pair shares no bucket with probability (1 - 0.8**5)**32 = 3e-6.
    """
    docs = docs.select("doc_id", "text").withColumn("tk", text_key(F.col("text")))
    signed_docs = written(_signatures(docs, words, bands, rows), "signatures")
    classes = written(
        signed_docs.where("n > 0").groupBy("c1", "c2")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("least"),
             F.first("n").alias("n"), F.first("keys").alias("keys"))
        .select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "least.doc_id", "least.tk", "n", "keys"),
        "classes",
    )
    entries = classes.select("node", "n", F.posexplode("keys").alias("band", "bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(entries.join(shared, "bucket"), "members")
    labels = written(members.groupBy("node").agg(F.first("node").alias("label")), "labels")
    if not labels.isEmpty():
        labels = _linked(docs, classes, members, labels, words, percent)
    owner = classes.select("node", "c1", "c2", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = owner.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    group = owner.join(smallest, "label").select("c1", "c2", "component_id")
    named = signed_docs.select("doc_id", "tk", "n", "c1", "c2")
    full = named.where("n > 0").join(group, ["c1", "c2"], "left").select("doc_id", "tk", "n", "component_id")
    empty = named.where("n = 0").select("doc_id", "tk", "n", F.col("doc_id").alias("component_id"))
    return full.union(empty).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("tk").alias("text_key"),
    )


def _linked(docs: DataFrame, classes: DataFrame, members: DataFrame, labels: DataFrame, words: int, percent: int) -> DataFrame:
    """Component labels of the classes that share a bucket with another class."""
    place = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"), "tk"]
    wanted = classes.join(labels, "node", "left_semi").select("node", *place)
    sets = written(_sets(docs.select(*place, "text").join(wanted, ["place", "tk"]).dropDuplicates(["node"]).select("node", "text"), words), "sets")
    tried, least = None, F.min("node")
    for bands in (FIRST_BANDS, None):  # stars around the bucket's smallest node
        seen = (members.where(F.col("band") < bands) if bands else members).join(labels, "node")
        labels, tried = _merge(labels, _star_pairs(seen, least, percent), tried, sets, percent)
    seen = members.join(labels, "node")
    rest = seen.join(_open(seen, least), "bucket", "left_semi").select("node").distinct()
    prefixes = _prefixes(rest, sets, percent)
    # One more star around the most typical member, whose shingles most others have: it settles what can be
    # settled by a single comparison each.
    typical = prefixes.groupBy("node").agg(F.first("typical").alias("typical"))
    seen = members.join(labels, "node").join(typical, "node")
    labels, tried = _merge(labels, _star_pairs(seen, F.max_by("node", F.struct("typical", "node")), percent), tried, sets, percent)
    return _merge(labels, _rest_pairs(prefixes.join(labels, "node"), percent), tried, sets, percent)[0]


def _open(seen: DataFrame, centre: Column) -> DataFrame:
    """(bucket, node): buckets whose members are in more than one component, and their centre."""
    return (
        seen.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), centre.alias("node"))
        .where("low < high").select("bucket", "node")
    )


def _star_pairs(seen: DataFrame, centre: Column, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's centre and its members in other components, if their sizes allow a link."""
    centres = seen.join(_open(seen, centre), ["bucket", "node"]).select(
        "bucket", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"))
    return (
        seen.join(centres, "bucket").where("label_a != label")
        .where(100 * F.least("n_a", "n") >= percent * F.greatest("n_a", "n"))
        .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    )


def _merge(labels: DataFrame, pairs: DataFrame, tried: DataFrame | None, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Labels after the links among the new pairs, and all pairs tried so far."""
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    pairs = written(pairs, "pairs")
    links = written(_confirmed(pairs, sets, percent), "links")
    if not links.isEmpty():
        own = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        merged = components(links.join(own, "a").join(other, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a != b"))
        labels = written(
            labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
            .select("node", F.coalesce("root", "label").alias("label")), "labels")
    return labels, pairs if tried is None else tried.union(pairs)


def _prefixes(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, n, place, typical): the first shingles of each set in an order common to all, rare ones first.

    Two linked sets share one of the first n - ceil(percent * n / 100) + 1 shingles of either. typical:
    how many sets have a shingle of this one, on average.
    """
    shingles = sets.join(rest, "node").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    owners = shingles.groupBy("shingle").agg(F.count("*").alias("owners"))
    own = Window.partitionBy("node")
    return written(
        shingles.join(owners, "shingle")
        .withColumn("place", F.row_number().over(own.orderBy("owners", "shingle"))).withColumn("typical", F.avg("owners").over(own))
        .where((F.col("owners") > 1) & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
        .select("shingle", "node", "n", "place", "typical"), "prefixes")


def _rest_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that can still be linked, by an exact prefix filter.

    The first shingle that two sets share must leave room for the overlap they need. A shingle's
    largest component does not ask; the others ask it and each other.
    """
    largest = (
        prefix.groupBy("shingle", "label").agg(F.count("*").alias("size"))
        .groupBy("shingle").agg(F.max_by("label", F.col("size")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    )
    open_prefix = prefix.join(largest, "shingle")
    asking = open_prefix.where("label != main").select(
        "shingle", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), F.col("label").alias("label_a"))
    room = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n") - F.col("place"))
    return (
        open_prefix.join(asking, "shingle").where("label != label_a")
        .where((100 + percent) * room >= percent * (F.col("n_a") + F.col("n")))
        .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(first, "a").join(second, "b")
        .select("a", "b", (F.size("set_a") + F.size("set_b")).alias("total"), common.alias("common"))
        .where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")
    )
