"""Merkle manifest of a dataset by time-forward processing: one tree per group, one over the groups, a proof per row.

Leaves of a group stand in order; while a level has several nodes, every ``ARITY`` consecutive ones become their hash. A node's
label is (level, place), and a node needs its children's digests before its parent needs its own: time-forward processing.
Spark's sort by (group, block, place) is the external priority queue between blocks of ``ARITY ** HEIGHT`` consecutive nodes;
inside a block a heap ordered by label delivers each digest to the parent's label, so nodes are met in the order in which
they are due. A sweep of the blocks gives the block roots, which are the nodes of the next round; 3 * 10^10 leaves take three rounds.
The reversed sweep starts at the root and hands every node's proof suffix down to its children, block by block, until the leaves have
theirs; a leaf's proof is then hashed and its root recomputed on the spot. A row meets the shuffle once on its way up, packed in
its block on its way down. No task holds more than one block, and no key owns more than one block's rows, whatever a group's share.

Places are counted in two levels: rows are sorted by range once, and the sizes of the sorted pieces (one row per piece and
group, far fewer than rows) give each piece its start.

Defined results: a null in a field is written ``-`` and hashed like any value; a null group comes first, then groups bytewise. A
null id comes first within its group and is never tampered with. Rows of one id are ordered by leaf digest; equal rows have a place
each. A single leaf is its group's root, a single group's root is the root. No rows in, no rows out. Columns are read by name; others
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayline.llm.common import written

ARITY, HEIGHT = 8, 4
BLOCK = ARITY**HEIGHT
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as UTF-8 byte count, colon, value; null as a dash."""
    texts = [field.cast("string") for field in fields]
    return F.sha2(F.concat(*[
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def digest(texts: Sequence[str]) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def levels(width: int) -> int:
    """Levels above ``width`` nodes until one is left, at most HEIGHT."""
    above = 0
    while width > 1 and above < HEIGHT:
        width, above = -(-width // ARITY), above + 1
    return above


def upward(digests: list[str], above: int) -> list[list[str]]:
    """The block's levels, leaves first: ``above`` levels over the digests, by a heap ordered by node label.

    The label of a node is (level, place); an entry is a child's digest sent to its parent's label.
    """
    made = [digests] + [[] for _ in range(above)]
    queue = [(1, place // ARITY, place, d) for place, d in enumerate(digests)] if above else []
    heapq.heapify(queue)
    while queue:
        level, place = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, place):
            children.append(heapq.heappop(queue)[3])
        own = digest(children)
        made[level].append(own)
        if level < above:
            heapq.heappush(queue, (level + 1, place // ARITY, place, own))
    return made


def downward(made: list[list[str]], suffix: str) -> list[str]:
    """Each leaf's path to the root: the reversed sweep, in which a node hands its path on to its children.

    A path lists, level by level, ``place in the run:siblings``; levels are separated by a slash.
    """
    paths = [suffix]
    for level in range(len(made) - 2, -1, -1):
        nodes, below = made[level], []
        for place in range(len(nodes)):
            parent, own = divmod(place, ARITY)
            run = nodes[parent * ARITY: parent * ARITY + ARITY]
            step = f"{own}:{''.join(run[:own] + run[own + 1:])}"
            below.append(f"{step}/{paths[parent]}" if paths[parent] else step)
        paths = below
    return paths


def proof(path: str) -> list[str]:
    """The siblings along a path, left to right, level by level."""
    return [step.partition(":")[2] for step in path.split("/") if step]


def folded(start: str, path: str) -> str:
    """The root that a leaf digest and the siblings of its path lead to."""
    for step in path.split("/") if path else ():
        place, _, siblings = step.partition(":")
        cut = 64 * int(place)
        start = digest([siblings[:cut], start, siblings[cut:]])
    return start


def ranked(rows: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """The rows with ``place`` (from 0 by ``order`` within ``by``) and ``width`` (rows of that ``by``), counted in two levels.

    The rows are sorted by range, key and order together, so that a hot key spans many pieces, and written.
    """
    keys = [F.col(by).asc_nulls_first(), *[F.col(name).asc_nulls_first() for name in order]]
    pieces = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_piece", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id())
    pieces = written(pieces, "sorted-rows")
    before = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy(F.col(by).alias("_by"), F.col("_piece").alias("_of")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n")).select(
        "_by", "_of", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_by")).alias("width"))
    same = F.col("_piece").eqNullSafe(F.col("_of")) & F.col(by).eqNullSafe(F.col("_by"))
    return pieces.join(starts, same).withColumn("place", F.col("_at") - F.col("_from") + F.col("_before")).drop("_piece", "_at", "_by", "_of", "_from", "_before")


NODE = "tree string, block long, place long, width long, digest string, id long, carried string"
PATH = "path string, subroot string, root string"
ROOTS = "tree string, place long, width long, digest string"
FOUND = f"tree string, place long, digest string, id long, carried string, {PATH}"
PROVED = "id long, digest string, subroot string, root string, proof_sha256 string, folded_root string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of one (tree, block) after the other, from batches sorted by tree, block and place."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if key != row[:2]:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield key, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schema(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(","))])


def _sweep_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block roots, as nodes of the next round: rows of ROOTS."""
    def roots():
        for (tree, block), rows in _blocks(batches):
            width = rows[0][3]
            yield tree, block, -(-width // BLOCK), upward([row[4] for row in rows], levels(width))[-1][0]

    return _batches(roots(), _schema(ROOTS))


def _sweep_down(leaves: bool):
    """Paths of a block's nodes from the path of its root, which stands before them; without one the block's root is the root.

    Inner nodes keep their path (rows of FOUND); leaves use it up (rows of PROVED).
    """
    def found(batches):
        for (tree, _), rows in _blocks(batches):
            above, subroot, root = ("", None, None) if rows[0][2] >= 0 else rows[0][7:]
            nodes = rows if rows[0][2] >= 0 else rows[1:]
            made = upward([row[4] for row in nodes], levels(nodes[0][3]))
            root = root or made[-1][0]
            for row, path in zip(nodes, downward(made, above)):
                if leaves:
                    yield row[5], row[4], subroot, root, digest(proof(path)), folded(row[6], path)
                else:
                    yield tree, row[2], *row[4:7], path, subroot, root

    return lambda batches: _batches(found(batches), _schema(PROVED if leaves else FOUND))


def _in_order(nodes: DataFrame) -> DataFrame:
    """Blocks apart, each in the order of places: what the sweeps need. At most BLOCK + 1 rows share a key."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round from the leaves of all trees up, and the trees' roots."""
    rounds, widest = [nodes], nodes.agg(F.max("width")).first()[0] or 0
    while True:
        tops = written(_in_order(rounds[-1]).mapInArrow(_sweep_up, ROOTS), "block-roots")
        widest = -(-widest // BLOCK)
        if widest <= 1:
            return rounds, tops
        rounds.append(tops.select(
            "tree", F.expr(f"place div {BLOCK}").alias("block"), "place", "width", "digest", F.lit(None).cast("long").alias("id"),
            F.lit(None).cast("string").alias("carried")))


def _descend(rounds: list[DataFrame], above: DataFrame | None, leaves: bool) -> DataFrame:
    """The reversed sweep through the rounds, last first. ``above``: (tree, block, path, subroot, root) of the trees' roots, if they have parents."""
    for number, nodes in reversed(list(enumerate(rounds))):
        for name in ("path", "subroot", "root"):
            nodes = nodes.withColumn(name, F.lit(None).cast("string"))
        if above is not None:
            sent = above.select(
                "tree", "block", F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("width"), F.lit(None).cast("string").alias("digest"),
                F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("carried"), "path", "subroot", "root")
            nodes = nodes.unionByName(sent)
        last = leaves and number == 0
        result = _in_order(nodes).mapInArrow(_sweep_down(last), PROVED if last else FOUND)
        if number:
            above = written(result.select("tree", F.col("place").alias("block"), "path", "subroot", "root"), "paths")
    return result


def _nodes(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    placed = ranked(rows, "tree", order)
    return written(placed.select(
        "tree", F.expr(f"place div {BLOCK}").alias("block"), F.col("place").cast("long"), F.col("width").cast("long"), "digest", "id", "carried"), "nodes")


def prove(leaves: DataFrame) -> DataFrame:
    """id, digest, subroot, root, proof_sha256 and folded_root of every leaf.

    ``leaves`` has tree (string, may be null), id (long, may be null), digest, and carried: the digest to fold up in its stead.
    """
    # A key that is never null and sorts bytewise with null first.
    keyed = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "tree"), F.lit("")))
    rounds, subroots = _climb(_nodes(keyed, ["id", "digest"]))
    trees = subroots.select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("id"), "digest", F.col("tree").alias("carried"))
    upper, _ = _climb(_nodes(trees, ["carried"]))
    roots = written(_descend(upper, None, leaves=False), "roots").select(
        F.col("carried").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root")
    return _descend(rounds, roots, leaves=True)


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", row_id: str = "doc_id",
    tampered: dict[str, Column] | None = None, where: Column | None = None,
) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether its leaf, with ``tampered`` fields where ``where`` holds, still folds to the root.

    ``tampered`` maps fields to what an attacker would have put there. Without it the rows' own leaves are folded.
    """
    column = {name: F.col(f"`{name}`") for name in fields}
    own = leaf(list(column.values()))
    changed = own if not tampered else F.when(F.coalesce(where, F.lit(False)), leaf([*(column | tampered).values()])).otherwise(own)
    proved = prove(docs.select(
        F.col(f"`{group}`").cast("string").alias("tree"), F.col(f"`{row_id}`").cast("long").alias("id"), own.alias("digest"), changed.alias("carried")))
    return proved.select(
        F.col("id").alias(row_id), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def lower_capitals(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, CAPITALS, CAPITALS.lower())
