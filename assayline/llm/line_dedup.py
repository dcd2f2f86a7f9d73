"""Line deduplication within one word edit: a deletion-neighbourhood join.

Lines are compared as sequences of words (A-Z lower-cased). A line goes if an earlier line is
equal to it, or, for lines of ``near_words`` words and more, if an earlier line becomes equal by
inserting, removing or replacing one word. Earlier means a smaller (doc_id, text digest,
line number). Lines below ``least_words`` words are left alone.

Equal lines are first folded into classes. Two lines within one edit share a variant: the words
around one gap (a replaced word), or one line as it is and the other without a word. A hashed
key (gap position, words before, words after) stands for each variant, so all lines that share a
key are within one edit of each other, and comparing each with the earliest loses nothing.
To spare most lines the emission of all their variants, coarser gaps come first: halves, then
eighths of a line. A line goes on to the next step, in that part, only if its remainder is shared.
The last step emits every variant of those parts, and each removal is verified on the words.

Defined results: a null text stays null, an empty one empty. A null doc_id comes last. Rows equal
in doc_id and text count as one document and keep the same lines. Line breaks are ``\\n``; kept
lines stay unchanged, with all other columns. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T
from xxhash import xxh3_64_intdigest

from assayline.llm.common import Memo, lean, mixed, portions, signed, text_key, texts, word_hashes, written

STEPS = (2, 8)  # parts per line in the coarse steps
WORDS_AT_ONCE, LINES_AT_ONCE = 300_000, 5000  # hashed together
ODD, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
BLOCK, LONG_WORD = 1 << 16, 128  # bytes hashed together; longer words are hashed one by one
# A value per byte, the same for a letter A-Z and its small one; none for white space.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
BYTES[ord("A"): ord("Z") + 1] = BYTES[ord("a"): ord("z") + 1]
BYTES[list(b" \t\n\r\x0b\x0c")] = 0
PLACES = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(LONG_WORD - 1, OTHER, np.uint64), dtype=np.uint64)])


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return (data == ord(" ")) | (data - np.uint8(9) < 5)


def line_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text that ends with a line break: 64-bit hashes of its words (A-Z lower-cased), words per line, and where the line breaks are.

    A word's hash is the sum of its bytes' values times OTHER ** place, made for all words of a block at once.
    """
    data, at = np.frombuffer(text, np.uint8), 0
    ids, ends, breaks = [], [], []
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        while stop < len(data):  # a block ends behind white space
            gaps = np.flatnonzero(white(data[stop: stop + BLOCK]))
            stop = stop + int(gaps[0]) + 1 if len(gaps) else min(stop + BLOCK, len(data))
            if len(gaps):
                break
        part = data[at: stop]
        edge = np.ones(len(part) + 2, bool)
        edge[1:-1] = white(part)
        change = np.flatnonzero(edge[1:] != edge[:-1])
        first, last = change[::2], change[1::2]
        if len(first):
            place = np.arange(first[0], len(part)) - np.repeat(first, np.diff(first, append=len(part)))
            sums = np.zeros(len(place) + 1, np.uint64)
            np.cumsum(BYTES.take(part[first[0]:], mode="clip") * PLACES.take(place, mode="clip"), out=sums[1:])
            made = mixed(sums[last - first[0]] - sums[first - first[0]] + (last - first).astype(np.uint64) * np.uint64(ODD))
            for word in np.flatnonzero(last - first > LONG_WORD):
                made[word] = xxh3_64_intdigest(text[at + first[word]: at + last[word]].lower())
            ids.append(made)
            ends.append(at + last)
        breaks.append(at + np.flatnonzero(part == ord("\n")))
        at = stop
    none = np.zeros(0, np.int64)
    breaks = np.concatenate([none, *breaks])
    upto = np.searchsorted(np.concatenate([none, *ends]), breaks, "right")
    return np.concatenate([none.astype(np.uint64), *ids]), np.diff(upto, prepend=0), breaks


class LineHashes:
    """Hashes of all beginnings and all ends of a line's words."""

    def __init__(self, ids: np.ndarray, base: int):
        powers = np.full(len(ids), base, np.uint64)
        powers[:1] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        zero = np.zeros(1, np.uint64)
        self.before = mixed(np.concatenate([zero, np.cumsum(ids * powers, dtype=np.uint64)]))
        self.after = mixed(np.concatenate([zero, np.cumsum(ids[::-1] * powers, dtype=np.uint64)]) + np.uint64(base))

    def keys(self, start: np.ndarray, rest: np.ndarray, tag: int) -> np.ndarray:
        """Keys of "the first ``start`` words, a gap, the last ``rest`` words"."""
        place = start.astype(np.uint64) * np.uint64(OTHER) + rest.astype(np.uint64) + np.uint64(tag << 56)
        return mixed((self.before[start] ^ mixed(place)) * np.uint64(ODD) + self.after[rest])


@dataclass
class Coarse:
    """Of many lines: a 128-bit hash each, and per left-out part a key and the gap [start, end)."""

    h1: np.ndarray
    h2: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def coarse(ids: np.ndarray, size: np.ndarray, parts: int) -> Coarse:
    """Hashes and coarse keys of many lines at once; ``ids`` holds the words of all lines in a row.

    The cuts between parts depend on a length only. A line uses those for its own length and, as the
    longer of two that differ by one word, those for one word less. Beginnings and ends of a line are
    differences of running sums of word * ODD ** place.
    """
    end = np.cumsum(size)
    start = end - size
    place = np.arange(len(ids)) - np.repeat(start, size)
    powers = np.full(int(size.max(initial=0)) + 1, ODD, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    zero = np.zeros(1, np.uint64)
    before = np.concatenate([zero, np.cumsum(ids * powers[place], dtype=np.uint64)])
    after = np.concatenate([zero, np.cumsum(ids * powers[np.repeat(size, size) - 1 - place], dtype=np.uint64)])
    other = np.concatenate([zero, np.cumsum(mixed(ids ^ np.uint64(OTHER)) * powers[place], dtype=np.uint64)])
    h1 = mixed(before[end] - before[start] + size.astype(np.uint64))
    h2 = mixed(other[end] - other[start] ^ np.uint64(OTHER))
    keys, starts, ends = [], [], []
    for grid in (size, size - 1):
        for part in range(parts):
            first, rest = part * grid // parts, grid - (part + 1) * grid // parts
            left = mixed(before[start + first] - before[start] + first.astype(np.uint64) * np.uint64(OTHER))
            right = mixed(after[end] - after[end - rest] + rest.astype(np.uint64))
            keys.append(mixed(left * np.uint64(ODD) + right + (grid * 64 + parts).astype(np.uint64) * np.uint64(OTHER)))
            starts.append(first)
            ends.append(size - rest)
    return Coarse(h1, h2, *(np.stack(x, axis=1) for x in (keys, starts, ends)))


def _lines(docs: DataFrame, least_words: int, near_words: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, limit=1 << 20):
            values = [text or b"" for text in texts(batch)]
            stops = np.cumsum(np.fromiter((len(v) + 1 for v in values), np.int64, len(values)))  # behind each text's last line break
            ids, sizes, breaks = line_words(b"\n".join([*values, b""]))
            row = np.searchsorted(stops, breaks, "right")
            number = np.arange(len(breaks)) - np.searchsorted(breaks, stops - np.diff(stops, prepend=0))[row]
            upto = np.cumsum(sizes)
            at = 0
            while at < len(sizes):
                before = int(upto[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(upto, before + WORDS_AT_ONCE, "right")))
                some = at + np.flatnonzero(sizes[at: stop] >= least_words)
                if len(some):
                    words = ids[before: int(upto[stop - 1])][np.repeat(sizes[at: stop] >= least_words, sizes[at: stop])]
                    made = coarse(words, sizes[some], STEPS[0])
                    long_enough = sizes[some] >= near_words
                    offsets = np.concatenate([[0], np.cumsum(long_enough * made.keys.shape[1])]).astype(np.int32)
                    owner = pa.array(row[some])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(owner), batch.column("tk").take(owner), pa.array(number[some], pa.int32()),
                         signed(made.h1), signed(made.h2),
                         pa.ListArray.from_arrays(pa.array(offsets), signed(made.keys[long_enough].ravel()))],
                        ["doc_id", "tk", "line", "h1", "h2", "keys"])
                at = stop

    return docs.mapInArrow(lean(emit), "doc_id long, tk long, line int, h1 long, h2 long, keys array<long>")


def _parts(lines: DataFrame, parts: int) -> DataFrame:
    """(key, node, start, end) per left-out part of each line."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxh3_64_intdigest)
        for batch in batches:
            for at in range(0, batch.num_rows, LINES_AT_ONCE):
                some = batch.slice(at, LINES_AT_ONCE)
                words = [line.lower().split() for line in texts(some, "line")]
                size = np.array([len(w) for w in words], np.int64)
                made = coarse(word_hashes([w for line in words for w in line], memo), size, parts)
                owner = np.repeat(np.arange(len(size)), 2 * parts)
                yield pa.RecordBatch.from_arrays(
                    [signed(made.keys.ravel()), some.column("node").take(pa.array(owner)), pa.array(made.starts.ravel(), pa.int32()),
                     pa.array(made.ends.ravel(), pa.int32())], ["key", "node", "start", "end"])

    return lines.mapInArrow(lean(emit), "key long, node long, start int, end int")


def _variants(lines: DataFrame) -> DataFrame:
    """(k1, k2, node) for every variant of the parts (``gaps``) of each line."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxh3_64_intdigest)
        for batch in batches:
            owners, ones, twos = [], [], []
            gaps = batch.column("gaps").to_pylist()
            for row, line in enumerate(texts(batch, "line")):
                ids = word_hashes(line.lower().split(), memo)
                one, two, length = LineHashes(ids, ODD), LineHashes(ids * np.uint64(OTHER), OTHER), len(ids)
                at = np.unique(np.concatenate([np.arange(g["start"], g["end"] + 1) for g in gaps[row]]))
                gap = at[at < length]
                start, rest = np.concatenate([gap, at]), np.concatenate([length - 1 - gap, length - at])
                owners.append(np.full(len(start), row))
                ones.append(one.keys(start, rest, 1))
                twos.append(two.keys(start, rest, 1))
            if owners:
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate(ones)), signed(np.concatenate(twos)), batch.column("node").take(pa.array(np.concatenate(owners)))],
                    ["k1", "k2", "node"])

    return lines.mapInArrow(lean(emit), "k1 long, k2 long, node long")


def within_one_edit(one: list, other: list) -> bool:
    """Whether two word sequences are equal up to one inserted, removed or replaced word."""
    if abs(len(one) - len(other)) > 1:
        return False
    short = min(len(one), len(other))
    front = next((i for i in range(short) if one[i] != other[i]), short)
    back = next((i for i in range(short - front) if one[-1 - i] != other[-1 - i]), short - front)
    return front + back >= max(len(one), len(other)) - 1


def _verified(pairs: DataFrame) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one_edit(a.lower().split(), b.lower().split()) for a, b in zip(texts(batch, "line"), texts(batch, "earlier"))]
            yield batch.select(["node"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(lean(check), "node long")


def _order(doc_id: str = "doc_id") -> Column:
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col("tk"), F.col("line"))


def _pick_lines(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, line): the text of wanted lines (node, doc_id, tk, line) out of packed texts."""
    kind = pa.list_(pa.struct([("line", pa.int32()), ("node", pa.int64())]))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            nodes, found = [], []
            for packed, picks in zip(batch.column("packed").to_pylist(), batch.column("picks").cast(kind).to_pylist()):
                lines = unpack.decompress(packed).split(b"\n")
                for want in picks:
                    nodes.append(want["node"])
                    found.append(lines[want["line"]].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.string())], ["node", "line"])

    by_doc = wanted.groupBy(F.coalesce("doc_id", F.lit(0)).alias("id_key"), F.col("doc_id").isNull().alias("no_id"), "tk").agg(
        F.collect_set(F.struct("line", "node")).alias("picks"))
    return store.join(by_doc, ["id_key", "no_id", "tk"]).select("packed", "picks").mapInArrow(
        pick, "node long, line string").dropDuplicates(["node"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("id_key", F.coalesce("doc_id", F.lit(0))).withColumn("no_id", F.col("doc_id").isNull())


def packed(docs: DataFrame) -> DataFrame:
    """The rows with the column text replaced by its compressed form ``packed`` (null stays null)."""
    fields = [field for field in docs.schema.fields if field.name != "text"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=5)
        for batch in portions(batches):
            values = [None if text is None else small.compress(text) for text in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array(values, pa.binary())], [*(f.name for f in fields), "packed"])

    return docs.mapInArrow(lean(pack), T.StructType([*fields, T.StructField("packed", T.BinaryType())]))


def repeated_lines(docs: DataFrame, store: DataFrame, least_words: int = 3, near_words: int = 8) -> DataFrame:
    """(doc_id, tk, lines): numbers (from 0) of the lines that repeat an earlier line; documents without any are absent.

    ``store`` holds the same texts packed, see ``deduplicate_lines``.
    """
    docs = docs.select("doc_id", "text").withColumn("tk", text_key(F.col("text")))
    lines = written(_lines(docs, least_words, near_words), "lines")
    classes = written(
        lines.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.count("*").alias("times"), F.first("keys").alias("keys"))
        .select(F.monotonically_increasing_id().alias("node"), "*"), "line-classes")
    entries = classes.select("node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1").select("key")
    hopeful = entries.join(shared, "key", "left_semi").select("node").distinct()
    wanted = classes.join(hopeful, "node", "left_semi").select("node", "first.doc_id", "first.tk", "first.line")
    texts_of = written(_pick_lines(store.where("packed IS NOT NULL"), wanted), "line-texts")

    parts = _parts(texts_of, STEPS[1])
    again = parts.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    gaps = parts.join(again, "key", "left_semi").groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias("gaps"))
    # Every variant of the parts left, each once as its place is part of its key; the earliest line of a key is the witness for the others.
    variants = written(_variants(texts_of.join(gaps, "node"))
                       .join(classes.select("node", "first"), "node"), "variants")
    earliest = variants.groupBy("k1", "k2").agg(F.min(F.struct("first", "node")).alias("least"), F.count("*").alias("holders")).where("holders > 1")
    pairs = (
        variants.join(earliest, ["k1", "k2"]).where("node != least.node")
        .select("node", F.col("least.node").alias("witness")).distinct()
        .join(texts_of, "node").join(texts_of.select(F.col("node").alias("witness"), F.col("line").alias("earlier")), "witness")
    )
    near = _verified(pairs.select("node", "line", "earlier")).distinct().withColumn("near", F.lit(True))
    repeated = (
        classes.join(near, "node", "left").where("near OR times > 1")
        .select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    gone = lines.select("doc_id", "tk", "line", "h1", "h2").join(repeated, ["h1", "h2"]).where(F.col("near") | (_order() != F.col("first")))
    return gone.groupBy("doc_id", "tk").agg(F.collect_set("line").alias("lines"))


def deduplicate_lines(docs: DataFrame, least_words: int = 3, near_words: int = 8) -> DataFrame:
    """The rows with repeated lines taken out of ``text``, and two more columns: n_lines, n_removed.

    Input columns of these names are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names if n != "text"]).alias("row"), "text", F.col("doc_id"), text_key(F.col("text")).alias("tk"))
    # Packed once: the texts are looked at again for lines that may be alike, and for the result.
    store = written(_keyed(packed(keyed)), "packed-texts")
    gone = repeated_lines(docs, store, least_words, near_words)
    marked = store.drop("doc_id").join(
        _keyed(gone).drop("doc_id"), ["id_key", "no_id", "tk"], "left").select("row", "packed", "lines")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, total, removed = [], [], []
            for data, numbers in zip(batch.column("packed").to_pylist(), batch.column("lines").to_pylist()):
                if data is None:
                    kept.append(None)
                    total.append(0)
                    removed.append(0)
                    continue
                lines, out = unpack.decompress(data).split(b"\n"), set(numbers or ())
                kept.append(b"\n".join(line for n, line in enumerate(lines) if n not in out).decode("utf-8", "replace"))
                total.append(len(lines))
                removed.append(len(out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                ["row", "text", "n_lines", "n_removed"])

    kind = T.StructType([marked.schema["row"], *T.StructType.fromDDL("text string, n_lines long, n_removed long").fields])
    return marked.mapInArrow(lean(cut), kind).select(
        *[F.col("text") if n == "text" else F.col("row")[n].alias(n) for n in names], "n_lines", "n_removed")
