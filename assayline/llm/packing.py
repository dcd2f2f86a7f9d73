"""Best-fit packing of documents into sequences by large-item matching.

Texts are tokenised in tasks; what is packed are piece lengths, and there are at most
``capacity`` different ones. The plan is therefore made from the histogram of lengths, whose
size does not grow with the corpus: pieces above a third of the capacity fit at most twice
into a sequence and are matched greedily, the longest with the longest partner that still
fits; shorter pieces go, longest first, where the remaining gap is smallest. The plan says for
each length which ranks go to which sequences at which offset; every piece finds its place by
its rank among the pieces of its length, counted in two levels so that a frequent length is
spread over many tasks.

Defined results: a null or empty text is the end token alone. A piece of a repeated row is
packed as often as it occurs. A null doc_id is a value like any other. Extra columns are
ignored. No rows in, no rows out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from assayline.llm.common import Memo, lean, portions, text_key, texts, written

RANK_GROUP = 50_000  # pieces of one length ranked together in a task
RANK_BITS = 48
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe
SPLITS_PER_TASK = 4  # input splits read by one task, so that fewer tasks meet the same rare words; never fewer tasks than cores
WORDS_KEPT = 1_000_000  # encoded chunks a task remembers, about 130 bytes each


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, tk, piece, start, length, ids_crc32.

    For tokenizers that lower-case and never join text over white space or between letters and
    punctuation: each distinct chunk between ASCII white space is encoded once per task and remembered.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)

        def chunk_ids(chunk: bytes) -> bytes:
            word = chunk.decode("utf-8", "replace")
            inner = word.strip(MARKS)
            if inner and inner != word and "<|" not in word and inner[0].isalnum() and inner[-1].isalnum():
                # The tokenizer splits between letters or digits and marks as well.
                at = word.index(inner)
                parts = (word[:at], inner, word[at + len(inner):])
                return b"".join(memo[part.encode()] for part in parts if part)
            return np.array(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

        memo, end, step = Memo(chunk_ids, WORDS_KEPT), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in portions(batches):
            rows, piece, length, crc = [], [], [], []
            for row, text in enumerate(texts(batch)):
                memo.trim()
                text = text or b""
                # The tokenizer lower-cases; doing so first makes more chunks alike. Special tokens must stay as they are.
                chunks = (text if b"<|" in text else text.lower()).split()
                data = b"".join(map(memo.__getitem__, chunks)) + end
                for number, at in enumerate(range(0, len(data), step)):
                    part = data[at: at + step]
                    rows.append(row)
                    piece.append(number)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            owner = pa.array(rows, pa.int64())
            number = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(owner), batch.column("tk").take(owner), pa.array(number, pa.int32()),
                 pa.array(number * capacity, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "tk", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(lean(encode), "doc_id long, tk long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places for all pieces of a length histogram, and the number of sequences.

    A place (length, rank, sequence, offset) holds for the ranks from this one up to the next
    place of the same length; rank + i goes to sequence + i.
    """
    places: list[tuple[int, int, int, int]] = []
    placed: dict[int, int] = defaultdict(int)
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, how many alike)
    gaps: list[int] = []
    sequences = 0

    def put(length: int, first: int, n: int, offset: int) -> None:
        places.append((length, placed[length], first, offset))
        placed[length] += n

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not bins[gap]:
                insort(gaps, gap)
            bins[gap].append((first, n))

    left = dict(counts)
    large = sorted(size for size in left if 3 * size > capacity)
    for size in reversed(large):
        while left[size]:
            place = bisect_right(large, capacity - size) - 1
            while place >= 0 and left[large[place]] < 1 + (large[place] == size):
                place -= 1
            partner = large[place] if place >= 0 else 0
            if partner == size:
                n = left[size] // 2
                left[size] -= 2 * n
            elif partner:
                n = min(left[size], left[partner])
                left[size] -= n
                left[partner] -= n
            else:
                n, left[size] = left[size], 0
            put(size, sequences, n, 0)
            if partner:
                put(partner, sequences, n, size)
            keep(capacity - size - partner, sequences, n)
            sequences += n

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        rest = left[size]
        while rest:
            place = bisect_left(gaps, size)
            if place < len(gaps):
                gap = gaps[place]
                first, n = bins[gap].pop()
                if not bins[gap]:
                    gaps.pop(place)
            else:
                gap, n = capacity, -(-rest // (capacity // size))
                first, sequences = sequences, sequences + n
            each = gap // size
            full = min(n, rest // each)
            if full:
                for k in range(each):
                    put(size, first, full, capacity - gap + k * size)
                keep(gap - each * size, first, full)
                rest -= each * full
            if full < n:
                if rest and rest < each:
                    for k in range(rest):
                        put(size, first + full, 1, capacity - gap + k * size)
                    keep(gap - rest * size, first + full, 1)
                    full, rest = full + 1, 0
                keep(gap, first + full, n - full)
    return places, sequences


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than ``capacity`` tokens are cut, at every ``capacity`` tokens.
    """
    splits = docs.rdd.getNumPartitions()
    tasks = max(-(-splits // SPLITS_PER_TASK), min(splits, docs.sparkSession.sparkContext.defaultParallelism))
    docs = docs.select("doc_id", "text").withColumn("tk", text_key(F.col("text"))).coalesce(max(tasks, 1))
    pieces = written(tokenised(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = pieces.groupBy("length").count()
    counts = {row["length"]: row["count"] for row in histogram.collect()}  # at most ``capacity`` rows
    places, _ = plan(counts, capacity)
    places.sort()
    table = pieces.sparkSession.sparkContext.broadcast((
        np.array([(length << RANK_BITS) + rank for length, rank, _, _ in places], np.int64),
        np.array([p[2] for p in places], np.int64), np.array([p[3] for p in places], np.int64)))

    groups = histogram.select("length", F.ceil(F.col("count") / RANK_GROUP).alias("groups"))
    salted = pieces.join(F.broadcast(groups), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "tk"), F.col("groups")))
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "tk")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = salted.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ranked = salted.withColumn("own", F.row_number().over(inner) - 1).join(ahead, ["length", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequence, offset = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            wanted = (batch.column("length").to_numpy() << RANK_BITS) + batch.column("rank").to_numpy()
            at = np.searchsorted(keys, wanted, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence[at] + wanted - keys[at], pa.int64()), pa.array(offset[at], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("ahead")).alias("rank")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
