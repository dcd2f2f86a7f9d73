"""Repeated passages: anchors at difference-cover positions, extended to whole windows.

``COVER`` modulo ``PERIOD`` is a difference cover: for any two word positions i and j there is
a shift d < PERIOD with (i + d) and (j + d) both in the cover. Two equal windows of ``window``
words therefore share an anchor - ``window - PERIOD + 1`` words starting at a cover position
of both. Only anchors are hashed and compared over the corpus; windows around a repeated
anchor are extended to the full ``window`` words and compared by a 96-bit hash.

Comparison happens in one shuffle per step. A hash that occurs more than once within an Arrow
batch is known to be repeated on the spot: its places leave under a spread-out key, and one
mark per batch tells the others. So no hash sends more than one row per batch to its task.

Defined results: a null text has no words and an empty kept text. A row's identity is its
doc_id and text; two rows equal in both repeat each other, so their windows go in both. A null
doc_id is a value like any other. Extra columns are ignored. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from assayline.llm.common import Memo, hash64, rolling, short_text_key, signed, texts, word_hashes

# {0, 1, 4, 14, 16} is a perfect difference set: its 20 differences are all residues of 21 but 0.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
BASE, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
SPREAD = 1 << 20


def _first_of_each(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs more than once, is the first place of its hash) per place."""
    _, first, inverse, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    lead = np.zeros(len(hashes), bool)
    lead[first] = True
    return count[inverse] > 1, lead


def _nullable(values: np.ndarray, missing: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=missing)


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    """(anchor, salt, doc_id, tk, pos): salt > 0 is already known to be repeated, a null pos is a mark."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, cover = Memo(hash64), np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        for batch in batches:
            found, places, rows = [], [], []
            for row, text in enumerate(texts(batch)):
                words = (text or b"").split()
                if len(words) < width + PERIOD - 1:
                    continue
                hashes = rolling(word_hashes(words, memo), width, BASE) >> np.uint64(16)  # 48 bits: chance hits only add candidates
                places.append(np.flatnonzero(np.resize(cover, len(hashes))))
                found.append(hashes[places[-1]])
                rows.append(np.full(len(places[-1]), row))
            if not found:
                continue
            anchor, pos, row = np.concatenate(found), np.concatenate(places), np.concatenate(rows)
            again, lead = _first_of_each(anchor)
            mark = np.flatnonzero(again & lead)
            take = np.concatenate([np.arange(len(anchor)), mark])
            is_mark = np.arange(len(take)) >= len(anchor)
            salt = np.where(again[take] & ~is_mark, 1 + (pos[take] + row[take]) % SPREAD, 0)
            owner = pa.array(row[take], pa.int64(), mask=is_mark)
            yield pa.RecordBatch.from_arrays(
                [signed(anchor[take]), pa.array(salt, pa.int32()), batch.column("doc_id").take(owner),
                 batch.column("tk").take(owner), _nullable(pos[take].astype(np.int32), is_mark, pa.int32())],
                ["anchor", "salt", "doc_id", "tk", "pos"],
            )

    return docs.mapInArrow(emit, "anchor long, salt int, doc_id long, tk long, pos int")


def _windows(docs: DataFrame, window: int, width: int) -> DataFrame:
    """Windows around repeated anchors: (h1, h2, salt, doc_id, tk, pos).

    pos holds the first window and, in its lower half, the number of windows: one long is half the shuffle of
    two columns. salt 0: one window to compare, or a mark (null pos). salt > 0: a run of windows known to be repeated.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, unpack = Memo(hash64), zstandard.ZstdDecompressor()
        for batch in batches:
            one, two, starts, rows = [], [], [], []
            anchored = batch.column("anchors")
            offsets, flat = anchored.offsets.to_numpy(), anchored.values.to_numpy()
            for row, packed in enumerate(batch.column("packed").to_pylist()):
                at = flat[offsets[row]: offsets[row + 1]]
                if not len(at):
                    continue
                ids = word_hashes(unpack.decompress(packed).split(), memo)
                near = np.zeros(len(ids) - window + 2, np.int32)
                np.add.at(near, np.maximum(at + width - window, 0), 1)
                np.add.at(near, np.minimum(at, len(near) - 2) + 1, -1)
                start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                one.append(rolling(ids, window, BASE)[start])
                two.append(rolling(ids * np.uint64(OTHER), window, OTHER)[start] >> np.uint64(32))
                starts.append(start)
                rows.append(np.full(len(start), row))
            if not one:
                continue
            h1, h2, start, row = (np.concatenate(x) for x in (one, two, starts, rows))
            both = np.empty(len(h1), [("a", np.uint64), ("b", np.uint64)])
            both["a"], both["b"] = h1, h2
            again, lead = _first_of_each(both)
            single, mark = np.flatnonzero(~again), np.flatnonzero(again & lead)
            known = np.flatnonzero(again)
            new_run = np.ones(len(known), bool)
            new_run[1:] = (np.diff(start[known]) != 1) | (np.diff(row[known]) != 0)
            run_at = np.flatnonzero(new_run)
            run_length = np.diff(np.append(run_at, len(known)))
            take = np.concatenate([single, mark, known[run_at]])
            kind = np.repeat([0, 1, 2], [len(single), len(mark), len(run_at)])
            zero = np.uint64(0)
            length = np.concatenate([np.ones(len(single) + len(mark), np.int64), run_length])
            owner = pa.array(row[take], pa.int64(), mask=kind == 1)
            yield pa.RecordBatch.from_arrays(
                [signed(np.where(kind == 2, zero, h1[take])), pa.array(np.where(kind == 2, zero, h2[take]).astype(np.uint32).view(np.int32)),
                 pa.array(np.where(kind == 2, 1 + (start[take] + row[take]) % SPREAD, 0), pa.int32()),
                 batch.column("doc_id").take(owner), batch.column("tk").take(owner),
                 _nullable(start[take].astype(np.int64) << 32 | length, kind == 1, pa.int64())],
                ["h1", "h2", "salt", "doc_id", "tk", "pos"],
            )

    return docs.mapInArrow(emit, "h1 long, h2 int, salt int, doc_id long, tk long, pos long")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            runs = batch.column("runs").to_pylist()
            for packed, own in zip(batch.column("packed").to_pylist(), runs):
                words = unpack.decompress(packed).split()
                sizes.append(len(words))
                merged: list[list[int]] = []
                for first, length in ((run >> 32, run & 0xFFFFFFFF) for run in sorted(own or ())):
                    end = first + length - 1 + window
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([first, end])
                left, at = [], 0
                for first, end in merged:
                    left += words[at:first]
                    at = end
                left += words[at:]
                removed.append(len(words) - len(left))
                spans.append([{"first": a, "end": b} for a, b in merged])
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept_text"],
            )

    return docs.mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, spans array<struct<first: int, end: int>>, kept_text string")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, packed): texts compressed, so that they pass shuffles at a fraction of their size."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [small.compress(text or b"") for text in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tk"), pa.array(packed, pa.binary())], ["doc_id", "tk", "packed"])

    return docs.mapInArrow(pack, "doc_id long, tk long, packed binary")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, spans of removed words [first, end), kept_text.

    Removed is every word covered by a window of ``window`` words whose word sequence also
    starts somewhere else in the corpus, the same document included. Needs window >= 25.
    """
    width = window - PERIOD + 1
    if width < 5:
        raise ValueError(f"a window needs at least {PERIOD + 4} words")
    docs = docs.select("doc_id", "text").withColumn("tk", short_text_key(F.col("text")))
    keys = ["id_key", "no_id", "tk"]  # a null id meets a null id

    def keyed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("id_key", F.coalesce("doc_id", F.lit(0))).withColumn("no_id", F.col("doc_id").isNull())

    def known(frame: DataFrame, *group: str) -> DataFrame:
        """The places of values that occur more than once, by document."""
        times = F.count("*").over(Window.partitionBy(*group, "salt"))
        return keyed(frame.withColumn("times", times).where("pos IS NOT NULL AND (salt > 0 OR times > 1)")).groupBy(*keys)

    repeated = known(_anchors(docs, width), "anchor").agg(F.collect_set("pos").alias("anchors"))
    # Both joins keep every document, so that they share one shuffle of the texts.
    packed = keyed(_packed(docs))
    around = packed.join(repeated, keys, "left").select("doc_id", "tk", "packed", "anchors")
    runs = known(_windows(around, window, width), "h1", "h2").agg(F.collect_set("pos").alias("runs"))
    return _cut(packed.join(runs, keys, "left").select("doc_id", "packed", "runs"), window)
