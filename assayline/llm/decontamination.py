"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

Texts are compared as sequences of words (letters, digits and underscores, lower-cased). A
document leaks an item if some stretch of it turns into the item by at most
``rate`` * (words of the item) inserted, removed or replaced words.

1. So many edits leave some run of three words untouched (an item's bound is lowered until that
   holds), so every leak shares a word triple with its item. Each shared triple proposes one window
   of the document, as long as the item and aligned with it at the triple.
2. The CGK random walk embeds window and item: at each step a walk copies the word under
   its pointer and moves on or stays by a coin tossed for (step, word). Where two sequences differ
   by few edits, walks with equal coins meet again, so edit distance becomes Hamming distance.
   ``WALKS`` walks, each sampled ``SAMPLES`` times at ``BITS`` of the first ``REACH`` * m steps, give the LSH keys; a window
   that has any key in common with its item goes on. A walk is through its words after about 2 * m steps; a
   key that meets the end of a walk matches nothing.
3. The window, widened by the bound on both sides, is compared with the item exactly.

The benchmark is used in blocks of at most ``block_bytes``, each broadcast for one pass over the
documents, which are written between two passes, so nothing broadcast or held in a task grows with the data.

Defined results: null and empty texts leak nothing; null items and items below ``least_words``
words are not looked for. Every row is judged on its own, so repeated rows leak alike. Items equal
in text are all reported. No rows or no items: nothing leaks.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh3_64_intdigest

from assayline.llm.common import lean, mixed, rolling, shared, shared_value, texts, written

WORD = re.compile(r"\w+")
GRAM, BASE = 3, 0x9E3779B97F4A7C15
WALKS, SAMPLES, BITS, REACH = 10, 16, 3, 1.6
SYMBOLS = 4_000_000  # of walks held at once, 32 MB
SLICE = 4 << 20  # bytes of text handled at once
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
LEAKS = "leaks array<struct<item_id: bigint, edits: int, first_word: int, words: int>>"


class Chunks(dict):
    """Word hashes of the chunks between white space, remembered up to ``limit`` bytes: most chunks occur again and again."""

    def __init__(self, limit: int = 32 << 20):
        super().__init__()
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.hashes, self.starts, self.held = array("Q"), array("q", [0]), 0

    def __missing__(self, chunk: bytes) -> int:
        code = self[chunk] = len(self)
        inner = chunk.strip(MARKS)
        if inner.isalnum():  # ASCII letters and digits between marks
            self.hashes.append(xxh3_64_intdigest(inner.lower()))
        else:
            self.hashes.extend(xxh3_64_intdigest(w.encode()) for w in WORD.findall(chunk.decode("utf-8", "replace").lower()))
        self.starts.append(len(self.hashes))
        self.held += len(chunk) + 150
        return code

    def words(self, batch: list[bytes | None]) -> list[np.ndarray]:
        """The word hashes of each text."""
        if self.held > self.limit:
            self.forget()
        split = [(text or b"").split() for text in batch]
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        starts, hashes = np.frombuffer(self.starts, np.int64), np.frombuffer(self.hashes, np.uint64) if self.hashes else np.zeros(0, np.uint64)
        lengths = starts[codes + 1] - starts[codes]
        ends = np.cumsum(lengths)
        flat = hashes[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        ends = np.concatenate([[0], ends])[np.cumsum([len(chunks) for chunks in split])]
        del starts, hashes  # the arrays may grow again
        return np.split(flat, ends[:-1]) if split else []


def words_of(text: bytes | None, chunks: Chunks) -> np.ndarray:
    return chunks.words([text])[0]


def edit_bound(words: int, rate: float) -> int:
    """The most edits allowed: so many that a run of GRAM untouched words is certain."""
    edits = int(rate * words)
    while edits and -(-(words - edits) // (edits + 1)) < GRAM:
        edits -= 1
    return edits


class Items:
    """The items of one block: word triples, bounds, and CGK keys."""

    def __init__(self, rows: list[tuple[int, str]], rate: float, least_words: int, seed: int = 7):
        chunks = Chunks()
        found = [(item_id, words_of(text.encode(), chunks)) for item_id, text in rows]
        found = [(item_id, ids) for item_id, ids in found if len(ids) >= max(least_words, GRAM)]
        self.item_ids = [item_id for item_id, _ in found]
        self.words = [ids for _, ids in found]
        self.lengths = np.array([len(ids) for ids in self.words], np.int64)
        self.bounds = np.array([edit_bound(len(ids), rate) for ids in self.words], np.int64)
        draw = np.random.default_rng(seed)
        self.coins = mixed(draw.integers(0, 1 << 63, (int(REACH * self.lengths.max(initial=1)) + 1, WALKS), dtype=np.uint64))
        self.sampled = draw.random((WALKS, SAMPLES, BITS))
        grams = [rolling(ids, GRAM, BASE) for ids in self.words]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.gram_item, self.gram_at = item[order], at[order]
        self.keys = np.zeros((len(found), WALKS, SAMPLES), np.uint64)
        for rows_ in self.portions(np.arange(len(found))):
            padded = np.zeros((len(rows_), int(self.lengths[rows_].max())), np.uint64)
            for row, item_ in enumerate(rows_):
                padded[row, : self.lengths[item_]] = self.words[item_]
            self.keys[rows_] = self.embed(padded, self.lengths[rows_], rows_, np.uint64(0))

    def portions(self, item: np.ndarray) -> Iterator[np.ndarray]:
        """Positions in ``item``, the short items' first, in portions whose walks fit into memory."""
        order = np.argsort(self.lengths[item], kind="stable")
        symbols = WALKS * ((REACH * self.lengths[item[order]]).astype(np.int64) + 1)
        at = 0
        while at < len(order):
            # Every window of a portion takes the room of its longest, the last one.
            room = symbols[at:] * np.arange(1, len(order) - at + 1)
            n = max(1, int(np.searchsorted(room, SYMBOLS, "right")))
            yield order[at: at + n]
            at += n

    def embed(self, windows: np.ndarray, sizes: np.ndarray, item: np.ndarray, ended: np.uint64) -> np.ndarray:
        """LSH keys (window, walk, sample) of the windows, taken at the steps their items use; ``ended`` where a walk was over."""
        rows = np.arange(len(windows))[:, None]
        pointer = np.zeros((len(windows), WALKS), np.int64)
        reach = (REACH * self.lengths[item]).astype(np.int64) + 1
        steps = int(reach.max())
        walked = np.zeros((len(windows), WALKS, steps), np.uint64)
        padded = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], axis=1)
        size = np.minimum(sizes, windows.shape[1])[:, None]
        for step in range(steps):
            symbol = np.where(pointer < size, padded[rows, np.minimum(pointer, size)], np.uint64(0))
            walked[:, :, step] = symbol
            pointer += (mixed(symbol ^ self.coins[step]) & np.uint64(1)).astype(np.int64)
        place = (self.sampled[None] * reach[:, None, None, None]).astype(np.int64)
        keys = np.zeros(place.shape[:3], np.uint64)
        over = np.zeros(keys.shape, bool)
        for bit in range(BITS):
            symbol = np.take_along_axis(walked, place[..., bit], axis=2)
            over |= symbol == 0
            keys = mixed(keys * np.uint64(BASE) + symbol + np.uint64(1))
        return np.where(over, ended, keys)

    def proposals(self, ids: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, start) of all windows proposed by a shared triple. ids: all documents' words in a row."""
        grams = rolling(ids, GRAM, BASE)
        if not len(grams) or not len(self.grams):
            return (np.zeros(0, np.int64),) * 3
        slot = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[slot] == grams)
        doc = np.searchsorted(doc_at, hit, "right") - 1
        inside = hit + GRAM <= doc_at[doc + 1]
        hit, doc = hit[inside], doc[inside]
        slot = slot[hit]
        times = self.count[slot]
        entry = np.repeat(self.first[slot] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        doc, start = np.repeat(doc, times), np.repeat(hit - doc_at[doc], times) - self.gram_at[entry]
        found = np.unique(np.stack([doc, self.gram_item[entry], start]), axis=1)
        return found[0], found[1], found[2]


    def near(self, flat: np.ndarray, doc_at: np.ndarray, doc: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which of the proposed windows share a key with their item."""
        found = np.zeros(len(doc), bool)
        for some in self.portions(item):
            d, i, s = doc[some], item[some], start[some]
            size = self.lengths[i]
            low, high = np.maximum(s, 0), np.minimum(s + size, doc_at[d + 1] - doc_at[d])
            column = np.arange(size.max())
            index = np.minimum(doc_at[d][:, None] + low[:, None] + column, len(flat) - 1)
            windows = np.where(column < (high - low)[:, None], flat[index], np.uint64(0))
            found[some] = (self.embed(windows, high - low, i, np.uint64(1)) == self.keys[i]).any(axis=(1, 2))
        return found


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of ``text`` that is nearest to ``item``; the earliest end of the best."""
    def last_row(pattern: np.ndarray, other: np.ndarray, free_start: bool) -> np.ndarray:
        along = np.arange(len(other) + 1)
        row = np.zeros(len(other) + 1, np.int64) if free_start else along.copy()
        for number, word in enumerate(pattern, 1):
            moved = np.empty_like(row)
            moved[0] = number
            np.minimum(row[:-1] + (other != word), row[1:] + 1, out=moved[1:])
            row = np.minimum.accumulate(moved - along) + along
        return row

    ends = last_row(item, text, True)
    end = int(ends.argmin())
    back = last_row(item[::-1], text[:end][::-1], False)
    return int(ends[end]), end - int(np.flatnonzero(back == ends[end])[0]), end


def mark_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, least_words: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows with one more column ``leaks``: item_id, edits, first_word and words of each leaked item.

    Per document and item the stretch with the fewest edits counts, of those the earliest. An input
    column named ``leaks`` is replaced.
    """
    docs = docs.drop("leaks")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-size * 2 // block_bytes))  # hashed into blocks of half the bound on average
    searched = False
    result = docs.withColumn("leaks", F.array().cast(LEAKS.split(" ", 1)[1]))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        prepared = Items(sorted((-1 if r["item_id"] is None else r["item_id"], r["text"]) for r in rows), rate, least_words)
        if prepared.item_ids:
            if searched:  # one block at a time in a task
                result = written(result, "leaks")
            result, searched = _search(result, shared(docs.sparkSession, prepared)), True
    return result


def _search(docs: DataFrame, sent) -> DataFrame:
    place = docs.columns.index("text")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("first_word", pa.int32()), ("words", pa.int32())]))

    def leaks_of(items: Items, ids: list[np.ndarray]) -> list[list[dict]]:
        doc_at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        flat = np.concatenate([*ids, np.zeros(0, np.uint64)])
        doc, item, start = items.proposals(flat, doc_at)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        near = np.flatnonzero(items.near(flat, doc_at, doc, item, start))
        for d, i, s in zip(doc[near].tolist(), item[near].tolist(), start[near].tolist()):
            bound = int(items.bounds[i])
            begin, end = max(0, s - bound), s + int(items.lengths[i]) + bound
            edits, first, last = closest(items.words[i], ids[d][begin:end])
            if edits <= bound:
                best[d, i] = min(best.get((d, i), (edits, begin + first, last - first)), (edits, begin + first, last - first))
        found: list[list[dict]] = [[] for _ in ids]
        for (d, i), (edits, first, words) in sorted(best.items()):
            found[d].append({"item_id": items.item_ids[i], "edits": edits, "first_word": first, "words": words})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, chunks = shared_value(sent), Chunks()
        for batch in batches:
            data, found, at = texts(batch, place), [], 0
            while at < len(data):
                stop, size = at + 1, len(data[at] or b"")
                while stop < len(data) and size + len(data[stop] or b"") <= SLICE:
                    size, stop = size + len(data[stop] or b""), stop + 1
                found += leaks_of(items, chunks.words(data[at:stop]))
                at = stop
            before = batch.column("leaks").to_pylist()
            column = pa.array([[*old, *new] for old, new in zip(before, found)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], batch.schema.names)

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields[:-1], *T.StructType.fromDDL(LEAKS).fields]))
