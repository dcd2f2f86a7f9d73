"""Quality rules on tokeniser fertility: what public vocabularies make of a text tells prose from noise.

Each text's words are tokenised with a subword vocabulary that falls back to bytes and with a second, byte-level one. Measures per document:
characters per token under both, the share of tokens that are bytes fallen back to, and the entropy of its tokens relative to what so
many tokens could have. Rejection bands hold per language, or per script where a row names no language. They come from the corpus itself: all
documents that pass the base rules are counted into a histogram of steps of ``1 / STEPS`` per language and measure, and a
band reaches ``reach`` robust deviations (quartile distance / 1.349) to either side of the median, never less than the measure's
``least`` distance. A short text's mean varies more, so its band is wider by sqrt(1 + SHORT / tokens). Histograms
merge exactly, so bands do not depend on how rows are split; a hot language is a few thousand counts per task.

Measures are one pass of Arrow batches; a word is tokenised once per task and remembered up to a bound in bytes, and a batch is handled in
slices of at most ``SLICE`` bytes of text (or one longer text). No text is shuffled or written.

Defined results: a null text has no words; a text without words has no measures and fails the base rules by its length. Rows of one id
stand for themselves, repeated rows are measured each. A null or empty language is judged by script (the commonest of its letters), a text without letters as ``none``.
A language with a single document is its own median and keeps it. No rows in, no rows out. Columns are read by name; others are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayline.llm.common import mixed, texts, written

SLICE = 4 << 20  # bytes of text handled at once
KEPT = 48 << 20  # bytes of words and tokens a task remembers, about
STEPS = 200  # histogram steps per unit of a measure
SHORT = 200
WINDOW = 5
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
# First code points of blocks of letters, by script; letters below the first are Latin.
SCRIPTS = (
    (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Indic"),
    (0x0E00, "Thai"), (0x0E80, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"),
    (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD800, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"),
)


@dataclass(frozen=True)
class Measure:
    """A measure with its band: ``reach`` deviations, at least ``least``; open below or above where asked."""

    name: str
    least: float
    reach: float = 4.0
    low: bool = True
    high: bool = True


MEASURES = (
    Measure("chars_per_token", 0.15), Measure("chars_per_token_2", 0.15),
    Measure("fallback_share", 0.1, low=False), Measure("entropy", 0.08, high=False),
)


class Words:
    """Codes of words and their tokens under both vocabularies, remembered up to a bound."""

    def __init__(self, pieces_file: str, ranks_file: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_file)
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.tokens, self.starts, self.second = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def of(self, words: list[bytes]) -> np.ndarray:
        """Codes of the words; new ones are tokenised together."""
        codes, new = self.codes, []
        for word in set(words).difference(codes):
            codes[word] = len(self.second) + len(new)
            new.append(word.decode("utf-8", "replace"))
        if new:
            made = self.pieces.encode(new, num_threads=1)
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            self.tokens = np.concatenate([self.tokens, np.fromiter((t for ids in made for t in ids), np.int32, int(sizes.sum()))])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            # One call for all words: a token that begins with a space begins a word, and no token spans two.
            second = np.array(self.ranks.encode_ordinary(" " + " ".join(new)), np.int64)
            begins = np.flatnonzero(self.spaced[second])
            self.second = np.concatenate([self.second, np.diff(begins, append=len(second))])
            self.held += sum(map(len, new)) + 120 * len(new) + 4 * int(sizes.sum())
        return np.fromiter(map(codes.__getitem__, words), np.int64, len(words))


def script(text: bytes) -> str:
    """The script most letters of a text belong to; the alphabet's earlier one if tied."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    letters = points[((points | 32) - 97 < 26) | (points >= 0xC0)]
    if not len(letters):
        return "none"
    counts = np.bincount(np.searchsorted([first for first, _ in SCRIPTS], letters, "right"), minlength=len(SCRIPTS) + 1)
    total: dict[str, int] = {}
    for name, n in zip(("Latin", *(name for _, name in SCRIPTS)), counts):
        total[name] = total.get(name, 0) + int(n)
    return min(total, key=lambda name: (-total[name], name))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    seen = set(lines)
    if len(seen) == len(lines):
        return 0
    worded = [line for line in lines if line.strip(SPACE)]
    return len(worded) - len(set(worded))


def repeated_words(codes: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Per row, words in windows of five words that occur twice or more in the row.

    Windows with equal 64-bit hashes are compared word by word.
    """
    result = np.zeros(rows, np.int64)
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return result
    values = mixed(codes.astype(np.uint64) + np.uint64(1))
    keys = owner[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(WINDOW):
        keys = keys + values[i: i + n] * FACTORS[i]
    keys = mixed(keys)
    inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1:])
    order = inside[np.argsort(keys[inside], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    alike = np.zeros(len(order), bool)
    alike[1:] |= same
    alike[:-1] |= same
    some = order[alike]
    if not len(some):
        return result
    exact = np.column_stack([owner[some], *(codes[some + i] for i in range(WINDOW))])
    _, which, times = np.unique(exact, axis=0, return_inverse=True, return_counts=True)
    starts = some[times[which.ravel()] > 1]
    covered = np.zeros(len(codes) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.subtract.at(covered, starts + WINDOW, 1)
    return np.bincount(owner[np.cumsum(covered[:-1]) > 0], minlength=rows).astype(np.int64)


MEASURED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_tokens_2 long, n_fallback long, "
    "entropy_bits double, script string")


def measures_of(batch: list[bytes], known: Words) -> tuple:
    """The columns of MEASURED but the script, for a slice of texts."""
    rows = len(batch)
    split = [text.split() for text in batch]
    sizes = np.fromiter(map(len, split), np.int64, rows)
    codes = known.of([word for words in split for word in words])
    owner = np.repeat(np.arange(rows), sizes)
    lengths = known.starts[codes + 1] - known.starts[codes]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    # Tokens of all words, one after the other, each with its document.
    at = np.repeat(known.starts[codes] - (ends - lengths), lengths) + np.arange(total)
    tokens, of = known.tokens[at], np.repeat(owner, lengths)
    n_tokens = np.bincount(of, minlength=rows)
    counted = np.sort(of * len(known.fallback) + tokens)
    first = np.flatnonzero(np.diff(counted, prepend=-1))
    times, whose = np.diff(first, append=total), counted[first] // len(known.fallback)
    share = times / n_tokens[whose]
    entropy = np.bincount(whose, -share * np.log2(share), minlength=rows)
    return (
        sizes, [len(t.translate(None, SPACE + CONTINUATION)) for t in batch], [len(t) - len(t.translate(None, SYMBOLS)) for t in batch],
        [repeated_lines(t) for t in batch], repeated_words(codes, owner, rows), n_tokens,
        np.bincount(owner, known.second[codes], minlength=rows).astype(np.int64), np.bincount(of[known.fallback[tokens]], minlength=rows), entropy)


def measured(docs: DataFrame, pieces_file: str, ranks_file: str) -> DataFrame:
    """doc_id, lang, the columns of MEASURED for every row of ``docs`` (doc_id, lang, text)."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(pieces_file, ranks_file)
        for batch in batches:
            data = [text or b"" for text in texts(batch)]
            named = batch.column("lang").to_pylist()
            start = 0
            while start < len(data):
                stop, size = start + 1, len(data[start])
                while stop < len(data) and size + len(data[stop]) <= SLICE:
                    size, stop = size + len(data[stop]), stop + 1
                if known.held > KEPT:
                    known.forget()
                columns = measures_of(data[start:stop], known)
                scripts = [None if lang else script(text) for lang, text in zip(named[start:stop], data[start:stop])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), batch.column("lang").slice(start, stop - start),
                     *[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.float64()), pa.array(scripts, pa.string())],
                    ["doc_id", "lang", *(c.split()[0] for c in MEASURED.split(", "))])
                start = stop

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, {MEASURED}")


def with_ratios(rows: DataFrame) -> DataFrame:
    """The rows with the measures that bands are set on, and the group whose bands hold."""
    n = F.nullif(F.col("n_tokens"), F.lit(0))
    most = F.log2(1 + F.least("n_tokens", F.lit(256)))
    return rows.select(
        "*", F.coalesce(F.nullif("lang", F.lit("")), F.concat(F.lit("script:"), "script")).alias("group"),
        (F.col("word_chars") / n).alias("chars_per_token"), (F.col("word_chars") / F.nullif(F.col("n_tokens_2"), F.lit(0))).alias("chars_per_token_2"),
        (F.col("n_fallback") / n).alias("fallback_share"), (F.col("entropy_bits") / F.when(n > 0, most)).alias("entropy"))


def bands(rows: DataFrame, measures: Sequence[Measure] = MEASURES) -> DataFrame:
    """group, and per measure its median and deviation, from exact histograms of the given rows."""
    steps = F.explode(F.array(*[
        F.struct(F.lit(m.name).alias("measure"), F.round(F.col(m.name) * STEPS).cast("long").alias("step")) for m in measures])).alias("at")
    counts = rows.select("group", steps).where("at.step IS NOT NULL").groupBy("group", "at.measure", "at.step").count()
    whole = Window.partitionBy("group", "measure")
    upto = counts.withColumn("upto", F.sum("count").over(whole.orderBy("step"))).withColumn("all", F.sum("count").over(whole))
    quartiles = upto.groupBy("group", "measure").agg(*[
        (F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("step"))) / STEPS).alias(f"q{q}") for q in (1, 2, 3)])
    return quartiles.groupBy("group").agg(*[
        F.max(F.when(F.col("measure") == m.name, F.col(value))).alias(f"{m.name}_{name}")
        for m in measures for name, value in (("middle", "q2"), ("q1", "q1"), ("q3", "q3"))])


def outside(measures: Sequence[Measure] = MEASURES) -> dict[str, Column]:
    """Per measure, whether a row joined with its group's bands lies outside."""
    found = {}
    for m in measures:
        middle, spread = F.col(f"{m.name}_middle"), (F.col(f"{m.name}_q3") - F.col(f"{m.name}_q1")) / 1.349
        half = F.greatest(m.reach * spread, F.lit(m.least)) * F.sqrt(1 + SHORT / F.col("n_tokens"))
        value = F.col(m.name)
        found[m.name] = F.coalesce((F.lit(m.low) & (value < middle - half)) | (F.lit(m.high) & (value > middle + half)), F.lit(False))
    return found


def judge(
    docs: DataFrame, pieces_file: str, ranks_file: str, least_words: int = 10, repeat_percent: int = 20, measures: Sequence[Measure] = MEASURES,
) -> DataFrame:
    """Measures of every row, base_failed, rejected_by (names of the measures outside their bands) and kept."""
    rows = written(with_ratios(measured(docs, pieces_file, ranks_file)).withColumn(
        "base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))), "fertility")
    # One row per language: small as a rule, and then broadcast by Spark from the size of the written table.
    limits = written(bands(rows.where("NOT base_failed"), measures), "bands")
    judged = rows.join(limits, "group", "left")
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in outside(measures).items()]))
    return judged.withColumn("rejected_by", names).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).select(
        *rows.columns, "rejected_by", "kept")
