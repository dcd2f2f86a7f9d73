"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's score is a logistic model over hashed features of its words: the word itself and
its beginnings. A passage is ``PASSAGE`` sentences in a row, or a whole text of fewer; its score is
the noisy-or of its sentences, 1 - prod(1 - p). A document scores as its worst passage, so that
the base rate does not add up over a long text. Only document labels are needed to train it: a
clean label holds for every sentence, a toxic one for at least one passage. The same sentence
scores then point at the offending sentences. Weights have a fixed size whatever the corpus.

Training uses at most ``max_docs`` labelled documents of any length, the ones with the smallest
hashes; scoring covers every whole text. Sentences over ``SPAN`` words are scored in spans of that
length, so that length alone never makes a sentence toxic.

Defined results: a null or empty text is one empty sentence and scores the model's base rate.
Labels that are null, or of a null doc_id, teach nothing; of several labels for one id the
largest counts. Without labels of both kinds every text scores the prior share of toxic
labels. Repeated rows score alike. No rows in, no rows out.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayline.llm.common import Memo, lean, portions, shared, shared_value, texts

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
SPAN = 40
PASSAGE = 64
BINS = 1 << 18
LEAST_DOCS = 8  # features of fewer training documents carry no weight
PAIRS = 100_000  # pairs of document and word whose features are counted at once


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float


def word_features(word: str) -> np.ndarray:
    """Feature numbers of a lower-case word: the word itself and its beginnings of 4 to 8 letters."""
    names = [f"={word}", *("^" + word[:n] for n in range(4, 9) if n < len(word))]
    return np.array([zlib.crc32(name.encode()) % BINS for name in names], np.int32)


def spans(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence, long ones in parts of SPAN words that share their place."""
    for found in SENTENCE.finditer(text):
        words = WORD.findall(found[0].lower())
        for at in range(0, len(words), SPAN):
            yield found.start(), found.end(), words[at: at + SPAN]


def worst_passage(q: np.ndarray) -> int:
    """Where the PASSAGE sentences with the largest sum of -log(1 - p) begin (0 in a shorter text)."""
    if len(q) <= PASSAGE:
        return 0
    total = np.concatenate([[0.0], np.cumsum(q)])
    return int(np.argmax(total[PASSAGE:] - total[:-PASSAGE]))


def fit(sample: Iterable[tuple[str, int]], steps: int = 150, rate: float = 0.05, decay: float = 1e-4) -> ToxicityModel:
    """Maximum likelihood of document labels under the noisy-or, by full-batch Adam."""
    number: dict[str, int] = {}
    known_labels: list[int] = []
    tokens, sizes, owner = array("i"), array("i"), array("i")  # compact: no text is kept
    for row, (text, label) in enumerate(sample):
        known_labels.append(label)
        for _, _, words in spans(text):
            tokens.extend(number.setdefault(word, len(number)) for word in words)
            sizes.append(len(words))
            owner.append(row)
    labels = np.array(known_labels, float)
    positive = float(labels.mean()) if len(labels) else 0.0
    if positive in (0.0, 1.0):
        share = min(max(positive, 1e-6), 1 - 1e-6)
        return ToxicityModel(np.zeros(BINS, np.float32), float(np.log(share / (1 - share))))
    token, size, owner_of = (np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (tokens, sizes, owner))
    if not len(size):
        return ToxicityModel(np.zeros(BINS, np.float32), float(np.log(positive / (1 - positive))))
    flat, lengths = array("i"), array("i")
    for word in number:
        found = word_features(word)
        flat.frombytes(found.tobytes())
        lengths.append(len(found))
    words, feature, per_word = len(number), np.frombuffer(flat, np.int32), np.frombuffer(lengths, np.int32)
    number.clear()
    word_at = np.concatenate([[0], np.cumsum(per_word)[:-1]])
    sentence_at = np.concatenate([[0], np.cumsum(size)[:-1]])
    known = _documents_per_feature(token, np.repeat(owner_of, size), feature, word_at, per_word) >= LEAST_DOCS
    ends = np.cumsum(np.bincount(owner_of, minlength=len(labels)))
    toxic_long = [(ends[row - 1] if row else 0, ends[row]) for row in np.flatnonzero(labels > 0) if ends[row] - (ends[row - 1] if row else 0) > PASSAGE]
    theta, bias = np.zeros(BINS), -6.0
    m, v, mb, vb = np.zeros(BINS), np.zeros(BINS), 0.0, 0.0
    for step in range(1, steps + 1):
        word_weight = np.add.reduceat(theta[feature], word_at)
        z = np.clip(np.add.reduceat(word_weight[token], sentence_at) + bias, -30, 30)
        part, inside = np.logaddexp(0, z), np.ones(len(z))
        for start, end in toxic_long:  # only the worst passage has to be toxic
            at = start + worst_passage(part[start:end])
            inside[start:at] = inside[at + PASSAGE: end] = 0
        q = np.maximum(np.bincount(owner_of, part * inside, len(labels)), 1e-9)  # -log(1 - score)
        slope = np.where(labels > 0, -1 / np.expm1(np.minimum(q, 50)), 1.0) / len(labels)
        by_sentence = inside * slope[owner_of] / (1 + np.exp(-z))
        by_word = np.bincount(token, np.repeat(by_sentence, size), words)
        gradient = np.bincount(feature, np.repeat(by_word, per_word), BINS) * known + decay * theta
        bias_gradient = by_sentence.sum()
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        mb, vb = 0.9 * mb + 0.1 * bias_gradient, 0.999 * vb + 0.001 * bias_gradient ** 2
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-6)
        bias -= rate * (mb / (1 - 0.9 ** step)) / (np.sqrt(vb / (1 - 0.999 ** step)) + 1e-6)
    return ToxicityModel(theta.astype(np.float32), float(bias))


def _documents_per_feature(token, owner, feature, word_at, per_word) -> np.ndarray:
    """In how many documents each feature occurs."""
    base = np.int64(token.max()) + 1
    pair = np.unique(owner * base + token)  # one (document, word) each
    document, word = pair // base, pair % base
    counts = np.zeros(BINS, np.int64)
    begins = np.flatnonzero(np.diff(document, prepend=-1))
    # In parts of whole documents, to keep memory small: each begins with the first document past PAIRS pairs.
    cuts = np.unique(np.searchsorted(begins, np.arange(0, len(pair), PAIRS)))
    edges = [*begins[cuts[cuts < len(begins)]].tolist(), len(pair)]
    for at, end in zip(edges, edges[1:]):
        d, w = document[at:end], word[at:end]
        inside = np.arange(per_word[w].sum()) - np.repeat(np.cumsum(per_word[w]) - per_word[w], per_word[w])
        features = feature[np.repeat(word_at[w], per_word[w]) + inside]
        seen = np.unique(np.repeat(d, per_word[w]) * BINS + features)
        counts += np.bincount(seen % BINS, minlength=BINS)
    return counts


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, max_docs: int) -> DataFrame:
    """(doc_id, text, toxic): at most ``max_docs`` labelled texts, the ids with the smallest hashes, found without moving other texts."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    # The limit bounds the broadcast: max_docs rows of two numbers.
    return (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .where(F.col("text").isNotNull())
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    )


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_docs: int = 10_000) -> ToxicityModel:
    """Fit on the labelled documents for which ``usable`` (over ``doc_id``) holds.

    The bounded sample meets in one task, so the driver receives the weights only.
    """
    sample = labelled_sample(docs, labels, F.lit(True) if usable is None else usable, max_docs)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (text.decode("utf-8", "replace"), int(toxic > 0))
            for batch in batches for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist())
        )
        model = fit(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weights", "bias"])

    learned = sample.repartition(1).sortWithinPartitions("doc_id").select("text", "toxic").mapInArrow(lean(learn), "weights binary, bias double").collect()
    if not learned:  # no partition at all
        return fit([])
    return ToxicityModel(np.frombuffer(learned[0]["weights"], np.float32), learned[0]["bias"])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows with three more columns; input columns of these names are replaced.

    ``toxicity`` (0 to 1), ``toxic`` (1 from ``threshold`` on), and ``offending``: start, end and
    score of the sentences that reach the threshold themselves, or of the worst one where only
    their combination does. Positions count characters.
    """
    sent = shared(docs.sparkSession, model)
    extra = {"toxicity": "double", "toxic": "int", "offending": "array<struct<start: int, end: int, score: double>>"}
    docs = docs.drop(*extra)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared_value(sent)
        weights, bias, least = known.weights, known.bias, -math.log1p(-threshold)
        memo = Memo(lambda word: float(weights[word_features(word)].sum()))
        for batch in portions(batches, place):
            scores, flags, places = [], [], []
            for data in texts(batch, place):
                memo.trim()
                begins, ends, parts, hits = array("i"), array("i"), array("d"), []
                for start, end, words in spans((data or b"").decode("utf-8", "replace")):
                    z = bias + sum(map(memo.__getitem__, words))
                    part = math.log1p(math.exp(z)) if z < 30 else z
                    begins.append(start)
                    ends.append(end)
                    parts.append(part)
                    if part >= least:
                        hits.append((start, end, part))
                first = worst_passage(np.frombuffer(parts)) if len(parts) > PASSAGE else 0
                passage = parts[first: first + PASSAGE]
                value = -math.expm1(-(sum(passage) if passage else math.log1p(math.exp(bias))))
                if value >= threshold and not hits and passage:
                    worst = first + max(range(len(passage)), key=passage.__getitem__)
                    hits = [(begins[worst], ends[worst], parts[worst])]
                by_place: dict[tuple[int, int], float] = {}
                for start, end, part in hits:
                    by_place[start, end] = by_place.get((start, end), 0.0) + part
                scores.append(value)
                flags.append(int(value >= threshold))
                places.append([{"start": s, "end": e, "score": float(-np.expm1(-p))} for (s, e), p in by_place.items()])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(flags, pa.int32()), pa.array(places, kind)],
                [*batch.schema.names, *extra])

    added = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in extra.items()))
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *added.fields]))
