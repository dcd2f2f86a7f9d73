"""Document log-likelihood under a gated recurrent language model with a class-factored softmax.

The unit is a word (A-Z lower-cased, split at ASCII white space), each text closed by one end
token. Symbols of the network are the end token, the most frequent words, and ``BUCKETS`` rare
classes by the last letters of a word. A rare word has the probability of its class given the
history, times its share of the class by corpus counts (with one added), so every text has a
proper probability. The output layer first chooses one of ``CLASSES`` groups of symbols and then
a symbol of the group.

Counts cover all training texts. The network learns by truncated backpropagation in numpy: each
task trains on its share of the documents, its lanes carrying their state from window to window,
and the weights are averaged by token counts, ``rounds`` times. Every training text gives gradient
steps in every round. Scoring reads every text whole; a document's state is
carried from its first word to its end, whatever its length.

Bounded broadcasts: the words with at least 1/``FREQUENT`` of all tokens, which are at most
FREQUENT, and one set of weights. Other words are looked up by a join on the word.

Defined results: null and empty texts are the end token alone. Rows equal in doc_id and text score
alike. A null doc_id is a value. Without training texts the network stays at even odds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from assayline.llm.common import keep_memory, lean, portions, shared, shared_value, text_key, written

FREQUENT = 1_000_000
CLASSES, PER_CLASS = 32, 32
SYMBOLS = CLASSES * PER_CLASS
BUCKETS = 64
END = BUCKETS  # the rare classes come first
HIDDEN = 16
WINDOW, LANES = 32, 64  # steps per truncated window and parallel streams in training
SCORE_LANES, SCORE_WINDOW = 1024, 64
# Where a symbol's input weights are; the candidate's first, as in the rows of their gradients.
PLACES = np.roll(np.arange(SYMBOLS * 3 * HIDDEN).reshape(SYMBOLS, 3 * HIDDEN), HIDDEN, axis=1)
SCORED = 4096  # states whose symbols are scored at a time
ONE, TWO = np.float32(1), np.float32(2)


class Words:
    """Number of each frequent word; rare words get one of BUCKETS numbers after them, by their last two bytes."""

    def __init__(self, words: list[bytes]):
        self.words = pa.array(words, pa.binary())

    def __len__(self) -> int:
        return len(self.words)

    def of(self, found: pa.Array | list[bytes]) -> np.ndarray:
        """The number of each word."""
        found = found if isinstance(found, pa.Array) else pa.array(found, pa.binary())
        number = pc.fill_null(pc.index_in(found, self.words), -1).to_numpy().astype(np.int64)
        rare = np.flatnonzero(number < 0)
        tails = pc.binary_slice(found.take(pa.array(rare)), -2).dictionary_encode()
        bucket = np.array([zlib.crc32(tail) % BUCKETS for tail in tails.dictionary.to_pylist()], np.int64)
        number[rare] = len(self) + bucket[tails.indices.to_numpy()]
        return number


@dataclass
class Vocabulary:
    words: list[bytes]  # frequent ones, the most frequent first
    log_count: np.ndarray  # log10(count + 1) of the frequent words, then zeros for the rare classes
    symbol: np.ndarray  # network symbol of each number
    log_share: np.ndarray  # of numbers: log10 of what divides count + 1 in its rare class, 0 for words with a symbol
    counts: np.ndarray  # training count per symbol
    end_log_count: float
    tokens: int
    types: int


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and the text each is from."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    words, owner = lists.flatten().cast(pa.binary()), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    there = pc.binary_length(words).to_numpy() > 0  # white space at an end of a text leaves an empty word
    return words.filter(pa.array(there)), owner[there]


def closed(symbols: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of n texts, each text closed by END, and the length of each."""
    sizes = np.bincount(owner, minlength=n) + 1
    stream = np.full(len(symbols) + n, END, np.int16)
    stream[np.arange(len(symbols)) + owner] = symbols
    return stream, sizes


# ---- the network ----


def shapes() -> dict[str, tuple[int, ...]]:
    return {"input": (SYMBOLS, 3 * HIDDEN), "state": (HIDDEN, 3 * HIDDEN), "group": (HIDDEN, CLASSES), "group_bias": (CLASSES,),
            "member": (CLASSES, HIDDEN, PER_CLASS), "member_bias": (CLASSES, PER_CLASS)}


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    parts, at = {}, 0
    for name, shape in shapes().items():
        size = math.prod(shape)
        parts[name] = flat[at: at + size].reshape(shape)
        at += size
    return parts


def initial(counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Small random weights; output biases at the log of the symbol counts, so training starts from word frequencies."""
    draw = np.random.default_rng(seed)
    flat = np.concatenate([draw.normal(0, 0.1, int(np.prod(s))).ravel() for s in shapes().values()]).astype(np.float32)
    parts, counts = unpacked(flat), (counts + 1.0).reshape(CLASSES, PER_CLASS)
    parts["group_bias"][:] = np.log(counts.sum(axis=1) / counts.sum())
    parts["member_bias"][:] = np.log(counts / counts.sum(axis=1, keepdims=True))
    return flat


def step(h: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One gated recurrent step: (new state, both gates, candidate). The plain form; ``_walk`` does many at once."""
    gates = h @ state[:, : 2 * HIDDEN]
    gates += x[:, : 2 * HIDDEN]
    gates *= 0.5  # the sigmoid, by way of the hyperbolic tangent
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    candidate = (gates[:, HIDDEN:] * h) @ state[:, 2 * HIDDEN:]
    candidate += x[:, 2 * HIDDEN:]
    np.tanh(candidate, out=candidate)
    new = h - candidate
    new *= gates[:, :HIDDEN]
    new += candidate
    return new, gates, candidate


def _signed(p: dict[str, np.ndarray], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input and state weights as ``_walk`` takes them: a sigmoid is 1 / (1 + exp(-x)), a hyperbolic tangent 2 / (1 + exp(-2x)) - 1."""
    taken = -p["input"].astype(kind)
    taken[:, 2 * HIDDEN:] *= 2
    return taken, -np.ascontiguousarray(p["state"][:, : 2 * HIDDEN].T), -2 * np.ascontiguousarray(p["state"][:, 2 * HIDDEN:].T)


def _walk(old: np.ndarray, x: np.ndarray, to_gates: np.ndarray, to_new: np.ndarray, now: np.ndarray, gates: np.ndarray, new: np.ndarray,
          part: np.ndarray) -> None:
    """One step; a lane is a column, so that gates and candidates are whole rows. Fills the new state, both gates and the candidate.

    An exponential that overflows gives the limit, 0 or -1.
    """
    np.dot(to_gates, old, out=gates)
    gates += x[: 2 * HIDDEN]
    np.exp(gates, out=gates)
    gates += ONE
    np.divide(ONE, gates, out=gates)
    np.multiply(gates[HIDDEN:], old, out=part)
    np.dot(to_new, part, out=new)
    new += x[2 * HIDDEN:]
    np.exp(new, out=new)
    new += ONE
    np.divide(TWO, new, out=new)
    new -= ONE
    np.subtract(old, new, out=now)
    now *= gates[:HIDDEN]
    now += new


def _by_group(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of targets by their group, and (group, first, end) of the groups there are."""
    group = (target // PER_CLASS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=CLASSES))]).tolist()
    return order, [(c, ends[c], ends[c + 1]) for c in range(CLASSES) if ends[c] < ends[c + 1]]


def _spaced(height: int, width: int, kind: np.dtype) -> np.ndarray:
    """An empty array whose rows do not start a power of two apart: those would displace each other from the cache."""
    return np.empty((height, width + 16), kind)[:, :width]


def _output_weights(p: dict[str, np.ndarray]) -> np.ndarray:
    """Per group the weights of all groups' scores, then of its symbols'; the bias is the last column."""
    w = np.empty((CLASSES, CLASSES + PER_CLASS, HIDDEN + 1), p["group"].dtype)
    w[:, :CLASSES, :HIDDEN], w[:, :CLASSES, HIDDEN] = p["group"].T, p["group_bias"]
    w[:, CLASSES:, :HIDDEN], w[:, CLASSES:, HIDDEN] = p["member"].transpose(0, 2, 1), p["member_bias"]
    return w


def _scores(ordered: np.ndarray, runs: list[tuple[int, int, int]], w: np.ndarray) -> np.ndarray:
    """Scores of the groups, then of the symbols of each column's group, less the highest of their kind; columns ordered by group.

    ``ordered``: states with a last row of ones.
    """
    z = _spaced(w.shape[1], ordered.shape[1], ordered.dtype)
    for c, first, end in runs:
        np.matmul(w[c], ordered[:, first: end], out=z[:, first: end])
    for part in (z[:CLASSES], z[CLASSES:]):
        part -= part.max(axis=0)
    return z


def _ordered(hidden: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The states (a row each) as columns in this order, with a last row of ones."""
    ordered = _spaced(HIDDEN + 1, len(order), hidden.dtype)
    ordered[:HIDDEN], ordered[HIDDEN] = np.take(hidden, order, axis=0).T, 1
    return ordered


def log_probabilities(hidden: np.ndarray, target: np.ndarray, p: dict[str, np.ndarray], w: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each target symbol from its hidden state."""
    w, result = _output_weights(p) if w is None else w, np.empty(len(target), hidden.dtype)
    for at in range(0, len(target), SCORED):  # few enough at a time to stay in the cache
        part = target[at: at + SCORED]
        order, runs = _by_group(part)
        z, part, each = _scores(_ordered(hidden[at: at + SCORED], order), runs, w), part[order], np.arange(len(part))
        found = z[part // PER_CLASS, each] + z[CLASSES + part % PER_CLASS, each]
        np.exp(z, out=z)
        found -= np.log(z[:CLASSES].sum(axis=0)) + np.log(z[CLASSES:].sum(axis=0))
        result[at + order] = found
    return result


def gradients(p: dict[str, np.ndarray], h: np.ndarray, source: np.ndarray, target: np.ndarray, fresh: np.ndarray,
              real: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(flat gradient of the mean loss, last state) of one window; all of shape (steps, lanes).

    fresh: a text starts here. real: 1 for a token that counts, 0 for padding at a lane's end.
    """
    (steps, lanes), kind, count = source.shape, h.dtype, source.size
    gate_state, new_state = np.ascontiguousarray(p["state"][:, : 2 * HIDDEN]), np.ascontiguousarray(p["state"][:, 2 * HIDDEN:])
    weights, to_gates, to_new = _signed(p, kind)
    taken = np.ascontiguousarray(np.take(weights, source, axis=0).transpose(0, 2, 1))
    kept, starts = (~fresh)[:, None, :].astype(kind), fresh.any(axis=1).tolist()
    states, candidates = np.empty((steps + 1, HIDDEN, lanes), kind), np.empty((steps, HIDDEN, lanes), kind)
    gates, part = np.empty((steps, 2 * HIDDEN, lanes), kind), np.empty((HIDDEN, lanes), kind)
    states[0] = h.T
    with np.errstate(over="ignore"):
        for t in range(steps):
            old = states[t] * kept[t] if starts[t] else states[t]
            _walk(old, taken[t], to_gates, to_new, states[t + 1], gates[t], candidates[t], part)
    before = states[:-1] * kept
    flat, flat_target = np.zeros(sum(map(math.prod, shapes().values())), np.float32), target.ravel()
    d, scale, at = unpacked(flat), np.full(count, 1.0 / count, kind), np.arange(count)
    if real is not None:
        scale = (real.ravel() / real.sum()).astype(kind)
    # The output layer, its columns ordered by group: from scores to their gradients in place.
    order, runs = _by_group(flat_target)
    w, ordered = _output_weights(p), _ordered(states[1:].transpose(0, 2, 1).reshape(count, HIDDEN), order)
    dz, symbol, scale = _scores(ordered, runs, w), flat_target[order], scale[order]
    np.exp(dz, out=dz)
    for own in (dz[:CLASSES], dz[CLASSES:]):
        own *= scale / own.sum(axis=0)
    dz[symbol // PER_CLASS, at] -= scale
    dz[CLASSES + symbol % PER_CLASS, at] -= scale
    dw, d_ordered = np.zeros(w.shape, kind), _spaced(HIDDEN, count, kind)
    for c, first, end in runs:
        own = dz[:, first: end]
        np.matmul(own, ordered[:, first: end].T, out=dw[c])
        np.matmul(w[c, :, :HIDDEN].T, own, out=d_ordered[:, first: end])
    of_groups = dw[:, :CLASSES].sum(axis=0)
    d["group"][:], d["group_bias"][:] = of_groups[:, :HIDDEN].T, of_groups[:, HIDDEN]
    d["member"][:], d["member_bias"][:] = dw[:, CLASSES:, :HIDDEN].transpose(0, 2, 1), dw[:, CLASSES:, HIDDEN]
    d_rows = np.empty((count, HIDDEN), kind)
    d_rows[order] = d_ordered.T
    d_hidden = np.ascontiguousarray(d_rows.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1))
    # What does not depend on later steps is made for the whole window at once.
    update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
    by_state, by_reset = np.empty((steps, 3, HIDDEN, lanes), kind), np.empty((steps, 2, HIDDEN, lanes), kind)
    by_state[:, 0], by_state[:, 1] = update, (1 - update) * (1 - candidates * candidates)
    by_state[:, 2] = (before - candidates) * update * (1 - update)
    by_reset[:, 0], by_reset[:, 1] = before * reset * (1 - reset), reset
    # Per step: the state's own way back, then the gradients of candidate, update and reset, then the way back through the reset.
    back, carry, d_reset = np.empty((steps, 5, HIDDEN, lanes), kind), np.zeros((HIDDEN, lanes), kind), np.empty((HIDDEN, lanes), kind)
    for t in range(steps - 1, -1, -1):
        dh, parts = d_hidden[t], back[t]
        dh += carry
        np.multiply(dh, by_state[t], out=parts[:3])
        np.dot(new_state, parts[1], out=d_reset)
        np.multiply(d_reset, by_reset[t], out=parts[3:])
        np.dot(gate_state, parts[2: 4].reshape(2 * HIDDEN, lanes), out=carry)
        carry += parts[0]
        carry += parts[4]
        if starts[t]:
            carry *= kept[t]
    by_row = lambda x: x.transpose(1, 0, 2).reshape(HIDDEN, count)
    rows = back[:, 1: 4].reshape(steps, 3 * HIDDEN, lanes).transpose(0, 2, 1).reshape(count, 3 * HIDDEN)
    d["state"][:, : 2 * HIDDEN] = by_row(before) @ rows[:, HIDDEN:]
    d["state"][:, 2 * HIDDEN:] = by_row(reset * before) @ rows[:, :HIDDEN]
    at = np.take(PLACES, source.ravel(), axis=0).ravel()
    d["input"].ravel()[:] = np.bincount(at, rows.ravel(), SYMBOLS * 3 * HIDDEN)
    return flat, states[-1].T


def trained(flat: np.ndarray, stream: np.ndarray, rate: float) -> np.ndarray:
    """Weights after one pass over all of a stream of symbols (texts closed by END), in LANES parallel parts.

    A lane that starts within a text knows the word before, with an empty state. The last lanes are padded.
    """
    flat = flat.copy()
    p, length = unpacked(flat), -(-len(stream) // LANES)
    padding = np.full(length * LANES - len(stream), END, stream.dtype)
    target = np.concatenate([stream, padding]).reshape(LANES, length).T
    source = np.concatenate([np.array([END], stream.dtype), stream, padding])[:-1].reshape(LANES, length).T
    real = (np.arange(length * LANES) < len(stream)).reshape(LANES, length).T
    fresh = source == END
    m, v, change, h = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat), np.zeros((LANES, HIDDEN), np.float32)
    for count, at in enumerate(range(0, length, WINDOW), 1):
        g, h = gradients(p, h, source[at: at + WINDOW], target[at: at + WINDOW], fresh[at: at + WINDOW], real[at: at + WINDOW])
        g *= min(1.0, 1.0 / max(float(np.sqrt(g @ g)), 1e-12))
        m *= 0.9
        np.multiply(g, 0.1, out=change)
        m += change
        v *= 0.99
        g *= g
        g *= 0.01
        v += g
        # rate * (m / (1 - 0.9 ** count)) / (sqrt(v / (1 - 0.99 ** count)) + 1e-4), its constants taken together
        young = (1 - 0.99 ** count) ** 0.5
        np.sqrt(v, out=change)
        change += 1e-4 * young
        np.divide(m, change, out=change)
        change *= rate * young / (1 - 0.9 ** count)
        flat -= change
    return flat


def text_scores(documents: list[np.ndarray], flat: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence of symbols (END included at its end)."""
    p, result = unpacked(flat), np.zeros(len(documents))
    (weights, to_gates, to_new), w = _signed(p, flat.dtype), _output_weights(p)
    order = np.argsort([-len(d) for d in documents], kind="stable")
    for first in range(0, len(order), SCORE_LANES):
        rows = order[first: first + SCORE_LANES]
        sizes = np.array([len(documents[r]) for r in rows])
        h, last = np.zeros((HIDDEN, len(rows)), flat.dtype), np.full(len(rows), END, np.int64)
        for at in range(0, int(sizes[0]), SCORE_WINDOW):
            wide = int((sizes > at).sum())
            long = min(SCORE_WINDOW, int(sizes[0]) - at)
            target = np.full((wide, long), -1, np.int64)
            for lane in range(wide):
                part = documents[rows[lane]][at: at + long]
                target[lane, : len(part)] = part
            source = np.concatenate([last[:wide, None], target[:, :-1]], axis=1).T.copy()
            last[:wide] = target[:, -1]
            active = (target >= 0).sum(axis=0).tolist()
            ends = np.cumsum([0, *active]).tolist()
            states, h = np.empty((ends[-1], HIDDEN), flat.dtype), h[:, :wide]
            with np.errstate(over="ignore"):
                for t, n in enumerate(active):
                    # The longest texts come first, so those that go on are the first columns.
                    old, x = np.ascontiguousarray(h[:, :n]), np.take(weights, source[t, :n], axis=0).T
                    h, gates, new, part = (np.empty((k * HIDDEN, n), flat.dtype) for k in (1, 2, 1, 1))
                    _walk(old, x, to_gates, to_new, h, gates, new, part)
                    states[ends[t]: ends[t + 1]] = h.T
            flat_target = target.T[target.T >= 0]
            lane = np.concatenate([np.arange(n) for n in active])
            result[rows[:wide]] += np.bincount(lane, log_probabilities(states, flat_target, p, w), wide)
    return result / np.log(10)


# ---- Spark ----


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the empty word stands for the end token."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(part.column("text"))[0].value_counts() for part in portions([batch])]
            words = pa.chunked_array([part.field("values") for part in found] + [pa.array([b""], pa.binary())])
            times = pa.chunked_array([part.field("counts") for part in found] + [pa.array([batch.num_rows], pa.int64())])
            summed = pa.table({"word": words, "n": times}).group_by("word", use_threads=False).aggregate([("n", "sum")])
            yield from summed.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    least = max(1, -(-total["tokens"] // FREQUENT))
    # At most FREQUENT words can have 1 / FREQUENT of the tokens each.
    rows = counts.where((F.col("n") >= least) & (F.col("word") != F.lit(b""))).toArrow()
    found = sorted(zip((-n for n in rows.column("n").to_pylist()), rows.column("word").to_pylist()))
    words, number = [w for _, w in found], np.array([-n for n, _ in found], np.int64)
    end = counts.where(F.col("word") == F.lit(b"")).first()
    named = min(len(words), SYMBOLS - BUCKETS - 1)
    bucket = np.array([zlib.crc32(w[-2:]) % BUCKETS for w in words] + list(range(BUCKETS)), np.int64)
    symbol = bucket.copy()
    symbol[:named] = BUCKETS + 1 + np.arange(named)
    # Tokens and types of the rare classes: all words without a symbol of their own.
    own = {words[i] for i in range(named)}
    by_bucket = counts.where(F.col("word") != F.lit(b"")).groupBy(
        (F.crc32(F.substring("word", -2, 2)) % BUCKETS).alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    tokens, types = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in by_bucket.collect():  # at most BUCKETS rows
        tokens[row["bucket"]], types[row["bucket"]] = row["n"], row["types"]
    for i in range(named):
        tokens[bucket[i]] -= number[i]
        types[bucket[i]] -= 1
    per_symbol = np.zeros(SYMBOLS)
    per_symbol[:BUCKETS] = tokens
    per_symbol[END] = end["n"] if end else 0
    per_symbol[BUCKETS + 1: BUCKETS + 1 + named] = number[:named]
    share = -np.log10(tokens + types + 1)[bucket]
    share[:named] = 0
    log_count = np.concatenate([np.log10(number + 1), np.zeros(BUCKETS)])
    return Vocabulary(words, log_count, symbol, share, per_symbol, float(np.log10(per_symbol[END] + 1)), total["tokens"], total["types"])


def _averaged(models: DataFrame) -> DataFrame:
    """One row (weights, tokens) per partition: the average by tokens of the partition's rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for batch in batches:
            for data, n in zip(batch.column("weights").to_pylist(), batch.column("tokens").to_pylist()):
                part = np.frombuffer(data, np.float32).astype(np.float64) * n
                total, tokens = part if total is None else total + part, tokens + n
        if tokens:
            mean = (total / tokens).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([mean], pa.binary()), pa.array([tokens], pa.int64())], ["weights", "tokens"])

    return models.mapInArrow(add, "weights binary, tokens long")


def train(docs: DataFrame, vocab: Vocabulary, one_in: int = 1, rounds: int = 1, rate: float = 0.01) -> np.ndarray:
    """Weights learned from all documents; with ``one_in`` over 1 from that share of them, chosen by a hash of id and text."""
    context = docs.sparkSession.sparkContext
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0).select("text")
    weights = initial(vocab.counts)
    for turn in range(rounds):
        sent = context.broadcast((weights, vocab.words, vocab.symbol, rate / (1 + turn)))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keep_memory()
            start, words, symbol, step_size = sent.value
            numbering, current, tokens, parts, size = Words(words), start, 0, [], 0
            for batch in batches:
                for portion in portions([batch]):
                    found, owner = words_of(portion.column("text"))
                    parts.append(closed(symbol[numbering.of(found)], owner, portion.num_rows)[0])
                    size += len(parts[-1])
                if size >= LANES * WINDOW:  # a short batch waits for the next
                    current, tokens = trained(current, np.concatenate(parts).astype(np.int64), step_size), tokens + size
                    parts, size = [], 0
            if parts:
                current, tokens = trained(current, np.concatenate(parts).astype(np.int64), step_size), tokens + size
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([current.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["weights", "tokens"])

        models = written(chosen.mapInArrow(lean(learn), "weights binary, tokens long"), "models")
        left = models.count()
        while left > 1:  # a tree, so that no task or driver holds many sets of weights
            left = -(-left // 64)
            models = _averaged(models.repartition(left))
        rows = models.collect()
        if rows:
            weights = np.frombuffer(rows[0]["weights"], np.float32).copy()
    return weights


def score(docs: DataFrame, usable: Column, one_in: int = 1, rounds: int = 1) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Counts and network learn from the rows where ``usable`` (over doc_id and text) holds. base_score
    is the log10 probability by word counts with one added, score that of the network.
    """
    docs = docs.select("doc_id", "text").withColumn("tk", text_key(F.col("text")))
    taught = docs.where(usable)
    counts = written(word_counts(taught), "word-counts")
    vocab = vocabulary(counts)
    weights = train(taught, vocab, one_in, rounds)
    sent = shared(docs.sparkSession, (vocab, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        vocab, weights = shared_value(sent)
        numbering, frequent = Words(vocab.words), len(vocab.words)
        for batch in batches:
            sequences, size, known, counted, share = [], [], [], [], []
            for portion in portions([batch]):
                found, owner = words_of(portion.column("text"))
                number, n = numbering.of(found), portion.num_rows
                logs, symbols = vocab.log_count[number], vocab.symbol[number]
                stream, sizes = closed(symbols, owner, n)
                sequences.extend(np.split(stream, np.cumsum(sizes)[:-1]))
                size.extend(sizes)
                known.extend(np.bincount(owner[number < frequent], minlength=n) + int(vocab.counts[END] > 0))
                counted.extend(np.bincount(owner, logs, n) + vocab.end_log_count)
                share.extend(np.bincount(owner, vocab.log_share[number] + np.where(symbols < BUCKETS, logs, 0), n))
            values = text_scores(sequences, weights) + np.array(share) if sequences else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tk"), pa.array(size, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(counted, pa.float64()), pa.array(values, pa.float64())],
                ["doc_id", "tk", "n_tokens", "known", "counted", "network"])

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = pa.array(shared_value(sent)[0].words, pa.binary())
        for portion in portions(batches):
            found, owner = words_of(portion.column("text"))
            rare = pc.index_in(found, frequent).is_null()
            word = found.filter(rare).dictionary_encode()
            kinds = max(len(word.dictionary), 1)
            each, times = np.unique(owner[rare.to_numpy(zero_copy_only=False)] * kinds + word.indices.to_numpy(), return_counts=True)
            owner = pa.array(each // kinds)
            yield pa.RecordBatch.from_arrays(
                [portion.column("doc_id").take(owner), portion.column("tk").take(owner), word.dictionary.take(pa.array(each % kinds)),
                 pa.array(times, pa.int32())],
                ["doc_id", "tk", "word", "times"])

    scored = written(docs.mapInArrow(lean(run), "doc_id long, tk long, n_tokens long, known long, counted double, network double"), "scored")
    rare = docs.mapInArrow(rare_words, "doc_id long, tk long, word binary, times int").join(counts, "word").groupBy("doc_id", "tk").agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_counted"))
    # Rows equal in id and text have met in one sum; each gets its part.
    keys = ["id_key", "no_id", "tk"]
    keyed = lambda frame: frame.withColumn("id_key", F.coalesce("doc_id", F.lit(0))).withColumn("no_id", F.col("doc_id").isNull())
    alike = keyed(scored).groupBy(*keys).agg(F.count("*").alias("alike"))
    joined = keyed(scored).join(alike, keys).join(keyed(rare).drop("doc_id"), keys, "left")
    part = lambda name: F.coalesce(F.col(name) / F.col("alike"), F.lit(0.0))
    below = float(np.log10(vocab.tokens + vocab.types + 1))
    return joined.select(
        "doc_id", "n_tokens", (F.col("known") + F.round(part("rare_known")).cast("long")).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") + part("rare_counted") - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("network") + part("rare_counted")).alias("score"))
