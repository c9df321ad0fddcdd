"""Language identification with a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.batches import by_bytes, utf8

UNKNOWN = "und"
HIDDEN = 8
WINDOW = 64  # bytes the network reads in one go; every byte of a text is in exactly one window
PAD = 256
LANES = 4096  # windows side by side
SAMPLE_ROWS = 3000  # labelled rows the network learns from
SAMPLE_WINDOWS = 6  # windows of each such row
STEPS, BATCH, RATE = 200, 384, 0.02
SLICE_BYTES = 2 << 20


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Direction:
    """One gated recurrent layer: gates update, reset and candidate, ``HIDDEN`` rows each."""

    bytes: np.ndarray  # (3H, 257): what each byte adds to the gates, biases included
    state: np.ndarray  # (3H, H)

    def step(self, symbols: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        size = len(h)
        given = self.bytes.take(symbols, axis=1)
        recalled = self.state @ h
        gates = given[:2 * size]
        gates += recalled[:2 * size]
        sigmoid(gates)
        update, reset = gates[:size], gates[size:]
        candidate = reset * recalled[2 * size:]
        candidate += given[2 * size:]
        np.tanh(candidate, out=candidate)
        new = h - candidate
        new *= update
        new += candidate
        return new, update, reset, candidate, recalled[2 * size:]


@dataclass
class Network:
    languages: list[str]
    layers: tuple[Direction, Direction]  # reading on and reading back
    out: np.ndarray  # (C, 2H)
    bias: np.ndarray  # (C, 1)

    def states(self, windows: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The state of either layer at every position, (T, H, lanes)."""
        steps, lanes = windows.shape
        both = []
        for layer, order in zip(self.layers, (range(steps), range(steps - 1, -1, -1))):
            size = layer.state.shape[1]
            all_states = np.empty((steps, size, lanes), np.float32)
            h = np.zeros((size, lanes), np.float32)
            kept = []
            for t in order:
                before = h
                h, *gates = layer.step(windows[t], h)
                all_states[t] = h
                if trace is not None:
                    kept.append((t, before, gates))
            if trace is not None:
                trace.append(kept)
            both.append(all_states)
        return both[0], both[1]

    def position_chances(self, on: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Chances of the languages at one position, (C, lanes)."""
        size = len(on)
        scores = self.out[:, :size] @ on
        scores += self.out[:, size:] @ back
        scores += self.bias
        scores -= scores.max(axis=0)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=0)
        return scores

    def window_sums(self, windows: np.ndarray) -> np.ndarray:
        """Chances summed over a window's bytes, (C, lanes)."""
        on, back = self.states(windows)
        total = np.zeros((len(self.languages), windows.shape[1]), np.float32)
        for t in range(len(windows)):
            chances = self.position_chances(on[t], back[t])
            chances *= windows[t] != PAD
            total += chances
        return total


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts as windows (T, lanes), and the first window of each text."""
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.full(firsts[-1] * WINDOW, PAD, np.uint16)
    flat[np.arange(len(data)) + np.repeat(firsts[:-1] * WINDOW - offsets[:-1], lengths)] = data
    return flat.reshape(-1, WINDOW).T, firsts


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Learn by backpropagation through time that every byte of a window has its text's language."""
    rng = np.random.default_rng(seed)
    classes, size = len(languages), HIDDEN
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    net = Network(
        languages,
        tuple(Direction(normal(3 * size, PAD + 1, scale=0.3), normal(3 * size, size, scale=0.4)) for _ in range(2)),
        normal(classes, 2 * size, scale=0.3),
        np.zeros((classes, 1), np.float32),
    )
    weights = [net.layers[0].bytes, net.layers[0].state, net.layers[1].bytes, net.layers[1].state, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    share = np.bincount(labels, minlength=classes).astype(np.float32)
    importance = (1 / np.maximum(share, 1)) * len(labels) / max(1, np.count_nonzero(share))
    order = np.empty(0, int)
    for done in range(1, STEPS + 1):
        while len(order) < min(BATCH, len(labels)):
            order = np.concatenate([order, rng.permutation(len(labels))])
        chosen, order = order[:BATCH], order[BATCH:]
        grads = gradients(net, windows[:, chosen], labels[chosen], importance[labels[chosen]])
        rate = RATE * (1 - 0.9 * done / STEPS)
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + 1e-8)
    return net


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> list[np.ndarray]:
    """The loss's gradients, in the order of the weights."""
    trace: list = []
    on, back = net.states(windows, trace)
    steps, lanes = windows.shape
    size = on.shape[1]
    real = windows != PAD
    scale = importance / max(1, real.sum())
    target = np.zeros((len(net.languages), lanes), np.float32)
    target[labels, np.arange(lanes)] = 1
    d_out, d_bias = np.zeros_like(net.out), np.zeros_like(net.bias)
    d_states = (np.empty_like(on), np.empty_like(back))
    for t in range(steps):
        error = (net.position_chances(on[t], back[t]) - target) * (real[t] * scale).astype(np.float32)
        d_out[:, :size] += error @ on[t].T
        d_out[:, size:] += error @ back[t].T
        d_bias += error.sum(axis=1, keepdims=True)
        d_states[0][t] = net.out[:, :size].T @ error
        d_states[1][t] = net.out[:, size:].T @ error
    grads = []
    for layer, kept, d_all in zip(net.layers, trace, d_states):
        d_bytes, d_state = np.zeros_like(layer.bytes), np.zeros_like(layer.state)
        carried = np.zeros((size, lanes), np.float32)
        for t, before, (update, reset, candidate, recalled) in reversed(kept):
            d_h = d_all[t] + carried
            d_candidate = d_h * (1 - update) * (1 - candidate * candidate)
            d_update = d_h * (before - candidate) * update * (1 - update)
            d_reset = d_candidate * recalled * reset * (1 - reset)
            given = np.concatenate([d_update, d_reset, d_candidate])
            recall = np.concatenate([d_update, d_reset, d_candidate * reset])
            carried = d_h * update + layer.state.T @ recall
            d_state += recall @ before.T
            for row, values in enumerate(given):
                d_bytes[row] += np.bincount(windows[t], values, PAD + 1)
        grads += [d_bytes, d_state]
    return [*grads, d_out, d_bias]


def held_out() -> Column:
    """Rows the network never learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


#: first and last code point of letters that no language needs to be learned from: of two and of three bytes
FOREIGN_LETTERS = ((0x370, 0x3FF), (0x400, 0x4FF), (0x530, 0x58F), (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0xE01, 0xE30), (0x3041, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def foreign_parts(count: int, seed: int) -> list[bytes]:
    """Whole windows of no learned language: random Latin letters, consonants alone, letters of one other script."""
    rng = np.random.default_rng(seed)
    consonants = [ord(c) for c in "bcdfghjklmnpqrstvwxz"]
    out = []
    for k in range(count):
        first, last = FOREIGN_LETTERS[int(rng.integers(0, len(FOREIGN_LETTERS)))] if k % 3 == 0 else (0x61, 0x7A)
        codes = rng.choice(consonants, 2 * WINDOW) if k % 3 == 1 else rng.integers(first, last + 1, 2 * WINDOW)
        codes[rng.random(2 * WINDOW) < 1 / rng.integers(3, 9)] = 0x20
        spot = int(rng.integers(0, WINDOW))
        out.append("".join(map(chr, codes.tolist())).encode()[spot:spot + WINDOW])
    return out


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7, foreign: bool = False) -> Network:
    """Train on ``text`` and ``lang`` of at most ``sample_rows`` labelled rows that are not held out.

    With ``foreign`` the network also learns what is none of these languages, from made-up windows as
    many as an average language has; texts that look most like those are ``und``.

    The rows with the smallest hashes are taken, so the sample is the same each time. Only a few windows
    of each come to the driver: at most ``sample_rows`` x 6 x 64 bytes. Without labelled rows the
    network knows no language and everything is ``und``.
    """
    order = F.xxhash64(F.lit(seed), "doc_id")
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = labelled.select("doc_id", order.alias("at")).orderBy("at", "doc_id").limit(sample_rows).select("doc_id").distinct()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                raw = text.encode()
                spots = np.unique(np.linspace(0, max(0, len(raw) - WINDOW), SAMPLE_WINDOWS).astype(int))
                parts = [raw[s:s + WINDOW] for s in spots.tolist() if raw]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array(parts, pa.binary())], names=["lang", "part"])

    rows = labelled.join(F.broadcast(ids), "doc_id", "left_semi").filter(has_letter()).select("text", "lang")
    got = rows.mapInArrow(some, "lang string, part binary").limit(sample_rows * SAMPLE_WINDOWS).collect()
    got.sort(key=lambda r: (r.lang, bytes(r.part)))
    languages = sorted({r.lang for r in got})
    if not got:
        return Network([], (), np.empty(0), np.empty(0))
    parts = [bytes(r.part) for r in got]
    made = foreign_parts(-(-len(parts) // len(languages)), seed) if foreign else []
    labels = [r.lang for r in got] + [UNKNOWN] * len(made)
    parts, languages = parts + made, languages + [UNKNOWN] * foreign
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    windows, _ = cut_windows(np.frombuffer(b"".join(parts), np.uint8), offsets)
    place = {name: k for k, name in enumerate(languages)}
    return train(windows, np.array([place[name] for name in labels]), languages, seed)


def predict(docs: DataFrame, net: Network, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with ``pred`` and ``score``, the mean chance over all bytes of the text.

    Null texts, texts without a letter and those that a network with ``foreign`` takes for no language are ``und`` with score 0. Ties go to the first language by
    name. Existing columns of these two names are replaced. Only ``text`` is looked at.
    """
    names = net.languages

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            data, offsets = utf8(batch)
            windows, firsts = cut_windows(data, offsets)
            sums = np.zeros((len(names), firsts[-1] + 1), np.float64)
            for start in range(0, firsts[-1], LANES):
                part = np.ascontiguousarray(windows[:, start:start + LANES])
                sums[:, start + 1:start + 1 + part.shape[1]] = net.window_sums(part)
            sums = np.cumsum(sums, axis=1)
            total = sums[:, firsts[1:]] - sums[:, firsts[:-1]]
            mean = total / np.maximum(np.diff(offsets), 1)
            best = mean.argmax(axis=0)
            sure = np.clip(mean.max(axis=0), 0, 1).round(6)
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns[pred] = pa.array([names[k] for k in best.tolist()], pa.string())
            columns[score] = pa.array(sure)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.drop(pred, score)
    none = rows.withColumn(pred, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    if not names:
        return none
    judged = rows.mapInArrow(judge, none.schema)
    known = has_letter() & (F.col(pred) != UNKNOWN)
    return judged.withColumn(pred, F.when(known, F.col(pred)).otherwise(UNKNOWN)).withColumn(score, F.when(known, F.col(score)).otherwise(0.0))


def identify(docs: DataFrame, pred: str = "lang_pred", score: str = "score", **options) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and predict every row."""
    return predict(docs, fit(docs, **options), pred, score)
