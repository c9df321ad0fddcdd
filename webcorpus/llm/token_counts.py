"""Token counts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.batches import by_bytes, texts_of
from webcorpus.llm.pretokens import pretokens

VOCABULARY = "byte_bpe_50k.json"
SLICE_BYTES = 2 << 20
CACHED = 1 << 20
_NONE = np.int64(1) << np.int64(60)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """How such files spell bytes: printable ones as themselves, the others from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merges:
    """The merge ranks of a byte-level vocabulary file, looked up for whole arrays of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = next((t["content"] for t in spec.get("added_tokens", []) if t["special"]), None)
        self.n = max(vocabulary.values()) + 1
        letters = byte_letters()
        self.bytes = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        keys = np.array([vocabulary[a] * self.n + vocabulary[b] for a, b in pairs], np.int64)
        into = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys, first = np.unique(keys, return_index=True)  # a repeated pair keeps its first rank
        size = 1 << (int(len(keys) * 4).bit_length())
        self._shift, self._mask = np.uint64(64 - (size.bit_length() - 1)), size - 1
        self._keys, self._ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        self._into = into
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self._keys[slot[todo]] < 0
            chosen, where = np.unique(slot[todo][free], return_index=True)
            won = todo[free][where]
            self._keys[chosen], self._ranks[chosen] = keys[won], first[won]
            todo = np.setdiff1d(todo, won)
            slot[todo] = (slot[todo] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.n + right
        slot = self._slot(keys)
        held = self._keys[slot]
        out = np.where(held == keys, self._ranks[slot], _NONE)
        lost = np.flatnonzero((held != keys) & (held >= 0))
        while len(lost):
            slot[lost] = (slot[lost] + 1) & self._mask
            held = self._keys[slot[lost]]
            hit = held == keys[lost]
            out[lost[hit]] = self._ranks[slot[lost[hit]]]
            lost = lost[~hit & (held >= 0)]
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols each byte string ends with."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = lengths.copy()
        symbols = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        alive, sizes = np.arange(len(words)), lengths
        while True:
            # Each round: every sequence finds its lowest rank and merges that pair from the left.
            firsts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            if not len(symbols):
                return out
            rank = np.full(len(symbols), _NONE, np.int64)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
            full = sizes > 0
            lowest = np.full(len(sizes), _NONE, np.int64)
            lowest[full] = np.minimum.reduceat(rank, firsts[full])
            hit = (rank == lowest[owner]) & (rank < _NONE)
            at = np.flatnonzero(hit)
            if len(at):
                # In a row of hits (a a a) every second one overlaps the one before it.
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1] + 1
                row = np.flatnonzero(new)
                at = at[(np.arange(len(at)) - np.repeat(row, np.diff(np.append(row, len(at))))) % 2 == 0]
                symbols[at] = self._into[rank[at]]
            active = lowest < _NONE
            merged = np.bincount(owner[at], minlength=len(sizes)) if len(at) else np.zeros(len(sizes), np.int64)
            sizes = sizes - merged
            out[alive] = sizes
            keep = active[owner]
            keep[at + 1] = False
            symbols = symbols[keep]
            alive, sizes = alive[active], sizes[active]



class Known:
    """Counts of pre-tokens met before, up to a bound."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.counts[at]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if len(self.keys) + len(keys) > CACHED:
            return
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.counts = keys[order], np.concatenate([self.counts, counts])[order]


@cache
def _state(path: str) -> tuple[Merges, Known]:
    return Merges(path), Known()  # one a worker process: the memory serves all tasks


def count_batch(texts: list[str], merges: Merges, known: Known) -> np.ndarray:
    joined, at, to, hashes, special, firsts = pretokens(texts, merges.special)
    if not len(at):
        return np.zeros(len(texts), np.int64)
    unique, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    hit, counts = known.find(unique)
    new = np.flatnonzero(~hit)
    if len(new):
        words = [joined[a:b].encode("utf-8", "surrogatepass") for a, b in zip(at[sample[new]].tolist(), to[sample[new]].tolist())]
        counts[new] = merges.count(words)
        known.add(unique[new], counts[new])
    per_token = counts[which]
    per_token[special] = 1
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_token)])
    return sums[firsts[1:]] - sums[firsts[:-1]]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", key: str = "doc_id", out: str = "n_tokens") -> DataFrame:
    """``key``, the text's UTF-8 length ``n_bytes`` and its number of tokens.

    A null text counts as empty: 0 bytes, 0 tokens. Rows come back as they are, repeated and null keys
    included; other columns are not read. Texts are worked on whole, in slices of about 2 MiB.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, known = _state(vocabulary_path(vocabulary))
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            counts = count_batch(texts_of(batch), merges, known)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), pa.array(counts)], names=["key", "n_bytes", "n"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"key {kind}, n_bytes long, n long").select(F.col("key").alias(key), "n_bytes", F.col("n").alias(out))
