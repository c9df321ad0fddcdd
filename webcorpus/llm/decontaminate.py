"""Benchmark decontamination by winnowing.

Of every six consecutive five-word grams the one with the smallest hash is a fingerprint. Two texts that
share ten words share those six grams, hence a fingerprint: no shared window is missed. Fingerprints of
documents and items are joined, and each hit is extended to the ten-word windows around it. Items of
fewer words are windows of their own; every gram of their length is a fingerprint.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.batches import by_bytes, utf8
from webcorpus.llm.hashing import Spans
from webcorpus.llm.scratch import settled
from webcorpus.llm.words import ALPHANUMERIC, word_hashes, word_spans

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 2 << 20  # benchmark text that is sent to the executors at once
SLICE_BYTES = 2 << 20
OUT = ("n_words", "hit_words", "items")


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each text."""
    starts, ends, firsts = word_spans(data, offsets, ALPHANUMERIC)
    return word_hashes(data, starts, ends, lower=True), firsts


def starts_within(firsts: np.ndarray, length: int, n: int) -> np.ndarray:
    """For each word, whether ``length`` words from it on belong to one text."""
    ends = np.repeat(firsts[1:], np.diff(firsts))
    return np.arange(n) + length <= ends


def fingerprints(hashes: np.ndarray, firsts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the smallest gram of each window, the last one if several are smallest."""
    grams = Spans(hashes, seed=2).every(gram)
    span = window - gram + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    smallest, where = grams[:n].copy(), np.arange(n)
    for k in range(1, span):
        other = grams[k:k + n]
        less = other <= smallest
        smallest[less] = other[less]
        where[less] = np.flatnonzero(less) + k
    chosen = np.unique(where[starts_within(firsts, window, len(hashes))[:n]])
    return chosen, grams[chosen]


class Benchmark:
    """A block of items: fingerprints, windows and which items have them."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int, gram: int):
        self.window, self.gram, self.names = window, gram, [name for name, _ in rows]
        raw = [text.encode() for _, text in rows]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        hashes, firsts = words_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
        sizes = np.diff(firsts)
        _, marks = fingerprints(hashes, firsts, window, gram)
        self.marks = np.unique(marks)
        owner = np.repeat(np.arange(len(rows)), sizes)
        #: window length -> sorted window hashes (two each), and the items of each
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]] = {}
        for length in sorted({min(int(s), window) for s in sizes if s}):
            ok = starts_within(firsts, length, len(hashes))
            ok &= (sizes[owner] == length) if length < window else True
            at = np.flatnonzero(ok)
            one, two = Spans(hashes, seed=4)(at, at + length), Spans(hashes, seed=5)(at, at + length)
            items: dict[tuple[int, int], set[int]] = defaultdict(set)
            for a, b, item in zip(one.tolist(), two.tolist(), owner[at].tolist()):
                items[a, b].add(item)
            keys = sorted(items)
            self.windows[length] = (np.array([a for a, _ in keys], np.uint64), np.array([b for _, b in keys], np.uint64), [sorted(items[k]) for k in keys])

    def hits(self, hashes: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[list[int]], np.ndarray]]:
        """For each window length: starts of occurring windows, the length, all windows' items, and each start's window."""
        n = len(hashes)
        for length, (one, two, items) in self.windows.items():
            if n < length:
                continue
            within = starts_within(firsts, length, n)
            if length == self.window:
                at, marks = fingerprints(hashes, firsts, self.window, self.gram)
                at = at[_found(self.marks, marks) >= 0]
                around = (at[:, None] - np.arange(self.window - self.gram + 1)).ravel()
                at = np.unique(around[around >= 0])
                at = at[within[at]]
            else:
                at = np.flatnonzero(within)
            first = Spans(hashes, seed=4)(at, at + length)
            place = _found(one, first)
            at, place = at[place >= 0], place[place >= 0]
            second = Spans(hashes, seed=5)(at, at + length)
            # Equal first hashes stand next to each other; the second tells them apart.
            while len(place):
                wrong = two[place] != second
                if not wrong.any():
                    break
                more = wrong & (place + 1 < len(one))
                more[more] = one[place[more] + 1] == one[place[more]]
                place = place + more
                keep = ~wrong | more
                at, place, second = at[keep], place[keep], second[keep]
            yield at, length, items, place


def _found(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value first stands in a sorted array, or -1."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[DataFrame]:
    """Distinct ``items`` in parts of at most ``block_bytes`` of text, or of one larger item."""
    size, mark = F.octet_length("text"), F.xxhash64("name", "text")
    items = settled(items.distinct().withColumn("large", size > block_bytes).withColumn("mark", mark))
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(1, -(-2 * total // block_bytes))
    while True:
        bucket = F.when(F.col("large"), F.col("mark")).otherwise(F.pmod("mark", F.lit(buckets)))
        sizes = items.groupBy("large", bucket.alias("bucket")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).collect()
        if all(r.large or r.bytes <= block_bytes or r.n == 1 for r in sizes):
            break
        buckets *= 2
    groups, held = [], block_bytes
    for r in sorted((r for r in sizes if not r.large), key=lambda r: r.bucket):
        if held + r.bytes > block_bytes:
            groups.append((False, []))
            held = 0
        groups[-1][1].append(r.bucket)
        held += r.bytes
    groups += [(True, [r.bucket]) for r in sizes if r.large]
    for large, chosen in groups:
        yield items.filter((F.col("large") == large) & bucket.isin(chosen)).select("name", "text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, out: tuple[str, str, str] = OUT) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``hit_words`` (word positions) and ``items`` (ids as text).

    ``out`` names the three.

    The benchmark is a query set: its distinct items are sent to the executors in blocks of at most
    ``block_bytes`` (or one item), all of which are held until the documents are read, and documents pass all blocks row by row, without a shuffle. Null texts have no words,
    and items without words never hit. Items of the same id count once; hits of items with a null id
    are hits, but the id is not listed. Columns of the three names are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    n_words, hit_words, found = out
    marked = docs.drop(*out).withColumn(n_words, F.lit(0).cast("int")).withColumn(hit_words, F.array().cast("array<int>")).withColumn(found, F.array().cast("array<string>"))
    schema = marked.schema
    empty = items.limit(0)  # words are counted without a benchmark, too
    for part in [*_blocks(items, block_bytes)] or [empty]:
        rows = sorted(((r.name_, r.text) for r in part.select(F.col("name").alias("name_"), "text").collect()), key=lambda r: (r[0] is None, r))
        sent = spark.sparkContext.broadcast(Benchmark(rows, window, gram))
        marked = marked.mapInArrow(_marker(sent, text, out), schema)
    return marked


def _marker(sent, text: str, out: tuple[str, str, str]):
    n_words, hit_words, items_found = out

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = sent.value
        for batch in by_bytes(batches, text, SLICE_BYTES):
            hashes, firsts = words_of(*utf8(batch, text))
            hit = np.zeros(len(hashes), bool)
            found: dict[int, set[str]] = defaultdict(set)
            for at, length, items, place in bench.hits(hashes, firsts):
                for k in range(length):
                    hit[at + k] = True
                rows = np.searchsorted(firsts, at, side="right") - 1
                for row, window in sorted({*zip(rows.tolist(), place.tolist())}):
                    found[row].update(bench.names[i] for i in items[window] if bench.names[i] is not None)
            spots = np.flatnonzero(hit)
            bounds = np.searchsorted(spots, firsts)
            local = spots - np.repeat(firsts[:-1], np.diff(bounds))
            old_hits, old_items = batch.column(hit_words), batch.column(items_found)
            lists = [sorted({*o, *local[a:b].tolist()}) if o else local[a:b].tolist() for o, a, b in zip(old_hits.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist())]
            names = [sorted({*o, *found.get(k, ())}) for k, o in enumerate(old_items.to_pylist())]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns |= {n_words: pa.array(np.diff(firsts), pa.int32()), hit_words: pa.array(lists, pa.list_(pa.int32())), items_found: pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return mark
