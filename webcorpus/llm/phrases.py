"""Collocations: phrases of two to four words that occur together more than their parts would.

Phrases are counted in burst tries. A task's trie begins as one hash container: arrays of entries in
order of the phrase's hash, to which batches are added at once. A container that grows too large bursts
into a node with one container for each leading byte of the first word's id, or of the second's once
all of it begin with one word. A trie that is full spills its largest subtrees whole, as sorted runs. Runs
are dealt by prefix (leading bits of the first word's id; very frequent first words are split by the
second word), and the runs of each prefix are merged.

A phrase can only be frequent if its parts are, so pairs are counted of frequent words only, and longer
phrases of frequent pairs only. "Is frequent" is a bitmap of fixed size over hashes: a bit may be set for
an infrequent part too, which costs time and changes no result.

Words are known by a 64-bit hash of language and word; the words themselves are looked up for the
phrases that are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webcorpus.llm.batches import by_bytes, ranges, utf8
from webcorpus.llm.hashing import Spans, mix
from webcorpus.llm.scratch import Scratch
from webcorpus.llm.words import word_hashes, word_spans

SLICE_BYTES = 2 << 20
HELD_BYTES = 64 << 20  # entries that a task's tries hold before they spill
BURST = 1 << 16  # entries of a container that bursts
KNOWN = 1 << 21  # words whose counts a task holds before it hands them on
BITS = 26  # the bitmap has so many address bits: 8 MiB
MERGE_BYTES = 32 << 20
UNKNOWN = "und"

#: ``[.,;:!?\x0A-\x0D]`` ends a piece; words are ``[^\x20\x09]+`` inside pieces
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
INSIDE = ~BREAK
INSIDE[[0x20, 0x09]] = False


class _Words:
    """The words of a slice of texts: places, ids, and which follow the one before in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.data = data
        self.starts, self.ends, firsts = word_spans(data, offsets, INSIDE)
        self.rows = np.repeat(np.arange(len(langs)), np.diff(firsts))
        self.ids = mix(word_hashes(data, self.starts, self.ends, lower=True) ^ langs[self.rows])
        piece = np.cumsum(BREAK[data])[self.starts] if len(self.starts) else np.empty(0, np.int64)
        self.follows = np.zeros(len(self.ids), bool)
        self.follows[1:] = piece[1:] == piece[:-1]
        self.follows[firsts[(firsts > 0) & (firsts < len(self.ids))]] = False

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k]:self.ends[k]].tobytes().lower()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, list[str]]]:
    for batch in by_bytes(batches, "text", SLICE_BYTES):
        names = batch.column("lang").to_pylist()
        langs = np.array([xxhash.xxh64_intdigest(name.encode()) for name in names], np.uint64)
        data, offsets = utf8(batch)
        for start, stop in ranges(data, SLICE_BYTES, BREAK):
            yield _Words(data[start:stop], np.clip(offsets, start, stop) - start, langs), names


def _languages(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")).filter(F.col("text").isNotNull())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``id, lang, word, f``: a task spells a word where it meets it first and counts it from then on."""
    known, counts, langs = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
    codes: dict[str, int] = {}

    def rows(ids: np.ndarray, lang: np.ndarray, spelt: list[str | None], f: np.ndarray) -> pa.RecordBatch:
        names = pa.array(list(codes), pa.string()).take(pa.array(lang))
        return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), names, pa.array(spelt, pa.string()), pa.array(f)], names=["id", "lang", "word", "f"])

    for words, names in _slices(batches):
        coded = np.array([codes.setdefault(name, len(codes)) for name in names], np.int32)
        ids, first, f = np.unique(words.ids, return_index=True, return_counts=True)
        at = np.searchsorted(known, ids)
        old = at < len(known)
        old[old] = known[at[old]] == ids[old]
        counts[at[old]] += f[old]
        new, first = ids[~old], first[~old]
        lang = coded[words.rows[first]]
        if len(new):
            yield rows(new, lang, [words.word(k).decode() for k in first.tolist()], f[~old])
        at = np.searchsorted(known, new)
        known, counts, langs = np.insert(known, at, new), np.insert(counts, at, 0), np.insert(langs, at, lang)
        if len(known) > KNOWN:
            yield rows(known, langs, [None] * len(known), counts)
            known, counts, langs = known[:0], counts[:0], langs[:0]
    again = counts > 0
    if again.any():
        yield rows(known[again], langs[again], [None] * int(again.sum()), counts[again])


class Bitmap:
    """Which hashes may be frequent; never wrong about one that is."""

    def __init__(self, words: np.ndarray):
        self._words, self._mask = words, np.uint64(64 * len(words) - 1)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        spot = hashes & self._mask
        return (self._words[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) > 0


def bitmap(hashes: DataFrame, bits: int) -> Bitmap:
    """The bitmap of a column ``h``: 2**bits bits, however many hashes there are."""
    spot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    packed = hashes.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[packed.column("at").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
    return Bitmap(words)


class Container:
    """Phrases by hash, with their words and counts; ``later`` are entries that are not yet in order."""

    def __init__(self, hashes: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.hashes, self.grams, self.counts = hashes, grams, counts
        self.later: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = len(hashes)

    def add(self, hashes: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> None:
        at = np.searchsorted(self.hashes, hashes)
        met = at < len(self.hashes)
        met[met] = self.hashes[at[met]] == hashes[met]
        self.counts[at[met]] += counts[met]
        new = ~met
        if new.any():
            self.later.append((hashes[new], grams[new], counts[new]))
            self.size += int(new.sum())
            if self.size - len(self.hashes) > max(1024, len(self.hashes) // 2):
                self.settle()

    def settle(self) -> None:
        if self.later:
            hashes, grams, counts = (np.concatenate(x) for x in zip((self.hashes, self.grams, self.counts), *self.later))
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            self.hashes, self.grams, self.counts = hashes[first], grams[order[first]], np.add.reduceat(counts[order], first)
            self.later, self.size = [], len(first)


def _byte(grams: np.ndarray, depth: int) -> np.ndarray:
    return (grams[:, depth // 8] >> np.uint64(56 - 8 * (depth % 8))) & np.uint64(255)


class Node:
    """What a container became: one container or node for each byte of a word's id at ``depth``."""

    def __init__(self, depth: int):
        self.depth = depth
        self.below: dict[int, Container | Node] = {}

    def add(self, hashes: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> None:
        """Distinct phrases in order of their words."""
        byte = _byte(grams, self.depth)
        edges = [*np.flatnonzero(np.append(True, byte[1:] != byte[:-1])).tolist(), len(byte)]
        for a, b in zip(edges, edges[1:]):
            key = int(byte[a])
            below = self.below.get(key)
            if below is None:
                order = np.argsort(hashes[a:b])
                below = self.below[key] = Container(hashes[a:b][order], grams[a:b][order], counts[a:b][order])
            else:
                below.add(hashes[a:b], grams[a:b], counts[a:b])
            if type(below) is Container and below.size > BURST:
                self.below[key] = burst(below, self.depth + 1)

    @property
    def size(self) -> int:
        return sum(b.size for b in self.below.values())


def burst(container: Container, depth: int) -> Container | Node:
    container.settle()
    firsts = container.grams[:, 0]
    if depth < 8 and (firsts == firsts[0]).all():
        depth = 8
    if container.size <= BURST or depth >= 16:
        return container
    node = Node(depth)
    order = np.lexsort(container.grams[:, 1::-1].T)
    node.add(container.hashes[order], container.grams[order], container.counts[order])
    return node


def _entries(node: Container | Node) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if type(node) is Container:
        node.settle()
        yield node.grams, node.counts
    else:
        for below in node.below.values():
            yield from _entries(below)


class Trie:
    """The counts of phrases of ``n`` words."""

    def __init__(self, n: int):
        self.n = n
        self.root = Node(0)

    def add(self, hashes: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort(grams[:, 1::-1].T)
        self.root.add(hashes[order], grams[order], counts[order])

    @property
    def bytes(self) -> int:
        return self.root.size * (8 * self.n + 16)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and counts of whole subtrees, the largest first, until ``keep`` bytes stay."""
        left, out = self.bytes, [(np.empty((0, self.n), np.uint64), np.empty(0, np.int64))]
        for key in sorted(self.root.below, key=lambda k: self.root.below[k].size, reverse=True):
            if left <= keep:
                break
            node = self.root.below.pop(key)
            left -= node.size * (8 * self.n + 16)
            out.extend(_entries(node))
        grams, counts = zip(*out)
        return np.concatenate(grams), np.concatenate(counts)


class Prefixes:
    """Which prefix a phrase belongs to: 2**bits ranges of first words, ``hot`` ones in parts of their own."""

    def __init__(self, bits: int, hot: dict[int, int]):
        self.bits = bits
        self.hot = np.array(sorted(hot), np.uint64)
        self.parts = np.array([hot[k] for k in sorted(hot)], np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        first = grams[:, 0]
        out = (first >> np.uint64(64 - self.bits)).astype(np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
            hot = self.hot[at] == first
            out[hot] = 2**self.bits + (mix(first[hot] ^ (grams[hot, 1] % self.parts[at[hot]])) >> np.uint64(24)).astype(np.int64)
        return out


def _packed(columns: np.ndarray, compressor: zstandard.ZstdCompressor) -> bytes:
    """Sorted numbers as bytes of the same weight side by side."""
    return compressor.compress(np.ascontiguousarray(columns.astype("<u8").view(np.uint8).reshape(len(columns), -1).T).tobytes())


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8 * width, -1)
    return np.ascontiguousarray(data.T).view("<u8").reshape(-1, width)


RUNS = "n int, prefix long, keys binary, counts binary"


def _runs(orders: tuple[int, ...], frequent, prefixes):
    """Texts to the sorted runs of their phrases, a row for each prefix; ``frequent`` and ``prefixes`` are broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, parts, prefix_of = {n: Trie(n) for n in orders}, frequent.value, prefixes.value
        compressor = zstandard.ZstdCompressor(level=1)

        def rows(keep: int) -> Iterator[pa.RecordBatch]:
            for n, trie in tries.items():
                grams, counts = trie.spill(keep // len(tries))
                if not len(grams):
                    continue
                prefix = prefix_of(grams)
                order = np.lexsort([*grams.T[::-1], prefix])
                grams, counts, prefix = grams[order], counts[order], prefix[order]
                edges = [*np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])).tolist(), len(prefix)]
                for some in range(0, len(edges) - 1, 256):
                    cuts = list(zip(edges[some:], edges[some + 1:some + 257]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([n] * len(cuts), pa.int32()), pa.array(prefix[[a for a, _ in cuts]]),
                            pa.array([_packed(grams[a:b], compressor) for a, b in cuts], pa.binary()), pa.array([_packed(counts[a:b], compressor) for a, b in cuts], pa.binary()),
                        ],
                        names=["n", "prefix", "keys", "counts"])

        for words, _ in _slices(batches):
            ids, spans = words.ids, Spans(words.ids, seed=5)
            if orders == (2,):
                known = parts.test(ids)
                ok = words.follows & known
                ok[1:] &= known[:-1]
            else:
                at = np.flatnonzero(words.follows)
                ok = np.zeros(len(ids), bool)
                ok[at] = parts.test(spans(at - 1, at + 1))
            ends = ok  # a phrase of two words may end here
            for n in range(2, max(orders) + 1):
                if n > 2:
                    longer = np.zeros(len(ids), bool)
                    longer[1:] = ends[:-1] & ok[1:]
                    ends = longer
                if n in orders:
                    at = np.flatnonzero(ends)
                    hashes, first, counts = np.unique(spans(at - (n - 1), at + 1), return_index=True, return_counts=True)
                    if len(hashes):
                        tries[n].add(hashes, ids[at[first][:, None] + np.arange(1 - n, 1)], counts)
            if sum(t.bytes for t in tries.values()) > HELD_BYTES:
                yield from rows(HELD_BYTES // 2)
        yield from rows(0)

    return run


COUNTED = "n int, words array<long>, f long, h long"


def _merged(least: int):
    """Runs, those of a prefix side by side, to the phrases that occur ``least`` times or more."""

    def flush(n: int, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort(keys.T[::-1])
        keys, counts = keys[order], counts[order]
        new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
        return keys[new], np.add.reduceat(counts, np.flatnonzero(new))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size, grown, last = 0, MERGE_BYTES, None

        def out() -> Iterator[pa.RecordBatch]:
            for n, runs in sorted(held.items()):
                keys, counts = flush(n, runs)
                keys, counts = keys[counts >= least], counts[counts >= least]
                if len(keys):
                    flat = keys.astype(np.uint64).ravel()
                    at = n * np.arange(len(keys))
                    lists = pa.ListArray.from_arrays(pa.array(n * np.arange(len(keys) + 1), pa.int32()), pa.array(flat.view(np.int64)))
                    # The hash that tasks of the next pass test: that of the words, wherever they stand.
                    hashes = Spans(flat, seed=5)(at, at + n)
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(keys), pa.int32()), lists, pa.array(counts), pa.array(hashes.view(np.int64))], names=["n", "words", "f", "h"])
            held.clear()

        for batch in batches:
            for n, prefix, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("n", "prefix", "keys", "counts"))):
                if prefix != last and size > MERGE_BYTES:
                    yield from out()
                    size, grown = 0, MERGE_BYTES
                elif size > 2 * grown:  # one prefix alone: add up what is there and go on
                    for k, runs in list(held.items()):
                        held[k] = [flush(k, runs)]
                    size = grown = sum(x[0].nbytes for runs in held.values() for x in runs)
                last = prefix
                rows = _unpacked(keys, n)
                held.setdefault(n, []).append((rows, _unpacked(counts, 1).ravel().astype(np.int64)))
                size += rows.nbytes
        yield from out()

    return merge


def count_phrases(scratch: Scratch, spark: SparkSession, docs: DataFrame, longest: int, least: int, bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``words`` (``id``, ``lang``, ``word``, ``f``: several rows a word), ``single`` (``id``, ``lang``, ``f``) and ``counted`` (``words``: ids, ``f``).

    ``single`` holds every word and ``counted`` every phrase of one to ``longest`` words that occurs ``least`` times or more.
    """
    texts = _languages(docs)
    words = scratch.keep(texts.mapInArrow(_count_words, "id long, lang string, word string, f long"), free=False)
    single = scratch.keep(words.groupBy("id", "lang").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), free=False)
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits_of_prefix = (4 * parts - 1).bit_length()
    # Words with more than a prefix's share of all: fewer than there are prefixes.
    often = single.filter(F.col("f") * 2**bits_of_prefix > total).select("id", "f").collect()
    prefixes = spark.sparkContext.broadcast(Prefixes(bits_of_prefix, {r.id % 2**64: -(-(r.f << bits_of_prefix) // total) for r in often}))
    counted = single.select(F.lit(1).alias("n"), F.array("id").alias("words"), "f", F.col("id").alias("h"))
    known = counted
    for orders in ((2,), tuple(range(3, longest + 1))):
        if not orders:
            break
        frequent = spark.sparkContext.broadcast(bitmap(known, bits))
        runs = texts.mapInArrow(_runs(orders, frequent, prefixes), RUNS)
        known = scratch.keep(runs.repartition(parts, "prefix").sortWithinPartitions("prefix").mapInArrow(_merged(least), COUNTED))
        counted = counted.unionByName(known)
        frequent.destroy()
    prefixes.destroy()
    return words, single, counted.select("n", "words", "f")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, scale: int = 2_000_000, share: int = 80, top: int | None = 2000) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Text is lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and those at blanks and tabs
    into words. Candidates are phrases of 2 to ``longest`` words of one piece that occur ``least`` times
    or more in their language. A cut after ``k`` words gives ``floor(scale * a / (l + r))`` from the
    counts of both parts; the lowest counts, the smallest ``k`` among equals. Candidates inside a longer
    one that occurs at least ``share`` percent as often go. ``top`` limits each language (None: all);
    equal scores are ranked by ``a`` descending and phrase.

    A null language is ``und``; null and empty texts have no words; repeated rows count each time; an empty table gives no rows. Only ``text`` and ``lang`` are read. Texts of any length are
    counted whole, in parts that end where a piece ends.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    words, single, counted = count_phrases(scratch, spark, docs, longest, least)
    phrases = counted.filter("n > 1")
    cuts = phrases.select("words", "n", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", 1, F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, F.col("n") - F.col("k")).alias("tail"))
    heads = counted.select(F.col("words").alias("head"), F.col("f").alias("l"))
    tails = counted.select(F.col("words").alias("tail"), F.col("f").alias("r"))
    wide = F.expr(f"cast({scale} as decimal(18,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))")
    scored = (
        cuts.join(heads, "head").join(tails, "tail").withColumn("score", wide)
        .groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("words", "a", "cut.l", "cut.r", "cut.score")
    )
    inner = phrases.filter("n > 2").select(
        "words", "n", "f", F.explode(F.expr("flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), s -> struct(m, s))))")).alias("at"))
    longer = inner.select(F.slice("words", F.col("at.s"), F.col("at.m")).alias("words"), "f").groupBy("words").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, "words", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
    by_lang = words.groupBy("lang").agg(F.sum("f").alias("n"))
    kept = kept.withColumn("id", F.element_at("words", 1)).join(single.select("id", "lang"), "id").drop("id")
    if top is not None:  # with all that tie, since the phrases that part them are not known yet
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        kept = kept.withColumn("at", F.rank().over(best)).filter(F.col("at") <= top).drop("at")
    kept = scratch.keep(kept, free=False)
    each = kept.select("words", F.posexplode("words").alias("at", "id"))
    spelt = words.filter("word IS NOT NULL").join(each.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("word").alias("word"))
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ")
    phrases = each.join(spelt, "id").groupBy("words").agg(phrase.alias("phrase"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = kept.join(phrases, "words").join(by_lang, "lang").withColumn("rank", F.row_number().over(ranked).cast("long"))
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
