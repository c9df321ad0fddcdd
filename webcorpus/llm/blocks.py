"""Which windows of fixed length occur elsewhere, by way of blocks around content-defined anchors.

Of the grams in a window the one with the smallest upper half of its hash (the first of several) is its anchor, so equal
windows have equal anchors at equal places. Consecutive windows with one anchor form a *block*: the text
from the first window's start to the last one's end. Every window lies in exactly one block, there are
about ``2 / (window - gram + 2)`` blocks per unit, and

* equal blocks have equal windows, so one row per distinct block answers for all its copies;
* windows of different blocks can only be equal if the blocks' anchors are.

Hence blocks are grouped by anchor and content; only distinct blocks with the same anchor are taken
apart into windows. No pairs are ever made, and hot passages shrink to one row before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.batches import by_bytes, utf8
from webcorpus.llm.hashing import Spans, mix
from webcorpus.llm.scratch import Scratch

SLICE_BYTES = 256 << 10  # arrays of a slice stay in a core's cache
HOT = 1024  # distinct blocks of one anchor from which on its windows are spread over tasks
BUCKET_WINDOWS = 256 << 10  # windows that one task compares at a time
_PLACE = np.uint64(2**32 - 1)
#: (text bytes, offsets) -> unit values and the first unit of each text
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tie`` (a hash of the text) and ``text``: rows equal in the first two get equal results."""
    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")


def anchors(values: np.ndarray, firsts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all texts: first window, last window, position of the anchor, and hash of the anchor."""
    grams = Spans(values, seed=2).every(gram)
    span = window - gram + 1
    n = len(values) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    # The upper half of the hash and the place in one number: the smallest is the first of several.
    smallest, reach = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    while reach < span:  # the smallest of twice as many grams each time
        step = min(reach, span - reach)
        smallest = np.minimum(smallest[:len(smallest) - step], smallest[step:])
        reach += step
    lengths = np.diff(firsts)
    inside = np.zeros(n + 1, bool)  # the window lies in one text
    starts, stops = firsts[:-1][lengths >= window], firsts[1:][lengths >= window] - window + 1
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    inside = np.cumsum(change[:n]) > 0
    new = np.zeros(n, bool)
    new[0] = True
    new[1:] = smallest[1:n] != smallest[:n - 1]
    new[starts] = True
    stop = np.zeros(n, bool)
    stop[stops[stops < n]] = True
    low = np.flatnonzero(new & inside)
    edge = np.flatnonzero(new | stop)
    after = np.append(edge, n)[np.searchsorted(edge, low) + 1]
    at = (smallest[low] & _PLACE).astype(np.int64)
    return low, after - 1, at, grams[at]


def owners(firsts: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(firsts, at, side="right") - 1


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


BLOCK_FIELDS = "tie long, low int, high int, anchor long, body long"


def find_blocks(docs: DataFrame, units: Units, window: int, gram: int, only: bool = False) -> DataFrame:
    """One row per block: ``doc_id``, ``tie``, ``low`` and ``high`` (window starts), ``anchor`` and ``body`` hashes.

    With ``only``, ``docs`` has a column ``spots`` of anchor positions, and other anchors are left out.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            values, firsts = units(*utf8(batch))
            low, high, at, marks = anchors(values, firsts, window, gram)
            owner = owners(firsts, low)
            if only:
                spots = batch.column("spots")
                lists = spots.flatten().to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(batch.num_rows), np.diff(spots.offsets.to_numpy()))
                keep = np.isin(at, firsts[rows] + lists)
                low, high, at, marks, owner = low[keep], high[keep], at[keep], marks[keep], owner[keep]
            body = Spans(values, seed=6)(low, high + window)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("tie").take(take), pa.array((low - firsts[owner]).astype(np.int32)), pa.array((high - firsts[owner]).astype(np.int32)), signed(marks), signed(body)],
                names=["doc_id", "tie", "low", "high", "anchor", "body"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"doc_id {kind}, {BLOCK_FIELDS}")


def _windows_of(units: Units, window: int, buckets: int):
    """Blocks in ``parts`` to their windows' hashes: one row per block, or per window of an anchor with very many blocks.

    ``step`` is the place of the first of ``contents`` in the block. Blocks of one anchor are in one bucket,
    windows of the others where their contents are.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            values, firsts = units(*utf8(batch))
            parts = batch.column("parts")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            fields = parts.flatten()
            start, stop, kinds, anchor = (fields.field(name).to_numpy() for name in ("low", "high", "kinds", "anchor"))
            sizes = stop - start + 1
            ends = np.cumsum(sizes)
            at = np.repeat(start + firsts[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
            contents = Spans(values, seed=7)(at, at + window)
            hot = kinds > HOT
            pieces = np.where(hot, sizes, 1)
            block = np.repeat(np.arange(len(rows)), pieces)
            step = np.arange(len(block)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            bounds = np.append(0, np.cumsum(np.where(hot, 1, sizes)[block]))
            key = mix(anchor[block].view(np.uint64), seed=3)
            spread = hot[block]
            key[spread] = mix(key[spread] ^ contents[bounds[:-1][spread]], seed=4)
            take = pa.array(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array((key % np.uint64(buckets)).astype(np.int32)), fields.field("anchor").take(take), fields.field("body").take(take), batch.column("at_id").take(pa.array(rows[block])),
                 pa.array(step.astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), signed(contents))],
                names=["bucket", "anchor", "body", "first", "step", "contents"],
            )

    return spell


def _met(earlier: bool):
    """Rows of one bucket to the runs of their windows that stand elsewhere."""

    def meet(table: pa.Table) -> pa.Table:
        contents = table.column("contents").combine_chunks()
        bounds = contents.offsets.to_numpy().astype(np.int64)
        bounds, sizes = bounds[:-1] - bounds[0], np.diff(bounds)
        hashes = contents.flatten().to_numpy()
        anchor, step = table.column("anchor").to_numpy(), table.column("step").to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((anchor[owner], hashes))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (anchor[owner[order[1:]]] != anchor[owner[order[:-1]]])
        firsts = np.flatnonzero(new)
        times = np.diff(np.append(firsts, len(order)))
        alive = np.repeat(times > 1, times)
        if earlier and len(order):
            place = pc.rank(table.column("first"), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()[owner[order]]
            alive &= np.repeat(np.minimum.reduceat(place, firsts), times) < place
        seen = np.sort(order[alive])
        row = owner[seen]
        window = seen - bounds[row] + step[row]
        edge = np.ones(len(seen), bool)
        edge[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(seen))[:len(begin)] - 1
        used, starts = np.unique(row[begin], return_index=True)
        runs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(begin)).astype(np.int32)), pa.array((window[begin].astype(np.int64) << 32) + window[end]))
        take = pa.array(used)
        return pa.table({"anchor": table.column("anchor").take(take), "body": table.column("body").take(take), "steps": runs})

    return meet


def repeated_windows(scratch: Scratch, docs: DataFrame, found: DataFrame, units: Units, window: int, earlier: bool) -> DataFrame:
    """``doc_id``, ``tie`` and ``covers``: the windows of each document that also start elsewhere.

    ``found`` are the blocks, a written table. Elsewhere is any other place, or with ``earlier`` any
    document with a smaller ``doc_id`` (null counts as the smallest). ``covers`` are runs of window
    starts, each as ``first * 2**32 + last``. Documents without any are left out.
    """
    classes = scratch.keep(
        found.groupBy("anchor", "body").agg(
            F.count("*").alias("n"), F.min(F.struct("doc_id", "tie", "low", "high")).alias("place"))
    )
    # Struct order puts null first, so the place is in the document with the smallest id.
    multi = classes.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    parts = F.struct("anchor", "body", "kinds", F.col("place.low").alias("low"), F.col("place.high").alias("high"))
    wanted = scratch.keep(  # the classes' shuffle goes before that of the texts comes
        classes.join(multi, "anchor")
        .groupBy(F.col("place.doc_id").alias("at_id"), F.col("place.tie").alias("at_tie"))
        .agg(F.collect_list(parts).alias("parts"), F.sum(F.col("place.high") - F.col("place.low") + 1).alias("windows"))
    )
    buckets = -(-(wanted.agg(F.sum("windows")).first()[0] or 1) // BUCKET_WINDOWS)
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("tie") == F.col("at_tie"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.join(wanted, same).select("at_id", "at_tie", "text", "parts")
    if not docs.groupBy("doc_id", "tie").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["at_id", "at_tie"])  # a document that is there twice would spell its blocks twice
    spelt = texts.select("at_id", "text", "parts").mapInArrow(
        _windows_of(units, window, buckets), f"bucket int, anchor long, body long, first {kind}, step int, contents array<long>")
    # Windows travel as arrays and are told apart in the task where an anchor's blocks meet. Of an anchor with very many
    # blocks no task gets all: equal windows meet, one by one.
    met = spelt.groupBy("bucket").applyInArrow(_met(earlier), "anchor long, body long, steps array<long>")
    partial = scratch.keep(met.groupBy("anchor", "body").agg(F.flatten(F.collect_list("steps")).alias("steps")))
    known = classes.select("anchor", "body", "n", F.col("place.doc_id").alias("first")).join(partial, ["anchor", "body"], "left")
    whole = _before(F.col("first"), F.col("doc_id")) if earlier else F.col("n") > 1
    answers = scratch.keep(known.filter(F.col("steps").isNotNull() | (F.col("n") > 1)))
    scratch.drop(classes, wanted, partial)

    def pack(low, high):
        return F.shiftleft(low.cast("long"), 32) + high

    moved = pack(F.col("low"), F.col("low"))
    runs = F.when(whole, F.array(pack(F.col("low"), F.col("high")))).otherwise(
        F.transform(F.coalesce("steps", F.array().cast("array<long>")), lambda s: s + moved))
    met = found.join(answers, ["anchor", "body"]).select("doc_id", "tie", runs.alias("runs")).filter(F.size("runs") > 0)
    met = scratch.keep(met)  # the blocks' shuffle goes before that of the documents comes
    scratch.drop(found, answers)
    covers = scratch.keep(met.groupBy("doc_id", "tie").agg(F.flatten(F.collect_set("runs")).alias("covers")))
    scratch.drop(met)
    return covers


def _before(a, b):
    """``a`` is a smaller document id than ``b``; null is smaller than any other."""
    return F.coalesce(a < b, a.isNull() & b.isNotNull())


def with_covers(docs: DataFrame, covers: DataFrame) -> DataFrame:
    """All documents with their ``covers`` (null if none)."""
    named = covers.select(F.col("doc_id").alias("at_id"), F.col("tie").alias("at_tie"), "covers")
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("tie") == F.col("at_tie"))
    return docs.join(named, same, "left").select("doc_id", "text", "covers")


def covered(covers: list[int] | np.ndarray | None, length: int, window: int) -> np.ndarray:
    """Which of ``length`` units lie in a covered window."""
    change = np.zeros(length + 1, np.int32)
    if covers is not None and len(covers):
        packed = np.asarray(covers, np.int64)
        np.add.at(change, packed >> 32, 1)
        np.add.at(change, (packed & 0xFFFFFFFF) + window, -1)
    return np.cumsum(change[:length]) > 0
