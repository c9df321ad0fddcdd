"""Repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Every window of ``window`` bytes has an anchor (``blocks.py``); the suffixes at anchors are sorted to the
depth of ``gram`` bytes, which all windows of an anchor share. A task sorts its suffixes into a run,
front-codes it (each suffix as the length of the prefix it shares with the one before, and the rest) and
sends each key range to the task that merges it. There a loser tree merges the runs: it carries the
common prefix with the last suffix put out, so contenders are compared behind what is known to be equal.
Suffixes that come out with a full common prefix are repeated; their blocks are then compared whole.

Trees of many key ranges are worked in step, one array element each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.batches import by_bytes, utf8
from webcorpus.llm.blocks import SLICE_BYTES, anchors, covered, find_blocks, keyed, owners, repeated_windows, with_covers
from webcorpus.llm.hashing import mix
from webcorpus.llm.scratch import Scratch
from webcorpus.llm.words import byte_values

WINDOW, GRAM = 50, 20
RUN = 1 << 20  # suffixes of a run
BUCKET_BYTES = 16 << 20  # run data that one task merges
SAMPLE_BYTES = 64 << 20  # text whose suffixes are sampled for the bounds of key ranges
SAMPLES = 128  # of each key range
LANES = 4096
FAN = 32  # runs that a tree merges; more are merged in rounds
WORD = 8
_RUN_OF = 2**32 - 1
_FROM_BYTE = np.array([1 << (8 * k) for k in range(WORD)], np.uint64)


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return byte_values(data), offsets


def suffix_keys(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` bytes from each position as big-endian 64-bit numbers, (n, words)."""
    width = -(-depth // WORD) * WORD
    letters = np.zeros((len(at), width), np.uint8)
    letters[:, :depth] = np.lib.stride_tricks.sliding_window_view(data, depth)[at]
    return letters.view(">u8").astype(np.uint64)


def sorted_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys: by their first words, then the others where those are equal."""
    order = np.argsort(keys[:, 0], kind="stable")
    head = keys[order, 0]
    same = np.concatenate([[False], head[1:] == head[:-1]])
    tied = np.flatnonzero(same | np.append(same[1:], False))
    rows, group = order[tied], np.cumsum(~same)[tied]
    order[tied] = rows[np.lexsort((*keys[rows, 1:].T[::-1], group))]
    return order


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes two 64-bit numbers share."""
    return WORD - np.searchsorted(_FROM_BYTE, a ^ b, side="right")


def prefixes_before(keys: np.ndarray, depth: int) -> np.ndarray:
    """The common prefix of each sorted key with the one before it, in bytes."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        going = np.ones(len(keys) - 1, bool)
        for w in range(keys.shape[1]):
            same = shared_bytes(keys[1:, w], keys[:-1, w])
            out[1:] += np.where(going, same, 0)
            going &= same == WORD
    return np.minimum(out, depth)


def front_code(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared prefix lengths and the remaining bytes of sorted keys."""
    shared = prefixes_before(keys, depth)
    letters = keys.astype(">u8").view(np.uint8).reshape(len(keys), -1)[:, :depth]
    return shared.astype(np.uint8), letters[np.arange(depth) >= shared[:, None]]


def front_decode(shared: np.ndarray, rest: np.ndarray, depth: int) -> np.ndarray:
    """The keys again. A column's byte is the last one written in that column."""
    n = len(shared)
    letters = np.zeros((n, -(-depth // WORD) * WORD), np.uint8)
    fresh = np.arange(depth) >= shared[:, None]
    raw = np.zeros((n, depth), np.uint8)
    raw[fresh] = rest
    for c in range(depth):
        last = np.maximum.accumulate(np.where(fresh[:, c], np.arange(n), 0))
        letters[:, c] = raw[last, c]
    return letters.view(">u8").astype(np.uint64)


def merge_runs(keys: np.ndarray, shared: np.ndarray, begin: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs lane by lane: rows of ``keys`` in order, and each one's prefix shared with the one before.

    ``begin`` and ``end`` are (lanes, runs) bounds of rows; every key of a lane is below all keys of the
    next lane. Each lane is one loser tree. A loser knows the prefix it shares with the key that beat
    it; a contender knows the one it shares with the last key put out. Of two such prefixes the longer
    one wins unseen, and only equal ones are compared, from where they end.
    """
    # The fullest lanes first: those that are done are then left out at the end of the arrays.
    totals = (end - begin).sum(axis=1)
    turn = np.argsort(-totals, kind="stable")
    begin, end, totals = begin[turn], end[turn], totals[turn]
    lanes, runs = begin.shape
    width = 1 << max(1, (runs - 1).bit_length())
    nothing = len(keys)
    keys = np.vstack([keys, np.full((1, keys.shape[1]), 2**64 - 1, np.uint64)])
    shared = np.append(shared.astype(np.int64), 0)
    head = np.full((lanes, width), nothing)
    stop = np.zeros((lanes, width), np.int64)
    head[:, :runs] = np.where(begin < end, begin, nothing)
    stop[:, :runs] = end

    def compare(a: np.ndarray, b: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether row b is below row a, and their common prefix; ``known`` bytes are equal."""
        below, prefix = np.zeros(len(a), bool), np.full(len(a), depth)
        todo = np.flatnonzero(known < depth)
        word = known[todo] // WORD
        while len(todo):
            x, y = keys[a[todo], word], keys[b[todo], word]
            differ = x != y
            done = todo[differ]
            below[done] = y[differ] < x[differ]
            prefix[done] = word[differ] * WORD + shared_bytes(x[differ], y[differ])
            todo, word = todo[~differ], word[~differ] + 1
            more = word < keys.shape[1]
            todo, word = todo[more], word[more]
        return below, np.minimum(prefix, depth)

    loser = np.zeros((lanes, width), np.int64)
    every = np.arange(lanes)
    winners = np.broadcast_to(np.arange(width), (lanes, width))
    while winners.shape[1] > 1:
        half = winners.shape[1] // 2
        a, b = winners[:, 0::2], winners[:, 1::2]
        rows = np.repeat(every, half)
        below, prefix = compare(head[rows, a.ravel()], head[rows, b.ravel()], np.zeros(lanes * half, np.int64))
        below = below.reshape(lanes, half)
        # A node holds prefix and run in one number, so the longer prefix is the larger number.
        loser[:, half:2 * half] = (prefix.reshape(lanes, half) << 32) | np.where(below, a, b)
        winners = np.where(below, b, a)
    best = winners[:, 0].copy()
    tree, heads, stops, base = loser.ravel(), head.ravel(), stop.ravel(), every * width
    firsts = np.cumsum(totals) - totals
    order_out, prefix_out = np.empty(int(totals.sum()), np.int64), np.empty(int(totals.sum()), np.int64)
    left = np.searchsorted(-totals, -np.arange(int(totals.max(initial=0))), side="left")  # lanes not yet empty
    for step, n in enumerate(left.tolist()):
        lane, best = base[:n], best[:n]
        winner = best & _RUN_OF
        slot = lane + winner
        row = heads[slot]
        at = firsts[:n] + step
        order_out[at], prefix_out[at] = row, best >> 32
        following = row + 1
        following = np.where(following < stops[slot], following, nothing)
        heads[slot] = following
        best = (shared[following] << 32) | winner
        node = (winner + width) >> 1
        while node[0]:
            place = lane + node
            other = tree[place]
            ahead, behind = np.maximum(best, other), np.minimum(best, other)
            level = np.flatnonzero((best ^ other) >> 32 == 0)
            if len(level):
                known, a, b = best[level] >> 32, best[level] & _RUN_OF, other[level] & _RUN_OF
                below, common = compare(heads[lane[level] + a], heads[lane[level] + b], known)
                ahead[level] = (known << 32) | np.where(below, b, a)
                behind[level] = (common << 32) | np.where(below, a, b)
            tree[place] = behind
            best = ahead
            node >>= 1
    # From the order of lanes by size back to that of their keys.
    back = np.argsort(turn, kind="stable")
    place = np.repeat(firsts[back], totals[back]) + np.arange(len(order_out)) - np.repeat(np.cumsum(totals[back]) - totals[back], totals[back])
    return order_out[place], prefix_out[place]


def lane_bounds(keys: np.ndarray, firsts: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut sorted runs at common keys so that lanes are about equal: (lanes, runs) begins and ends."""
    runs = len(firsts) - 1
    step = max(1, len(keys) // (lanes * 64))
    picked = np.concatenate([keys[a:b:step] for a, b in zip(firsts[:-1], firsts[1:])])
    picked = picked[np.lexsort(picked.T[::-1])]
    splits = np.unique(picked[np.linspace(0, len(picked) - 1, min(lanes, len(picked)) + 1).astype(int)[1:-1]], axis=0)
    whole = _comparable(keys)
    bounds = np.stack([np.searchsorted(whole[a:b], _comparable(splits)) + a for a, b in zip(firsts[:-1], firsts[1:])], axis=1)
    return np.vstack([firsts[None, :-1], bounds]), np.vstack([bounds, firsts[None, 1:]]) if runs else (bounds, bounds)


def merge_rounds(keys: np.ndarray, firsts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge any number of sorted runs: rows of ``keys`` in order, and each one's prefix shared with the one before.

    A tree over hundreds of runs leaves few lanes to work in step. So trees take ``FAN`` runs at most, those
    of all groups of runs in step, and the runs they make are merged in the next round.
    """
    order = np.arange(len(keys))
    while True:
        runs = len(firsts) - 1
        groups = max(1, -(-runs // FAN))
        cuts = np.linspace(0, runs, groups + 1).astype(int)
        begins, ends = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            low, high = int(firsts[a]), int(firsts[b])
            lanes = max(1, min(LANES // groups, (high - low) // (4 * (b - a))))
            for held, bounds in zip((begins, ends), lane_bounds(keys[low:high], firsts[a:b + 1] - low, lanes)):
                held.append(np.pad(bounds + low, ((0, 0), (0, FAN - (b - a)))) if groups > 1 else bounds + low)
        turn, prefix = merge_runs(keys, prefixes_before(keys, depth), np.vstack(begins), np.vstack(ends), depth)
        order = order[turn]
        if groups == 1:
            return order, prefix
        keys, firsts = keys[turn], firsts[cuts]


def _comparable(keys: np.ndarray) -> np.ndarray:
    """Keys as byte strings that compare like the keys."""
    return np.ascontiguousarray(keys.astype(">u8")).view(f"S{keys.shape[1] * WORD}").ravel()


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def _runs(splits: np.ndarray, window: int, gram: int):
    bounds = _comparable(splits) if len(splits) else None

    def flush(parts: list[tuple], ids: list, ties: list, slots: list) -> Iterator[pa.RecordBatch]:
        keys, docs, spots = (np.concatenate(p) for p in zip(*parts))
        order = sorted_order(keys)  # documents and places come in order
        keys, docs, spots = keys[order], docs[order], spots[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        firsts = np.flatnonzero(new)  # equal suffixes are one entry of the run
        sizes = np.diff(np.append(firsts, len(keys)))
        entries = keys[firsts]
        edges = np.concatenate([[0], [] if bounds is None else np.searchsorted(_comparable(entries), bounds), [len(entries)]]).astype(int)
        columns = [pa.concat_arrays(ids), pa.concat_arrays(ties), pa.concat_arrays(slots)]
        for bucket, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if a == b:
                continue
            shared, rest = front_code(entries[a:b], gram)
            low, high = firsts[a], firsts[b - 1] + sizes[b - 1]
            used, local = np.unique(docs[low:high], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), *(pa.array([_pack(x)], pa.binary()) for x in (shared, rest, sizes[a:b].astype("<u4"), local.astype("<u4"), spots[low:high].astype("<u4"))),
                 *(pa.ListArray.from_arrays([0, len(used)], c.take(pa.array(used))) for c in columns)],
                names=["bucket", "shared", "rest", "sizes", "docs", "spots", "ids", "ties", "slots"],
            )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, ties, slots, held, rows = [], [], [], [], 0, 0
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            data, offsets = utf8(batch)
            _, _, at, _ = anchors(*byte_units(data, offsets), window, gram)
            if len(at):
                owner = owners(offsets, at)
                parts.append((suffix_keys(data, at, gram), owner + rows, at - offsets[owner]))
                held += len(at)
            ids.append(batch.column("doc_id"))
            ties.append(batch.column("tie"))
            slots.append(batch.column("slot"))
            rows += batch.num_rows
            if held >= RUN:
                yield from flush(parts, ids, ties, slots)
                parts, ids, ties, slots, held, rows = [], [], [], [], 0, 0
        if parts:
            yield from flush(parts, ids, ties, slots)

    return sort


def _merge(gram: int):
    def merge(table: pa.Table) -> pa.Table:
        decoded, sizes, docs, spots, firsts, bases = [], [], [], [], [0], 0
        for row in table.select(["shared", "rest", "sizes", "docs", "spots"]).to_pylist():
            decoded.append(front_decode(_unpack(row["shared"], "u1"), _unpack(row["rest"], "u1"), gram))
            sizes.append(_unpack(row["sizes"], "<u4").astype(np.int64))
            docs.append(_unpack(row["docs"], "<u4").astype(np.int64))
            spots.append(_unpack(row["spots"], "<u4").astype(np.int32))
            firsts.append(firsts[-1] + len(decoded[-1]))
        counts = pc.list_value_length(table.column("ids")).to_numpy()
        starts = np.cumsum(counts) - counts
        docs = np.concatenate([d + s for d, s in zip(docs, starts)])
        ids, ties, slots = (table.column(name).combine_chunks().flatten() for name in ("ids", "ties", "slots"))
        keys, sizes, spots = np.concatenate(decoded), np.concatenate(sizes), np.concatenate(spots)
        order, prefix = merge_rounds(keys, np.array(firsts), gram)
        new = prefix < gram
        if len(new):
            new[0] = True
        group = np.cumsum(new) - 1
        often = np.bincount(group, weights=sizes[order]) if len(order) else np.empty(0)
        hit = np.zeros(len(keys), bool)
        hit[order[often[group] > 1]] = True
        seen = np.repeat(hit, sizes)
        docs, spots = docs[seen], spots[seen]
        slot = slots.to_numpy()[docs]
        turn = np.argsort((slot.astype(np.int64) << 32) | docs, kind="stable")
        slot, docs, spots = slot[turn], docs[turn], spots[turn]
        own = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])[:len(docs)])  # where each document begins
        used, first = np.unique(slot[own], return_index=True)
        edges, take = pa.array(np.append(first, len(own)).astype(np.int32)), pa.array(docs[own])
        sizes = pa.array(np.diff(np.append(own, len(docs))).astype(np.int32))
        places = pa.array(np.append(own[first], len(docs)).astype(np.int32))
        return pa.table({
            "slot": pa.array(used.astype(np.int32)), "ids": pa.ListArray.from_arrays(edges, ids.take(take)), "ties": pa.ListArray.from_arrays(edges, ties.take(take)),
            "sizes": pa.ListArray.from_arrays(edges, sizes), "spots": pa.ListArray.from_arrays(places, pa.array(spots, pa.int32())),
        })

    return merge


def _gather(table: pa.Table) -> pa.Table:
    """What all key ranges found for the documents of one slot: a row per document."""
    ids, ties, sizes, spots = (table.column(name).combine_chunks().flatten() for name in ("ids", "ties", "sizes", "spots"))
    names = pc.dictionary_encode(ids, null_encoding="encode")
    sizes, tie = sizes.to_numpy(), ties.to_numpy()
    code = names.indices.to_numpy()
    order = np.lexsort((tie, code))
    new = np.append(True, (code[order[1:]] != code[order[:-1]]) | (tie[order[1:]] != tie[order[:-1]]))[:len(order)]
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
    bounds = np.append((ends - sizes)[new], ends[-1:])
    take = pa.array(order[new])
    return pa.table({"doc_id": ids.take(take), "tie": ties.take(take), "spots": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spots.take(pa.array(at)))})


def repeated_suffixes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``tie`` and ``spots``: the anchors of each document whose suffix also stands elsewhere."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    per_byte = 2 / (window - gram + 2) * (gram + 4)
    buckets = max(1, int(total * per_byte / BUCKET_BYTES))
    splits = np.empty((0, -(-gram // WORD)), np.uint64)
    if buckets > 1:
        share = max(1, int(total // SAMPLE_BYTES))
        rate = max(1, int(total / share * 2 / (window - gram + 2) / (SAMPLES * buckets)))

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, "text", SLICE_BYTES):
                data, offsets = utf8(batch)
                _, _, at, marks = anchors(*byte_units(data, offsets), window, gram)
                at = at[mix(marks, seed=9) % np.uint64(rate) == 0]  # by content: copies count once
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in suffix_keys(data, at, gram).astype(">u8")], pa.binary())], names=["key"])

        some = docs.filter(F.pmod("tie", F.lit(share)) == 0).select("text").mapInArrow(sample, "key binary").distinct().collect()
        if some:
            picked = np.sort(np.array([bytes(r.key) for r in some], f"S{splits.shape[1] * WORD}"))
            cuts = np.unique(picked[np.linspace(0, len(picked) - 1, buckets + 1).astype(int)[1:-1]])
            raw = b"".join(c.ljust(splits.shape[1] * WORD, b"\0") for c in cuts.tolist())
            splits = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(cuts), -1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Key ranges answer in as many slots of documents, not document by document.
    dealt = docs.withColumn("slot", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)).cast("int"))
    runs = dealt.mapInArrow(_runs(splits, window, gram), f"bucket int, shared binary, rest binary, sizes binary, docs binary, spots binary, ids array<{kind}>, ties array<long>, slots array<int>")
    merged = runs.groupBy("bucket").applyInArrow(_merge(gram), f"slot int, ids array<{kind}>, ties array<long>, sizes array<int>, spots array<int>")
    return merged.groupBy("slot").applyInArrow(_gather, f"doc_id {kind}, tie long, spots array<int>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove bytes covered by a string of ``window`` bytes that also starts in a document with a smaller id.

    Columns: ``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (removed runs as ``first * 2**32 + end``),
    ``kept`` (binary) and ``kept_sha256``. Null texts are empty; texts under ``window`` bytes lose
    nothing; documents of the same id do not remove each other's bytes, and a null id is smaller than
    all others. Other columns are not read.
    """
    texts, scratch = keyed(docs), Scratch(docs.sparkSession)
    spots = scratch.keep(repeated_suffixes(texts.filter(F.octet_length("text") >= window), window, gram))
    wanted = spots.select(F.col("doc_id").alias("at_id"), F.col("tie").alias("at_tie"), "spots")
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("tie") == F.col("at_tie"))
    marked = texts.join(wanted, same).select("doc_id", "tie", "text", "spots")
    index = scratch.keep(find_blocks(marked, byte_units, window, gram, only=True))
    scratch.drop(spots)
    covers = repeated_windows(scratch, texts, index, byte_units, window, earlier=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            rows = []
            data, offsets = utf8(batch)
            covers = batch.column("covers")
            bounds, packed = covers.offsets.to_numpy(), covers.values.to_numpy()
            for row, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                raw, found = data[start:stop], packed[bounds[row]:bounds[row + 1]]
                spans, kept = [], raw.tobytes()
                if len(found):
                    gone = covered(found, len(raw), window)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans = ((edges[::2] << 32) + edges[1::2]).tolist()
                    kept = raw[~gone].tobytes()
                rows.append((len(raw), len(raw) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_covers(texts, covers).mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, spans array<long>, kept binary, kept_sha256 string")
