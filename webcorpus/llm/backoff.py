"""Stupid-backoff scores of documents against the whole corpus.

Documents are packed into chunks, a table of its own. Each chunk explodes into its distinct n-grams,
sorted by hash and cut into hash partitions, one array per partition. A partition joins the arrays of
all chunks with the count table they add up to, and answers each chunk with the corpus counts of its
n-grams. Chunks then put answers and words together and sum the scores of each document. An n-gram
that is in all documents is one entry per chunk, however often it occurs.

A document is scored by the others: its own occurrences are taken off every count, else no n-gram in it
could be unseen. An n-gram that no other document has at one of its parts cannot have a count left, so from
three words on only n-grams travel whose parts both do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.batches import by_bytes, utf8
from webcorpus.llm.hashing import Spans
from webcorpus.llm.scratch import settled
from webcorpus.llm.words import NOT_WHITE, word_hashes, word_spans

ORDER, ALPHA = 3, 0.4
CHUNK_BYTES = 4 << 20
PARTITION_BYTES = 16 << 20  # n-gram data that one task counts


def pack_chunks(docs: DataFrame) -> DataFrame:
    """``chunk`` and ``payload``: about 4 MiB of documents as compressed Arrow data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in by_bytes(batches, "text", CHUNK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            payload = zstandard.compress(sink.getvalue().to_pybytes(), 3)
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + k], pa.int64()), pa.array([payload], pa.binary())], names=["chunk", "payload"])
            k += 1

    return docs.select("doc_id", "text").mapInArrow(pack, "chunk long, payload binary")


class Chunk:
    """The words of a chunk and the n-grams that end at each of them."""

    def __init__(self, payload: bytes, own: bool):
        self.own = own
        with pa.ipc.open_stream(zstandard.decompress(payload)) as reader:
            batch = pa.Table.from_batches(list(reader), reader.schema).combine_chunks().to_batches()[0]
        self.ids = batch.column("doc_id")
        data, offsets = utf8(batch)
        starts, ends, self.firsts = word_spans(data, offsets, NOT_WHITE)
        self.words = word_hashes(data, starts, ends)
        self.rows = np.repeat(np.arange(len(self.ids)), np.diff(self.firsts))
        self.place = np.arange(len(self.words)) - self.firsts[self.rows]
        self._spans = Spans(self.words, seed=2)
        self.counts: list[np.ndarray] = []  # by n - 1 and position: what is left of the count of the n-gram that ends there

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the n-grams that may have a count left, the distinct hashes, and which one each position has."""
        ok = self.place >= n - 1
        if n > 2:
            below = self.counts[n - 2]
            ok &= below > 0
            ok[1:] &= below[:-1] > 0
        at = np.flatnonzero(ok)
        unique, which = np.unique(self._spans(at - (n - 1), at + 1), return_inverse=True)
        return at, unique, which

    def learn(self, n: int, totals: np.ndarray) -> None:
        at, _, which = self.grams(n)
        counts = np.zeros(len(self.words), np.int64)
        counts[at] = totals[which]
        if not self.own:
            _, same, times = np.unique(self.rows[at] * (len(totals) + 1) + which, return_inverse=True, return_counts=True)
            counts[at] -= times[same]
        self.counts.append(counts)

    def scores(self, order: int, alpha: float, total: int) -> np.ndarray:
        """Log score of every word: its longest n-gram with a count left against that n-gram's history."""
        if not len(self.words):
            return np.empty(0)
        rest = total - (0 if self.own else np.diff(self.firsts)[self.rows])
        seen = self.counts[0] > 0
        out = np.where(seen, np.log(np.maximum(self.counts[0], 1)) - np.log(np.maximum(rest, 1)), -np.log(rest + 1.0))
        used = np.ones(len(self.words), np.int64)
        for n in range(2, order + 1):
            here, before = self.counts[n - 1], np.roll(self.counts[n - 2], 1)
            seen = here > 0
            out[seen] = np.log(here[seen]) - np.log(before[seen])
            used[seen] = n
        return out + np.log(alpha) * (np.minimum(self.place + 1, order) - used)


def _bounds(buckets: int) -> np.ndarray:
    """First hash of each partition but the first."""
    return np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)


def _send(chunk_id: int, chunk: Chunk, n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    at, unique, which = chunk.grams(n)
    local = np.bincount(which, minlength=len(unique)).astype("<u4")
    edges = np.concatenate([[0], np.searchsorted(unique, _bounds(buckets)), [len(unique)]])
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if a < b]
    gaps = np.diff(unique, prepend=unique[:1])
    # The first hash of each array is kept whole, the others as gaps.
    blobs = [zstandard.compress(np.concatenate([unique[a:a + 1], gaps[a + 1:b]]).view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for _, a, b in rows]
    counts = [zstandard.compress(local[a:b].tobytes(), 1) for _, a, b in rows]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _, _ in rows], pa.int32()), pa.array([n] * len(rows), pa.int32()), pa.array([chunk_id] * len(rows), pa.int64()), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())],
        names=["bucket", "n", "chunk", "grams", "counts"],
    )


SENT = "bucket int, n int, chunk long, grams binary, counts binary"
ANSWERS = "chunk long, n int, bucket int, totals binary"


def _read(blob: bytes) -> np.ndarray:
    columns = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(columns.T).view(np.uint64).ravel(), dtype=np.uint64)


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Add up one partition's counts and give each chunk those of its n-grams, in its order."""
    arrays = [_read(b) for b in table.column("grams").to_pylist()]
    local = np.concatenate([np.frombuffer(zstandard.decompress(c), "<u4") for c in table.column("counts").to_pylist()])
    unique, which = np.unique(np.concatenate(arrays), return_inverse=True)
    totals = np.bincount(which, weights=local, minlength=len(unique)).astype("<i8")[which]
    ends = np.cumsum([len(a) for a in arrays]).tolist()
    blobs = [zstandard.compress(totals[e - len(a):e].view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for a, e in zip(arrays, ends)]
    return pa.table({"chunk": table.column("chunk"), "n": table.column("n"), "bucket": table.column("bucket"), "totals": pa.array(blobs, pa.binary())})


def _known(chunk: Chunk, answers: pa.Table) -> None:
    """Put the answers, which come in any order, to the chunk's n-grams."""
    by_n: dict[int, list[tuple[int, bytes]]] = {}
    for row in answers.to_pylist():
        by_n.setdefault(row["n"], []).append((row["bucket"], row["totals"]))
    for n in range(1, max(by_n, default=0) + 1):
        parts = [np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view("<i8").ravel() for _, b in sorted(by_n.get(n, []), key=lambda p: p[0])]
        chunk.learn(n, np.concatenate(parts) if parts else np.empty(0, np.int64))


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, own: bool = False) -> DataFrame:
    """``doc_id``, ``n_words`` and ``log_score``, the sum of the natural logs of all words' scores.

    Counts are those of all documents but the scored row (with ``own``, of all documents). The score of a
    word is count(n-gram) / count(history) for the longest n-gram of at most ``order`` words with a count
    above 0, times ``alpha`` for each word the n-gram is short of what stands before it (within
    ``order``). A single word scores its share of the counted words, and one that none of them is
    1 / (counted words + 1). Null and empty texts have no words and score 0. Rows come back as they are,
    null and repeated ids included, each scored by all others; an empty table gives none. Other columns
    are not read.
    """
    chunks = settled(pack_chunks(docs))
    total_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total_bytes // PARTITION_BYTES))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist()):
                chunk = Chunk(payload, own)
                for n in range(1, min(order, 2) + 1):
                    yield from _send(chunk_id, chunk, n, buckets)

    def longer(n: int):
        def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
            if not left.num_rows:
                return schema.empty_table()
            chunk = Chunk(left.column("payload")[0].as_py(), own)
            _known(chunk, right)
            for k in range(len(chunk.counts) + 1, n):
                chunk.learn(k, np.empty(0, np.int64))
            return pa.Table.from_batches(list(_send(left.column("chunk")[0].as_py(), chunk, n, buckets)), schema)

        return send

    sent = chunks.mapInArrow(first, SENT)
    answers = settled(sent.groupBy("bucket", "n").applyInArrow(_answer, ANSWERS), free=True)
    for n in range(3, order + 1):
        sent = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(longer(n), SENT)
        more = settled(sent.groupBy("bucket", "n").applyInArrow(_answer, ANSWERS), free=True)
        answers = answers.unionByName(more)
    words = docs.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type

    def sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], id_type), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
        chunk = Chunk(left.column("payload")[0].as_py(), own)
        _known(chunk, right)
        for n in range(len(chunk.counts) + 1, order + 1):
            chunk.learn(n, np.empty(0, np.int64))
        each = np.concatenate([[0.0], np.cumsum(chunk.scores(order, alpha, words))])
        return pa.table({"doc_id": chunk.ids, "n_words": pa.array(np.diff(chunk.firsts), pa.int64()), "log_score": pa.array(each[chunk.firsts[1:]] - each[chunk.firsts[:-1]])})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sums, f"doc_id {kind}, n_words long, log_score double")
