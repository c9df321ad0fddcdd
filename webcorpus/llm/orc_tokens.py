"""Token ids in ORC files: sorted by document, with row indexes and Bloom filters on the ids."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.llm.batches import by_bytes, texts_of
from webcorpus.llm.pretokens import pretokens
from webcorpus.llm.token_counts import CACHED, SLICE_BYTES, VOCABULARY, byte_letters, vocabulary_path
from webcorpus.session import shared_dir

END_ID = 0


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """The tokenizers library over distinct pre-tokens; ids of those met before are kept up to a bound.

    A byte-level vocabulary never merges across pre-tokens, so a text's ids are those of its pre-tokens
    in a row.
    """

    def __init__(self, path: str):
        self.library = _tokenizer(path)
        added = self.library.get_added_tokens_decoder()
        self.special = next((t.content for t in added.values() if t.special), None)
        self.special_id = self.library.token_to_id(self.special) if self.special else 0
        self.letters = byte_letters()
        self.keys = np.empty(0, np.uint64)
        self.starts, self.lengths, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _look_up(self, unique: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each unique pre-token start, how many they are, and the ids."""
        at = np.searchsorted(self.keys, unique)
        hit = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        hit[inside] = self.keys[at[inside]] == unique[inside]
        new = np.flatnonzero(~hit)
        starts, lengths = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        starts[hit], lengths[hit] = self.starts[at[hit]], self.lengths[at[hit]]
        ids = self.ids
        if len(new):
            # One pre-token at a time needs no pre-tokenizer: the library's model takes it as it is,
            # each byte written as the vocabulary's letter for it.
            raw = [words[i].encode() for i in new.tolist()]
            ends = list(accumulate(map(len, raw)))
            spelt = b"".join(raw).decode("latin-1").translate(self.letters)
            model = self.library.model.tokenize
            found = [[t.id for t in model(spelt[e - len(r):e])] for r, e in zip(raw, ends)]
            lengths[new] = np.fromiter(map(len, found), np.int64, len(found))
            starts[new] = len(ids) + np.cumsum(lengths[new]) - lengths[new]
            ids = np.concatenate([ids, np.fromiter((i for f in found for i in f), np.int32, int(lengths[new].sum()))])
            if len(self.keys) + len(new) <= CACHED:
                keys = np.concatenate([self.keys, unique[new]])
                order = np.argsort(keys, kind="stable")
                self.keys = keys[order]
                self.starts = np.concatenate([self.starts, starts[new]])[order]
                self.lengths = np.concatenate([self.lengths, lengths[new]])[order]
                self.ids = ids
        return starts, lengths, ids

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end_id`` after each, and where each text's ids start."""
        joined, at, to, hashes, special, firsts = pretokens(texts, self.special)
        unique, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        words = [joined[a:b] for a, b in zip(at[sample].tolist(), to[sample].tolist())]
        starts, lengths, ids = self._look_up(unique, words)
        # The end ids are one more token each, at the end of its text.
        starts = np.append(starts, [len(ids), len(ids) + 1])
        lengths = np.append(lengths, [1, 1])
        ids = np.append(ids, np.array([end_id, self.special_id], np.int32))
        which = which.astype(np.int64)
        which[special] = len(unique) + 1
        which = np.insert(which, firsts[1:], len(unique))
        sizes = lengths[which]
        ends = np.cumsum(sizes)
        gather = np.repeat(starts[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        last = firsts[1:] + np.arange(len(texts))
        return ids[gather], np.concatenate([np.zeros(1, np.int64), ends[last]])


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)  # one a worker process: its memory of pre-tokens serves all tasks


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, stripe_bytes: int = 64 << 20, stride: int = 10_000, fpp: float = 0.01, text: str = "text", key: str = "doc_id") -> None:
    """Write every document's ids to ORC files under ``path``, in ascending order of ``key``.

    Texts are dealt by key ranges, sorted and only then encoded, so that texts and not ids are shuffled.
    Columns: ``doc_id``, ``n_tokens`` (with the end id), ``part`` and ``ahead`` (tokens before the
    document in its file) and ``ids``. Integers use ORC's run-length encoding; each stripe has row
    indexes for every ``stride`` rows and a Bloom filter on ``doc_id``. A null text is empty; null keys
    come first; equal keys are ordered by text. An empty table gives files without rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary_path(vocabulary))
        part, ahead = TaskContext.get().partitionId(), 0
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            ids, firsts = encoder.encode(texts_of(batch), end_id)
            lists = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(firsts)), pa.array(np.full(len(lists), part, np.int32)), pa.array(firsts[:-1] + ahead), lists],
                names=["doc_id", "n_tokens", "part", "ahead", "ids"],
            )
            ahead += len(ids)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (rows.mapInArrow(encode, f"doc_id {kind}, n_tokens long, part int, ahead long, ids array<int>")
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(fpp))
     .option("orc.stripe.size", str(stripe_bytes)).option("orc.row.index.stride", str(stride))
     .option("orc.create.index", "true").option("compression", "zstd").orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids of all documents before each.

    One small sum per file is gathered, read from the narrow columns alone.
    """
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.max(F.col("ahead") + F.col("n_tokens")).alias("n")).collect()  # a row a file
    totals = sorted((r.part, r.n) for r in totals)
    before = [0, *accumulate(n for _, n in totals)]
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part int, base long")
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("ahead")).drop("base", "part", "ahead")


def lookup(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """Documents by id: stripes whose Bloom filters and indexes rule them out are not read."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(ids)).select("doc_id", "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the CRC-32 of the ids as little-endian 32-bit integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
            crc = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "ids").mapInArrow(sums, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def tokens_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to a new folder of the shared directory and read every file back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/orc-{uuid.uuid4().hex}"
    write_tokens(docs, path, **options)
    return checksums(read_tokens(spark, path))
