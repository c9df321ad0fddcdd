"""Repeated passages over words, by hashes of blocks and windows.

The whole corpus is cut into blocks at content-defined anchors and grouped by the hashes of anchor and
block (``blocks.py``). Windows of blocks that are not repeated as a whole are counted by hash. What is
called a factor here is a run of words under repeated windows; there is no Lempel-Ziv parse: no position
in the reference, no greedy extension. Factors of ``window`` words and more are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webcorpus.llm.batches import by_bytes
from webcorpus.llm.blocks import SLICE_BYTES, covered, find_blocks, keyed, repeated_windows, with_covers
from webcorpus.llm.scratch import Scratch
from webcorpus.llm.words import NOT_WHITE, word_hashes, word_spans

WINDOW, GRAM = 35, 8


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, firsts = word_spans(data, offsets, NOT_WHITE)
    return word_hashes(data, starts, ends), firsts


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``text`` and ``covers``, the runs of window starts that are repeated elsewhere."""
    texts, scratch = keyed(docs), Scratch(docs.sparkSession)
    rows = scratch.keep(find_blocks(texts, word_units, window, gram))
    # Anchors that stand in one place only cannot be part of a factor.
    twice = rows.groupBy("anchor").count().filter("count > 1").select("anchor")
    index = scratch.keep(rows.join(twice, "anchor", "left_semi"))
    scratch.drop(rows)
    return with_covers(texts, repeated_windows(scratch, texts, index, word_units, window, earlier=False))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove the words of all factors: ``doc_id``, ``n_words``, ``n_removed``, ``spans``, ``kept``, ``kept_sha256``.

    ``spans`` are the factors as ``first * 2**32 + end`` in words, ``kept`` the remaining words joined
    by one space. Null texts have no words; texts under ``window`` words lose none; equal rows count as
    repeats of each other. Other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            rows = []
            for text, covers in zip(batch.column("text").to_pylist(), batch.column("covers").to_pylist()):
                words = (text or "").encode().split()
                spans = []
                kept = words
                if covers:
                    gone = covered(covers, len(words), window)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans = ((edges[::2] << 32) + edges[1::2]).tolist()
                    kept = list(compress(words, (~gone).tolist()))
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), spans, joined.decode(), hashlib.sha256(joined).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n_words", "n_removed", "spans", "kept", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return factors(docs, window, gram).mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, spans array<long>, kept string, kept_sha256 string")
