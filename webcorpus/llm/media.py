"""Media columns: WAV bytes in a table, and spectral fingerprints of what they hold."""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.llm.batches import by_bytes
from webcorpus.session import shared_dir

RATE = 16_000
UNIT = 192  # samples a payload is padded to, and a frame's length
HOP = UNIT // 2
BANDS = (2, 6, 14, 34, UNIT // 2 + 1)  # spectral bins that are searched for one peak each
REACH, FAN = 31, 3  # frames and peaks a pair may span
SLICE_BYTES = 2 << 20
FRAMES = 8192  # transformed at once


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of spectral peaks: the strongest bin of a band, stronger than in both frames beside it."""
    window = np.hanning(UNIT + 1)[:UNIT]
    frames = np.lib.stride_tricks.sliding_window_view(samples, UNIT)[::HOP]
    bins = np.empty((len(frames), len(BANDS) - 1), np.int64)
    power = np.empty(bins.shape)
    for start in range(0, len(frames), FRAMES):
        part = frames[start:start + FRAMES] - 128.0
        spectrum = np.fft.rfft(part * window, axis=1)
        # Whole numbers: rounding noise must not make peaks of silence.
        energy = np.rint(spectrum.real**2 + spectrum.imag**2)
        for k, (low, high) in enumerate(zip(BANDS[:-1], BANDS[1:])):
            best = energy[:, low:high].argmax(axis=1) + low
            bins[start:start + len(part), k] = best
            power[start:start + len(part), k] = energy[np.arange(len(part)), best]
    edge = np.zeros((1, power.shape[1]))
    before, after = np.vstack([edge, power[:-1]]), np.vstack([power[1:], edge])
    at, band = np.nonzero((power > 0) & (power >= before) & (power > after))
    return at, bins[at, band]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Codes of peak pairs in time order: frame of the first peak, its bin, the second's bin, frames between."""
    at, bins = peaks(samples)
    codes = []
    for ahead in range(1, FAN + 1):
        gap = at[ahead:] - at[:-ahead]
        near = gap <= REACH
        first = np.flatnonzero(near)
        codes.append((at[first] << 20) | (bins[first] << 13) | (bins[first + ahead] << 6) | gap[near])
    return np.sort(np.concatenate(codes)).astype("<i8")


def write_media(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> None:
    """Write a table of ``doc_id``, ``n_bytes`` and ``media``: each text's UTF-8 bytes as 8-bit samples.

    Bytes 32 fill the payload up to a positive multiple of 192. A null text is empty. Rows come as they
    are, null and repeated ids included.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            media = [to_wav(r + b" " * (-len(r) % UNIT if r else UNIT)) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows.mapInArrow(encode, f"doc_id {kind}, n_bytes long, media binary").write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """What the stored media hold: sizes, checksums, and ``codes``, the fingerprint's time-coded array."""
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codes array<long>"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "media", SLICE_BYTES):
            rows = []
            for media in batch.column("media").to_pylist():
                payload = from_wav(media)
                codes = fingerprint(np.frombuffer(payload, np.uint8))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), codes))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codes"],
            )

    stored = spark.read.parquet(path).select("doc_id", "n_bytes", "media")
    return stored.mapInArrow(decode, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, {fields}")


def media_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Store ``docs`` as media in a new folder of the shared directory and read them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    write_media(docs, path, **options)
    return read_media(spark, path)
