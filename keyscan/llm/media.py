"""Media columns: payloads as WAV bytes, read again by the wave module, and spectral fingerprints.

A payload is stored as 8-bit mono samples. The short-time Fourier transform of what is read back gives,
for each frame and band, the strongest bin; bins that also peak in time are landmarks, and each landmark
pairs with those that follow it. A fingerprint is ``frame << 24 | bin1 << 15 | bin2 << 6 | frames apart``.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, utf8

FRAME, HOP, RATE = 512, 256, 8000
BANDS = (2, 12, 40, 100, FRAME // 2 + 1)
#: How many following landmarks a landmark pairs with, and the most frames between the two.
FAN_OUT, MOST_APART = 3, 63
BLOCK = 1024
MEDIA = "media binary, payload binary, fingerprints array<long>"


def to_wav(payload: bytes) -> bytes:
    """The payload as a WAV file of 8-bit samples."""
    with wave.open(out := io.BytesIO(), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file of 8-bit samples."""
    with wave.open(io.BytesIO(media), "rb") as r:
        if r.getsampwidth() != 1 or r.getnchannels() != 1:
            raise ValueError("not 8-bit mono")
        return r.readframes(r.getnframes())


def landmarks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) of the spectral peaks of 8-bit samples, in order of frame, then bin."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    padded = np.full((n - 1) * HOP + FRAME, 128, np.uint8)
    padded[: len(samples)] = samples[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    best, power, loud = np.empty((n, len(BANDS) - 1), np.int64), np.empty((n, len(BANDS) - 1), np.float32), np.empty(n, np.float32)
    for at in range(0, n, BLOCK):
        s = np.abs(np.fft.rfft((frames[at : at + BLOCK].astype(np.float32) - 128) * window, axis=1)).astype(np.float32)
        loud[at : at + BLOCK] = s.mean(1)
        for k, (lo, hi) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            top = s[:, lo:hi].argmax(1)
            best[at : at + BLOCK, k] = lo + top
            power[at : at + BLOCK, k] = s[np.arange(len(s)), lo + top]
    edge = np.pad(power, ((1, 1), (0, 0)))
    peak = (power > loud[:, None]) & (power > edge[:-2]) & (power >= edge[2:])
    t, k = np.nonzero(peak)
    return t, best[t, k]


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """The pair fingerprints of 8-bit samples, ordered by time; empty where nothing peaks."""
    t, f = landmarks(samples)
    codes = [np.empty(0, np.int64)]
    for k in range(1, FAN_OUT + 1):
        apart = t[k:] - t[:-k]
        ok = (apart > 0) & (apart <= MOST_APART) if len(t) > k else np.zeros(0, bool)
        if len(t) > k:
            codes.append((t[:-k] << 24 | f[:-k] << 15 | f[k:] << 6 | apart)[ok])
    return np.sort(np.concatenate(codes))


def _analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 32):
            part = b.slice(at, 32)
            media = [to_wav(x) for x in part.column(part.num_columns - 1).to_pylist()]
            back = [from_wav(x) for x in media]
            codes = [fingerprints(np.frombuffer(x, np.uint8)) for x in back]
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(codes)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(media, pa.binary()), pa.array(back, pa.binary()), lists], [*part.schema.names[:-1], "media", "payload", "fingerprints"])


def media_columns(df: DataFrame, payload: Column, *carry: str) -> DataFrame:
    """``*carry, media, payload, fingerprints``: ``payload`` (binary) stored as WAV, read back and analysed.

    Each row is worked on alone, so repeated rows give repeated results and an empty table an empty one.
    Null payload: an empty one. Only the columns named in ``carry`` are kept, nulls and all.
    """
    small_batches(df.sparkSession)
    rows = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)), F.coalesce(payload, F.lit(b"")).alias("stored"))
    kinds = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(rows.schema.fields[:-1]))
    return rows.mapInArrow(_analysed, kinds + MEDIA).toDF(*carry, "media", "payload", "fingerprints")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's payload, of its WAV form and of its fingerprints."""
    raw = utf8(F.col("text"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", raw.alias("raw"), F.octet_length(raw).cast("long").alias("n_bytes"))
    zeros = F.greatest(F.lit(64), F.ceil(F.col("n_bytes") / 64).cast("int") * 64) - F.col("n_bytes").cast("int")
    out = media_columns(docs, F.concat("raw", F.unhex(F.repeat(F.lit("00"), zeros))), "doc_id", "n_bytes")
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.sha2(F.array_join("fingerprints", " ").cast("binary"), 256).alias("feature"),
        F.size("fingerprints").cast("long").alias("n_fingerprints"),
    )
