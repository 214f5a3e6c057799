"""Media columns: 8-bit WAV payloads, short-time Fourier transforms, spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .shared import arrow_map, bounded, materialize

RATE = 8000
ALIGN = 64
#: Frames overlap by three quarters, so each sample is near the middle of one.
FRAME, HOP = 256, 64
#: Frequency bands (bins) of which each frame gives its strongest bin as a peak.
BANDS = ((2, 10), (10, 24), (24, 56), (56, 128))
#: An anchor is paired with the peaks of this many following frames, band by band.
FAN = 2
#: Rows of an Arrow batch with texts or media.
BATCH = 500
#: Version 2 pages write the sorted time codes as differences.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
_HANN = np.hanning(FRAME).astype(np.float32)


def store(data: bytes) -> bytes:
    """The WAV file of ``data`` padded with zero bytes to a positive multiple of ALIGN, one byte a sample."""
    pad = -len(data) % ALIGN if data else ALIGN
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data + bytes(pad))
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def n_frames(size: int) -> int:
    """Frames of a payload: each HOP samples start one, and FRAME - HOP samples of silence lie before and after."""
    return -(-size // HOP) + FRAME // HOP - 1


def fingerprint(payload: bytes) -> np.ndarray:
    """Time-coded peak pairs: anchor frame << 32 | anchor bin << 20 | paired bin << 8 | frames between.

    Frames of FRAME samples give the strongest bin of each band; an anchor is paired with the
    same and the next band of the FAN following frames. Silent bands give no peak.
    """
    n, edge = n_frames(len(payload)), FRAME - HOP
    x = np.zeros((n - 1) * HOP + FRAME, np.float32)
    x[edge : edge + len(payload)] = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    windows = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, loud = [], []
    for at in range(0, n, 1024):  # a long text is transformed in blocks of 1024 frames
        part = windows[at : at + 1024]
        power = np.abs(np.fft.rfft((part - part.mean(1, keepdims=True)) * _HANN, axis=1)).astype(np.float32)
        top = np.stack([power[:, a:b].argmax(1) + a for a, b in BANDS], 1)
        bins.append(top)
        loud.append(np.take_along_axis(power, top, 1) > 1e-2)
    peaks, loud = np.concatenate(bins).astype(np.int64), np.concatenate(loud)
    out = []
    k = len(BANDS)
    for dt in range(1, FAN + 1):
        for da in (0, 1):
            a, b = peaks[:-dt, : k - da], peaks[dt:, da:]
            ok = loud[:-dt, : k - da] & loud[dt:, da:]
            t = np.arange(len(a))[:, None]
            out.append(((t << 32) | (a << 20) | (b << 8) | dt)[ok])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def media_columns(docs: DataFrame, fingerprints: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, media, n_bytes, fingerprint): every text's UTF-8 bytes as a WAV column with its features.

    A null text is empty: 64 zero bytes. Rows are independent; repeated rows give equal rows.
    """

    def rows(part):
        data = [(t or "").encode() for t in part[text].to_pylist()]
        media = [store(x) for x in data]
        out = {key: part[key], "n_bytes": [len(x) for x in data], "media": media}
        return out | ({"fingerprint": [fingerprint(load(m)) for m in media]} if fingerprints else {})

    kind = dict(docs.dtypes)[key]
    return arrow_map(docs.select(key, text), rows, f"{key} {kind}, n_bytes long, media binary" + ", fingerprint array<long>" * fingerprints, 64)


def describe(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of a media table (key, n_bytes, media, fingerprint), read from what it stores.

    ``feature`` names the number of frames and of peak pairs and the SHA-1 of the time-coded array,
    which is computed from the payload only where the table has no fingerprint column.
    """
    made = "fingerprint" in media.columns

    def rows(part):
        stored = [m.as_py() for m in part["media"]]
        read = [load(m) for m in stored]
        prints = [f.values.to_numpy() for f in part["fingerprint"]] if made else [fingerprint(p) for p in read]
        return {
            key: part[key],
            "n_bytes": part["n_bytes"],
            "payload_bytes": [len(p) for p in read],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in read],
            "tail_crc32": [zlib.crc32(p[-ALIGN:]) for p in read],
            "media_bytes": [len(m) for m in stored],
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in stored],
            "feature": [f"frames={n_frames(len(p))};pairs={len(f)};{hashlib.sha1(f.astype('<i8').tobytes()).hexdigest()}" for p, f in zip(read, prints, strict=True)],
        }

    kind = dict(media.dtypes)[key]
    return arrow_map(
        media.select(key, "n_bytes", "media", *["fingerprint"] * made), rows,
        f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", 64)


def op8_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bounded(describe(materialize(media_columns(docs), "media", BATCH, STORED)), "media-digests", BATCH)
