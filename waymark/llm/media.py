"""Media columns: payloads as 8-bit WAV, read back, with short-time spectra and peak-pair fingerprints.

Payload: the UTF-8 bytes of a text, filled up with zeros to a positive multiple of 64, one byte a sample. Frames of FRAME
samples every HOP go through a Hann window and a Fourier transform; in each of BANDS the strongest bin is a peak if it stands out
over its band, and the strongest bin of all is one in a frame without such a band, unless the frame is silent. Before and after the
samples stand FRAME - HOP of the mean of the FRAME next to them: every sample lies in as many frames as any
other, and 64 samples lie in four. Each peak is paired with the peaks of the AHEAD next frames. A
fingerprint is two arrays: the time (frame number) and the code (bin, other bin, frames between), in order.

Nulls: a null text counts as empty, a null doc_id stays null. Equal texts have equal values, repeated rows each have theirs; peaks that tie go to the
lowest bin. A long text is one WAV whose spectra are made in pieces. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_bytes, materialize, slices

BLOCK, RATE = 64, 8000
FRAME, HOP, AHEAD = 256, 64, 2
BANDS = ((1, 8), (8, 24), (24, 56), (56, 128))
#: A peak is so many times its band's mean.
OVER = 2.0
#: What rounding alone can leave in a bin of a silent frame.
QUIET = 0.05


def to_wav(body: bytes) -> bytes:
    """The payload as a mono 8-bit WAV file."""
    n = max(1, -(-len(body) // BLOCK)) * BLOCK
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(body.ljust(n, b"\0"))
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not mono 8-bit")
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """For each frame and band the bin of the peak, or -1. The last frame is filled up with the mean."""
    x = samples.astype(np.float32)
    lacks = FRAME - len(x) if len(x) < FRAME else (FRAME - len(x)) % HOP
    if lacks:
        x = np.concatenate((x, np.full(lacks, x.mean(), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, out = np.hanning(FRAME).astype(np.float32), []
    for at in range(0, len(frames), 1024):
        part = frames[at : at + 1024]
        power = np.abs(np.fft.rfft((part - part.mean(1, keepdims=True)) * window, axis=1))
        rows = np.arange(len(part))
        found, bests, heights = [], [], []
        for lo, hi in BANDS:
            band = power[:, lo:hi]
            best = band.argmax(1)
            bests.append(best + lo)
            heights.append(band[rows, best])
            found.append(np.where(heights[-1] > OVER * band.mean(1), best + lo, -1))
        found, heights = np.stack(found, 1), np.stack(heights, 1)
        top = heights.argmax(1)
        flat = np.flatnonzero((found < 0).all(1) & (heights[rows, top] > QUIET))
        found[flat, top[flat]] = np.stack(bests, 1)[flat, top[flat]]
        out.append(found)
    return np.concatenate(out)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """times, codes of all peak pairs, ordered by time and code."""
    before, after = (np.full(FRAME - HOP, edge.mean(), np.float32) for edge in (samples[:FRAME], samples[-FRAME:]))
    found = peaks(np.concatenate((before, samples, after)))
    times, codes = [], []
    for ahead in range(1, AHEAD + 1):
        a, b = found[:-ahead, :, None], found[ahead:, None, :]
        both = (a >= 0) & (b >= 0)
        times.append(np.nonzero(both)[0])
        codes.append(((a << 12) | (b << 2) | ahead)[both])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        bodies = [b or b"" for b in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, bodies)), pa.int64()), pa.array(map(to_wav, bodies), pa.binary())], ["doc_id", "n_bytes", "media"])


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the WAV file)."""
    return id_and_bytes(docs).mapInArrow(_encode_batches, "doc_id long, n_bytes long, media binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media", 2 << 20):
        rows = []
        for media in batch.column("media").to_pylist():
            payload = from_wav(media)
            times, codes = fingerprint(np.frombuffer(payload, np.uint8))
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), times, codes))
        *cols, times, codes = zip(*rows)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        ends = np.concatenate(([0], np.cumsum([len(t) for t in times]))).astype(np.int32)
        pairs = [pa.ListArray.from_arrays(ends, np.concatenate(x)) for x in (times, codes)]
        names = [c.split()[0] for c in READ.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds)), *pairs], names)


def read(media: DataFrame) -> DataFrame:
    """The columns of READ, computed from the stored bytes."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read_batches, READ)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the whole documents table stored as WAV in a table of the shared folder, and what is read back from it, times and codes included."""
    got = read(materialize(encode(documents(spark, sf_dir)), "media"))
    text = F.concat_ws(":", F.size("times").cast("string"), F.hex(F.xxhash64("times", "codes")), F.array_join(F.slice(F.transform("codes", lambda c: c.cast("string")), 1, 4), "-"))
    return got.withColumn("feature", text)
