"""Media columns: payloads as WAV, short-time Fourier transforms and spectral-peak fingerprints.

Both steps are pandas UDFs on one column, so all other columns stay in Spark. A text is stored as
its UTF-8 bytes with bytes 0 appended up to a positive multiple of 64, one byte a sample (8-bit
unsigned, mono). Nulls: a null text is an empty one, 64 bytes 0. Results depend on the text alone,
so repeated rows agree. What a task returns goes out in parts of PART_BYTES of its input, or of one
longer text; long texts are transformed in runs of frames, so beside its text, its samples and its
peaks one needs no more memory than a short one. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 8000
BLOCK = 64
FRAME, HOP = 256, 128
#: Frames that are transformed at once; the fingerprint does not depend on it.
RUN = 2048
#: Of a batch of rows, so many bytes are worked on and returned at once.
PART_BYTES = 1 << 22
#: A peak is paired with those of so many frames that follow.
AHEAD = 3
READ = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("frames", T.IntegerType()),
                     T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("codes", T.ArrayType(T.IntegerType()))])


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def parts(s: pd.Series) -> Iterator[pd.Series]:
    """The texts or byte strings in parts of PART_BYTES at most, or of one that is longer."""
    first, held = 0, 0
    for i, x in enumerate(s):
        size = len(x) if x is not None else 0
        if i > first and held + size > PART_BYTES:
            yield s.iloc[first:i]
            first, held = i, 0
        held += size
    if len(s) > first:
        yield s.iloc[first:]


@F.pandas_udf(T.BinaryType())
def to_wav(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The WAV file that holds the text's padded bytes as samples."""

    def one(x: str | None) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(pad((x or "").encode()))
        return out.getvalue()

    for s in text:
        for part in parts(s):
            yield pd.Series([one(x) for x in part], dtype=object)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strongest bin of every frame of the short-time Fourier transform, and whether it stands out."""
    x = samples.astype(np.float32) - 128.0
    x = np.concatenate([x, np.zeros(FRAME - len(x) if len(x) < FRAME else (FRAME - len(x)) % HOP, np.float32)])  # the last frame whole
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    best, clear = [], []
    for i in range(0, len(frames), RUN):
        power = np.abs(np.fft.rfft(frames[i:i + RUN] * window, axis=1))[:, 2:]
        at = power.argmax(axis=1)
        best.append(at + 2)
        clear.append(power[np.arange(len(at)), at] > 2 * power.mean(axis=1))
    return np.concatenate(best), np.concatenate(clear)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): for each pair of peaks the frame of the first, and both bins with the distance."""
    best, clear = peaks(samples)
    times, codes = [], []
    for d in range(1, AHEAD + 1):
        at = np.flatnonzero(clear[:-d] & clear[d:]) if len(best) > d else np.empty(0, int)
        times.append(at)
        codes.append((best[at] * 129 + best[at + d]) * 4 + d)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


@F.pandas_udf(READ)
def from_wav(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What the stored bytes hold: the payload, the number of frames and the time-coded fingerprint."""
    def one(data: bytes) -> tuple:
        with wave.open(io.BytesIO(data), "rb") as w:
            payload = w.readframes(w.getnframes())
        return payload, max(1, -((FRAME - len(payload)) // HOP) + 1), *fingerprint(np.frombuffer(payload, np.uint8))

    for s in media:
        for part in parts(s):
            yield pd.DataFrame([one(x) for x in part], columns=["payload", "frames", "times", "codes"])
