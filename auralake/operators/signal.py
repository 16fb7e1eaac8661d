"""Signal functions: windows, spectra, mel features and resampling, vectorised over arrays of samples."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.text import hz_to_mel, mel_to_hz

RATE = 16_000


def mel_filterbank(spark: SparkSession, n_freq: int = 201, n_mels: int = 128, rate: int = RATE) -> DataFrame:
    """(freq, mel, weight): triangles with their corners evenly spaced in mels, each of the same area."""
    top = hz_to_mel(F.lit(rate / 2))
    edge = lambda i: mel_to_hz(i.cast("double") * top / (n_mels + 1))
    mels = spark.range(n_mels).select(F.col("id").alias("mel"), edge(F.col("id")).alias("lo"), edge(F.col("id") + 1).alias("mid"), edge(F.col("id") + 2).alias("hi"))
    hz = F.col("freq") * (rate / 2 / (n_freq - 1))
    height = F.greatest(F.least((hz - F.col("lo")) / (F.col("mid") - F.col("lo")), (F.col("hi") - hz) / (F.col("hi") - F.col("mid"))), F.lit(0.0))
    cells = mels.withColumn("freq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_freq - 1).cast("long"))))
    return cells.select("freq", "mel", F.round(height * 2 / (F.col("hi") - F.col("lo")), 6).alias("weight"))


def hann(n: int, root: bool = False) -> np.ndarray:
    """The periodic Hann window, or its square root."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    return np.sqrt(w) if root else w


def reflect_pad(x: np.ndarray, pad: int) -> np.ndarray:
    """The samples with their reflections on both sides; what a short signal lacks repeats its end."""
    if not len(x):
        return np.zeros(2 * pad, x.dtype)
    at = np.abs(np.arange(-pad, len(x) + pad))
    at = np.where(at >= len(x), 2 * (len(x) - 1) - at, at)
    return x[np.clip(at, 0, len(x) - 1)]


def stft(x: np.ndarray, n: int = 512, hop: int = 256) -> np.ndarray:
    """Complex spectra (frames, n / 2 + 1), square-root Hann windows, centred."""
    y = reflect_pad(np.asarray(x, float), n // 2)
    frames = np.lib.stride_tricks.sliding_window_view(y, n)[::hop] if len(y) >= n else np.zeros((0, n))
    return np.fft.rfft(frames * hann(n, True), axis=1)


def istft(spec: np.ndarray, length: int, n: int = 512, hop: int = 256) -> np.ndarray:
    """Weighted overlap-add of spectra."""
    w = hann(n, True)
    out, norm = np.zeros(hop * max(len(spec) - 1, 0) + n), np.zeros(hop * max(len(spec) - 1, 0) + n)
    for i, f in enumerate(np.fft.irfft(spec, n, axis=1)):
        out[i * hop : i * hop + n] += f * w
        norm[i * hop : i * hop + n] += w * w
    out = np.where(norm > 1e-8, out / np.maximum(norm, 1e-8), out)[n // 2 :]
    return np.pad(out, (0, max(0, length - len(out))))[:length]


@lru_cache(4)
def mel_matrix(n_freq: int = 201, n_mels: int = 128, rate: int = RATE) -> np.ndarray:
    to_mel = lambda f: np.where(f >= 1000, 15 + np.log(np.maximum(f, 1) / 1000) / (np.log(6.4) / 27), f * 3 / 200)
    to_hz = lambda m: np.where(m >= 15, 1000 * np.exp((m - 15) * (np.log(6.4) / 27)), m * 200 / 3)
    edges = to_hz(np.linspace(0, float(to_mel(np.array(rate / 2))), n_mels + 2))
    hz = np.linspace(0, rate / 2, n_freq)[:, None]
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(np.minimum((hz - lo) / (mid - lo), (hi - hz) / (hi - mid)), 0) * 2 / (hi - lo)


def log_mel(x: np.ndarray, seconds: int = 30, n_mels: int = 128) -> np.ndarray:
    """Whisper-style features (n_mels, 100 * seconds): log10 power on the mel scale, at most 8 below its peak, scaled to about -1..1."""
    x = np.pad(np.asarray(x, float)[: RATE * seconds], (0, max(0, RATE * seconds - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, 200, mode="reflect"), 400)[::160][: 100 * seconds]
    power = np.abs(np.fft.rfft(frames * hann(400), axis=1)) ** 2
    mel = np.log10(np.maximum(power @ mel_matrix(201, n_mels), 1e-10)).T
    return ((np.maximum(mel, mel.max() - 8) + 4) / 4).astype(np.float32)


def fbank(x: np.ndarray, n_mels: int = 80, rate: int = RATE) -> np.ndarray:
    """Log mel energies by frames of 25 ms every 10 ms (pre-emphasis 0.97, Povey window, no dither), less their means."""
    x = np.asarray(x, float) * 32768
    size, hop, n = rate // 40, rate // 100, 512
    if len(x) < size:
        return np.zeros((0, n_mels))
    f = np.lib.stride_tricks.sliding_window_view(x, size)[::hop].copy()
    f -= f.mean(1, keepdims=True)
    f[:, 1:], f[:, 0] = f[:, 1:] - 0.97 * f[:, :-1], f[:, 0] * 0.03
    f *= (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))) ** 0.85
    power = np.abs(np.fft.rfft(f, n, axis=1)) ** 2
    to_mel = lambda h: 1127 * np.log(1 + h / 700)
    edges = np.linspace(to_mel(20), to_mel(rate / 2), n_mels + 2)
    at = to_mel(np.arange(n // 2 + 1) * rate / n)[:, None]
    bank = np.maximum(np.minimum((at - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - at) / (edges[2:] - edges[1:-1])), 0)
    out = np.log(np.maximum(power @ bank, np.finfo(np.float32).eps))
    return out - out.mean(0)


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Band-limited resampling by the spectrum, block by block for long signals; the same rate or no samples change nothing."""
    x = np.asarray(x, np.float32)
    if rate == to or not len(x):
        return x
    n = max(1, round(len(x) * to / rate))
    spec = np.fft.rfft(x)
    keep = min(len(spec), n // 2 + 1)
    out = np.zeros(n // 2 + 1, complex)
    out[:keep] = spec[:keep]
    return (np.fft.irfft(out, n) * (n / len(x))).astype(np.float32)


def downmix(x: np.ndarray, channels: int) -> np.ndarray:
    """The mean of each frame's channels; a last frame that isn't full is divided by all of them, too."""
    x = np.asarray(x, np.float32)
    x = np.pad(x, (0, -len(x) % channels))
    return x.reshape(-1, channels).sum(1) / channels


def _log_mel(samples):
    return samples.map(lambda s: log_mel(np.asarray(s)).ravel())


def _fbank(samples):
    return samples.map(lambda s: fbank(np.asarray(s)).ravel().astype(np.float32))


for _f in (_log_mel, _fbank):
    _f.__annotations__ = {"samples": pd.Series, "return": pd.Series}
log_mel_column = F.pandas_udf(_log_mel, ArrayType(FloatType()))
fbank_column = F.pandas_udf(_fbank, ArrayType(FloatType()))
