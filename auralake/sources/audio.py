"""Audio files as rows: folders of media to mono samples at 16 kHz, with the error in a column where a file can't be read."""

from __future__ import annotations

import contextlib
import io
import os
import shutil
import subprocess
import tempfile
import threading
import wave

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_media
from ..operators.signal import RATE, downmix, resample

#: Samples of eight hours; longer files are errors.
MAX_SAMPLES = RATE * 60 * 60 * 8
SCHEMA = "path string, sample_rate int, duration_s double, samples array<float>, error_class string, error string"
_WIDTH = {1: ("u1", 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}


class AudioError(ValueError):
    pass


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and the rate of a PCM WAV file."""
    try:
        with wave.open(io.BytesIO(content)) as f:
            rate, channels, width, n = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.getnframes()
            if n > MAX_SAMPLES:
                raise AudioError(f"longer than {MAX_SAMPLES} samples")
            raw = f.readframes(n)
    except (wave.Error, EOFError) as e:
        raise AudioError(f"not a PCM WAV file: {e}") from e
    if channels < 1 or rate < 1:
        raise AudioError("no channels or no rate")
    raw = raw[: len(raw) // (width * channels) * width * channels]  # a file cut off ends with its last whole frame
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608.0
    elif width in _WIDTH:
        kind, zero, scale = _WIDTH[width]
        x = (np.frombuffer(raw, kind).astype(np.float64) - zero) / scale
    else:
        raise AudioError(f"{8 * width} bits a sample")
    return downmix(x.astype(np.float32), channels), rate


def find_ffmpeg(env: dict[str, str] | None = None) -> str | None:
    """The decoder that FFMPEG names, if that is a file, else the first in an absolute entry of PATH."""
    env = dict(os.environ) if env is None else env
    if (named := env.get("FFMPEG")) and os.path.isfile(named):
        return named
    entries = [p for p in env.get("PATH", "").split(os.pathsep) if os.path.isabs(p)]
    return shutil.which("ffmpeg", path=os.pathsep.join(entries)) if entries else None


def decode_ffmpeg(content: bytes, rate: int = RATE, most: int = MAX_SAMPLES) -> np.ndarray:
    """Mono samples from the decoder's output, which is read block by block and no further than ``most`` samples."""
    if not (program := find_ffmpeg()):
        raise AudioError("no decoder for this format")
    command = [program, "-v", "error", "-i", "pipe:0", "-vn", "-ac", "1", "-ar", str(rate), "-f", "f32le", "pipe:1"]
    with tempfile.TemporaryFile() as said, subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=said) as run:
        feed = threading.Thread(target=_feed, args=(run.stdin, content), daemon=True)
        feed.start()
        blocks, size = [], 0
        while block := run.stdout.read(1 << 20):
            blocks.append(block)
            size += len(block)
            if size > 4 * most:
                run.kill()
                raise AudioError(f"longer than {most} samples")
        if run.wait():
            said.seek(0)
            raise AudioError(said.read().decode("utf-8", "replace")[-300:])
    return np.frombuffer(b"".join(blocks)[: size // 4 * 4], "<f4")


def _feed(pipe, content: bytes) -> None:
    with contextlib.suppress(OSError), pipe:  # the decoder may end before it has read all
        pipe.write(content)


def decode(content: bytes, rate: int = RATE) -> np.ndarray:
    """Mono samples at the rate: WAV by itself, all else (and what fails) by ffmpeg where there is one."""
    try:
        x, own = decode_wav(content)
        x = resample(x, own, rate)
    except AudioError as e:
        try:
            x = decode_ffmpeg(content, rate)
        except AudioError as other:
            raise AudioError(f"{e}; {other}") from other
    if not len(x):
        raise AudioError("no samples")
    return x


def read_audio(spark: SparkSession, folder: str, rate: int = RATE) -> DataFrame:
    """The media files right in a folder, a row each; a broken file has an error and no samples, and fails nothing."""
    files = spark.read.format("binaryFile").load(folder).where(is_media(F.col("path"))).select("path", "content")
    return decode_rows(files, rate)


def decode_rows(files: DataFrame, rate: int = RATE) -> DataFrame:
    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content, strict=True):
                try:
                    x = decode(bytes(content), rate)
                    rows.append((path, rate, len(x) / rate, x.astype(np.float32), None, None))
                except ValueError as e:  # AudioError among them
                    rows.append((path, None, None, None, "Audio", str(e)))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "duration_s", "samples", "error_class", "error"])

    return files.mapInPandas(run, SCHEMA)
